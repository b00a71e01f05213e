"""The conversation trie against one built turn by turn."""

import hashlib
import random
from zlib import crc32

import pytest

from shelfmark.llm import queries, turntrie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string, depth string, `a.b` int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows, rule=True):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, digest(role or "", text or ""),
                                          (role or "", text or "")))
    own = {c: [r[-1] for r in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + v[h:] if rule else v
    nodes = {}
    for c, v in sorted(paths.items()):
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = {}
    for key in sorted(nodes, key=len, reverse=True):
        m = nodes[key]
        kids = out.setdefault(key, [0, 0, 0])
        leaves, below = max(kids[1], 0 if kids[0] else 1), kids[2]
        saved = below + ((len(m) - 1) * len(key[-1][1].encode()) if key else 0)
        out[key] = [kids[0], leaves, saved]
        if key:
            up = out.setdefault(key[:-1], [0, 0, 0])
            up[0] += 1
            up[1] += leaves
            up[2] += saved
    return sorted((min(m), len(key), min(nodes[key[:-1]]) if key else None, len(m), *out[key],
                   hashlib.sha256(",".join(str(c) for c in sorted(m)
                                           if len(paths[c]) == len(key)).encode()).hexdigest())
                  for key, m in nodes.items())


def check(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))
    assert got == want


def make_rows(seed, convs=60):
    rng = random.Random(seed)
    stock = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "日本 z"]))
             for _ in range(4)]
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        n = rng.choice([1, 1, 2, 3, 5, 12])
        rows += [(c, rng.choice([None, t, t, t, t]), *rng.choice(stock)) for t in range(n)]
    rows += rows[:7] + [(None, 1, "user", "x"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("container,stratum", [(1 << 12, 1024), (8, 1024), (8, 3), (1 << 12, 2)])
def test_trie_against_brute_force(spark, monkeypatch, container, stratum):
    monkeypatch.setattr(turntrie, "CONTAINER", container)
    monkeypatch.setattr(turntrie, "STRATUM", stratum)
    rows = make_rows(container + stratum, 120 if stratum > 3 else 30)
    df = conversations(spark, rows)
    check(turntrie.prefix_trie(turntrie.rebuilt(df)), brute(rows))
    if stratum != 2:
        check(turntrie.prefix_trie(turntrie.conversations(df)), brute(rows, False))


def test_trie_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    check(queries.op11_burst_trie(spark, sf), brute(rows))


def test_trie_of_copies_and_of_one_long_conversation(spark, monkeypatch):
    """A third of all conversations are equal, another third one conversation's rows."""
    monkeypatch.setattr(turntrie, "CONTAINER", 64)
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(5)]
    rows += [(5000, t, "user", f"long {t}") for t in range(1500)]
    rows += [(5001, t, "user", f"long {t}") for t in range(1400)]
    rows += [(6000 + c, t, "user", f"{c} {t}") for c in range(100) for t in range(5)]
    check(turntrie.prefix_trie(turntrie.rebuilt(conversations(spark, rows))), brute(rows))


def test_trie_of_nothing(spark):
    assert queries.turntrie.prefix_trie(turntrie.rebuilt(conversations(spark, []))).count() == 0
    only = conversations(spark, [(None, 1, "a", "b")])
    assert turntrie.prefix_trie(turntrie.rebuilt(only)).count() == 0
    # Conversation 7 keeps nothing of its own and has no conversation 5 to begin with.
    short = [(c, 0, None, None) for c in range(1, 5)]
    check(turntrie.prefix_trie(turntrie.rebuilt(conversations(spark, short))), brute(short))
