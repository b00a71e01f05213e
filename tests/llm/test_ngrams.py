"""The n-gram Jaccard join and periodic runs against brute force."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from shelfmark.llm import jaccardtree, periods, queries
from tests.llm import fixtures as fx

AWKWARD = [(11, None), (12, ""), (13, " \n\t "), (None, "no id " * 9), (None, None)]


def rows_of(texts):
    return [(i, t, None, None, 0, *["x"] * 4, 1) for i, t in texts]


def brute_sets(text):
    w = fx.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute_groups(rows):
    """(doc_id, set size, smallest id reachable) of every row."""
    sets = [brute_sets(r[1]) for r in rows]
    distinct = list({s for s in sets if s})
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for n, a in enumerate(distinct):
        for b in distinct[:n]:
            if 100 * len(a & b) >= 90 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for r, s in zip(rows, sets):
        if s and r[0] is not None:
            k = find(s)
            least[k] = min(least.get(k, r[0]), r[0])
    return [(r[0], len(s), least.get(find(s)) if s else r[0]) for r, s in zip(rows, sets)]


def check_groups(spark, rows):
    got = [tuple(r) for r in jaccardtree.jaccard_groups(fx.documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_groups(rows), key=str)


def edited(words, n, rng, mark):
    words = list(words)
    for k in range(n):
        words[rng.randrange(len(words))] = f"{mark}{k}"
    return " ".join(words)


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    rows = fx.make_rows()
    stock = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(12):  # around the threshold: up to five edits of 20 to 200 words
        base = [rng.choice(stock) for _ in range(rng.choice([9, 10, 11, 12, 20, 60, 200]))]
        texts += [edited(base, rng.randint(0, 5), rng, f"e{k}-{j}-") for j in range(6)]
    texts += ["One two THREE four", "one two three four", "one", "ONE", "one two", "One Two"]
    check_groups(spark, rows + rows_of([(2000 + k, t) for k, t in enumerate(texts)] + AWKWARD))


@pytest.mark.parametrize("block", [4, 512])
def test_groups_of_shards_with_several_components(spark, monkeypatch, block):
    """Families that share a passage, one large family, many copies of one row, outsiders."""
    monkeypatch.setattr(jaccardtree, "BLOCK", block)
    rng = random.Random(block)
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for family in range(6):
        base = passage + [f"f{family}-{k}" for k in range(rng.randint(5, 30))]
        texts += [edited(base, rng.randint(0, 3), rng, f"x{family}-{j}-") for j in range(14)]
    texts += [" ".join(passage), " ".join(passage[:39]), " ".join(passage[1:])]
    texts += [" ".join(passage)] * 60
    rows = rows_of(list(enumerate(texts)))
    check_groups(spark, rows + [rows[0]] * 40)


def test_words_that_agree_modulo_powers_of_two(spark):
    """Thue-Morse words collide in every polynomial hash modulo 2^64."""
    one = two = ""
    for k in range(2048):
        bit = bin(k).count("1") % 2
        one += "ab"[bit]
        two += "ba"[bit]
    rows = rows_of([(1, one), (2, two), (3, f"x {one} y"), (4, f"x {two} y")])
    check_groups(spark, rows)


def test_classes_that_met_do_not_meet_again(spark):
    members = spark.range(20_000).selectExpr("7L shard", "id cid", "0L comp", "0L met").union(
        spark.sql("SELECT 7L, 50000L, 50000L, 1L"))
    dealt = jaccardtree.meeting_blocks(members)
    # Each of them goes to its one meeting with the outsider's block.
    assert dealt.filter("comp = 0").count() == 20_000
    pairs = dealt.select("c1", "b1", "c2", "b2").distinct().count()
    assert dealt.filter("comp <> 0").count() == pairs
    assert dealt.groupBy("c1", "b1", "c2", "b2").count().selectExpr("max(count)").first()[0] < 800


def test_tree_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(60):
        pool = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
        base = [rng.choice(pool, rng.integers(10, 60), replace=False) for _ in range(3)]
        sets = {}
        for _ in range(25):
            s = set(base[rng.integers(3)].tolist())
            for x in rng.choice(pool, rng.integers(0, 6)):
                s ^= {int(x)}
            sets[frozenset(s)] = 1
        sets = [s for s in sets if s]
        comp = rng.integers(0, len(sets), len(sets)).tolist()

        def groups(links):
            root = {c: c for c in comp}

            def find(c):
                while root[c] != c:
                    c = root[c]
                return c

            for a, b in links:
                root[find(comp[a])] = find(comp[b])
            return [find(c) for c in comp]

        want = [(a, b) for a in range(len(sets)) for b in range(a)
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
        got = jaccardtree.tree_links(list(range(len(sets))), comp,
                                     [np.array(sorted(s), np.uint64) for s in sets])
        assert set(got) <= {p for a, b in want for p in ((a, b), (b, a))}
        same = {}
        for a, b in zip(groups(want), groups(got)):
            assert same.setdefault(a, b) == b
        assert len(set(same.values())) == len(same)


def test_groups_of_nothing(spark):
    assert jaccardtree.jaccard_groups(fx.documents(spark, [])).count() == 0
    check_groups(spark, rows_of(AWKWARD))


def brute_runs(doc_id, text, periodic):
    w = fx.words(text)
    n = len(w)
    h = crc32(("" if doc_id is None else str(doc_id)).encode())
    if periodic and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = []
    for p in range(1, n // 4 + 1):
        k = 0
        while k + p < n:
            start = k
            while k + p < n and w[k] == w[k + p]:
                k += 1
            length = k - start + p
            if k > start and length >= max(6, 4 * p):
                part = w[start:start + length]
                if all(part[q:] != part[:-q] for q in range(1, p)):
                    runs.append((start, length, p))
            k += k == start
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode())
            .hexdigest())


def check_runs(spark, rows, periodic):
    got = [tuple(r) for r in periods.find_runs(fx.documents(spark, rows), periodic=periodic)
           .collect()]
    want = [brute_runs(r[0], r[1], periodic) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("periodic", [False, True])
def test_runs_against_brute_force(spark, periodic):
    rng = random.Random(7)
    texts = []
    for _ in range(300):
        names = rng.choice([1, 2, 3, 10, 100])
        parts = []
        for _ in range(rng.randint(0, 6)):
            unit = [f"w{rng.randrange(names)}" for _ in range(rng.randint(1, 8))]
            parts += unit * rng.choice([1, 1, 2, 4, 5, 9])
        texts.append(rng.choice([" ", "  \n"]).join(parts))
    rows = rows_of(list(enumerate(texts)) + AWKWARD)
    awkward = [r for r in fx.make_rows() if len(r[1] or "") < 50_000]
    check_runs(spark, rows + rows[:50] + awkward, periodic)


def test_runs_of_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op13_lcp_kruskal_runs(spark, sf).collect()]
    assert sorted(got) == sorted(brute_runs(*r, True) for r in rows)


def test_runs_of_very_long_texts(spark):
    unit = [f"w{k}" for k in range(1000)]
    rows = rows_of([(1, "a " * 200_000), (2, "a b " * 100_000), (3, " ".join(unit * 60)),
                    (4, " ".join(f"v{k}" for k in range(100_000)))])
    got = {r.doc_id: r for r in periods.find_runs(fx.documents(spark, rows)).collect()}
    assert [tuple(got[i])[1:6] for i in (1, 2, 3, 4)] == [
        (1, 0, 200_000, 1, 200_000_000), (1, 0, 200_000, 2, 100_000_000),
        (1, 0, 60_000, 1000, 60_000), (0, None, None, None, None)]
    kept = " ".join(unit).encode()
    assert got[3].collapsed_sha256 == hashlib.sha256(kept).hexdigest()


def test_runs_of_nothing(spark):
    assert periods.find_runs(fx.documents(spark, [])).count() == 0
