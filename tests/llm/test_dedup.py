import hashlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import graph, neardup, substring, suffixes
from tests.llm import fixtures as fx


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_bytes(rows, width=400):
    bodies = [(r[1] or "").encode() for r in rows]
    out = []
    for r, body, gone in zip(rows, bodies, fx.removed(bodies, width)):
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((r[0], len(body), sum(gone), spans,
                    sha(bytes(b for b, g in zip(body, gone) if not g))))
    return out


def short(rows):
    """Without the very long text, for which brute force is slow."""
    return [r for r in rows if len(r[1] or "") < 50_000]


def by_text(rows):
    return sorted(rows, key=str)


def test_bytes_against_brute_force(spark):
    rows = short(fx.make_rows())
    got = suffixes.remove_repeats(fx.documents(spark, rows)).collect()
    assert by_text(tuple(r) for r in got) == by_text(brute_bytes(rows))


@pytest.mark.parametrize("pattern", ["ab", "abcabd", "x" * 37 + "y"])
def test_bytes_of_periodic_texts(spark, pattern):
    texts = [pattern * n for n in (30, 90, 200, 401)] + [(pattern * 300)[3:] + "tail", "z" * 400]
    rows = [(i, t, None, None, 0, *[None] * 5) for i, t in enumerate(texts)]
    got = suffixes.remove_repeats(fx.documents(spark, rows)).collect()
    assert by_text(tuple(r) for r in got) == by_text(brute_bytes(rows))


@pytest.mark.parametrize("edit", [1, 37, 190, 211, 399, 400, 401, 600])
def test_bytes_at_edges_of_a_shared_passage(spark, edit):
    """Passages of all lengths around the limit, with other text before and after."""
    import random
    rng = random.Random(edit)

    def noise(n):
        return "".join(rng.choice("abcdefghij ") for _ in range(n))

    shared = noise(1500)
    rows = [(i, noise(rng.randint(0, 300)) + shared[a:a + n] + noise(rng.randint(0, 300)),
             None, None, 0, *[None] * 5)
            for i, (a, n) in enumerate([(0, 399 + edit % 3), (0, 1500), (edit, 400), (edit, 700),
                                        (edit + 1, 399), (200, 800), (1100, 400)])]
    got = suffixes.remove_repeats(fx.documents(spark, rows)).collect()
    assert by_text(tuple(r) for r in got) == by_text(brute_bytes(rows))


def test_bytes_of_pieces_of_a_text_with_copies(spark):
    """Pieces that begin and end in any stretch, also one whose neighbour has its prefix."""
    import random
    rng = random.Random(8)

    def noise(n):
        return "".join(rng.choice("abcdefghij ") for _ in range(n))

    whole = noise(120_000)[106_000:111_000]  # starts 2980 and 2981 follow the same prefix
    pieces = "".join(whole[a:a + 415] + noise(30) for a in range(0, len(whole), 16))
    rows = [(i, t, None, None, 0, *[None] * 5) for i, t in enumerate([whole, whole, pieces])]
    got = suffixes.remove_repeats(fx.documents(spark, rows)).collect()
    assert by_text(tuple(r) for r in got) == by_text(brute_bytes(rows))


def test_copies_of_a_passage_are_named_once(spark, monkeypatch):
    """The rows that are joined with the names do not grow with the places of a passage."""
    import random
    rng = random.Random(11)
    named = []
    materialise = suffixes.materialise

    def counted(df, name):
        table = materialise(df, name)
        if name == "suffixes":
            named.append(table.count())
        return table

    def noise(n):
        return "".join(rng.choice("abcdefghij ") for _ in range(n))

    monkeypatch.setattr(suffixes, "materialise", counted)
    shared = noise(3000)
    rows = [(i, noise(rng.randint(0, 300)) + shared + noise(rng.randint(0, 300)),
             None, None, 0, *[None] * 5) for i in range(160)]
    for size in (40, 160):
        got = suffixes.remove_repeats(fx.documents(spark, rows[:size])).collect()
        assert by_text(tuple(r) for r in got) == by_text(brute_bytes(rows[:size]))
    assert 0 < named[1] < 2 * named[0]


def test_kept_texts_carry_all_columns(spark):
    rows = short(fx.make_rows())
    docs = fx.documents(spark, rows)
    kept = suffixes.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    want = []
    bodies = [(r[1] or "").encode() for r in rows]
    for r, body, gone in zip(rows, bodies, fx.removed(bodies, 400)):
        text = bytes(b for b, g in zip(body, gone) if not g).decode("utf-8", "ignore")
        want.append((r[0], text, *r[2:]))
    assert by_text(tuple(r) for r in kept.collect()) == by_text(want)


def brute_words(rows, width=35):
    split = [tuple(w.encode() for w in fx.words(r[1])) for r in rows]
    return [(r[0], len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
            for r, w, gone in zip(rows, split, fx.removed(split, width))]


@pytest.mark.parametrize("bucket", [2048, 1])
def test_words_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(substring, "BUCKET", bucket)
    rows = fx.make_rows()
    got = substring.remove_repeats(fx.documents(spark, rows)).collect()
    assert by_text(tuple(r) for r in got) == by_text(brute_words(rows))


def test_words_as_texts(spark):
    rows = [(1, "a  b\nc", *[None] * 8), (2, None, *[None] * 8)]
    got = substring.remove_repeats(fx.documents(spark, rows), texts=True).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, 0, "a b c"), (2, 0, 0, "")]


@pytest.mark.parametrize("find", [suffixes.remove_repeats, substring.remove_repeats,
                                  neardup.near_duplicates, suffixes.without_repeats,
                                  neardup.one_of_each])
def test_empty_tables(spark, find):
    assert find(fx.documents(spark, [])).count() == 0
    nothing = [(None, None, *[None] * 8), (4, "", *[None] * 8)]
    assert find(fx.documents(spark, nothing)).count() == 2


def test_near_duplicates_against_brute_force(spark):
    rows = short(fx.make_rows())
    roots = fx.near_groups([r[1] for r in rows])
    least = {}
    for r, root in zip(rows, roots):
        if root is not None and r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = [(r[0], len(fx.shingles(r[1])), least.get(root) if root else r[0],
             r[0] == (least.get(root) if root else r[0])) for r, root in zip(rows, roots)]
    got = neardup.near_duplicates(fx.documents(spark, rows)).select(
        "doc_id", "n_shingles", "component_id", "kept").collect()
    assert by_text(tuple(r) for r in got) == by_text(want)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Groups larger than a block, with few links to any one member."""
    import random
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), *[None] * 8))
    roots = fx.near_groups([r[1] for r in rows])
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min(least.get(root, r[0]), r[0])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(
        fx.documents(spark, rows)).collect()}
    assert got == {r[0]: least[root] for r, root in zip(rows, roots)}


def test_one_of_each_group(spark):
    rows = short(fx.make_rows())
    docs = fx.documents(spark, rows)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    roots = fx.near_groups([r[1] for r in kept.collect()])
    worded = [r for r in roots if r is not None]
    all_roots = fx.near_groups([r[1] for r in rows])
    assert len(worded) == len(set(worded)) == len({r for r in all_roots if r is not None})
    assert roots.count(None) == all_roots.count(None)


def test_sketch_estimates_follow_similarity():
    import numpy as np
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        n = 1000
        both = int(2 * n * share / (1 + share))
        a, b = pool[:n], np.concatenate([pool[:both], pool[n:2 * n - both]])
        got = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None],
                               np.array([n]), np.array([n]))[0]
        assert abs(got - share) < 0.17


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 120)] + [(7, 7), (200, 150)]
    got = {r.node: r.component for r in graph.components(
        spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 120)},
                   150: 150, 200: 150}
    none = graph.components(spark.createDataFrame([], "a long, b long"), "t")
    assert none.select(F.count("*")).first()[0] == 0


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_that_agree_modulo_powers_of_two(spark):
    """Two documents that differ in one long Thue-Morse word share no window around it, and two
    such words are two texts."""
    one, two = thue_morse(2048, "ab"), thue_morse(2048, "ba")
    rest = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rest[:20] + [word] + rest[20:]), None, None, 0, *[None] * 5)
            for i, word in enumerate((one, two))]
    got = substring.remove_repeats(fx.documents(spark, rows)).collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(41, 0), (41, 0)]
    rows = [(1, one, None, None, 0, *[None] * 5), (2, two, None, None, 0, *[None] * 5)]
    got = neardup.near_duplicates(fx.documents(spark, rows)).collect()
    assert sorted(r.component_id for r in got) == [1, 2]
    rows = [(i, t, None, None, 0, *[None] * 5) for i, t in enumerate(
        (thue_morse(1024, "ab"), thue_morse(1024, "ba")))]
    got = suffixes.remove_repeats(fx.documents(spark, rows)).collect()
    assert by_text(tuple(r) for r in got) == by_text(brute_bytes(rows))
