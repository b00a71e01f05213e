"""Classifier, mixing, outliers, search, shards and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import mixing, outliers, queries, rules, sharding, vafile
from tests.llm import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_classifier_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_rule_ensemble(spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    ranks = held.score.rank()
    good, bad = (held.quality == 1).sum(), (held.quality == 0).sum()
    area = (ranks[held.quality == 1].sum() - good * (good + 1) / 2) / (good * bad)
    assert area > 0.97
    assert ((held.predicted == held.quality).mean()) > 0.95
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("known", [[], [(7, 1, 0)], [(None, 1, 0), (7, None, 0), (14, 5, 0)]])
def test_classifier_without_two_classes(spark, known):
    got = rules.classify(fx.documents(spark), labels(spark, known)).collect()
    assert len(got) == len(fx.make_rows()) and len({r.score for r in got}) == 1


def test_compiled_score_equals_the_model(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, len(rules.FEATURES)))
    y = ((x[:, 0] > 0.4) & (x[:, 3] <= 0.7)).astype(int)
    model = rules.fit(x, y)
    margin = np.full(400, model.base)
    for weight, f, low, high in model.linear:
        margin += weight * np.clip(x[:, f], low, high)
    for weight, rule in model.parts:
        margin += weight * rules.holds(x, rule)
    df = spark.createDataFrame(x.tolist(), [f for f in rules.FEATURES])
    got = [r[0] for r in df.select(model.score({f: F.col(f) for f in rules.FEATURES})).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))
    assert ((margin > 0) == y).mean() > 0.95 and len(model.parts) < 200


def test_accepted_follows_classify(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in rules.accepted(docs, known).select("doc_id").collect()}
    want = {r.doc_id for r in rules.classify(docs, known).filter("predicted = 1").collect()}
    assert kept == want
    assert rules.accepted(fx.documents(spark, []), known).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[n % 3] for n, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        rate = left / sum(w[s] for s in open_)
        full = {s for s in open_ if rate * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: rate * w[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark):
    rows = fx.make_rows()
    got = mixing.mix(fx.documents(spark, rows)).drop("_row").collect()
    sizes, longest = Counter(), Counter()
    for r in rows:
        n = len(fx.words(r[1]))
        sizes[r[3]] += n
        longest[r[3]] = max(longest[r[3]], n)
    target = brute_targets(sizes)
    taken = Counter()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted(
        (str(r[0]), len(fx.words(r[1]))) for r in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(
            r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * longest[s] + 1
    assert sum(taken.values()) <= round(1.5 * sum(sizes.values()))
    again = mixing.mix(fx.documents(spark, rows).repartition(5)).drop("_row").collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_mix_of_one_row_many_times(spark):
    """A hundred equal rows of a source are sent one by one, beside sixty others."""
    one = (7, "w " * 1000, "en", "a", 0, *[None] * 5)
    rows = [one] * 100 + [(100 + n, "v " * 1000, "en", "b", 0, *[None] * 5) for n in range(60)]
    taken, target = Counter(), {}
    for r in mixing.mix(fx.documents(spark, rows)).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 2000 for s in "ab")
    mixed = mixing.mixed(fx.documents(spark, rows)).groupBy("source").count().collect()
    assert {r["source"]: 1000 * r["count"] for r in mixed} == dict(taken)


def test_mix_of_nothing(spark):
    assert mixing.mix(fx.documents(spark, [])).count() == 0
    none = [(1, None, None, None, None, *[None] * 5), (1, "", None, "a", None, *[None] * 5)]
    assert [r.taken for r in mixing.mix(fx.documents(spark, none)).collect()] == [0, 0]


def test_mixed_documents(spark):
    docs = fx.documents(spark)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[(r.doc_id, r.source)] += r.taken
    got = Counter()
    for r in mixed.collect():
        got[(r.doc_id, r.source)] += len(fx.words(r.text))
    assert +got == +want


def brute_stats(text):
    w = fx.words(text)
    three = Counter(zip(w, w[1:], w[2:]))
    again = set()
    for i in range(len(w) - 2):
        if three[tuple(w[i:i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if fx.words(x)]
    return (len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")),
            len(lines) - len(set(lines)), len(again))


def test_outliers_base(spark):
    rows = fx.make_rows()
    got = outliers.judge(fx.documents(spark, rows)).collect()
    stats = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
              r.base_failed) for r in got]
    want = []
    for r in rows:
        s = brute_stats(r[1])
        want.append((r[0], *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert sorted(map(str, stats)) == sorted(map(str, want))
    assert not any(r.kept and r.base_failed for r in got)
    assert outliers.judge(fx.documents(spark, [])).count() == 0


def test_outliers_reject_junk_and_keep_clean(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_mcd_outliers(spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.05


def test_outliers_of_small_groups_far_off(spark):
    """Every row is judged, also where a group has no document near the centre of all."""
    rng = np.random.default_rng(4)

    def row(i, lang, length):
        text = " ".join("".join(rng.choice(list("abcdefghij"), length)) for _ in range(80))
        return (i, text, lang, "s", len(text), *[None] * 5)

    rows = [row(i, "en", 5) for i in range(200)]
    for size in range(1, 6):
        rows += [row(1000 * size + far * 10 + i, f"g{size}-{far}", 5 + far)
                 for far in (2, 5, 20) for i in range(size)]
    got = outliers.judge(fx.documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert all(r.d2 is not None and not r.base_failed for r in got)
    assert all(r.kept for r in got if r.doc_id < 1000)
    assert all(r.kept == (r.d2 <= outliers.KEEP) for r in got)


def test_outliers_run_no_python(spark):
    plan = queries.op7_mcd_outliers(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_top(vectors, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i is None or i % every:
            continue
        hits = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0)
                      for m, (j, c) in enumerate(good) if m != n and len(c) == len(q))
        out += [(i, place + 1, None if h[1] else h[2], -h[0])
                for place, h in enumerate(hits[:k])]
    return out


@pytest.mark.parametrize("scale", [1.0, 1.0e6])
def test_top_k(spark, monkeypatch, scale):
    """Repeated rows, equal ids with other vectors, and vectors that take no part included."""
    monkeypatch.setattr(vafile, "BLOCK", 16)
    rng = np.random.default_rng(8)
    vectors = [(n, [float(x) * scale for x in rng.normal(size=4).astype(np.float32)])
               for n in range(120)]
    vectors += [(200 + n, vectors[3][1]) for n in range(6)] + [vectors[10], vectors[11]]
    vectors += [(10, vectors[4][1]), vectors[20], vectors[20], vectors[20]]
    vectors += [(300, None), (350, [1.0, None, 0.0, 0.0]), (400, [float("nan"), 0.0, 0.0, 0.0]),
                (450, [float("inf"), 0.0, 0.0, 0.0]), (500, [1.0, 2.0]), (501, [0.5, 0.5]),
                (None, [5.0, 5.0, 5.0, 5.0]), (None, [5.0, 5.0, 5.0, 5.0]), (550, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn(
        "score", F.lit("x"))
    got = vafile.top_k(df, F.col("vec_id") % 10 == 0, 5).collect()
    want = brute_top(vectors, 5, 10)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_top_k_of_one_vector_many_times(spark):
    """A third of all rows is one vector: only the few that can rank leave its group."""
    rng = np.random.default_rng(9)
    vectors = [(n, rng.normal(size=8).tolist()) for n in range(400)]
    vectors += [(1000 + n, vectors[0][1]) for n in range(200)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = df.withColumns({"_query": F.col("vec_id") % 50 == 0, "_dim": F.size("embedding"),
                           "_row": F.monotonically_increasing_id()})
    queries = sum(1 for i, _ in vectors if i % 50 == 0)
    assert vafile.open_pairs(rows, 5).count() < queries * 40
    got = vafile.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute_top(vectors, 5, 50)))


def test_bounds_hold_the_product():
    rng = np.random.default_rng(3)
    for scale in (1e-3, 1.0, 1e9, 1e160, 1e300):
        rows = vafile.whole(rng.normal(size=(300, 12)) * scale)
        queries = vafile.whole(rng.normal(size=(20, 12)) * scale)
        low, width, cells = vafile.approximate(rows)
        lower, upper = vafile.bounds(queries, low, width, cells)
        for n, q in enumerate(queries):
            for m, r in enumerate(rows):
                exact = sum(int(a) * int(b) for a, b in zip(q, r))
                # Python compares its floats and integers exactly.
                assert lower[n, m].item() <= exact <= upper[n, m].item()


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.top_k(df, F.col("vec_id") % 10 == 0, 5).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert vafile.top_k(one, F.col("vec_id") % 10 == 0, 5).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, shards):
    rows = fx.make_rows()
    got = sharding.kd_shards(fx.documents(spark, rows), shards).collect()
    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))
            for r in rows]
    assert sorted(map(str, [(r.doc_id, r.size, r.text_crc32) for r in got])) == sorted(
        map(str, want))
    home = {}
    load, slots = Counter(), {}
    for r in got:
        assert home.setdefault((r.text_crc32, r.size), r.shard) == r.shard
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(load) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for r in want:
        groups[r[1:]] += r[1]
    assert max(load.values()) - min(load.values()) <= 2 * max(groups.values())


def test_shards_of_nothing(spark):
    assert sharding.kd_shards(fx.documents(spark, []), 8).count() == 0
    same = [(1, None, None, None, None, *[None] * 5)] * 5
    got = sharding.kd_shards(fx.documents(spark, same), target_bytes=2).collect()
    assert sorted(r.slot for r in got) == [0, 1, 2, 3, 4] and len({r.shard for r in got}) == 1


def test_pipeline_stages(spark):
    """Every stage against a brute-force version on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    known = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = (before.collect(), docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = kept["quality_classifier"]
    bad = {r.doc_id for r in known.filter("quality = 0").collect()}
    good = {r.doc_id for r in known.filter("quality = 1").collect()}
    ids = {r.doc_id for r in after}
    assert len(good & ids) >= 0.95 * len(good) and len(bad & ids) <= 0.2 * len(bad) + 1
    before, after = kept["near_dedup"]
    roots = fx.near_groups([r.text for r in before])
    least = {}
    for r, root in zip(before, roots):
        if root:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert {r.doc_id for r in after} == set(least.values()) | {
        r.doc_id for r, root in zip(before, roots) if not root}
    before, after = kept["suffix_array_dedup"]
    bodies = [r.text.encode() for r in before]
    want = {r.doc_id: bytes(b for b, g in zip(body, gone) if not g).decode("utf-8", "ignore")
            for r, body, gone in zip(before, bodies, fx.removed(bodies, 400))}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = kept["source_mix"]
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(fx.words(r.text))
    target = brute_targets(sizes)
    taken = Counter()
    for r in after:
        taken[r.source] += len(fx.words(r.text))
    longest = max(len(fx.words(r.text)) for r in before)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in sizes)
    before, after = kept["bpe_encode"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
