import random

from pyspark.sql import functions as F

from shelfmark.operators.ordered import (
    first_per_key, number_rows, number_sorted, previous_row, running_max, running_sum,
)


def rows_of(spark):
    pick = random.Random(5)
    rows = [(f"k{i % 3 if i % 2 else 0}", order, pick.randint(0, 50))
            for i, order in enumerate(pick.sample(range(1000), 200))]
    return rows, spark.createDataFrame(rows, "k STRING, o BIGINT, v BIGINT")


def test_ordered_operators_cross_range_borders(spark):
    rows, df = rows_of(spark)
    got = previous_row(df, ["k"], "o", ["v"], width=16)
    got = number_rows(got, ["k"], "o", width=16)
    got = number_rows(got, ["k"], "o", "evens", width=16, where=F.col("v") % 2 == 0)
    got = running_sum(got, ["k"], "o", F.col("v"), "total", width=16)
    got = running_max(got, ["k"], "o", "v", "top", width=16)
    got = {(r["k"], r["o"]): r for r in got.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == key)
        for i, (_, order, value) in enumerate(mine):
            row = got[key, order]
            before = [v for _, _, v in mine[:i]]
            assert (row["previous"]["v"] if row["previous"] else None) == (
                before[-1] if before else None)
            assert row["row_no"] == i + 1
            assert row["evens"] == sum(v % 2 == 0 for v in before + [value])
            assert row["total"] == sum(before) + value
            assert row["top"] == (max(before) if before else None)


def test_positions_by_any_order(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40))
        .alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    got = {}
    for r in number_sorted(rows.repartition(7), ["k"], [F.reverse("s")], "at").collect():
        got.setdefault(r["k"], []).append((r["at"], r["s"]))
    for places in got.values():
        places.sort()
        assert [at for at, _ in places] == list(range(1, len(places) + 1))
        assert [s for _, s in places] == sorted((s for _, s in places), key=lambda s: s[::-1])


def test_first_per_key(spark):
    rows, df = rows_of(spark)
    firsts = {r["k"]: r["o"] for r in first_per_key(df, ["k"], F.col("o")).collect()}
    assert firsts == {k: min(o for key, o, _ in rows if key == k) for k in firsts}
