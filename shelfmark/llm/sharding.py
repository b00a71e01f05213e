"""Shards of near equal bytes by k-d tree partitioning.

Documents with equal text form one group, which stays together. Starting with all groups, a node
is split at the weighted median along the metadata dimension that is widest in it, until every
leaf holds its share of the bytes. Dimensions: text size (logarithm), source and language (place
among all values, by code point). A hash of the text orders groups that a dimension does not tell apart, so a source
that holds most rows can still be cut.

The median is found without collecting rows: its bits are fixed fourteen at a time, each time by
the summed weights of 2^14 bins per node.

Null texts are empty (size 1); very long texts are measured whole. A null source or language lies at the low end of its dimension.
Repeated rows share a shard and have slots of their own. A group larger than a leaf's share makes
its shard that much larger. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, running_totals

COORD_BITS, HASH_BITS, ROUND_BITS = 24, 32, 14
ROUNDS = (COORD_BITS + HASH_BITS) // ROUND_BITS
GROUP = ["_th", "text_crc32", "size"]


def _ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add `name`: the place of the row's value among all distinct values, by code point."""
    values = rows.select(F.col(column).alias("_value")).distinct().withColumn(
        "_one", F.lit(1).cast("long"))
    placed = running_totals(values, [], ["_value"], {name: "_one"}, f"kd-{column}").select(
        "_value", F.col(name).cast("double").alias(name))
    return rows.join(placed, rows[column].eqNullSafe(placed["_value"])).drop("_value", column)


def _measured(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("_th"),
        F.col("source").alias("_source"), F.col("lang").alias("_lang")), "kd-measured")
    return _ranked(_ranked(rows, "_source", "d1"), "_lang", "d2")


def _groups(rows: DataFrame) -> tuple[DataFrame, int]:
    """One row per text: weight, coordinates of 24 bits in `d` and a hash of 32 bits."""
    grouped = materialise(rows.groupBy(*GROUP).agg(
        (F.count("*") * F.col("size")).alias("weight"),
        F.log("size").alias("d0"), F.min("d1").alias("d1"), F.min("d2").alias("d2")), "kd-groups")
    dims = ["d0", "d1", "d2"]
    ends = grouped.agg(F.sum("weight").alias("total"), *[
        f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)]).first()
    top = (1 << COORD_BITS) - 1

    def scaled(d: str) -> Column:
        low, high = ends[f"{d}_min"] or 0.0, ends[f"{d}_max"] or 0.0
        if high <= low:
            return F.lit(0).cast("long")
        return F.floor((F.col(d) - F.lit(low)) / F.lit(high - low) * F.lit(float(top)))

    tie = F.pmod(F.xxhash64("_th", "text_crc32", F.lit(7)), F.lit(1 << HASH_BITS))
    return grouped.select(*GROUP, "weight", F.array(*[scaled(d) for d in dims]).alias("d"),
                          tie.alias("tie")), ends["total"] or 0


def _widest(tree: DataFrame) -> DataFrame:
    """The dimension of largest extent in each open node; the first on ties."""
    extent = [(F.max(F.col("d")[i]) - F.min(F.col("d")[i])) for i in range(3)]
    wide = tree.groupBy("node").agg(F.sum("weight").alias("total"), F.array(*extent).alias("w"))
    return wide.select("node", "total", (F.array_position("w", F.array_max("w")) - 1)
                       .cast("int").alias("dim"))


def _medians(tree: DataFrame, nodes: dict[int, dict]) -> dict[int, int]:
    """The last key of the left part of each node.

    `nodes`: by number the widest dimension and the weight wanted on the left. At most one row
    per node comes back to the driver in each round.
    """
    spark = tree.sparkSession
    state = {n: {"prefix": 0, "before": 0} for n in nodes}
    for step in range(1, ROUNDS + 1):
        shift = ROUND_BITS * (ROUNDS - step)
        plan = spark.createDataFrame(
            [(n, nodes[n]["dim"], s["prefix"], s["before"], float(nodes[n]["want"]))
             for n, s in state.items()],
            "node int, dim int, prefix long, before long, want double")
        key = F.shiftleft(F.get("d", F.col("dim")), HASH_BITS) + F.col("tie")
        bins = (tree.join(F.broadcast(plan), "node")
                .withColumn("bin", F.shiftright(key, shift))
                .filter(F.shiftright("bin", ROUND_BITS) == F.col("prefix"))
                .groupBy("node", "before", "want", "bin").agg(F.sum("weight").alias("w")))
        upto = Window.partitionBy("node").orderBy("bin")
        chosen = (bins.withColumn("upto", F.col("before") + F.sum("w").over(upto))
                  .filter(F.col("upto") >= F.col("want")).groupBy("node")
                  .agg(F.min_by(F.struct("bin", "w", "upto"), "bin").alias("at")))
        for row in chosen.collect():
            state[row.node] = {"prefix": row.at.bin, "before": row.at.upto - row.at.w,
                               "upto": row.at.upto}
    cut = {}
    for n, s in state.items():
        over, under = s["upto"] - nodes[n]["want"], nodes[n]["want"] - s["before"]
        cut[n] = s["prefix"] if over <= under else s["prefix"] - 1
    return cut


def _grow(groups: DataFrame, shards: int) -> DataFrame:
    """Give every group its leaf. Nodes carry the first leaf and the number of leaves below."""
    tree = groups.withColumn("node", F.lit(0))
    leaves = {0: shards}
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        open_nodes = {n: k for n, k in leaves.items() if k > 1}
        nodes = {r.node: {"dim": r.dim, "want": r.total * (open_nodes[r.node] // 2)
                          / open_nodes[r.node]}
                 for r in _widest(tree.filter(F.col("node").isin(list(open_nodes)))).collect()}
        if not nodes:
            break
        cuts = _medians(tree, nodes)
        plan = tree.sparkSession.createDataFrame(
            [(n, nodes[n]["dim"], cuts[n], n + open_nodes[n] // 2) for n in nodes],
            "node int, dim int, cut long, right int")
        key = F.shiftleft(F.get("d", F.col("dim")), HASH_BITS) + F.col("tie")
        tree = materialise(
            tree.join(F.broadcast(plan), "node", "left")
            .withColumn("node", F.when(key > F.col("cut"), F.col("right"))
                        .otherwise(F.col("node")))
            .select(*groups.columns, "node"), f"kd-level-{level}")
        leaves = {m: c for n, k in leaves.items() for m, c in
                  ([(n, 1)] if k == 1 else [(n, k // 2), (n + k // 2, k - k // 2)])}
    return tree


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
              text: str = "text") -> DataFrame:
    """`doc_id, size, text_crc32, shard, slot` of every row; slots count from 0 in each shard.

    Give the number of shards, or the bytes a shard should hold.
    """
    rows = materialise(_measured(docs, text), "kd-rows")
    groups, total = _groups(rows)
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))
    leaf = materialise(_grow(groups, shards).select(
        *[F.col(c).alias(f"g{c}") for c in GROUP], F.col("node").alias("shard")), "kd-leaves")
    on = [rows[c] == leaf[f"g{c}"] for c in GROUP]
    placed = rows.join(leaf, on).select(
        "doc_id", "size", "text_crc32", "_th", "shard", F.lit(1).cast("long").alias("_one"))
    return running_totals(
        placed, ["shard"], ["doc_id", "_th"], {"slot": "_one"}, "kd-slots").select(
        "doc_id", "size", "text_crc32", "shard", "slot")
