"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in hashed order, served again from the start when it is
through. A document's virtual finish time is the words its source has sent up to its end, divided
by the source's target. The merged stream is sorted by that time and cut where the next document
would pass the total budget, so every source stops within a document of its target.

Sources weigh in cyclic order of their names by code point, null last. A target is never above
`most` times the source's size; what that leaves over goes to the others by weight.

Null texts and texts without words have size 0 and are taken 0 words of. Every row is sent by
itself, also one of many equal ones; which of equal rows is taken does not show. Very long texts
are counted whole. A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import keyed, materialise, running_totals

ORDER_SEED = 20_240_517


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """`source, source_size, target` from one row of `source, source_size` per source.

    A source is at its cap if all sources together, raised to its ratio of cap to weight, stay
    within the budget; the others share what is left by weight.
    """
    named = sizes.select(
        "source", "source_size", F.col("source").isNull().alias("_last"),
        F.lit(1).cast("long").alias("_one"))
    numbered = running_totals(named, [], ["_last", "source"], {"_no": "_one"}, "mix-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = numbered.withColumns({
        "_w": F.get(cycle, F.pmod(F.col("_no"), F.lit(len(weights))).cast("int")),
        "_cap": F.col("source_size") * F.lit(float(most))}).withColumn(
        "_ratio", F.col("_cap") / F.col("_w"))
    filled = materialise(running_totals(
        weighed, [], ["_ratio", "_last", "source"], {"_caps": "_cap", "_ws": "_w"}, "mix-ratio"),
        "mix-filled")
    whole = filled.agg(F.sum("_w").alias("w"), F.sum("source_size").alias("n")).first()
    if whole.w is None:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    budget = share * whole.n
    level = F.col("_caps") + F.col("_cap") + F.col("_ratio") * (
        F.lit(whole.w) - F.col("_ws") - F.col("_w"))
    capped = filled.withColumn("_full", level <= F.lit(budget))
    free = capped.agg(
        F.sum(F.when(F.col("_full"), F.col("_cap"))).alias("caps"),
        F.sum(F.when(~F.col("_full"), F.col("_w"))).alias("w")).first()
    rate = (budget - (free.caps or 0.0)) / free.w if free.w else 0.0
    return materialise(capped.select(
        "source", "source_size", F.when(F.col("_full"), F.col("_cap"))
        .otherwise(F.col("_w") * F.lit(rate)).alias("target")), "mix-targets")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
        most: int = 2, text: str = "text", row: str | None = None) -> DataFrame:
    """One row per document: `doc_id, _id, _th, source, size, source_size, target, copies, taken`,
    and `_row`, the number in column `row` or one of its own.

    `copies` says how often the document is in the mix.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = materialise(
        keyed(docs.select("doc_id", text, F.col("source").alias("source"), number.alias("_row")),
              text, ["source", "_row"])
        .withColumn("size", word_count(F.col("_text"))).drop("_text"), "mix-rows")
    sent = rows.withColumn("_order", F.xxhash64("_id", "_th", F.lit(ORDER_SEED)))
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                     weights, share, most)
    place = ["_order", "_id", "_th", "_row"]
    queued = running_totals(sent, ["source"], place, {"_sent": "size"}, "mix-queues")
    queued = materialise(
        queued.join(wanted.withColumnRenamed("source", "_source"),
                    F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-sent")

    def finish(turn: Column) -> Column:
        words = turn * F.col("source_size") + F.col("_sent") + F.col("size")
        return F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0))

    turns = queued.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    tie = ["_turn", *place, "source"]
    stream = running_totals(
        turns.select(finish(F.col("_turn")).alias("_finish"), *tie, "size"),
        [], ["_finish", *tie], {"_before": "size"}, "mix-stream")
    budget = wanted.agg(F.sum("target").alias("b")).first().b or 0.0
    # The sum of the targets is the budget up to rounding; words are whole.
    cut = (stream.filter(F.col("_before") + F.col("size") > F.lit(round(budget)))
           .select(F.struct("_finish", *tie).alias("k")).agg(F.min("k").alias("k")).first().k)
    taken = [F.lit(1)] * most
    if cut is not None:
        def before(turn: int) -> Column:
            mine = F.struct(finish(F.lit(turn)).alias("_finish"), F.lit(turn).alias("_turn"),
                            *place, "source")
            end = F.struct(*[F.lit(cut[c]).cast(stream.schema[c].dataType).alias(c)
                             for c in ["_finish", *tie]])
            return F.when(mine < end, 1).otherwise(0)
        taken = [before(t) for t in range(most)]
    return queued.withColumn("copies", sum(taken[1:], taken[0])).select(
        F.col("_id").alias("doc_id"), "_id", "_th", "source", "_row", "size", "source_size",
        "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
          most: int = 2, text: str = "text") -> DataFrame:
    """The mix itself: every document as often as it is taken. The rows are written once with a
    number, by which they meet their decision."""
    rows = materialise(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"),
        F.monotonically_increasing_id().alias("_number")), "mix-documents")
    plain = rows.select(F.col("_whole.doc_id").alias("doc_id"), F.col("_whole.source")
                        .alias("source"), F.col(f"_whole.`{text}`").alias(text), "_number")
    decided = mix(plain, weights, share, most, text, "_number").filter("copies > 0").select(
        F.col("_row").alias("_number"), "copies")
    return rows.join(decided, "_number").select(
        "_whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_whole.*")
