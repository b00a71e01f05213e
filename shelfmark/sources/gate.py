"""Is a landed inventory complete? Only a complete one may deactivate anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialise


def inventory_problems(links: DataFrame, first: str = "1", constant_total: bool = False
                       ) -> DataFrame:
    """(listing, problem) over page links (listing, page, next, total).

    A listing is complete if its pages form one chain from `first` to exactly one end: no page
    twice, no page reached twice, every next page landed, no pages that only lead to each other,
    and where asked one total throughout.
    """
    pages = links.groupBy("listing", "page").agg(F.count(F.lit(1)).alias("n"))
    targets = (links.filter(F.col("next").isNotNull())
               .groupBy("listing", F.col("next").alias("page"))
               .agg(F.count(F.lit(1)).alias("n")))

    def problem(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("listing", F.lit(name).alias("problem")).distinct()

    per_listing = links.groupBy("listing").agg(
        F.count_if(F.col("next").isNull()).alias("ends"),
        F.count_if(F.col("page") == first).alias("starts"),
        F.min("total").alias("low"), F.max("total").alias("high"),
        F.count_if(F.col("total").isNull()).alias("untold"))
    found = [
        problem(pages.filter("n > 1"), "repeated page"),
        problem(targets.filter((F.col("n") > 1) | (F.col("page") == first)), "repeated next page"),
        problem(targets.join(pages, ["listing", "page"], "left_anti"), "missing page"),
        problem(pages.filter(F.col("page") != first).join(targets, ["listing", "page"],
                                                          "left_anti"), "unreachable page"),
        problem(per_listing.filter("ends <> 1"), "not one terminal page"),
        problem(per_listing.filter("starts = 0"), "first page missing"),
        problem(_on_a_cycle(links).join(
            targets.filter((F.col("n") > 1) | (F.col("page") == first)).select("listing"),
            "listing", "left_anti"), "detached pages"),
    ]
    if constant_total:
        found.append(problem(per_listing.filter(
            (F.col("untold") > 0) | (F.col("low") != F.col("high")) | (F.col("low") < 0)),
            "total changed"))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _on_a_cycle(links: DataFrame) -> DataFrame:
    """Pages from which no end is reached: jump lengths double until every chain must have ended.

    A listing in which some page is reached twice is reported for that already.
    """
    hops = links.filter(F.col("next").isNotNull()).select("listing", "page", "next").distinct()
    longest = links.groupBy("listing").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("n")).first()["n"] or 0
    once = hops.groupBy("listing", "page").agg(F.min("next").alias("next"))
    for step in range(int(longest).bit_length()):
        onward = once.select("listing", F.col("page").alias("next"),
                             F.col("next").alias("further"))
        once = materialise(once.join(onward, ["listing", "next"]).select(
            "listing", "page", F.col("further").alias("next")), f"page-hops-{step}")
    return once


def is_complete(links: DataFrame, first: str = "1", constant_total: bool = False) -> bool:
    """True if something landed and nothing is wrong with it."""
    if links.select("page").first() is None:
        return False
    return inventory_problems(links, first, constant_total).first() is None
