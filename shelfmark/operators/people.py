"""Person identities and which resources show whom, reconciled with a provider's inventory."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.schemas import PERSON_SOURCES, RESOURCE_PERSON, Catalog
from shelfmark.session import materialise


class People(NamedTuple):
    persons: DataFrame
    person_sources: DataFrame
    outcomes: DataFrame


def inventory_violations(inventory: DataFrame) -> DataFrame:
    """(external_id, violation): blank or repeated ids."""
    blank = inventory.filter(F.coalesce(fn.strip("external_id"), F.lit("")) == "").select(
        "external_id", F.lit("blank_id").alias("violation"))
    twice = inventory.groupBy("external_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return blank.unionByName(twice.select("external_id", F.lit("duplicate_id").alias("violation")))


def reconcile_people(provider: str, inventory: DataFrame, persons: DataFrame,
                     person_sources: DataFrame, now: datetime, complete: bool = True) -> People:
    """Create, keep, reactivate and (for a complete inventory) inactivate identities.

    Unlike sources, a complete inventory that is empty does inactivate everyone.
    """
    if not provider.strip():
        raise ValueError("provider must be non-empty")
    wrong = inventory_violations(inventory).select("violation").first()
    if wrong is not None:
        raise ValueError(f"person inventory: {wrong['violation']}")
    at = F.lit(now).cast("timestamp")
    mine = person_sources.filter(F.col("provider") == provider)
    both = inventory.select("external_id", F.lit(True).alias("listed")).join(
        mine.select("external_id", "person_id", "inactive_at",
                    F.lit(True).alias("stored")), "external_id", "full_outer")
    outcome = (
        F.when(F.col("stored").isNull(), "created")
        .when(F.col("listed") & F.col("inactive_at").isNull(), "existing")
        .when(F.col("listed"), "reactivated")
        .when(F.col("inactive_at").isNull() & F.lit(complete), "inactivated")
        .otherwise("untouched")
    )
    rows = both.select(
        "external_id", F.coalesce("person_id", fn.uuid_text(
            F.lit("person"), F.lit(provider), "external_id")).alias("person_id"),
        "inactive_at", outcome.alias("outcome"))
    next_mine = rows.select(
        F.lit(provider).alias("provider"), "external_id", "person_id",
        F.when(F.col("outcome") == "inactivated", at)
        .when(F.col("outcome") == "untouched", F.col("inactive_at")).alias("inactive_at"))
    created = rows.filter(F.col("outcome") == "created").select(
        F.col("person_id").alias("id"), at.alias("created_at"))
    others = person_sources.filter(F.col("provider") != provider)
    return People(
        persons.unionByName(created),
        others.select(*PERSON_SOURCES.fieldNames()).unionByName(next_mine),
        rows.filter(F.col("outcome") != "untouched").select("external_id", "person_id", "outcome"))


def get_or_create(provider: str, ids: DataFrame, persons: DataFrame, person_sources: DataFrame,
                  now: datetime) -> People:
    """`reconcile_people` for ids seen outside a full inventory: nobody is inactivated."""
    return reconcile_people(provider, ids, persons, person_sources, now, complete=False)


def active_person_ids(person_sources: DataFrame, provider: str) -> DataFrame:
    return person_sources.filter(
        (F.col("provider") == provider) & F.col("inactive_at").isNull()).select(
        "external_id", "person_id").orderBy("external_id")


class Relations(NamedTuple):
    relations: DataFrame
    outcomes: DataFrame
    totals: DataFrame


def map_pairs(provider: str, pairs: DataFrame, catalog: Catalog, person_sources: DataFrame
              ) -> DataFrame:
    """Distinct (resource_id, person_id) of external pairs whose both ends are active."""
    people = person_sources.filter(
        (F.col("provider") == provider) & F.col("inactive_at").isNull()).select(
        F.col("external_id").alias("person_external_id"), "person_id")
    blobs = catalog.blobs.select(F.col("id").alias("blob_id"), F.col("asset_id").alias("resource_id"))
    files = catalog.resources.filter(F.col("resource_type") == "file").select(
        F.col("id").alias("resource_id"))
    assets = (
        catalog.sources.filter(F.col("is_active") & (F.col("provider") == provider))
        .select("blob_id", F.col("external_id").alias("asset_external_id"))
        .join(blobs, "blob_id").join(files, "resource_id", "left_semi")
        .select("asset_external_id", "resource_id")
    )
    rows = pairs.join(people, "person_external_id").join(assets, "asset_external_id")
    return rows.select("resource_id", "person_id").distinct()


def reconcile_relations(provider: str, pairs: DataFrame, catalog: Catalog,
                        person_sources: DataFrame, relations: DataFrame, now: datetime
                        ) -> Relations:
    """Created, unchanged, reactivated and inactivated relations of one provider."""
    if not provider.strip():
        raise ValueError("provider must be non-empty")
    # Written once: the joins and the totals read them.
    pairs = materialise(
        pairs.select("asset_external_id", "person_external_id").distinct(), "observed-pairs")
    blank = (fn.strip("asset_external_id") == "") | (fn.strip("person_external_id") == "")
    if pairs.filter(F.coalesce(blank, F.lit(True))).select("asset_external_id").first():
        raise ValueError("observed relation ids must be non-empty")
    mapped = map_pairs(provider, pairs, catalog, person_sources)
    at = F.lit(now).cast("timestamp")
    mine = relations.filter(F.col("provider") == provider).select(
        "resource_id", "person_id", "inactive_at", F.lit(True).alias("stored"))
    both = mapped.withColumn("listed", F.lit(True)).join(
        mine, ["resource_id", "person_id"], "full_outer")
    outcome = (
        F.when(F.col("stored").isNull(), "created")
        .when(F.col("listed") & F.col("inactive_at").isNull(), "unchanged")
        .when(F.col("listed"), "reactivated")
        .when(F.col("inactive_at").isNull(), "inactivated").otherwise("untouched")
    )
    rows = both.withColumn("outcome", outcome)
    next_mine = rows.select(
        "resource_id", "person_id", F.lit(provider).alias("provider"),
        F.when(F.col("outcome") == "inactivated", at)
        .when(F.col("outcome") == "untouched", F.col("inactive_at")).alias("inactive_at"))
    others = relations.filter(F.col("provider") != provider)

    def n(name: str):
        return F.count_if(F.col("outcome") == name).alias(name)

    asked = pairs.agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = rows.agg(n("created"), n("unchanged"), n("reactivated"), n("inactivated"),
                      F.count_if("listed").alias("mapped")).select(
        "created", "unchanged", "reactivated", "inactivated",
        (asked - F.col("mapped")).alias("skipped_unmapped"))
    return Relations(
        others.select(*RESOURCE_PERSON.fieldNames()).unionByName(next_mine),
        rows.filter(F.col("outcome") != "untouched").select("resource_id", "person_id", "outcome"),
        totals)
