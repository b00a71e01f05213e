"""Reconcile a provider's inventory of facts with the catalog, as one set-oriented plan.

The outcome equals handling the facts one by one in `ordinal` order: a fact sees the sources
and contents that earlier facts of the same scan created. What an earlier fact can change for a
later one is small (who created which content first), so it is computed per content hash and
joined back, instead of walking the scan.

Two differences are deliberate. The changed content of a file listed more than once in one scan
is not offered to other new files of that same scan. A content hash that two contents share does
not stop the run: its new sources get the reason `ambiguous_blob_hash` for the whole scan.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators.content import KEY, ContentSource, only
from shelfmark.operators.ordered import (
    first_per_key, previous_row, running_max,
)
from shelfmark.schemas import (
    BLOBS, DECISIONS, FACT_KINDS, FACTS, RESOURCES, SOURCES, Catalog,
)
from shelfmark.session import materialise

# Reasons that carry zero confidence and change nothing.
REJECTED = (
    "invalid_fact_missing_provider",
    "invalid_fact_missing_external_id",
    "invalid_fact_kind",
    "content_hash_required",
    "existing_source_has_no_blob",
    "existing_source_blob_not_found",
    "existing_blob_has_no_asset",
    "existing_source_resource_type_mismatch",
    "ambiguous_blob_hash",
)
# What each accepting reason does.
ACTIONS = {
    "new_message_source": "create_resource+create_blob+create_source",
    "new_source_new_blob": "create_resource+create_blob+create_source",
    "new_source_existing_blob": "create_source",
    "new_blob_for_existing_asset": "create_blob+update_source",
    "source_returned_to_existing_blob_in_asset": "update_source",
    "source_metadata_changed": "update_source",
}


class Changes(NamedTuple):
    """Rows that a run adds or replaces, by id; everything else stays as it is."""

    resources: DataFrame
    blobs: DataFrame
    sources: DataFrame


class Reconciled(NamedTuple):
    decisions: DataFrame
    missing: DataFrame
    catalog: Catalog
    changes: Changes


def validity(provider: Column, external_id: Column, kind: Column) -> Column:
    """The reason a fact cannot be used, or null."""
    return (
        F.when(F.coalesce(fn.strip(provider), F.lit("")) == "", "invalid_fact_missing_provider")
        .when(F.coalesce(external_id, F.lit("")) == "", "invalid_fact_missing_external_id")
        .when(~F.coalesce(kind.isin(*FACT_KINDS), F.lit(False)), "invalid_fact_kind")
    )


def title_of(name: Column, kind: Column) -> Column:
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "Untitled Asset")
        .when(kind == "message", name)
        .otherwise(fn.without_extension(name))
    )


def content_hashes(content: DataFrame) -> DataFrame:
    """(provider, external_id, computed_hash): bytes are digested where they are read, so a
    shuffle carries digests, never content."""
    return content.select(*KEY, F.sha2(F.col("content"), 256).alias("computed_hash"))


def _prior_state(catalog: Catalog, listed: DataFrame) -> DataFrame:
    """The stored chain of the listed keys; the catalog is reduced to them before its own joins."""
    sources = catalog.sources.join(listed.select(*KEY).distinct(), KEY, "left_semi")
    blobs = catalog.blobs.select(
        F.col("id").alias("blob_id"), F.col("asset_id").alias("p_asset_id"),
        F.lit(True).alias("p_blob_found"))
    resources = catalog.resources.select(
        F.col("id").alias("p_asset_id"), F.col("resource_type").alias("p_type"))
    return (
        sources.join(blobs, "blob_id", "left").join(resources, "p_asset_id", "left")
        .select(
            *KEY, F.col("id").alias("p_source_id"), F.col("blob_id").alias("p_blob_id"),
            "p_asset_id", "p_type", "p_blob_found", F.col("path").alias("p_path"),
            F.col("name").alias("p_name"), F.col("version_tag").alias("p_version"),
            F.col("metadata").alias("p_metadata"))
    )


def _with_hash(rows: DataFrame, content: DataFrame | ContentSource | None) -> DataFrame:
    """Fill in the content hash where a new source or a changed version needs one.

    The rows that need one are known before any content is read, and only theirs is.
    """
    given = F.nullif(F.col("content_hash"), F.lit(""))
    changed = ~F.col("p_version").eqNullSafe(F.nullif(F.col("version_tag"), F.lit("")))
    needs = given.isNull() & (F.col("p_source_id").isNull() | changed)
    rows = materialise(rows.withColumn("needs_hash", needs), "staged-facts")
    if content is None:
        return rows.withColumn("hash", given)
    hashes = only(content, rows.filter("needs_hash").select(*KEY), content_hashes)
    found = F.when(F.col("needs_hash"), F.col("computed_hash"))
    return materialise(
        rows.join(hashes, KEY, "left")
        .withColumn("hash", F.coalesce(given, found))
        # A message has no version of its own: its content is its version.
        .withColumn("version_tag", F.when(
            (F.col("kind") == "message") & found.isNotNull(), found)
            .otherwise(F.col("version_tag")))
        .drop("computed_hash"), "hashed-facts")


def _json_value(name: str) -> Column:
    """JSON by value, so key order and blanks are no change; other text as it is."""
    return F.coalesce(fn.canonical_json(name), F.col(name))


def _same_json(one: str, other: str) -> Column:
    """Equal as text, or else by value: most metadata is compared without being parsed."""
    return (F.col(one).eqNullSafe(F.col(other))
            | _json_value(one).eqNullSafe(_json_value(other)))


def _match_known(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Decide facts whose source exists; `blobs` are the contents known before these facts."""
    same_version = F.col("p_version").eqNullSafe(F.nullif(F.col("version_tag"), F.lit("")))
    same_state = (
        F.col("p_path").eqNullSafe(F.col("path"))
        & F.col("p_name").eqNullSafe(F.col("name"))
        & F.col("p_version").eqNullSafe(F.col("version_tag"))
        & _same_json("p_metadata", "raw")
    )
    first = (
        F.when(F.col("p_blob_id").isNull(), "existing_source_has_no_blob")
        .when(F.col("p_blob_found").isNull(), "existing_source_blob_not_found")
        .when(F.col("p_type").isNull(), "existing_blob_has_no_asset")
        .when(F.col("p_type") != F.col("kind"), "existing_source_resource_type_mismatch")
        .when(same_version & same_state, "source_unchanged")
        .when(same_version, "source_metadata_changed")
        .when(F.col("hash").isNull(), "content_hash_required")
    )
    rows = rows.withColumn("reason", first)
    # A fact is known by its key and ordinal; an ordinal alone may be shared.
    fact = [*KEY, "ordinal"]
    repointed = rows.filter(F.col("reason").isNull()).select(*fact, "p_asset_id", "hash")
    creators = (
        repointed.groupBy("p_asset_id", "hash").agg(
            F.min(F.struct("ordinal", *KEY)).alias("first"))
        .select("p_asset_id", "hash", "first.*").join(blobs.select(F.col("asset_id").alias("p_asset_id"), "hash"),
              ["p_asset_id", "hash"], "left_anti")
        .select(*fact, F.lit(True).alias("creates"))
    )
    known = blobs.groupBy(F.col("asset_id").alias("p_asset_id"), "hash").agg(
        F.min("id").alias("known_blob_id"))
    repoints = F.col("reason").isNull()
    return (
        rows.join(creators, fact, "left").join(known, ["p_asset_id", "hash"], "left")
        .withColumn("resource_id", F.col("p_asset_id"))
        .withColumn("blob_id", F.when(repoints, F.coalesce(
            "known_blob_id", fn.uuid_text(F.lit("blob"), "p_asset_id", "hash")))
            .otherwise(F.col("p_blob_id")))
        .withColumn("reason", F.coalesce("reason", F.when(
            F.col("creates"), "new_blob_for_existing_asset")
            .otherwise("source_returned_to_existing_blob_in_asset")))
        .withColumn("source_id", F.col("p_source_id"))
        .drop("creates", "known_blob_id")
    )


def _match_new_messages(rows: DataFrame) -> DataFrame:
    resource_id = fn.uuid_text(F.lit("resource"), F.lit("message"), *KEY)
    usable = F.col("hash").isNotNull()
    return (
        rows.withColumn("resource_id", F.when(usable, resource_id))
        .withColumn("blob_id", F.when(usable, fn.uuid_text(F.lit("blob"), resource_id, "hash")))
        .withColumn("reason", F.when(usable, "new_message_source")
                    .otherwise("content_hash_required"))
    )


def _match_new_files(rows: DataFrame, blobs: DataFrame, created: DataFrame) -> DataFrame:
    """Decide new files. `created` lists contents that other facts of this scan create:
    (hash, ordinal, blob_id, resource_id). Only the first two per hash can matter: none before
    the file leaves it free to create, one gives the content to attach to, two are ambiguous.
    """
    unusable = rows.filter(F.col("hash").isNull()).select(
        "*", F.lit(None).cast("string").alias("resource_id"),
        F.lit(None).cast("string").alias("blob_id"),
        F.lit("content_hash_required").alias("reason"))
    usable = rows.filter(F.col("hash").isNotNull())
    per_hash = usable.groupBy("hash").agg(F.min("ordinal").alias("first_ordinal"))
    existing = blobs.groupBy("hash").agg(
        F.count(F.lit(1)).alias("e_count"),
        F.min(F.struct("id", "asset_id")).alias("e_blob"))
    by_ordinal = Window.partitionBy("hash").orderBy("ordinal")
    rivals = (
        created.withColumn("place", F.row_number().over(by_ordinal))
        .filter(F.col("place") <= 2)
        .groupBy("hash").agg(
            F.min("ordinal").alias("c1"),
            F.min_by(F.struct("blob_id", "resource_id"), "ordinal").alias("c_blob"),
            F.max(F.when(F.col("place") == 2, F.col("ordinal"))).alias("c2"))
    )
    stats = (
        per_hash.join(existing, "hash", "left").join(rivals, "hash", "left")
        .select("hash", "first_ordinal", F.coalesce("e_count", F.lit(0)).alias("e_count"),
                "e_blob", "c1", "c_blob", "c2")
    )
    joined = usable.join(stats, "hash", "left")
    at = F.col("ordinal")
    before_one = F.coalesce(F.col("c1") < at, F.lit(False))
    before_two = F.coalesce(F.col("c2") < at, F.lit(False))
    rival_first = F.coalesce(F.col("c1") < F.col("first_ordinal"), F.lit(False))
    ambiguous = (
        (F.col("e_count") >= 2)
        | ((F.col("e_count") == 1) & before_one)
        | ((F.col("e_count") == 0) & (before_two | (~rival_first & before_one)))
    )
    own_resource = fn.uuid_text(F.lit("resource"), F.lit("file"), "hash")
    own_blob = fn.uuid_text(F.lit("blob"), own_resource, "hash")
    decided = (
        joined.withColumn("reason", F.when(ambiguous, "ambiguous_blob_hash")
                          .when((F.col("e_count") == 0) & ~rival_first
                                & (at == F.col("first_ordinal")), "new_source_new_blob")
                          .otherwise("new_source_existing_blob"))
        .withColumn("blob_id", F.when(ambiguous, None)
                    .when(F.col("e_count") == 1, F.col("e_blob.id"))
                    .when(rival_first, F.col("c_blob.blob_id")).otherwise(own_blob))
        .withColumn("resource_id", F.when(ambiguous, None)
                    .when(F.col("e_count") == 1, F.col("e_blob.asset_id"))
                    .when(rival_first, F.col("c_blob.resource_id")).otherwise(own_resource))
        .drop("first_ordinal", "e_count", "e_blob", "c1", "c_blob", "c2")
    )
    return decided.unionByName(unusable)


DECISION = DECISIONS.fieldNames()


def _finish(rows: DataFrame) -> DataFrame:
    rejected = F.col("reason").isin(*REJECTED)
    action = F.lit("none")
    for reason, name in ACTIONS.items():
        action = F.when(F.col("reason") == reason, name).otherwise(action)
    return (
        rows.withColumn("confidence", F.when(rejected, 0.0).otherwise(1.0))
        .withColumn("action", action)
        .withColumn("hash_computed", F.col("needs_hash") & F.col("hash").isNotNull())
        .select(*DECISION)
    )


def decide(facts: DataFrame, catalog: Catalog,
           content: DataFrame | ContentSource | None = None) -> DataFrame:
    """One decision per fact. `facts` has the FACTS columns, `ordinal` unique in the scan;
    `content` has (provider, external_id, content BINARY) or reads such rows by key."""
    facts = facts.select(*FACTS.fieldNames()).withColumn(
        "reason", validity(F.col("provider"), F.col("external_id"), F.col("kind")))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source_id", "blob_id",
                                                             "resource_id", "hash")]
    idle = (
        facts.filter(F.col("reason").isNotNull() | (F.col("kind") == "folder"))
        .withColumn("reason", F.coalesce("reason", F.lit("folder_ignored_in_v0_1")))
        .select("*", *nothing, F.lit(False).alias("needs_hash"))
    )
    usable = facts.filter(F.col("reason").isNull() & (F.col("kind") != "folder")).drop("reason")

    rest = [c for c in usable.columns if c not in KEY]
    firsts = usable.groupBy(*KEY).agg(
        F.min_by(F.struct(*rest), "ordinal").alias("f"), F.count(F.lit(1)).alias("listed"))
    first = firsts.select(*KEY, *[F.col("f")[c].alias(c) for c in rest], "listed")

    prior = _prior_state(catalog, usable)
    rows = _with_hash(first.join(prior, KEY, "left"), content)
    source_id = fn.uuid_text(F.lit("source"), *KEY)
    known = _match_known(rows.filter(F.col("p_source_id").isNotNull()), catalog.blobs)
    new = rows.filter(F.col("p_source_id").isNull()).withColumn("source_id", source_id)
    messages = _match_new_messages(new.filter(F.col("kind") == "message"))
    common = [c for c in DECISION if c not in ("confidence", "action", "hash_computed")]
    common += ["needs_hash", "listed"]
    settled = materialise(
        known.select(*common).unionByName(messages.select(*common)), "settled-facts")
    created = settled.filter(
        F.col("reason").isin("new_blob_for_existing_asset", "new_message_source")).select(
        "hash", "ordinal", "blob_id", "resource_id")
    files = _match_new_files(new.filter(F.col("kind") == "file"), catalog.blobs, created)
    decided = settled.unionByName(files.select(*common))
    if rows.filter(F.col("listed") > 1).select("ordinal").first() is not None:
        decided = materialise(decided, "decided-facts")
        repeats = _match_repeats(usable, decided, catalog.blobs, content)
        decided = decided.unionByName(repeats.select(*common))
    return _finish(idle.withColumn("listed", F.lit(1).cast("bigint")).select(*common)
                   .unionByName(decided))


def content_needed(facts: DataFrame, catalog: Catalog) -> DataFrame:
    """(provider, external_id) of the listed things whose content a run has to read."""
    facts = facts.filter(validity(F.col("provider"), F.col("external_id"), F.col("kind")).isNull()
                         & (F.col("kind") != "folder"))
    rows = facts.join(_prior_state(catalog, facts), KEY, "left")
    changed = ~F.col("p_version").eqNullSafe(F.nullif(F.col("version_tag"), F.lit("")))
    return rows.filter(F.nullif(F.col("content_hash"), F.lit("")).isNull()
                       & (F.col("p_source_id").isNull() | changed)).select(*KEY).distinct()


def _match_repeats(usable: DataFrame, decided: DataFrame, blobs: DataFrame,
                   content: DataFrame | ContentSource | None) -> DataFrame:
    """Decide facts that list a source again in one scan: each sees what the one before left."""
    state = ["path", "name", "version_tag", "raw"]
    leads = decided.filter(F.col("listed") > 1).select(
        *KEY, "source_id", F.col("resource_id").alias("p_asset_id"),
        F.col("blob_id").alias("p_blob_id"), F.col("reason").alias("lead_reason"),
        F.col("kind").alias("p_type"), F.col("ordinal").alias("lead_ordinal"),
        F.col("version_tag").alias("lead_version"))
    chains = previous_row(usable.join(leads.select(*KEY), KEY, "left_semi"), KEY, "ordinal", state)
    again = chains.join(leads, KEY).filter(F.col("ordinal") > F.col("lead_ordinal")).select(
        *usable.columns,
        F.col("source_id").alias("p_source_id"), "p_asset_id", "p_blob_id", "p_type",
        F.lit(True).alias("p_blob_found"), F.col("previous.path").alias("p_path"),
        F.col("previous.name").alias("p_name"), F.col("previous.raw").alias("p_metadata"),
        F.when(F.col("kind") == "message", F.col("lead_version"))
        .otherwise(F.col("previous.version_tag")).alias("p_version"), "lead_reason")
    again = _with_hash(again, content)
    contents = blobs.select("id", "asset_id", "hash").unionByName(
        decided.filter(F.col("reason").isin(
            "new_message_source", "new_source_new_blob", "new_blob_for_existing_asset"))
        .select(F.col("blob_id").alias("id"), F.col("resource_id").alias("asset_id"), "hash"))
    moved = ~F.col("p_version").eqNullSafe(F.nullif(F.col("version_tag"), F.lit("")))
    again = running_max(
        again.withColumn("_moved", F.when(moved, F.struct("ordinal", "hash"))),
        KEY, "ordinal", "_moved", "_last").withColumn("_last_hash", F.col("_last.hash"))
    by_hash = contents.groupBy(F.col("asset_id").alias("p_asset_id"),
                               F.col("hash").alias("_last_hash")).agg(F.min("id").alias("_id"))
    again = again.join(by_hash, ["p_asset_id", "_last_hash"], "left").withColumn(
        "p_blob_id", F.when(F.col("_last_hash").isNull(), F.col("p_blob_id")).otherwise(
            F.coalesce("_id", fn.uuid_text(F.lit("blob"), "p_asset_id", "_last_hash"))))
    return _match_known(materialise(again, "repeated-facts"), contents).withColumn(
        "reason", F.when(F.col("p_asset_id").isNull(), F.col("lead_reason"))
        .otherwise(F.col("reason"))).withColumn("listed", F.lit(1).cast("bigint"))


def missing_sources(facts: DataFrame, catalog: Catalog) -> DataFrame:
    """Active sources of the scanned providers that a completed scan did not list."""
    scanned = facts.select("provider").distinct()
    seen = facts.filter(F.col("external_id").isNotNull()).select(*KEY).distinct()
    return (
        catalog.sources.filter("is_active")
        .join(scanned, "provider", "left_semi").join(seen, KEY, "left_anti")
    )


def changes(decisions: DataFrame, missing: DataFrame, catalog: Catalog, now: datetime) -> Changes:
    """What the decisions add to the catalog and which sources they replace."""
    at = F.coalesce("observed_at", F.lit(now).cast("timestamp"))
    does = F.col("action")
    resources = decisions.filter(does.contains("create_resource")).select(
        F.col("resource_id").alias("id"), F.col("kind").alias("resource_type"),
        title_of(F.col("name"), F.col("kind")).alias("title"), F.lit("{}").alias("metadata"),
        at.alias("created_at"), at.alias("updated_at"))
    blobs = decisions.filter(does.contains("create_blob")).select(
        F.col("blob_id").alias("id"), F.col("resource_id").alias("asset_id"), "hash", "size",
        "mime_type")
    state = ["blob_id", "path", "name", "version_tag"]
    created = decisions.filter(does.contains("create_source")).select(
        F.col("source_id").alias("id"), "blob_id", *KEY, "path", "name", "version_tag",
        F.col("raw").alias("metadata"), F.lit(True).alias("is_active"),
        F.lit(None).cast("timestamp").alias("deleted_at"))
    updates = materialise(first_per_key(
        decisions.filter(does.contains("update_source")).select(
            F.col("source_id").alias("id"), (-F.col("ordinal")).alias("recency"), *state,
            F.col("raw").alias("metadata")),
        ["id"], F.col("recency")), "source-updates")
    # A source listed for the first time and again in one scan is created with its last state;
    # those few are found by id, so that the created rows need no shuffle.
    again = materialise(updates.join(created.select("id"), "id"), "created-again")
    created = (
        created.alias("c").join(
            again.select("id", F.struct(*state, "metadata").alias("u")), "id", "left")
        .select("id", *[F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"c.{c}"))
                        .alias(c) if c in (*state, "metadata") else F.col(f"c.{c}").alias(c)
                        for c in SOURCES.fieldNames() if c != "id"])
    )
    touched = updates.select("id", F.struct(*state, "metadata").alias("u"),
                             F.lit(False).alias("gone")).unionByName(
        missing.select("id", F.lit(True).alias("gone")), allowMissingColumns=True)
    gone = F.coalesce("gone", F.lit(False))
    replaced = (
        catalog.sources.alias("s").join(touched, "id")
        .select("id", *[
            F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
            if c in (*state, "metadata")
            else F.when(gone, False).otherwise(F.col("s.is_active")).alias(c)
            if c == "is_active"
            else F.when(gone, F.lit(now).cast("timestamp")).otherwise(F.col("s.deleted_at"))
            .alias(c) if c == "deleted_at"
            else F.col(f"s.{c}").alias(c)
            for c in SOURCES.fieldNames() if c != "id"])
    )
    sources = replaced.unionByName(created.select(*SOURCES.fieldNames()))
    return Changes(resources.select(*RESOURCES.fieldNames()), blobs.select(*BLOBS.fieldNames()),
                   materialise(sources, "changed-sources"))


def apply(made: Changes, catalog: Catalog) -> Catalog:
    """The catalog after the changes; `sources.tables` stores the changes alone."""
    return Catalog(
        catalog.resources.unionByName(made.resources), catalog.blobs.unionByName(made.blobs),
        catalog.sources.join(made.sources.select("id"), "id", "left_anti").select(
            *SOURCES.fieldNames()).unionByName(made.sources))


def metrics(decisions: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: facts, actions, hashes and missing sources of the run."""
    each = F.when(F.col("action") == "none", 0).otherwise(F.size(F.split("action", r"\+")))
    run = decisions.agg(
        F.count(F.lit(1)).alias("facts"), F.coalesce(F.sum(each), F.lit(0)).alias("made"),
        F.count_if("hash_computed").alias("hashes"))
    lost = missing.agg(F.count(F.lit(1)).alias("missing"))
    return run.select(
        "facts", (F.col("made") + lost.scalar()).alias("actions"), "hashes",
        lost.scalar().alias("missing"))


def reconcile(facts: DataFrame, catalog: Catalog, now: datetime,
              content: DataFrame | ContentSource | None = None, *, complete: bool,
              seen: DataFrame | None = None) -> Reconciled:
    """Decide every fact, find missing sources of a `complete` scan, and derive what changes.

    `seen` (provider, external_id) holds all keys of an inventory of which `facts` are the last
    part. The decisions are written to the shared folder first, so all changes come from one set.
    """
    decisions = materialise(decide(facts, catalog, content), "decisions")
    missing = missing_sources(facts if seen is None else seen, catalog)
    if not complete:
        missing = missing.limit(0)
    made = changes(decisions, missing, catalog, now)
    return Reconciled(decisions, missing, apply(made, catalog), made)


def sync_provider(facts: DataFrame, catalog: Catalog, now: datetime,
                  content: DataFrame | ContentSource | None = None, complete: bool = False,
                  seen: DataFrame | None = None) -> Reconciled:
    """`reconcile` for one provider's run; refuses a mixed scan or an unusable source chain.

    Nothing is deactivated unless the caller says that the scan is complete; the sync calls of
    `sources.sync` find that out for themselves.
    """
    providers = facts.select(F.count_distinct("provider")).first()[0]
    if providers > 1:
        raise ValueError("a single sync run cannot contain multiple providers")
    result = reconcile(facts, catalog, now, content, complete=complete, seen=seen)
    fatal = result.decisions.filter(F.col("reason").isin(
        "content_hash_required", "existing_source_has_no_blob", "existing_source_blob_not_found",
        "existing_blob_has_no_asset", "existing_source_resource_type_mismatch"))
    bad = fatal.select("reason").first()
    if bad is not None:
        raise RuntimeError(bad["reason"])
    return result
