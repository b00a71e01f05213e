"""Gate, validate and publish statements; keep their history; answer statement lookups."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators.extract import DRAFT_VALUES, load
from shelfmark.operators.query import InvalidQuery, check_limit
from shelfmark.schemas import (
    ENRICHMENT_STATES, PREDICATES, STATEMENTS, Catalog, Generator,
    predicate_table,
)
from shelfmark.session import materialise

# Fixed values.
STALE_AFTER = timedelta(minutes=30)
MAX_ERROR_CODE = 64
MAX_ERROR_MESSAGE = 512
DEFAULT_ERROR = "extraction_failed"

GENERATOR = ["generator_type", "generator_name", "generator_version"]
CONTENT_KEY = ["predicate", "value_type", "value_digest", "source_kind", "source_locator",
               "confidence"]


def value_text() -> Column:
    """The one typed value as text; timestamps to the microsecond."""
    return F.coalesce(
        "string_value", F.col("integer_value").cast("string"), F.col("float_value").cast("string"),
        F.col("boolean_value").cast("string"),
        F.unix_micros("datetime_value").cast("string"), "resource_value_asset_id")


def value_digest() -> Column:
    """Equal where the values are equal: long texts are compared without being shuffled."""
    text = value_text()
    return F.when(F.octet_length(text) <= 64, F.concat(F.lit("="), text)).otherwise(
        F.sha2(text, 256))


def of_generator(generator: Generator) -> Column:
    return ((F.col("generator_type") == generator.type)
            & (F.col("generator_name") == generator.name)
            & (F.col("generator_version") == generator.version))


def _state_of(states: DataFrame, generator: Generator) -> DataFrame:
    return states.filter((F.col("extractor_type") == generator.type)
                         & (F.col("extractor_name") == generator.name)
                         & (F.col("extractor_version") == generator.version))


def gate(inputs: DataFrame, states: DataFrame, generator: Generator, now: datetime,
         stale_after: timedelta = STALE_AFTER) -> DataFrame:
    """Add `gate`: 'unreadable', 'skip' (done for this input, or running and fresh) or 'run'."""
    prior = _state_of(states, generator).select(
        F.col("subject_asset_id").alias("resource_id"), F.col("status").alias("p_status"),
        F.col("input_fingerprint").alias("p_fingerprint"), F.col("updated_at").alias("p_updated"))
    done = (F.col("p_status") == "completed") & (F.col("p_fingerprint") == F.col("fingerprint"))
    fresh = (F.col("p_status") == "running") & (F.col("p_updated") > F.lit(now - stale_after))
    return (
        inputs.join(prior, "resource_id", "left")
        .withColumn("gate", F.when(F.col("fingerprint").isNull(), "unreadable")
                    .when(F.coalesce(done | fresh, F.lit(False)), "skip").otherwise("run"))
        .drop("p_status", "p_fingerprint", "p_updated")
    )


def draft_violations(drafts: DataFrame, covered: tuple[str, ...], registry: DataFrame) -> DataFrame:
    """(resource_id, violation) of drafts a batch may not contain."""
    known = registry.select("predicate", F.col("value_type").alias("r_type"), "cardinality")
    # The registry is small; a shuffle by predicate would put all drafts of one into one task.
    rows = drafts.withColumn("value_digest", value_digest()).join(
        F.broadcast(known), "predicate", "left")
    confidence = F.col("confidence")
    single = (
        F.when(~F.col("predicate").isin(*covered) | F.col("r_type").isNull(), "not_covered")
        .when(F.col("value_type") != F.col("r_type"), "wrong_value_type")
        .when(confidence.isNotNull() & ~(fn.is_finite(confidence) & confidence.between(0, 1)),
              "bad_confidence")
        .when(F.col("float_value").isNotNull() & ~fn.is_finite("float_value"), "not_finite")
    )
    per_row = rows.select("resource_id", single.alias("violation")).filter("violation is not null")
    per_value = rows.groupBy("resource_id", "predicate", "cardinality", "value_type",
                             "value_digest").agg(F.count(F.lit(1)).alias("n"))
    duplicate = per_value.filter("n > 1").select("resource_id",
                                                 F.lit("duplicate_value").alias("violation"))
    several = (per_value.filter(F.col("cardinality") == "single")
               .groupBy("resource_id", "predicate").agg(F.sum("n").alias("n")).filter("n > 1")
               .select("resource_id", F.lit("several_values").alias("violation")))
    return per_row.unionByName(duplicate).unionByName(several)


def family_conflicts(statements: DataFrame, resources: DataFrame, generator: Generator,
                     covered: tuple[str, ...], family: tuple[str, ...]) -> DataFrame:
    """Resources that already hold a current statement of another family member."""
    rival = statements.filter(
        F.col("is_current") & F.col("predicate").isin(*covered)
        & (F.col("generator_type") == generator.type) & F.col("generator_name").isin(*family)
        & ~((F.col("generator_name") == generator.name)
            & (F.col("generator_version") == generator.version)))
    return resources.select("resource_id").join(
        rival.select(F.col("subject_asset_id").alias("resource_id")), "resource_id", "left_semi")


def changed_subjects(statements: DataFrame, drafts: DataFrame, batch: DataFrame,
                     generator: Generator, covered: tuple[str, ...]) -> DataFrame:
    """Subjects of `batch` (resource_id) whose current statements differ from their drafts.

    Both sides are compared as multisets by counting, also where a batch has no drafts at all.
    """
    key = [F.col(c) for c in CONTENT_KEY if c != "value_digest"]
    key.append(value_digest().alias("value_digest"))
    old = statements.filter(
        F.col("is_current") & of_generator(generator) & F.col("predicate").isin(*covered)).select(
        F.col("subject_asset_id").alias("resource_id"), *key, F.lit(1).alias("side"))
    new = drafts.select("resource_id", *key, F.lit(-1).alias("side"))
    balance = (old.join(batch, "resource_id", "left_semi").unionByName(new)
               .groupBy("resource_id", *CONTENT_KEY).agg(F.sum("side").alias("d")))
    return balance.filter("d <> 0").select("resource_id").distinct()


def new_statements(drafts: DataFrame, generator: Generator, now: datetime) -> DataFrame:
    """Drafts as current statement rows; the same draft published at one time has one id."""
    return (
        drafts.withColumn("generator_type", F.lit(generator.type))
        .withColumn("generator_name", F.lit(generator.name))
        .withColumn("generator_version", F.lit(generator.version))
        .withColumn("created_at", F.lit(now).cast("timestamp"))
        .withColumn("is_current", F.lit(True))
        .withColumn("id", fn.uuid_text(
            F.lit("statement"), "resource_id", *GENERATOR, "predicate", value_text(),
            F.unix_micros("created_at").cast("string")))
        .withColumnRenamed("resource_id", "subject_asset_id")
        .select(*STATEMENTS.fieldNames())
    )


class Published(NamedTuple):
    statements: DataFrame
    retired: DataFrame
    created: DataFrame

    def changes(self) -> DataFrame:
        """The rows that differ from before, by id: ended and new ones."""
        return self.retired.withColumn("is_current", F.lit(False)).unionByName(self.created)


def publish(statements: DataFrame, drafts: DataFrame, batch: DataFrame, generator: Generator,
            covered: tuple[str, ...], now: datetime) -> Published:
    """Replace the covered statements of every changed subject; equal sets write nothing.

    What changes is written once; the history beside it is passed on as it is.
    """
    changed = materialise(changed_subjects(statements, drafts, batch, generator, covered),
                          "changed-subjects")
    mine = (F.col("is_current") & of_generator(generator) & F.col("predicate").isin(*covered))
    retired = materialise(statements.filter(mine).join(
        changed.withColumnRenamed("resource_id", "subject_asset_id"), "subject_asset_id",
        "left_semi").select(*STATEMENTS.fieldNames()), "retired-statements")
    created = materialise(new_statements(drafts.join(changed, "resource_id", "left_semi"),
                                         generator, now), "new-statements")
    ended = retired.select("id", F.lit(True).alias("_ended"))
    kept = statements.join(ended, "id", "left").withColumn(
        "is_current", F.col("is_current") & F.col("_ended").isNull())
    return Published(kept.select(*STATEMENTS.fieldNames()).unionByName(created), retired, created)


IDENTITY = ["subject_asset_id", "extractor_type", "extractor_name", "extractor_version"]


def claims(inputs: DataFrame, generator: Generator, now: datetime) -> DataFrame:
    """State rows that say who is being worked on since when (ENRICHMENT_STATES)."""
    at, none = F.lit(now).cast("timestamp"), F.lit(None)
    return inputs.select(
        F.col("resource_id").alias("subject_asset_id"),
        F.lit(generator.type).alias("extractor_type"),
        F.lit(generator.name).alias("extractor_name"),
        F.lit(generator.version).alias("extractor_version"),
        F.col("fingerprint").alias("input_fingerprint"), F.lit("running").alias("status"),
        at.alias("started_at"), none.cast("timestamp").alias("completed_at"),
        at.alias("updated_at"), none.cast("string").alias("error_code"),
        none.cast("string").alias("error_message"))


class Enriched(NamedTuple):
    statements: DataFrame
    states: DataFrame
    outcomes: DataFrame
    totals: DataFrame
    published: Published
    finished: DataFrame


def run_enrichment(extractor, catalog: Catalog, statements: DataFrame, states: DataFrame,
                   now: datetime, limit: int | None = None,
                   stale_after: timedelta = STALE_AFTER, registry: DataFrame | None = None,
                   claim: Callable[[DataFrame], DataFrame] | None = None) -> Enriched:
    """Discover, gate, claim, read, extract, validate and publish for one extractor.

    The gate needs stored hashes and metadata only. What it lets through is claimed: `claim` gets
    the state rows, stores them for other workers to see, and returns those it got. Content is
    read for these alone, so a rerun over unchanged inputs reads none.

    One failing resource never stops the others: its error lands in its state row. An optional
    `limit` bounds the resources worked on, in id order, after the gate.
    """
    spark = catalog.resources.sparkSession
    generator, covered = extractor.generator, extractor.covered
    registry = registry if registry is not None else predicate_table(spark)
    inputs = gate(extractor.inputs(catalog), states, generator, now, stale_after)
    if limit is not None:
        rest = inputs.filter(F.col("gate") != "run")
        inputs = rest.unionByName(inputs.filter(F.col("gate") == "run")
                                  .orderBy("resource_id").limit(limit))
    # Written once: extraction must not be repeated for statements, states and totals.
    inputs = materialise(inputs, "enrichment-inputs")
    if claim is not None:
        got = claim(claims(inputs.filter(F.col("gate") == "run"), generator, now))
        got = got.select(F.col("subject_asset_id").alias("resource_id"), F.lit(True).alias("_got"))
        inputs = materialise(
            inputs.join(got, "resource_id", "left").withColumn("gate", F.when(
                (F.col("gate") == "run") & F.col("_got").isNull(), "skip").otherwise(F.col("gate")))
            .drop("_got"), "claimed-inputs")
    work = inputs.filter((F.col("gate") == "run") & F.col("error_code").isNull())
    work = materialise(load(extractor, work.drop("gate")), "enrichment-work")
    readable = work.filter(F.col("error_code").isNull())
    drafts = materialise(extractor.drafts(readable), "enrichment-drafts")
    bad = draft_violations(drafts, covered, registry).groupBy("resource_id").agg(
        F.min("violation").alias("violation"))
    faults = work.filter(F.col("error_code").isNotNull()).select(
        "resource_id", F.col("error_code").alias("_code"), F.col("error_message").alias("_message"))
    outcomes = inputs.join(faults, "resource_id", "left").select(
        "resource_id", "fingerprint", "gate",
        F.coalesce("error_code", "_code").alias("error_code"),
        F.coalesce("error_message", "_message").alias("error_message")).join(
        bad, "resource_id", "left")
    if extractor.family:
        rivals = family_conflicts(statements, readable, generator, covered, extractor.family)
        outcomes = outcomes.join(rivals.withColumn("_rival", F.lit(True)), "resource_id", "left")
    else:
        outcomes = outcomes.withColumn("_rival", F.lit(None).cast("boolean"))
    own_fault = F.col("violation").isNotNull() | F.coalesce("_rival", F.lit(False))
    outcomes = materialise(
        outcomes.select(
            "resource_id", "fingerprint",
            F.when(F.col("gate") == "skip", "skipped")
            .when((F.col("gate") == "unreadable") | F.col("error_code").isNotNull() | own_fault,
                  "failed").otherwise("processed").alias("outcome"),
            (F.col("gate") == "run").alias("recorded"),
            fn.clip(F.coalesce("error_code", F.when(own_fault, DEFAULT_ERROR)), MAX_ERROR_CODE)
            .alias("error_code"),
            fn.clip(F.coalesce(
                "error_message", F.concat(F.lit("Invalid statements: "), F.col("violation")),
                F.when(F.col("_rival"), "Another generator holds the current excerpt")),
                MAX_ERROR_MESSAGE).alias("error_message")),
        "enrichment-outcomes")
    batch = outcomes.filter(F.col("outcome") == "processed").select("resource_id")
    published = publish(statements, drafts.join(batch, "resource_id", "left_semi"), batch,
                        generator, covered, now)
    at = F.lit(now).cast("timestamp")
    done = F.col("outcome") == "processed"
    finished = outcomes.filter("recorded").select(
        F.col("resource_id").alias("subject_asset_id"),
        F.lit(generator.type).alias("extractor_type"),
        F.lit(generator.name).alias("extractor_name"),
        F.lit(generator.version).alias("extractor_version"),
        F.col("fingerprint").alias("input_fingerprint"),
        F.when(done, "completed").otherwise("failed").alias("status"), at.alias("started_at"),
        F.when(done, at).alias("completed_at"), at.alias("updated_at"),
        F.when(~done, F.col("error_code")).alias("error_code"),
        F.when(~done, F.col("error_message")).alias("error_message"))
    next_states = states.join(finished.select(*IDENTITY), IDENTITY, "left_anti").select(
        *ENRICHMENT_STATES.fieldNames()).unionByName(finished)
    totals = outcomes.agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(done).alias("processed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed")).select(
        "*", published.created.agg(F.count(F.lit(1)).alias("n")).scalar().alias("writes"),
        published.retired.agg(F.count(F.lit(1)).alias("n")).scalar().alias("deactivated"))
    return Enriched(published.statements, next_states, outcomes, totals, published, finished)


# --- lookups --------------------------------------------------------------------------------

def typed_value() -> Column:
    """The value as text for display: references formatted, times in ISO form."""
    return (
        F.when(F.col("value_type") == "resource_ref", fn.resource_ref("resource_value_asset_id"))
        .when(F.col("value_type") == "datetime",
              F.date_format("datetime_value", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .otherwise(value_text())
    )


def statement_order() -> list[Column]:
    return [F.col("predicate").asc(), *[F.col(c).asc() for c in GENERATOR],
            F.col("created_at").desc(), F.col("id").asc()]


def get_statements(statements: DataFrame, ref: str, predicate: str | None = None,
                   include_history: bool = False, limit: int = 100) -> DataFrame:
    """Statements about one resource in their stable order."""
    if predicate is not None and predicate not in PREDICATES:
        raise InvalidQuery("unknown predicate")
    check_limit(limit)
    spark = statements.sparkSession
    subject = spark.range(1).select(fn.parse_ref(F.lit(ref)).alias("id")).first()["id"]
    if subject is None:
        raise InvalidQuery("resource reference is malformed")
    rows = statements.filter(F.col("subject_asset_id") == subject)
    if predicate is not None:
        rows = rows.filter(F.col("predicate") == predicate)
    if not include_history:
        rows = rows.filter("is_current")
    return view(rows.orderBy(*statement_order()).limit(limit)).orderBy(*statement_order())


def statements_of(statements: DataFrame, subjects: DataFrame, include_history: bool = False,
                  limit: int = 100) -> DataFrame:
    """`get_statements` for many subjects (resource_id): of each the first `limit` in their stable
    order, numbered by `position`. No more than `limit` rows of a subject leave a task."""
    check_limit(limit)
    rows = statements.join(subjects.select(F.col("resource_id").alias("subject_asset_id")).distinct(),
                           "subject_asset_id", "left_semi")
    if not include_history:
        rows = rows.filter("is_current")
    place = F.row_number().over(Window.partitionBy("subject_asset_id").orderBy(*statement_order()))
    rows = rows.withColumn("position", place).filter(F.col("position") <= limit)
    return view(rows, "position")


def view(statements: DataFrame, *also: str) -> DataFrame:
    return statements.select(
        *also,
        "id", fn.resource_ref("subject_asset_id").alias("resource_ref"), "predicate",
        "value_type", typed_value().alias("value"), *GENERATOR, "source_kind", "source_locator",
        "confidence", "created_at", "is_current")


def get_state(states: DataFrame, subjects: DataFrame, generator: Generator) -> DataFrame:
    """State rows of the named subjects (resource_id) for one extractor."""
    return _state_of(states, generator).join(
        subjects.select(F.col("resource_id").alias("subject_asset_id")).distinct(),
        "subject_asset_id", "left_semi")


def claim_violations(statements: DataFrame, registry: DataFrame) -> DataFrame:
    """Subjects with more than one current value of a single-valued predicate."""
    single = registry.filter(F.col("cardinality") == "single").select("predicate")
    return (
        statements.filter("is_current").join(F.broadcast(single), "predicate", "left_semi")
        .groupBy("subject_asset_id", "predicate").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )


