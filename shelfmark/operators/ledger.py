"""The run ledger: fold run events, recover interrupted runs, report freshness."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.schemas import RUNS

# Fixed values.
INTERRUPTED = "interrupted_previous_run"
# Provider, display name, category, its sync job, its enrichment jobs.
PROVIDERS = (
    ("gmail", "Gmail", "Messages", "provider.gmail.sync", ("enrichment.gmail_metadata",)),
    ("immich", "Immich", "Photos", "provider.immich.sync",
     ("enrichment.file_metadata", "enrichment.immich_geo", "enrichment.immich_metadata",
      "enrichment.immich_ocr")),
    ("nextcloud", "Nextcloud", "Files", "provider.nextcloud.sync",
     ("enrichment.nextcloud_text", "enrichment.nextcloud_documents",
      "enrichment.file_metadata")),
)


class Folded(NamedTuple):
    runs: DataFrame
    illegal: DataFrame


def fold_runs(log: DataFrame) -> Folded:
    """Runs from log rows (run_id, seq, event begin|complete|fail, pipeline_key, kind, at,
    error_code). Only the first terminal event after the begin moves a run; others are illegal.
    """
    begins = log.filter(F.col("event") == "begin").groupBy("run_id").agg(
        F.min(F.struct("seq", "pipeline_key", "kind", F.col("at").alias("started_at"))).alias("b"))
    ends = (
        log.filter(F.col("event") != "begin").join(begins, "run_id")
        .filter(F.col("seq") > F.col("b.seq")).groupBy("run_id").agg(
            F.min(F.struct("seq", "event", "at", "error_code")).alias("e"))
    )
    runs = begins.join(ends, "run_id", "left").select(
        F.col("run_id").alias("id"), F.col("b.pipeline_key").alias("pipeline_key"),
        F.col("b.kind").alias("kind"),
        F.when(F.col("e").isNull(), "running").when(F.col("e.event") == "complete", "completed")
        .otherwise("failed").alias("status"),
        F.col("b.started_at").alias("started_at"), F.col("e.at").alias("finished_at"),
        F.when(F.col("e.event") == "fail", F.col("e.error_code")).alias("error_code"))
    legal = begins.select("run_id", F.col("b.seq").alias("seq")).unionByName(
        ends.select("run_id", F.col("e.seq").alias("seq")))
    return Folded(runs.select(*RUNS.fieldNames()), log.join(legal, ["run_id", "seq"], "left_anti"))


def fail_interrupted(runs: DataFrame, keys: DataFrame, now: datetime) -> DataFrame:
    """Runs of the given jobs (pipeline_key) still marked running become failed."""
    asked = keys.select("pipeline_key", F.lit(True).alias("_asked")).distinct()
    hit = F.coalesce("_asked", F.lit(False)) & (F.col("status") == "running")
    at = F.lit(now).cast("timestamp")
    return runs.join(asked, "pipeline_key", "left").select(
        "id", "pipeline_key", "kind", F.when(hit, "failed").otherwise(F.col("status"))
        .alias("status"), "started_at", F.when(hit, at).otherwise(F.col("finished_at"))
        .alias("finished_at"), F.when(hit, INTERRUPTED).otherwise(F.col("error_code"))
        .alias("error_code"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of every job (ties: lowest id); an aggregate, so a busy job's rows
    combine before the shuffle."""
    newest = F.struct(-F.unix_micros("started_at"), F.col("id"))
    return runs.groupBy("pipeline_key").agg(F.min_by(
        F.struct("id", "status", "started_at", "finished_at", "error_code"), newest).alias("r")
    ).select("pipeline_key", "r.*")


def last_successes(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") == "completed").groupBy("pipeline_key").agg(
        F.max("finished_at").alias("last_success_at"))


def job_status(runs: DataFrame, jobs: DataFrame, now: datetime) -> DataFrame:
    """Freshness of every job of the dimension (position, pipeline_key, kind, dependencies)."""
    at = F.lit(now).cast("timestamp")
    success = last_successes(runs)
    latest = latest_runs(runs).select(
        "pipeline_key", F.col("status").alias("latest_status"),
        F.col("started_at").alias("latest_started_at"),
        F.col("finished_at").alias("latest_finished_at"),
        F.col("error_code").alias("latest_error_code"))
    needs = jobs.select("pipeline_key", F.explode("dependencies").alias("dependency"))
    own = success.withColumnRenamed("last_success_at", "own")
    theirs = success.select(F.col("pipeline_key").alias("dependency"),
                            F.col("last_success_at").alias("theirs"))
    validated = (
        needs.join(own, "pipeline_key", "left").join(theirs, "dependency", "left")
        .groupBy("pipeline_key").agg(F.bool_and(F.coalesce(
            F.col("own") >= F.col("theirs"), F.lit(False))).alias("validated_after_dependencies"))
    )
    last = F.col("last_success_at")
    age = F.when(last <= at, (F.unix_micros(at) - F.unix_micros(last)) / F.lit(1e6))
    return (
        jobs.select("position", "pipeline_key", "kind", "dependencies")
        .join(latest, "pipeline_key", "left").join(success, "pipeline_key", "left")
        .join(validated, "pipeline_key", "left")
        .withColumn("success_age_seconds", age)
        .select("position", "pipeline_key", "kind", "latest_status", "latest_started_at",
                "latest_finished_at", "latest_error_code", "last_success_at",
                "success_age_seconds", "dependencies", "validated_after_dependencies")
    )


def provider_table(spark, providers=PROVIDERS) -> DataFrame:
    return spark.createDataFrame(
        [(p, name, category, sync, list(jobs)) for p, name, category, sync, jobs in providers],
        "provider STRING, display_name STRING, category STRING, sync_key STRING, "
        "job_keys ARRAY<STRING>")


def provider_state(status: DataFrame, counts: DataFrame, providers: DataFrame,
                   configured: Column | None = None) -> DataFrame:
    """Operational state and resource count per provider; `counts` has (bucket, bucket_count)."""
    configured = configured if configured is not None else F.lit(True)
    view = status.select("pipeline_key", "latest_status", "last_success_at",
                         "validated_after_dependencies")
    sync = view.select(F.col("pipeline_key").alias("sync_key"), F.col("latest_status")
                       .alias("sync_status"), "last_success_at",
                       F.col("validated_after_dependencies").alias("sync_valid"))
    jobs = (
        providers.select("provider", F.explode("job_keys").alias("pipeline_key"))
        .join(view.drop("last_success_at"), "pipeline_key").groupBy("provider").agg(
            F.bool_or(F.coalesce(F.col("latest_status") == "running", F.lit(False)))
            .alias("any_running"),
            F.bool_or(F.coalesce(F.col("latest_status") == "failed", F.lit(False))
                      | F.coalesce(~F.col("validated_after_dependencies"), F.lit(False)))
            .alias("any_trouble"))
    )
    sizes = counts.groupBy(F.lower("bucket").alias("provider")).agg(
        F.max("bucket_count").alias("resource_count"))
    trouble = (F.coalesce("any_trouble", F.lit(False))
               | F.coalesce(F.col("sync_status") == "failed", F.lit(False))
               | F.coalesce(~F.col("sync_valid"), F.lit(False)))
    state = (
        F.when(~configured | F.col("last_success_at").isNull(), "not_synced")
        .when(F.col("sync_status") == "running", "syncing")
        .when(F.coalesce("any_running", F.lit(False)), "processing")
        .when(trouble, "attention").otherwise("ready")
    )
    return (
        providers.join(sync, "sync_key", "left").join(jobs, "provider", "left")
        .join(sizes, "provider", "left")
        .select("provider", "display_name", "category", state.alias("operational_state"),
                F.coalesce("resource_count", F.lit(0)).cast("bigint").alias("resource_count"),
                F.when(configured, F.col("last_success_at")).alias("last_success_at"))
        .orderBy("provider")
    )


def stage_vector(states: DataFrame) -> DataFrame:
    """The three stages a provider's records pass through, one row each."""
    state = F.col("operational_state")

    def stage(position: int, name: str, done: tuple[str, ...], current: str | None) -> Column:
        value = F.when(state.isin(*done), "completed")
        if current is not None:
            value = value.when(state == current, "current").when(state == "attention", "attention")
        return F.struct(F.lit(position).alias("position"), F.lit(name).alias("stage"),
                        value.otherwise("pending").alias("stage_state"))

    return states.select("provider", F.inline(F.array(
        stage(1, "Source sync", ("processing", "ready"), "syncing"),
        stage(2, "Resource processing", ("ready",), "processing"),
        stage(3, "Available", ("ready",), None))))
