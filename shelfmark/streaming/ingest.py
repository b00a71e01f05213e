"""Incremental ingest: landed inventory pages become changes of the live catalog."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import reconcile as rec
from shelfmark.session import materialise
from shelfmark.sources import gate, photos, tables


SEEN = "provider STRING, external_id STRING, stream STRING, batch BIGINT"
LINKS = "listing STRING, page STRING, next STRING, total BIGINT, stream STRING, batch BIGINT"


def _landed(spark: SparkSession, root: str, name: str, schema: str, stream: str) -> DataFrame:
    """What the batches of a stream have landed so far."""
    path = f"{root}/inventory/{name}"
    if not tables.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(F.col("stream") == stream)


def _keep(rows: DataFrame, root: str, name: str, stream: str, batch: int) -> None:
    """Keep a batch's part of an inventory; a repeated batch replaces its own part only."""
    (rows.withColumn("stream", F.lit(stream)).withColumn("batch", F.lit(batch).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("stream", "batch").parquet(f"{root}/inventory/{name}"))


def open_inventory(spark: SparkSession, root: str, stream: str, batch: int, first: str = "1"
                   ) -> tuple[DataFrame, DataFrame] | None:
    """Links and keys of the inventory that a batch belongs to, from the batch with its first page
    up to this one; None if no first page has landed."""
    links = _landed(spark, root, "links", LINKS, stream).filter(F.col("batch") <= batch)
    begun = links.filter(F.col("page") == first).agg(F.max("batch").alias("b")).first()["b"]
    if begun is None:
        return None
    keys = _landed(spark, root, "seen", SEEN, stream).filter(F.col("batch") <= batch)
    return (links.filter(F.col("batch") >= begun).drop("stream", "batch"),
            keys.filter(F.col("batch") >= begun).select("provider", "external_id"))


def ingest_batch(pages: DataFrame, batch: int, root: str, stream: str,
                 to_facts=photos.photo_facts, to_links=photos.page_chain, content=None,
                 now: datetime | None = None) -> None:
    """Reconcile one batch of pages with the live catalog and commit what it changes, once.

    A batch is known by its stream and its number in it: another stream, or one that begins anew
    after its checkpoint was lost, counts its own.

    An inventory may land over several batches. It begins with the batch that holds its first
    page; the keys seen and the page links are kept per batch. Missing sources are deactivated by
    the batch with which the links become one unbroken chain to its last page, against the keys of
    all its batches. Every other batch adds and updates only.
    """
    spark = pages.sparkSession
    if tables.worked_in(spark, root, stream, batch) is not None:
        return
    pages = materialise(pages, "landed-pages")
    if pages.first() is None:
        return
    catalog = tables.read_catalog(spark, root)
    facts = to_facts(pages)
    _keep(to_links(pages).select("listing", "page", "next", "total"), root, "links", stream, batch)
    _keep(facts.select("provider", "external_id"), root, "seen", stream, batch)
    whole = open_inventory(spark, root, stream, batch)
    complete = whole is not None and gate.is_complete(whole[0])
    bytes_ = content(spark) if content is not None else None
    result = rec.sync_provider(facts, catalog, now or datetime.now(timezone.utc), bytes_, complete,
                               seen=whole[1] if complete else None)
    tables.commit_changes(spark, root, result.changes._asdict(), stream, batch)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gives a query when its checkpoint begins."""
    row = spark.read.json(f"{checkpoint.rstrip('/')}/metadata").select("id").first()
    return row["id"]


def ingest_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, content=None,
                  schema=photos.PAGE, now: datetime | None = None, multi_line: bool = True,
                  **adapter):
    """Start a stream over a landing folder of inventory pages: one page per file, or with
    `multi_line=False` one page per line. It stops when everything landed is worked in."""
    pages = spark.readStream.schema(schema).option("multiLine", multi_line).json(landing)
    return (
        pages.writeStream.foreachBatch(
            lambda df, batch: ingest_batch(df, batch, root, _stream_id(spark, checkpoint),
                                           content=content, now=now, **adapter))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
