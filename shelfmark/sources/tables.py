"""The stored catalog, in one of two plain layouts of Parquet folders.

Versions: every commit writes whole tables to a fresh folder, so older versions stay readable.
Live tables: rows lie in hash buckets of their key, one partition each, and a commit overwrites
only the buckets that its rows fall into. What a small batch writes then follows the batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.publish import IDENTITY, Published
from shelfmark.schemas import TABLES, Catalog
from shelfmark.session import materialise

# Sources are asked for by activity and provider, statements by currency and predicate.
LAYOUT = {"sources": ["is_active"], "statements": ["is_current"]}
COMMITS = "commits"
_COMMIT = ("version BIGINT, run STRING, tables ARRAY<STRING>, committed_at TIMESTAMP, "
           "stream STRING, batch BIGINT")


def _place(spark: SparkSession, path: str):
    """(file system, path) of any path that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def read_table(spark: SparkSession, path: str, name: str, folder: str | None = None) -> DataFrame:
    rows = spark.read.schema(TABLES[name]).parquet(f"{path}/{folder or name}")
    return rows.select(*TABLES[name].fieldNames())  # without the partitions it is stored in


def commits(spark: SparkSession, root: str) -> DataFrame:
    """Commit rows of a catalog root; empty for one nothing was committed to."""
    if not exists(spark, f"{root}/{COMMITS}"):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).parquet(f"{root}/{COMMITS}")


def current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(version, folder) of the newest commit."""
    row = commits(spark, root).orderBy(F.col("version").desc(), "run").first()
    return None if row is None else (row["version"], f"{root}/{row['run']}")


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    newest = commits(spark, root).orderBy(F.col("version").desc(), "run").first()
    if newest is None:
        return {}
    return {n: read_table(spark, f"{root}/{newest['run']}", n) for n in newest["tables"]}


def read_catalog(spark: SparkSession, root: str) -> Catalog:
    """The newest catalog; a table that nothing was committed to is empty."""
    return Catalog(**{**Catalog.empty(spark)._asdict(), **{
        name: df for name, df in read_tables(spark, root).items() if name in Catalog._fields}})


def worked_in(spark: SparkSession, root: str, stream: str, batch: int) -> str | None:
    """The folder that a batch of a stream was committed to, if it was."""
    row = commits(spark, root).filter(
        (F.col("stream") == stream) & (F.col("batch") == batch)).first()
    return None if row is None else f"{root}/{row['run']}"


def write_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame],
                 stream: str | None = None, batch: int | None = None) -> str:
    """Write every table to a fresh folder, then make it the next version with one commit row.

    A batch of a stream that is already committed is left as it is, so a repeated batch changes
    nothing; batch numbers of other streams are other batches. A run that dies before its commit
    row leaves only an unused folder. One writer at a time.
    """
    if stream is not None:
        done = worked_in(spark, root, stream, batch)
        if done is not None:
            return done
    newest = current(spark, root)
    version = 1 if newest is None else newest[0] + 1
    run = f"run-{version:012d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df.select(*TABLES[name].fieldNames()).write
        if name in LAYOUT:
            writer = writer.partitionBy(*LAYOUT[name])
        writer.parquet(f"{root}/{run}/{name}")
    _commit_row(spark, root, version, run, list(tables), stream, batch)
    return f"{root}/{run}"


def _commit_row(spark: SparkSession, root: str, version: int, run: str, names: list[str],
                stream: str | None, batch: int | None) -> None:
    spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"), F.lit(run).alias("run"),
        F.array(*[F.lit(n) for n in names]).alias("tables"),
        F.current_timestamp().alias("committed_at"),
        F.lit(stream).cast("string").alias("stream"),
        F.lit(batch).cast("bigint").alias("batch")).coalesce(1).write.mode("append").parquet(
        f"{root}/{COMMITS}")


# --- live tables ----------------------------------------------------------------------------

LIVE = "live"
#: Partitions of a live table; a root keeps the number it began with.
BUCKETS = 64
KEYS = {"resources": ["id"], "blobs": ["id"], "sources": ["id"], "statements": ["id"],
        "enrichment_states": IDENTITY}


def bucket_of(name: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(buckets)).cast("int")


def _live(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A live table with its bucket; empty if nothing was merged yet."""
    schema = T.StructType([*TABLES[name].fields, T.StructField("bucket", T.IntegerType())])
    path = f"{root}/{LIVE}/{name}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def merge(spark: SparkSession, root: str, name: str, rows: DataFrame,
          removed: DataFrame | None = None, buckets: int = BUCKETS) -> list[int]:
    """Insert or replace rows of a live table by key and remove those with the keys `removed`;
    returns the buckets that were written, at most `buckets` numbers.

    The new content of the touched buckets is written to the shared folder before they are
    overwritten, so a lost executor costs a re-read. Merging the same rows again changes nothing.
    Readers of the touched buckets may have to start again; one writer at a time.
    """
    key, names = KEYS[name], TABLES[name].fieldNames()
    own = bucket_of(name, buckets)
    rows = materialise(rows.select(*names).withColumn("bucket", own), f"merge-{name}")
    gone = rows.select(*key, "bucket")
    if removed is not None:
        gone = gone.unionByName(materialise(
            removed.select(*key).withColumn("bucket", own), f"remove-{name}"))
    touched = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect())
    if not touched:
        return []
    old = _live(spark, root, name).filter(F.col("bucket").isin(touched))
    after = materialise(old.join(gone.drop("bucket"), key, "left_anti").select(
        *names, "bucket").unionByName(rows), f"merged-{name}")
    filled = {r["bucket"] for r in after.select("bucket").distinct().collect()}
    path = f"{root}/{LIVE}/{name}"
    # Large buckets are split into files by AQE.
    (after.hint("rebalance", "bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    for bucket in sorted(set(touched) - filled):
        files, place = _place(spark, f"{path}/bucket={bucket}")
        files.delete(place, True)
    return touched


def commit_changes(spark: SparkSession, root: str, changes: dict[str, DataFrame],
                   stream: str | None = None, batch: int | None = None) -> dict[str, list[int]]:
    """Merge changed rows into the live tables, then record the commit; returns the buckets.

    A root that so far had versions only gets its live tables from the newest one. A batch of a
    stream that is already committed is left as it is. A run that dies between two tables is
    repaired by running its batch again: ids follow from the facts, so the same rows come out.
    """
    if stream is not None and worked_in(spark, root, stream, batch) is not None:
        return {}
    newest = commits(spark, root).orderBy(F.col("version").desc(), "run").first()
    if newest is not None and newest["run"] != LIVE:
        for name in newest["tables"]:
            if name in KEYS:
                merge(spark, root, name, read_table(spark, f"{root}/{newest['run']}", name))
    written = {name: merge(spark, root, name, rows) for name, rows in changes.items()}
    names = sorted({*changes, *(newest["tables"] if newest is not None else [])} & set(KEYS))
    for name in names:
        if not exists(spark, f"{root}/{LIVE}/{name}"):
            spark.createDataFrame([], TABLES[name]).write.parquet(f"{root}/{LIVE}/{name}")
    _commit_row(spark, root, 1 if newest is None else newest["version"] + 1, LIVE, names, stream,
                batch)
    return written


HISTORY = "statement_history"


def commit_statements(spark: SparkSession, root: str, published: Published, commit: str
                      ) -> list[int]:
    """Store what a publication changes: ended statements move from the live table to the
    history, which only grows; `commit` names the publication, so repeating it adds nothing."""
    ended = published.retired.withColumn("is_current", F.lit(False)).withColumn(
        "commit", F.lit(commit))
    (ended.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("commit").parquet(f"{root}/{HISTORY}"))
    return merge(spark, root, "statements", published.created, published.retired)


def read_statements(spark: SparkSession, root: str, history: bool = False) -> DataFrame:
    """Current statements, with `history` the ended ones too."""
    rows = _live(spark, root, "statements").drop("bucket")
    if history and exists(spark, f"{root}/{HISTORY}"):
        rows = rows.unionByName(read_table(spark, root, "statements", HISTORY))
    return rows


def read_states(spark: SparkSession, root: str) -> DataFrame:
    return _live(spark, root, "enrichment_states").drop("bucket")


def write_json(df: DataFrame, path: str) -> None:
    """Payload rows (column `payload`) as JSON lines."""
    df.select("payload").write.text(path)


def backfill_resource_type(old: DataFrame, value: str = "file") -> DataFrame:
    """Resources of the schema before typed resources: every row gets the one type there was."""
    filled = old.withColumn("resource_type", F.lit(value))
    return filled.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES["resources"].fields])


def read_content(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """(provider, external_id, content) of landed files named by their external id."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.lit(provider).alias("provider"), F.try_url_decode(
        F.element_at(F.split("path", "/"), -1)).alias("external_id"), "content")
