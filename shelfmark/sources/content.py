"""Stored and landed content that is read for wanted keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.content import CONTENT, KEY

#: Partitions of stored content; a root keeps the number it was written with.
BUCKETS = 256
#: Files that are named one by one; more are found by reading their folder.
NAMED_FILES = 10_000


class StoredContent:
    """Content as Parquet in hash buckets of its key: other buckets' files are never opened.

    The buckets that wanted keys fall into (at most `buckets` numbers) come to the driver and
    become a partition filter.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def write(self, content: DataFrame) -> None:
        """Add content; a key that is stored already must not come again."""
        (content.select(*KEY, "content").withColumn("bucket", self.bucket())
         .repartition("bucket").sortWithinPartitions(*KEY)
         .write.mode("append").partitionBy("bucket").parquet(self.path))

    def read(self, keys: DataFrame) -> DataFrame:
        touched = [r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()]
        rows = self.spark.read.schema(CONTENT + ", bucket INT").parquet(self.path)
        return rows.filter(F.col("bucket").isin(touched)).drop("bucket")


class LandedFiles:
    """Content landed as one file a key, the file named after the percent-encoded external id.

    File names are listed without their content and matched with the wanted keys. Up to
    NAMED_FILES chosen files are then read by name; beyond that the folder is read, and what is
    not wanted is dropped before anything else happens to it.
    """

    def __init__(self, spark: SparkSession, path: str, provider: str,
                 named_files: int = NAMED_FILES) -> None:
        self.spark, self.path, self.provider, self.named = spark, path, provider, named_files

    def _files(self, *paths: str) -> DataFrame:
        files = self.spark.read.format("binaryFile").load(list(paths))
        return files.withColumn("provider", F.lit(self.provider)).withColumn(
            "external_id", F.try_url_decode(F.element_at(F.split("path", "/"), -1)))

    def read(self, keys: DataFrame) -> DataFrame:
        chosen = self._files(self.path).select("path", *KEY).join(keys, KEY, "left_semi")
        # Names are no patterns.
        plain = F.regexp_replace("path", r"([\[\]{}*?\\])", r"\\$1")
        paths = [r["p"] for r in chosen.select(plain.alias("p")).limit(self.named + 1).collect()]
        if not paths:
            return self.spark.createDataFrame([], CONTENT)
        files = self._files(*(paths if len(paths) <= self.named else [self.path]))
        return files.select(*KEY, "content")
