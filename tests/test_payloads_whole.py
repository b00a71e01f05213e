"""Payload queries over a resource of more sources than one part of a payload holds."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from shelfmark.operators import payloads as pay
from shelfmark.operators import presentation as pres

SF = "/root/testdata/sf0.001"
COPIES = pay.PART_ROWS + 100


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """The smallest tables; one text more has more copies than a part has entries."""
    folder = tmp_path_factory.mktemp("copied")
    for table in check.TABLES:
        os.symlink(f"{SF}/{table}.parquet", folder / f"{table}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = spark.range(COPIES).select(
        (F.col("id") + 1_000_000).alias("doc_id"), F.lit("one text of many copies").alias("text"),
        F.lit("en").alias("lang"), F.concat(F.lit("src"), F.pmod("id", F.lit(3)).cast("string"))
        .alias("source"), F.lit(23).cast("bigint").alias("n_chars"))
    os.remove(folder / "documents.parquet")
    docs.unionByName(copies).coalesce(1).write.parquet(f"{folder}/docs")
    part = next(f for f in os.listdir(folder / "docs") if f.endswith(".parquet"))
    os.symlink(folder / "docs" / part, folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["detail_payloads", "resource_payloads", "summary_payloads",
                                  "page_payload"])
def test_one_payload_per_resource(spark, copied, name):
    assert COPIES > max(pay.PART_ROWS, pres.SOURCES_PER_PART)
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{copied}/{table}.parquet'")
    ok, text = check.compare(spark, con, copied, name)
    assert ok, text
