"""Landed responses of a photo provider: inventory, people, relations and semantic hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import functions as fn
from shelfmark.schemas import FACTS

# Items stay JSON text: their fields are checked by JSON type, which a schema would coerce.
PAGE = T.StructType([
    T.StructField("page", T.LongType()),
    T.StructField("assets", T.StructType([
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("nextPage", T.StringType()),
        T.StructField("total", T.LongType()),
    ])),
])
PEOPLE_PAGE = T.StructType([
    T.StructField("page", T.LongType()),
    T.StructField("people", T.ArrayType(T.StructType([T.StructField("id", T.StringType())]))),
    T.StructField("total", T.LongType()),
    T.StructField("hasNextPage", T.BooleanType()),
])
RELATION_PAGE = T.StructType([
    T.StructField("personId", T.StringType()),
    T.StructField("page", T.LongType()),
    T.StructField("assets", PAGE["assets"].dataType),
])
#: Places of a page; an array holds fewer.
PAGE_SHIFT = 1 << 32


def read_pages(spark: SparkSession, path: str, schema: T.StructType = PAGE) -> DataFrame:
    """One JSON document per landed file, each carrying the page number it was asked for."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def parse_pages(texts: DataFrame, schema: T.StructType = PAGE) -> DataFrame:
    """Pages that arrive as text (column `body`) instead of files."""
    return texts.select(F.from_json("body", schema).alias("p")).select("p.*")


def _items(pages: DataFrame) -> DataFrame:
    return pages.select("page", F.posexplode("assets.items").alias("place", "item")).select(
        (F.col("page") * PAGE_SHIFT + F.col("place")).alias("ordinal"), "item")


def photo_facts(pages: DataFrame, provider: str = "immich") -> DataFrame:
    """FACTS of an inventory. An item without a usable id stays, with a null external_id, and
    is rejected by the reconcile."""
    doc = F.try_parse_json("item")

    def text(field: str) -> Column:
        return fn.json_string("item", f"$.{field}")

    def value(field: str) -> Column:
        return F.try_variant_get(doc, f"$.{field}", "variant")

    checksum = text("checksum")
    exif = F.when(fn.json_kind("item", "$.exifInfo").startswith("OBJECT"), value("exifInfo"))
    size = F.to_json(value("exifInfo.fileSizeInByte"))
    raw = F.struct(
        value("isArchived").alias("archived"), checksum.alias("checksum"),
        F.when(checksum.isNotNull(), "sha1").alias("checksum_algorithm"),
        F.when(checksum.isNotNull(), "base64").alias("checksum_encoding"),
        value("duration").alias("duration"),
        F.coalesce(exif, F.parse_json(F.lit("{}"))).alias("exif"),
        value("isFavorite").alias("favorite"), value("fileModifiedAt").alias("fileModifiedAt"),
        value("height").alias("height"), value("isEdited").alias("isEdited"),
        value("isTrashed").alias("trashed"), value("visibility").alias("visibility"),
        value("width").alias("width"))
    none = F.lit(None).cast("string")
    return _items(pages).select(
        "ordinal", F.lit(provider).alias("provider"), F.lit("file").alias("kind"),
        F.nullif(text("id"), F.lit("")).alias("external_id"),
        text("originalFileName").alias("name"), text("originalPath").alias("path"),
        fn.fact_size(size).alias("size"), text("originalMimeType").alias("mime_type"),
        text("fileModifiedAt").alias("modified_at"), text("updatedAt").alias("version_tag"),
        none.alias("content_hash"), F.to_json(raw, {"ignoreNullFields": "false"}).alias("raw"),
        F.lit(None).cast("timestamp").alias("observed_at")).select(*FACTS.fieldNames())


def people_inventory(pages: DataFrame) -> DataFrame:
    """(external_id) of every listed person; repeated or blank ids are for the checks to find."""
    return pages.select(F.explode("people").alias("p")).select(F.col("p.id").alias("external_id"))


def observed_pairs(pages: DataFrame) -> DataFrame:
    """Distinct (asset_external_id, person_external_id) of relation pages."""
    rows = pages.select(F.col("personId").alias("person_external_id"),
                        F.explode("assets.items").alias("item"))
    return rows.select(fn.json_string("item", "$.id").alias("asset_external_id"),
                       "person_external_id").dropDuplicates()


def semantic_hits(responses: DataFrame) -> DataFrame:
    """Ranked hits from responses (query_id, body): rank is the place in the list, and of a
    locator listed twice only the first place counts, so ranks may have gaps."""
    items = F.from_json("body", "assets STRUCT<items: ARRAY<STRUCT<id: STRING>>>")["assets"]["items"]
    places = responses.select("query_id", F.posexplode(items).alias("place", "item"))
    return places.groupBy("query_id", F.col("item.id").alias("locator")).agg(
        (F.min("place") + 1).alias("rank"))


def page_chain(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Inventory pages as links for the completeness gate: (listing, page, next, total)."""
    listing = F.concat_ws("/", *keys) if keys else F.lit("")
    return pages.select(
        listing.alias("listing"), F.col("page").cast("string").alias("page"),
        F.nullif("assets.nextPage", F.lit("")).alias("next"),
        F.col("assets.total").alias("total"))


def people_chain(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.lit("").alias("listing"), F.col("page").cast("string").alias("page"),
        F.when(F.col("hasNextPage"), (F.col("page") + 1).cast("string")).alias("next"), "total")
