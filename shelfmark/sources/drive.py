"""Landed directory listings (multistatus XML) of a file provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.schemas import FACTS
from shelfmark.session import materialise

# Element names of a listing.
PROPERTIES = ("oc:id", "oc:fileid", "d:resourcetype", "d:getcontentlength", "d:getcontenttype",
              "d:getlastmodified", "d:getetag")
_PROP = ", ".join(f"`{p}`: STRING" for p in PROPERTIES)
RESPONSE = ("`d:href` STRING, `d:propstat` ARRAY<STRUCT<`d:prop`: STRUCT<" + _PROP + ">>>")
LISTING = ("`d:response` ARRAY<STRUCT<" + RESPONSE.replace("`d:href` ", "`d:href`: ")
           .replace("`d:propstat` ", "`d:propstat`: ") + ">>")
BROKEN = "_broken"
END_TAG = "</d:multistatus"


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """(listing_path, body) of landed files named after the percent-encoded listed directory."""
    files = spark.read.option("wholetext", "true").text(path)
    return files.select(_named_after(F.input_file_name()).alias("listing_path"),
                        F.col("value").alias("body"))


def _named_after(file: Column) -> Column:
    """The listed directory from a file URI: its name is encoded once by the lander and once more
    by the URI."""
    name = F.element_at(F.split(file, "/"), -1)
    return F.try_url_decode(F.try_url_decode(F.regexp_replace(name, r"\.xml\z", "")))


def read_entries(spark: SparkSession, path: str, listing: Column | None = None) -> DataFrame:
    """(listing_path, r, broken) of landed listing files, one row per listed thing.

    Files are parsed element by element, so a listing of any length takes the memory of one entry.
    `listing` names the listed directory where it is no part of the file name.
    """
    rows = (spark.read.format("xml").schema(RESPONSE + f", {BROKEN} STRING")
            .option("rowTag", "d:response").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BROKEN).load(path))
    # Parsed once: facts and checks read the entries, not the files.
    return materialise(rows.select(
        (_named_after(F.input_file_name()) if listing is None else listing).alias("listing_path"),
        F.struct("`d:href`", "`d:propstat`").alias("r"), F.col(BROKEN).alias("broken")),
        "listing-entries")


def listing_files(spark: SparkSession, path: str, listing: Column | None = None) -> DataFrame:
    """(listing_path, whole) of every landed file: whether the document's end has landed. The
    files are read tag by tag."""
    tags = spark.read.option("lineSep", ">").text(path).select(
        (_named_after(F.input_file_name()) if listing is None else listing).alias("listing_path"),
        F.input_file_name().alias("file"), "value")
    return tags.groupBy("listing_path", "file").agg(
        F.bool_or(F.rtrim("value").endswith(END_TAG)).alias("whole")).drop("file")


def clean_href(href: Column, user: str) -> Column:
    """Percent-decoded path below the user's root; `+` is a plain character."""
    decoded = F.coalesce(F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B"))), href)
    root = f"/remote.php/dav/files/{user}/"
    return F.when(decoded.startswith(root), F.substr(decoded, F.lit(len(root) + 1))).otherwise(
        decoded)


def parsed(listings: DataFrame) -> DataFrame:
    """(listing_path, r) of listings that are texts (listing_path, body), once per directory."""
    once = listings.dropDuplicates(["listing_path"])
    return once.select("listing_path", F.explode(F.from_xml("body", LISTING)["d:response"])
                       .alias("r"))


def entries(rows: DataFrame, user: str) -> DataFrame:
    """Rows (listing_path, r) as listed things, without the row of the directory itself."""
    prop = F.get(F.col("r")["d:propstat"], F.lit(0))["d:prop"]
    rows = rows.select(
        "listing_path", F.col("r")["d:href"].alias("href"),
        clean_href(F.col("r")["d:href"], user).alias("path"),
        *[F.nullif(prop[p], F.lit("")).alias(p.split(":")[1]) for p in PROPERTIES])
    return rows.filter(_bare(F.col("path")) != _bare(F.col("listing_path")))


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, r"\A/+|/+\z", "")


def drive_facts(listings: DataFrame, user: str, provider: str = "nextcloud") -> DataFrame:
    """FACTS of listings that are texts; a row without an id stays with a null external_id."""
    return entry_facts(parsed(listings), user, provider)


def entry_facts(rows: DataFrame, user: str, provider: str = "nextcloud") -> DataFrame:
    """FACTS of listed things (listing_path, r), numbered in the order of directories and paths."""
    folder = F.coalesce(F.col("resourcetype").contains("collection"), F.lit(False))
    name = F.element_at(F.split(F.regexp_replace("path", r"/+\z", ""), "/"), -1)
    raw = F.to_json(
        F.struct(F.col("fileid").alias("file_id"), "getlastmodified", "href",
                 folder.alias("is_collection"), F.col("id").alias("oc_id")),
        {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    order = ["listing_path", "path", "id"]
    # Sorted by range, so the numbers rise with the order; written once, so they stay.
    named = entries(rows, user).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(named.select(
        F.monotonically_increasing_id().alias("ordinal"), F.lit(provider).alias("provider"),
        F.when(folder, "folder").otherwise("file").alias("kind"), F.col("id").alias("external_id"),
        name.alias("name"), "path", F.col("getcontentlength").try_cast("bigint").alias("size"),
        F.col("getcontenttype").alias("mime_type"), F.col("getlastmodified").alias("modified_at"),
        F.col("getetag").alias("version_tag"), none.alias("content_hash"), raw.alias("raw"),
        F.lit(None).cast("timestamp").alias("observed_at")).select(*FACTS.fieldNames()),
        "listed-facts")


def _problems(*found: DataFrame) -> DataFrame:
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _problem(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("listing_path", F.lit(name).alias("problem")).distinct()


def _entry_problems(rows: DataFrame, files: DataFrame, user: str) -> list[DataFrame]:
    """What is wrong with listed things (listing_path, r) of the listings `files`."""
    named = entries(rows, user)
    size = F.col("getcontentlength")
    return [
        _problem(files.groupBy("listing_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
                 "listed twice"),
        _problem(rows.filter(F.coalesce(F.col("r")["d:href"], F.lit("")) == ""),
                 "entry without place"),
        _problem(named.filter(F.col("id").isNull()), "entry without id"),
        _problem(named.filter(size.isNotNull() & size.try_cast("bigint").isNull()),
                 "entry with a broken size"),
        _problem(_unlisted(named, files).withColumnRenamed("folder", "listing_path"),
                 "folder without listing"),
    ]


def listing_problems(listings: DataFrame, user: str) -> DataFrame:
    """(listing_path, problem): what keeps landed listings from being a whole inventory.

    A listing that cannot be read, is landed twice, names something without a place, an id or a
    readable size, or names a folder that has no listing of its own.
    """
    bodies = listings.select("listing_path", F.from_xml("body", LISTING)["d:response"].alias("r"))
    rows = bodies.select("listing_path", F.explode("r").alias("r"))
    return _problems(_problem(bodies.filter(F.col("r").isNull()), "broken listing"),
                     *_entry_problems(rows, listings, user))


def file_problems(rows: DataFrame, files: DataFrame, user: str) -> DataFrame:
    """As `listing_problems`, for listings read entry by entry: a listing is broken too if an entry
    of it is, if it has none, or if its end has not landed."""
    good = rows.filter(F.col("broken").isNull()).select("listing_path", "r")
    return _problems(
        _problem(rows.filter(F.col("broken").isNotNull()), "broken listing"),
        _problem(files.filter("NOT whole"), "broken listing"),
        _problem(files.join(rows.select("listing_path").distinct(), "listing_path", "left_anti"),
                 "broken listing"),
        *_entry_problems(good, files, user)).distinct()


def unlisted_folders(listings: DataFrame, user: str) -> DataFrame:
    """Folders that some listing names but that have no landed listing of their own."""
    return _unlisted(entries(parsed(listings), user), listings)


def _unlisted(named: DataFrame, files: DataFrame) -> DataFrame:
    folders = named.filter(F.coalesce(F.col("resourcetype").contains("collection"), F.lit(False)))
    return folders.select(_bare(F.col("path")).alias("folder")).distinct().join(
        files.select(_bare(F.col("listing_path")).alias("folder")).distinct(),
        "folder", "left_anti")
