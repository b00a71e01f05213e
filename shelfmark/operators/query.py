"""Read queries over the catalog: filters, pages, search, aggregation and detail.

A resource qualifies only if one active source, together with its own content, satisfies every
source-level filter. Sources are reduced to distinct content ids before any join, so many
copies of one content cost one row in the shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.schemas import RESOURCE_TYPES, Catalog

# Bounds of the read queries.
DEFAULT_DAYS = 30
DEFAULT_LIMIT = 50
MAX_LIMIT = 100
BUCKET_LIMIT = 100
MAX_GROUPED_DAYS = 366
GROUPINGS = ("provider", "day", "mime_type", "mime_category")


class InvalidQuery(ValueError):
    """An argument is outside what the query accepts."""


def _text(value, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise InvalidQuery(f"{name} must be non-empty")
    return value.strip()


def instant(value: datetime | None, name: str) -> datetime | None:
    if value is None:
        return None
    if not isinstance(value, datetime) or value.utcoffset() is None:
        raise InvalidQuery(f"{name} must be a timezone-aware datetime")
    return value.astimezone(timezone.utc)


def check_limit(limit, top: int = MAX_LIMIT) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= top:
        raise InvalidQuery(f"limit must be between 1 and {top}")
    return limit


@dataclass(frozen=True)
class Filters:
    provider: str | None = None
    resource_type: str | None = None
    mime_type: str | None = None
    mime_category: str | None = None
    path_prefix: str | None = None

    def __post_init__(self) -> None:
        for name in self.__dataclass_fields__:
            value = getattr(self, name)
            if value is not None:
                object.__setattr__(self, name, _text(value, name))
        if self.mime_type is not None and self.mime_category is not None:
            raise InvalidQuery("mime_type and mime_category cannot be combined")
        if self.mime_category is not None:
            if "/" in self.mime_category:
                raise InvalidQuery("mime_category must not contain /")
            object.__setattr__(self, "mime_category", self.mime_category.lower())
        if self.resource_type is not None and self.resource_type not in RESOURCE_TYPES:
            raise InvalidQuery("unknown resource_type")

    @property
    def on_source(self) -> bool:
        return any((self.provider, self.mime_type, self.mime_category, self.path_prefix))


@dataclass(frozen=True)
class Period:
    """Half-open [observed_from, observed_to)."""

    observed_from: datetime | None = None
    observed_to: datetime | None = None

    def __post_init__(self) -> None:
        for name in ("observed_from", "observed_to"):
            object.__setattr__(self, name, instant(getattr(self, name), name))
        if self.observed_from and self.observed_to and self.observed_from >= self.observed_to:
            raise InvalidQuery("observed_from must be earlier than observed_to")

    def matches(self, created: Column) -> Column:
        test = F.lit(True)
        if self.observed_from is not None:
            test = test & (created >= F.lit(self.observed_from))
        if self.observed_to is not None:
            test = test & (created < F.lit(self.observed_to))
        return test


# --- eligibility ----------------------------------------------------------------------------

def eligible_contents(catalog: Catalog, filters: Filters, keep: list[str] | None = None,
                      text: str | None = None) -> DataFrame:
    """Distinct (resource_id, mime_type, *keep) with an active source that passes the filters.

    `keep` names source columns; with `text` the source's name or path must contain it.
    """
    keep = keep or []
    sources = catalog.sources.filter("is_active")
    if filters.provider is not None:
        sources = sources.filter(F.col("provider") == filters.provider)
    if filters.path_prefix is not None:
        sources = sources.filter(fn.startswith_ci(F.col("path"), filters.path_prefix))
    if text is not None:
        sources = sources.filter(
            fn.contains_ci(F.coalesce("name", F.lit("")), text)
            | fn.contains_ci(F.coalesce("path", F.lit("")), text))
    blobs = catalog.blobs
    if filters.mime_type is not None:
        blobs = blobs.filter(F.col("mime_type") == filters.mime_type)
    if filters.mime_category is not None:
        blobs = blobs.filter(fn.mime_category("mime_type") == filters.mime_category)
    blobs = blobs.select(F.col("id").alias("blob_id"), F.col("asset_id").alias("resource_id"),
                         "mime_type")
    return sources.select("blob_id", *keep).distinct().join(blobs, "blob_id").drop("blob_id")


def eligible_resources(catalog: Catalog, filters: Filters, text: str | None = None) -> DataFrame:
    return eligible_contents(catalog, filters, text=text).select("resource_id").distinct()


def matching_resources(catalog: Catalog, filters: Filters, period: Period) -> DataFrame:
    """Resource rows that pass the type, time and source filters."""
    rows = catalog.resources.filter(period.matches(F.col("created_at")))
    if filters.resource_type is not None:
        rows = rows.filter(F.col("resource_type") == filters.resource_type)
    eligible = eligible_resources(catalog, filters)
    return rows.join(eligible, rows.id == eligible.resource_id, "left_semi")


# --- aggregation ----------------------------------------------------------------------------

def _check_grouping(group_by: str | None, period: Period) -> None:
    if group_by is not None and group_by not in GROUPINGS:
        raise InvalidQuery("unknown group_by")
    if group_by == "day":
        if period.observed_from is None or period.observed_to is None:
            raise InvalidQuery("day grouping needs both bounds")
        if period.observed_to - period.observed_from > timedelta(days=MAX_GROUPED_DAYS):
            raise InvalidQuery(f"day grouping is limited to {MAX_GROUPED_DAYS} days")


def aggregate(catalog: Catalog, filters: Filters = Filters(), period: Period = Period(),
              group_by: str | None = None, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Count distinct qualifying resources, in total or per bucket.

    Ungrouped: one row (total_count). Grouped: (bucket, bucket_count, total_count, truncated);
    a resource counts once in every bucket one of its qualifying sources falls into.
    """
    _check_grouping(group_by, period)
    if group_by is None:
        return matching_resources(catalog, filters, period).agg(
            F.count(F.lit(1)).alias("total_count"))
    if group_by == "day":
        pairs = matching_resources(catalog, filters, period).select(
            F.col("id").alias("resource_id"),
            F.date_format("created_at", "yyyy-MM-dd").alias("bucket"))
    else:
        bucket = {
            "provider": F.col("provider"),
            "mime_type": F.when(F.coalesce("mime_type", F.lit("")) == "", "unknown")
            .otherwise(F.col("mime_type")),
            "mime_category": fn.mime_category("mime_type"),
        }[group_by]
        rows = catalog.resources.filter(period.matches(F.col("created_at")))
        if filters.resource_type is not None:
            rows = rows.filter(F.col("resource_type") == filters.resource_type)
        keep = ["provider"] if group_by == "provider" else []
        pairs = (
            eligible_contents(catalog, filters, keep)
            .select("resource_id", bucket.alias("bucket"))
            .join(rows.select(F.col("id").alias("resource_id")), "resource_id", "left_semi")
        )
    # The rollup's grand total counts each resource once; sorted first, it travels with the top-k.
    counts = pairs.rollup("bucket").agg(
        F.count_distinct("resource_id").alias("bucket_count"), F.grouping_id().alias("_total"))
    order = [F.col("_total").desc(), F.col("bucket").asc()]
    if group_by != "day":
        order.insert(1, F.col("bucket_count").desc())
    # One bucket more than shown tells whether the list was cut; the windows see this top-k only.
    top = counts.orderBy(*order).limit(bucket_limit + 2)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing)
    return (
        top.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
        .withColumn("total_count", F.max(F.when(F.col("_total") == 1, F.col("bucket_count")))
                    .over(whole))
        .withColumn("truncated", F.count_if(F.col("_total") == 0).over(whole) > bucket_limit)
        .filter((F.col("_total") == 0) & (F.col("_place") <= bucket_limit + 1))
        .orderBy("_place")
        .select("bucket", "bucket_count", "total_count", "truncated")
    )


# --- pages ----------------------------------------------------------------------------------

TOKEN_VERSION = 1


def query_fingerprint(operation: str, values: dict) -> str:
    text = json.dumps({"operation": operation, **values}, sort_keys=True, default=str,
                      separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def encode_token(payload: dict) -> str:
    body = json.dumps({"version": TOKEN_VERSION, **payload}, sort_keys=True, default=str,
                      separators=(",", ":"))
    check = hashlib.sha256(body.encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(f"{check}{body}".encode()).decode().rstrip("=")


def decode_token(token: str, operation: str, fingerprint: str) -> dict:
    try:
        text = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode()
        payload = json.loads(text[16:])
        intact = hashlib.sha256(text[16:].encode()).hexdigest()[:16] == text[:16]
    except (ValueError, TypeError, AttributeError) as error:
        raise InvalidQuery("cursor is malformed") from error
    if not intact or payload.get("version") != TOKEN_VERSION:
        raise InvalidQuery("cursor is malformed")
    if payload.get("operation") != operation or payload.get("query") != fingerprint:
        raise InvalidQuery("cursor belongs to another query")
    return payload


@dataclass
class Page:
    """`heads`: one row per resource with `position`; `rows`: the same with their sources."""

    heads: DataFrame
    rows: DataFrame
    _lookahead: DataFrame = field(repr=False)
    _limit: int = field(repr=False)
    _token: dict = field(repr=False)
    _sort_key: str = field(repr=False)

    def next_token(self) -> str | None:
        """Position after this page, or null on the last one. Reads at most limit + 1 keys."""
        keys = (self._lookahead.select(
            "position", "id", F.col(self._sort_key).cast("string").alias("key"))
            .orderBy("position").collect())
        if len(keys) <= self._limit:
            return None
        last = keys[self._limit - 1]
        return encode_token({**self._token, "after_key": last["key"], "after_id": last["id"]})


def source_rows(catalog: Catalog, heads: DataFrame, active_only: bool = True) -> DataFrame:
    """`heads` (resource rows, column `id`) with one row per source, in one plan.

    Rows stay flat: a resource with very many copies is many rows, not one huge array.
    """
    blobs = catalog.blobs.select(F.col("id").alias("blob_id"), F.col("asset_id").alias("id"),
                                 "hash", "size", "mime_type")
    sources = catalog.sources.select("blob_id", F.col("id").alias("source_id"), "provider",
                                     "external_id", "path", "name", "is_active")
    if active_only:
        sources = sources.filter("is_active")
    return heads.join(blobs, "id").join(sources, "blob_id")


def source_order() -> list[Column]:
    return [F.col("provider"), F.coalesce("path", F.lit("")), F.coalesce("name", F.lit("")),
            F.col("external_id")]


def _summary_rows(catalog: Catalog, heads: DataFrame) -> DataFrame:
    return (
        source_rows(catalog, heads)
        .orderBy("position", *source_order())
        .select("position", fn.resource_ref("id").alias("resource_ref"), "resource_type",
                F.col("title").alias("display_name"), F.col("created_at").alias("first_observed_at"),
                "provider", F.col("path").alias("location"), "name", "external_id", "mime_type",
                F.col("size").alias("size_bytes"), "is_active")
    )


def _page(catalog: Catalog, rows: DataFrame, order: list[Column], limit: int, token: dict,
          sort_key: str) -> Page:
    ahead = (
        rows.select("id", "resource_type", "title", "created_at").orderBy(*order).limit(limit + 1)
        .withColumn("position", F.row_number().over(Window.orderBy(*order)))
    )
    heads = ahead.filter(F.col("position") <= limit)
    return Page(heads, _summary_rows(catalog, heads), ahead, limit, token, sort_key)


def _open_page(operation: str, identity: dict, asked: Period, now: datetime,
               cursor: str | None) -> tuple[Period, dict, dict | None]:
    """The period to read, the token base, and the position to go on from.

    The first page fixes the period, up to `now`; later pages take it from their token, so rows
    that appear in between do not move anything.
    """
    fingerprint = query_fingerprint(operation, identity)
    after = decode_token(cursor, operation, fingerprint) if cursor else None
    if after:
        begin = datetime.fromisoformat(after["from"]) if after["from"] else None
        end = datetime.fromisoformat(after["to"])
    else:
        begin = asked.observed_from
        end = min(asked.observed_to, now) if asked.observed_to is not None else now
        if begin is not None and begin >= end:
            end = begin + timedelta(microseconds=1)
            after = {"nothing": True}  # the asked period has not begun
    token = {"operation": operation, "query": fingerprint, "to": end.isoformat(),
             "from": begin.isoformat() if begin else None}
    return Period(begin, end), token, after


def _beyond(rows: DataFrame, after: dict | None, key: str, at: Column, descending: bool
            ) -> DataFrame:
    """Rows behind the last one of the page before, by sort key and then id."""
    if after is None:
        return rows
    if after.get("nothing"):
        return rows.limit(0)
    value = F.col(key)
    further = value < at if descending else value > at
    return rows.filter(further | ((value == at) & (F.col("id") > after["after_id"])))


def list_recent(catalog: Catalog, now: datetime, filters: Filters = Filters(),
                period: Period | None = None, days: int | None = None,
                limit: int = DEFAULT_LIMIT, cursor: str | None = None) -> Page:
    """Qualifying resources, newest first; ties by id. Without a period: the last 30 days."""
    check_limit(limit)
    now = instant(now, "now")
    if days is not None and period is not None:
        raise InvalidQuery("days cannot be combined with an explicit range")
    if days is not None and (isinstance(days, bool) or not isinstance(days, int) or days < 1):
        raise InvalidQuery("days must be a positive integer")
    span = days or DEFAULT_DAYS
    window = asdict(period) if period else {"days": span}
    bounded, token, after = _open_page(
        "recent", {**asdict(filters), **window}, period or Period(now - timedelta(days=span)), now,
        cursor)
    rows = matching_resources(catalog, filters, bounded)
    at = F.lit(after and after.get("after_key")).cast("timestamp")
    rows = _beyond(rows, after, "created_at", at, descending=True)
    return _page(catalog, rows, [F.col("created_at").desc(), F.col("id").asc()], limit, token,
                 "created_at")


def search(catalog: Catalog, text: str, now: datetime, filters: Filters = Filters(),
           period: Period = Period(), limit: int = DEFAULT_LIMIT,
           cursor: str | None = None) -> Page:
    """Qualifying resources whose title, or one qualifying source's name or path, contains
    `text` literally and without regard to case; by title, ties by id."""
    check_limit(limit)
    text = _text(text, "query")
    bounded, token, after = _open_page(
        "search", {**asdict(filters), **asdict(period), "text": text}, period,
        instant(now, "now"), cursor)
    rows = matching_resources(catalog, filters, bounded)
    by_source = eligible_resources(catalog, filters, text).select(
        F.col("resource_id").alias("id"), F.lit(True).alias("_by_source"))
    rows = rows.join(by_source, "id", "left").filter(
        fn.contains_ci(F.col("title"), text) | F.col("_by_source")).drop("_by_source")
    at = F.lit(after and after.get("after_key")).cast("string")
    rows = _beyond(rows, after, "title", at, descending=False)
    return _page(catalog, rows, [F.col("title").asc(), F.col("id").asc()], limit, token, "title")


# --- detail ---------------------------------------------------------------------------------

class Detail(NamedTuple):
    heads: DataFrame
    sources: DataFrame
    contents: DataFrame


def get_resources(catalog: Catalog, refs: DataFrame) -> Detail:
    """Detail of the resources named in `refs` (column `resource_ref`): head, every source
    whether active or not, and every content variant, each in its stable order."""
    ids = refs.select(fn.parse_ref("resource_ref").alias("id")).filter("id is not null").distinct()
    heads = catalog.resources.join(ids, "id", "left_semi")
    summary = heads.select(fn.resource_ref("id").alias("resource_ref"), "resource_type",
                           F.col("title").alias("display_name"),
                           F.col("created_at").alias("first_observed_at"))
    sources = source_rows(catalog, heads.select("id"), active_only=False).orderBy(
        "id", *source_order())
    contents = (
        catalog.blobs.join(heads.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
        .orderBy("asset_id", "hash", F.coalesce("mime_type", F.lit("")),
                 F.coalesce("size", F.lit(-1)))
        .select(F.col("asset_id").alias("id"), "mime_type", F.col("size").alias("size_bytes"),
                F.col("hash").alias("checksum"))
    )
    return Detail(summary, sources, contents)


def get_resource(catalog: Catalog, ref: str) -> Detail:
    spark = catalog.resources.sparkSession
    return get_resources(catalog, spark.createDataFrame([(ref,)], "resource_ref STRING"))


def list_files(catalog: Catalog) -> DataFrame:
    """Every file resource in id order with its number of contents and active sources."""
    per_blob = catalog.sources.groupBy("blob_id").agg(
        F.count_if("is_active").alias("active"), F.count(F.lit(1)).alias("every"))
    counts = (
        catalog.blobs.join(per_blob, catalog.blobs.id == per_blob.blob_id, "left")
        .groupBy("asset_id").agg(
            F.count(F.lit(1)).alias("contents"),
            F.coalesce(F.sum("active"), F.lit(0)).alias("active_sources"),
            F.coalesce(F.sum("every"), F.lit(0)).alias("all_sources"))
    )
    files = catalog.resources.filter(F.col("resource_type") == "file")
    return files.join(counts, files.id == counts.asset_id, "left").orderBy("id").select(
        "id", "title", F.coalesce("contents", F.lit(0)).alias("contents"),
        F.coalesce("active_sources", F.lit(0)).alias("active_sources"),
        F.coalesce("all_sources", F.lit(0)).alias("all_sources"))


# --- lookups and access ---------------------------------------------------------------------

def find_sources(catalog: Catalog, keys: DataFrame) -> DataFrame:
    return catalog.sources.join(keys.select("provider", "external_id").distinct(),
                                ["provider", "external_id"], "left_semi")


def find_blobs(catalog: Catalog, keys: DataFrame) -> DataFrame:
    """Contents by the columns `keys` has: id, hash, or (asset_id, hash)."""
    on = [c for c in ("id", "asset_id", "hash") if c in keys.columns]
    return catalog.blobs.join(keys.select(*on).distinct(), on, "left_semi")


def find_resources(catalog: Catalog, keys: DataFrame) -> DataFrame:
    return catalog.resources.join(keys.select("id").distinct(), "id", "left_semi")


def active_sources(catalog: Catalog, provider: str) -> DataFrame:
    return catalog.sources.filter(F.col("is_active") & (F.col("provider") == provider))


def access_sources(catalog: Catalog, refs: DataFrame, provider: str = "immich") -> DataFrame:
    """For each asked reference: not_found, unavailable, ambiguous, or available with the one
    image source that can serve it."""
    asked = refs.select("resource_ref", fn.parse_ref("resource_ref").alias("id")).distinct()
    sources = catalog.sources.filter(F.col("is_active") & (F.col("provider") == provider)).select(
        "blob_id", F.col("id").alias("source_id"), "external_id")
    images = catalog.blobs.filter(F.lower("mime_type").startswith("image/")).select(
        F.col("id").alias("blob_id"), F.col("asset_id").alias("id"))
    found = catalog.resources.select("id", F.col("resource_type"))
    eligible = (
        sources.join(images, "blob_id").groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("external_id").alias("locator"))
    )
    n = F.when(F.col("resource_type") == "file", F.coalesce("n", F.lit(0))).otherwise(0)
    return (
        asked.join(found, "id", "left").join(eligible, "id", "left")
        .withColumn("status", F.when(F.col("resource_type").isNull(), "not_found")
                    .when(n == 0, "unavailable").when(n > 1, "ambiguous").otherwise("available"))
        .select("resource_ref", "status",
                F.when(F.col("status") == "available", F.col("locator")).alias("locator"))
    )
