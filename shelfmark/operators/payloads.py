"""Nested JSON payloads with fixed key order: what a consumer reads over the wire.

Every payload is text in column `payload`. Lists are in their stable order and built per result
(a page, a query, a resource); those without a bound of their own are cut into parts of
`PART_ROWS` entries, so that no resource becomes one array however many sources it has. With
`whole`, for consumers that take one object per resource, the ordered parts are put together again.
Nulls stay as keys, times are ISO texts in UTC.
"""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import query as q
from shelfmark.operators.ordered import number_sorted
from shelfmark.operators.publish import GENERATOR, value_text
from shelfmark.operators.retrieval import Mapped, Retrieved, around
from shelfmark.schemas import Catalog
from shelfmark.session import materialise

#: Entries of a list in one part of a payload.
PART_ROWS = 1_000


def iso(at: Column | str) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def as_json(body: Column) -> Column:
    return F.to_json(body, {"ignoreNullFields": "false"}).alias("payload")


def one_part(lists: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The lists (*keys, part, name) with all parts of a key in order as its part 0."""
    return lists.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", name))).alias("l")
                                    ).select(*keys, F.lit(0).alias("part"), F.flatten(
                                        F.transform("l", lambda x: x[name])).alias(name))


def _lists(rows: DataFrame, keys: list[str], order: list[Column], entry: Column, name: str,
           whole: bool = False) -> DataFrame:
    """(*keys, part, name): the rows of each key as ordered lists of up to PART_ROWS entries, or
    with `whole` as one list."""
    placed = number_sorted(rows, keys, order, "place")
    part = F.floor((F.col("place") - 1) / F.lit(PART_ROWS)).cast("int")
    lists = placed.groupBy(*keys, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))).alias("l")).select(
        *keys, "part", F.transform("l", lambda x: x["entry"]).alias(name))
    return one_part(lists, keys, name) if whole else lists


def _source() -> Column:
    return F.struct("provider", F.col("path").alias("location"), "name", "mime_type",
                    F.col("size").alias("size_bytes"), "is_active")


def _sources(catalog: Catalog, ids: DataFrame, active_only: bool, whole: bool) -> DataFrame:
    rows = q.source_rows(catalog, ids, active_only)
    return _lists(rows, ["id"], [*q.source_order(), F.col("source_id")], _source(), "sources",
                  whole)


def _head() -> list[Column]:
    return [fn.resource_ref("id").alias("resource_ref"), F.col("resource_type"),
            F.col("title").alias("display_name"),
            iso("created_at").alias("first_observed_at")]


def _none() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<provider string, location string, name string, "
                       "mime_type string, size_bytes bigint, is_active boolean>>")


def summaries(catalog: Catalog, heads: DataFrame, active_only: bool = True, whole: bool = False
              ) -> DataFrame:
    """(id, part, parts, resource): resource rows `heads` with their sources."""
    heads = heads.select("id", "resource_type", "title", "created_at").distinct()
    lists = _sources(catalog, heads.select("id"), active_only, whole)
    parts = lists.groupBy("id").agg((F.max("part") + 1).alias("parts"))
    full = heads.join(lists, "id", "left").join(parts, "id", "left")
    return full.select(
        "id", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("parts", F.lit(1))
        .alias("parts"), F.struct(*_head(), F.coalesce("sources", _none()).alias("sources"))
        .alias("resource"))


def summary(catalog: Catalog, heads: DataFrame, whole: bool = False) -> DataFrame:
    """(resource_ref, part, parts, payload): one object per resource and part."""
    return summaries(catalog, heads, whole=whole).select(
        F.col("resource.resource_ref").alias("resource_ref"), "part", "parts",
        as_json(F.col("resource")))


def detail(catalog: Catalog, refs: DataFrame, whole: bool = False) -> DataFrame:
    """(resource_ref, part, parts, payload) of the resources `refs` name: all sources, active or
    not, and all content variants."""
    ids = refs.select(fn.parse_ref("resource_ref").alias("id")).filter("id IS NOT NULL").distinct()
    heads = catalog.resources.join(ids, "id", "left_semi")
    contents = catalog.blobs.join(ids.withColumnRenamed("id", "asset_id"), "asset_id",
                                  "left_semi").withColumnsRenamed({"id": "blob_id",
                                                                   "asset_id": "id"})
    variants = _lists(
        contents, ["id"], [F.col("hash"), F.coalesce("mime_type", F.lit("")),
                           F.coalesce("size", F.lit(-1)), F.col("blob_id")],
        F.struct("mime_type", F.col("size").alias("size_bytes"), F.col("hash").alias("checksum")),
        "variants", whole)
    sources = _sources(catalog, ids, active_only=False, whole=whole)
    lists = sources.join(variants, ["id", "part"], "full_outer")
    parts = lists.groupBy("id").agg((F.max("part") + 1).alias("parts"))
    full = heads.join(lists, "id", "left").join(parts, "id", "left")
    empty = F.from_json(F.lit("[]"), "array<struct<mime_type string, size_bytes bigint, "
                        "checksum string>>")
    return full.select(
        fn.resource_ref("id").alias("resource_ref"), F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("parts", F.lit(1)).alias("parts"), as_json(F.struct(
            *_head(), F.coalesce("sources", _none()).alias("sources"),
            F.coalesce("variants", empty).alias("content_variants"))))


def _first_parts(catalog: Catalog, heads: DataFrame, whole: bool = False) -> DataFrame:
    """Summaries for lists of resources: the first part, and how many there are."""
    return summaries(catalog, heads, whole=whole).filter("part = 0").select(
        "id", "parts", "resource")


def page(catalog: Catalog, found: q.Page, whole: bool = False) -> DataFrame:
    """One row: the resources of a page in order and the position of the next one. Unless `whole`,
    a resource of more than PART_ROWS sources goes on in its own payload; `parts` tells."""
    rows = found.heads.select("id", "position").join(
        _first_parts(catalog, found.heads, whole), "id")
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("position", "parts", "resource")))
                      .alias("l"))
    return listed.select(as_json(F.struct(
        F.transform("l", lambda x: x["resource"]).alias("resources"),
        F.transform(F.filter("l", lambda x: x["parts"] > 1), lambda x: F.struct(
            x["resource"]["resource_ref"].alias("resource_ref"), x["parts"].alias("parts")))
        .alias("continued"),
        F.lit(found.next_token()).cast("string").alias("next_cursor"))))


def aggregation(result: DataFrame, filters: q.Filters, period: q.Period,
                group_by: str | None) -> DataFrame:
    """One row from the bucket rows of `query.aggregate`, or its one total row."""
    asked = asdict(filters)
    names = ("provider", "resource_type", "mime_type", "mime_category", "path_prefix")

    def text(value: datetime | None) -> Column:
        return iso(F.lit(value).cast("timestamp"))

    if group_by is None:
        rows = result.agg(F.first("total_count").alias("total"))
        buckets, cut = F.array().cast("array<struct<key:string,count:bigint>>"), F.lit(False)
    else:
        order = (F.struct(F.col("bucket").alias("o")) if group_by == "day"
                 else F.struct((-F.col("bucket_count")).alias("n"), F.col("bucket").alias("o")))
        rows = result.agg(
            F.max("total_count").alias("total"), F.bool_or("truncated").alias("cut"),
            F.array_sort(F.collect_list(F.struct(order.alias("order"), F.struct(
                F.col("bucket").alias("key"), F.col("bucket_count").alias("count")).alias("b"))))
            .alias("l"))
        buckets, cut = F.transform("l", lambda x: x["b"]), F.coalesce("cut", F.lit(False))
    return rows.select(as_json(F.struct(
        F.lit("first_observed_at").alias("time_basis"), text(period.observed_from)
        .alias("observed_from"), text(period.observed_to).alias("observed_to"),
        F.struct(*[F.lit(asked[n]).cast("string").alias(n) for n in names])
        .alias("applied_filters"), F.lit(group_by).cast("string").alias("group_by"),
        F.coalesce("total", F.lit(0)).alias("total_count"), buckets.alias("buckets"),
        cut.alias("buckets_truncated"))))


def _few(catalog: Catalog, ids: DataFrame) -> DataFrame:
    """The resource rows of a bounded list of ids, written once."""
    return materialise(catalog.resources.join(ids.distinct(), "id", "left_semi"), "hit-heads")


def semantic_hits(catalog: Catalog, found: Mapped, provider: str) -> DataFrame:
    """(query_id, payload): the mapped hits of every query by rank."""
    heads = _few(catalog, found.hits.select(F.col("resource_id").alias("id")))
    catalog = around(catalog, heads.select(F.col("id").alias("resource_id")))
    rows = found.hits.select("query_id", "rank", F.col("resource_id").alias("id")).join(
        _first_parts(catalog, heads), "id")
    kind = F.lit("semantic").alias("retrieval_kind")
    hits = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.lit(provider).alias("provider"), kind, "resource"))).alias("hits"))
    return found.unmapped.join(hits, "query_id", "left").select("query_id", as_json(F.struct(
        F.lit(provider).alias("provider"), kind,
        F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"),
        "unmapped_hit_count")))


def filtered_hits(catalog: Catalog, found: Retrieved) -> DataFrame:
    """One row, or with `query_id` one per query: hits by rank and the stages of the funnel."""
    by = ["query_id"] if "query_id" in found.stages.columns else []
    rows = found.hits.withColumn("id", fn.parse_ref("resource_ref"))
    heads = _few(catalog, rows.select("id"))
    catalog = around(catalog, heads.select(F.col("id").alias("resource_id")))
    rows = rows.join(_first_parts(catalog, heads), "id")
    hits = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        "source_rank", F.struct(
            "resource", "source_rank", "matched_predicates",
            iso("captured_at").alias("captured_at"),
            iso("file_modified_at").alias("file_modified_at")).alias("hit")))).alias("h"))
    stages = found.stages.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        "position", F.struct("stage", "input_count", "output_count").alias("s")))).alias("s"))
    joined = stages.join(hits, by, "left") if by else stages.select(
        "s", hits.select("h").scalar().alias("h"))
    return joined.select(*by, as_json(F.struct(
        F.transform(F.coalesce("h", F.array().cast(hits.schema["h"].dataType)),
                    lambda x: x["hit"]).alias("hits"),
        F.transform("s", lambda x: x["s"]).alias("stages"))))


def statements(rows: DataFrame) -> DataFrame:
    """(resource_ref, part, payload): the statements of every subject in their stable order."""
    value = (F.when(F.col("value_type") == "resource_ref",
                    fn.resource_ref("resource_value_asset_id"))
             .when(F.col("value_type") == "datetime", iso("datetime_value"))
             .otherwise(value_text()))
    entry = F.struct(
        fn.resource_ref("subject_asset_id").alias("subject_resource_ref"), "predicate",
        "value_type", value.alias("value"), *GENERATOR, "source_kind", "source_locator",
        "confidence", iso("created_at").alias("created_at"))
    order = [F.col("predicate"), *map(F.col, GENERATOR), -F.unix_micros("created_at"), F.col("id")]
    lists = _lists(rows, ["subject_asset_id"], order, entry, "statements")
    return lists.select(fn.resource_ref("subject_asset_id").alias("resource_ref"), "part",
                        as_json(F.struct("statements")))


def status(jobs: DataFrame, now: datetime) -> DataFrame:
    """One row: the freshness of all jobs (`ledger.job_status`) in their order."""
    entry = F.struct(
        "pipeline_key", "kind", "latest_status", iso("latest_started_at")
        .alias("latest_started_at"), iso("latest_finished_at").alias("latest_finished_at"),
        "latest_error_code", iso("last_success_at").alias("last_success_at"),
        "success_age_seconds", "dependencies", "validated_after_dependencies")
    rows = jobs.agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("e"))))
                    .alias("l"))
    return rows.select(as_json(F.struct(
        iso(F.lit(now).cast("timestamp")).alias("generated_at"),
        F.transform("l", lambda x: x["e"]).alias("pipelines"))))


def facts(cards: DataFrame) -> DataFrame:
    """(resource_ref, place, name, value): the lines of a detail card (`presentation.present`)."""
    lines = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value"))
                               for name, value in (
        ("Type", F.col("label")), ("Format", F.col("mime_type")), ("Size", F.col("size_label")),
        ("First observed", iso("first_observed_at")))]), lambda x: x["value"].isNotNull())
    return cards.select("resource_ref", F.posexplode(lines).alias("place", "f")).select(
        "resource_ref", (F.col("place") + 1).alias("place"), "f.name", "f.value")
