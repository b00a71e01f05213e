"""The registered queries: each key has a Spark plan and, where SQL can say it, DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import query as q
from shelfmark.operators import reconcile as rec
from shelfmark.plans import bind
from shelfmark.plans import oracle as o
from shelfmark.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLE[name] = sql
        return plan
    return keep


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


NOW = utc(2024, 12, 1)
PERIOD = q.Period(utc(2024, 2, 1), utc(2024, 11, 1))
IN_PERIOD = ("created_at >= TIMESTAMP '2024-02-01' AND created_at < TIMESTAMP '2024-11-01'")


# --- aggregation ----------------------------------------------------------------------------

def _bucket_sql(bucket: str, where: str, order: str = "bucket_count DESC, bucket") -> str:
    return f"""WITH {o.CATALOG}, {o.JOINED},
    pairs AS (SELECT DISTINCT id, {bucket} AS bucket FROM joined WHERE {where}),
    counts AS (SELECT bucket, count(*) AS bucket_count FROM pairs GROUP BY bucket)
    SELECT bucket, bucket_count, (SELECT count(DISTINCT id) FROM pairs) AS total_count,
      (SELECT count(*) FROM counts) > 100 AS truncated
    FROM counts ORDER BY {order} LIMIT 100"""


@register("count_by_mime_category", _bucket_sql(o.CATEGORY, IN_PERIOD))
def count_by_mime_category(spark, sf_dir):
    return q.aggregate(bind.catalog(spark, sf_dir), q.Filters(), PERIOD, "mime_category")


@register("count_by_provider", _bucket_sql("provider", "TRUE"))
def count_by_provider(spark, sf_dir):
    return q.aggregate(bind.catalog(spark, sf_dir), group_by="provider")


@register("count_by_day", _bucket_sql(
    "strftime(created_at, '%Y-%m-%d')",
    IN_PERIOD + " AND resource_type = 'file' AND starts_with(lower(path), '/en/')", "bucket"))
def count_by_day(spark, sf_dir):
    filters = q.Filters(resource_type="file", path_prefix="/EN/")
    return q.aggregate(bind.catalog(spark, sf_dir), filters, PERIOD, "day")


@register("count_by_mime_type", _bucket_sql(
    "CASE WHEN coalesce(mime_type, '') = '' THEN 'unknown' ELSE mime_type END",
    "resource_type = 'file'"))
def count_by_mime_type(spark, sf_dir):
    return q.aggregate(bind.catalog(spark, sf_dir), q.Filters(resource_type="file"),
                       group_by="mime_type")


@register("count_total", f"""WITH {o.CATALOG}, {o.JOINED}
    SELECT count(DISTINCT id) AS total_count FROM joined
    WHERE {o.CATEGORY} = 'text' AND {IN_PERIOD}""")
def count_total(spark, sf_dir):
    return q.aggregate(bind.catalog(spark, sf_dir), q.Filters(mime_category="Text"), PERIOD)


# --- pages, search, detail ------------------------------------------------------------------

PAGE = ("position, " + o.ref("id") + " AS resource_ref, resource_type, title AS display_name, "
        "created_at AS first_observed_at, provider, path AS location, name, external_id, "
        "mime_type, size AS size_bytes, TRUE AS is_active")


def _page_sql(pick: str, order: str, first: int, last: int) -> str:
    return f"""WITH {o.CATALOG}, {o.JOINED},
    heads AS (SELECT id, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place
      FROM resources WHERE id IN ({pick})),
    page AS (SELECT id, place - {first - 1} AS position FROM heads
      WHERE place BETWEEN {first} AND {last})
    SELECT {PAGE.replace('position', 'CAST(position AS INTEGER) AS position')}
    FROM page JOIN joined USING (id)"""


TEXT_FILES = f"SELECT id FROM joined WHERE {o.CATEGORY} = 'text' AND created_at < TIMESTAMP '2024-12-01' AND created_at >= TIMESTAMP '2024-02-01'"


def _recent(spark, sf_dir, cursor=None):
    return q.list_recent(bind.catalog(spark, sf_dir), NOW, q.Filters(mime_category="text"),
                         q.Period(utc(2024, 2, 1)), limit=25, cursor=cursor)


@register("recent_page_1", _page_sql(TEXT_FILES, "created_at DESC, id", 1, 25))
def recent_page_1(spark, sf_dir):
    return _recent(spark, sf_dir).rows


@register("recent_page_2", _page_sql(TEXT_FILES, "created_at DESC, id", 26, 50))
def recent_page_2(spark, sf_dir):
    return _recent(spark, sf_dir, _recent(spark, sf_dir).next_token()).rows


@register("search_page", _page_sql(
    "SELECT id FROM joined WHERE created_at < TIMESTAMP '2024-12-01' AND (contains(lower(title), "
    "'c-1') OR contains(lower(name), 'c-1') OR contains(lower(path), 'c-1'))",
    "title, id", 1, 100))
def search_page(spark, sf_dir):
    return q.search(bind.catalog(spark, sf_dir), " C-1 ", NOW, limit=100).rows


@register("resource_detail", f"""WITH {o.CATALOG}, {o.JOINED}
    SELECT {o.ref('id')} AS resource_ref, 'source' AS section, provider AS key_1,
      coalesce(path, '') AS key_2, coalesce(name, '') AS key_3, external_id AS key_4,
      mime_type, size AS size_bytes FROM joined
    UNION ALL
    SELECT {o.ref('asset_id')}, 'content', hash, coalesce(mime_type, ''), '', '', mime_type, size
    FROM blobs""")
def resource_detail(spark, sf_dir):
    catalog = bind.catalog(spark, sf_dir)
    detail = q.get_resources(catalog, catalog.resources.select(
        fn.resource_ref("id").alias("resource_ref")))
    blank = F.lit("")
    sources = detail.sources.select(
        fn.resource_ref("id").alias("resource_ref"), F.lit("source").alias("section"),
        F.col("provider").alias("key_1"), F.coalesce("path", blank).alias("key_2"),
        F.coalesce("name", blank).alias("key_3"), F.col("external_id").alias("key_4"),
        "mime_type", F.col("size").alias("size_bytes"))
    contents = detail.contents.select(
        fn.resource_ref("id").alias("resource_ref"), F.lit("content").alias("section"),
        F.col("checksum").alias("key_1"), F.coalesce("mime_type", blank).alias("key_2"),
        blank.alias("key_3"), blank.alias("key_4"), "mime_type", "size_bytes")
    return sources.unionByName(contents)


@register("file_list", f"""WITH {o.CATALOG}
    SELECT r.id, r.title, CAST(count(DISTINCT b.id) AS BIGINT) AS contents,
      CAST(count(s.id) AS BIGINT) AS active_sources, CAST(count(s.id) AS BIGINT) AS all_sources
    FROM resources r LEFT JOIN blobs b ON b.asset_id = r.id LEFT JOIN sources s ON s.blob_id = b.id
    WHERE r.resource_type = 'file' GROUP BY r.id, r.title""")
def file_list(spark, sf_dir):
    return q.list_files(bind.catalog(spark, sf_dir))


@register("image_access", f"""WITH {o.CATALOG}, {o.JOINED},
    images AS (SELECT id, count(*) AS n, min(external_id) AS locator FROM joined
      WHERE provider = 'immich' AND resource_type = 'file'
        AND starts_with(lower(mime_type), 'image/') GROUP BY id)
    SELECT {o.ref('r.id')} AS resource_ref,
      CASE WHEN n IS NULL THEN 'unavailable' WHEN n > 1 THEN 'ambiguous' ELSE 'available' END
        AS status,
      CASE WHEN n = 1 THEN locator END AS locator
    FROM resources r LEFT JOIN images i ON i.id = r.id
    UNION ALL
    SELECT DISTINCT {o.ref(o.uid("'absent|' || label"))}, 'not_found', NULL FROM embeddings""")
def image_access(spark, sf_dir):
    catalog = bind.catalog(spark, sf_dir)
    absent = bind.table(spark, sf_dir, "embeddings").select(
        fn.resource_ref(fn.uuid_text(F.lit("absent"), F.col("label").cast("string")))
        .alias("resource_ref")).distinct()
    asked = catalog.resources.select(fn.resource_ref("id").alias("resource_ref"))
    return q.access_sources(catalog, asked.unionByName(absent))


@register("key_lookups", f"""WITH {o.CATALOG}
    SELECT 'blob' AS found, b.id, b.asset_id AS parent FROM blobs b
      WHERE hash IN (SELECT sha256(text) FROM documents)
    UNION ALL
    SELECT 'source', s.id, s.blob_id FROM sources s
      WHERE provider = 'gmail' AND external_id IN
        (SELECT 'msg-' || conv_id || '-' || turn FROM conversations)
    UNION ALL
    SELECT 'active', s.id, s.blob_id FROM sources s WHERE provider = 'immich' AND is_active""")
def key_lookups(spark, sf_dir):
    catalog = bind.catalog(spark, sf_dir)
    hashes = bind.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"))
    keys = bind.table(spark, sf_dir, "conversations").select(
        F.lit("gmail").alias("provider"),
        F.concat_ws("-", F.lit("msg"), F.col("conv_id").cast("string"),
                    F.col("turn").cast("string")).alias("external_id"))

    def shape(df, name, parent):
        return df.select(F.lit(name).alias("found"), "id", F.col(parent).alias("parent"))

    return (
        shape(q.find_blobs(catalog, hashes), "blob", "asset_id")
        .unionByName(shape(q.find_sources(catalog, keys), "source", "blob_id"))
        .unionByName(shape(q.active_sources(catalog, "immich"), "active", "blob_id")))


# --- reconcile ------------------------------------------------------------------------------

DECIDED = """SELECT ordinal, provider, external_id, reason, source_id, blob_id, resource_id, hash"""


@register("reconcile_first_scan", f"""WITH {o.CATALOG}
    SELECT ordinal, provider, external_id,
      CASE WHEN kind = 'message' THEN 'new_message_source' WHEN creates THEN 'new_source_new_blob'
        ELSE 'new_source_existing_blob' END AS reason,
      {o.uid("'source|' || provider || '|' || external_id")} AS source_id,
      {o.uid("'blob|' || resource_id || '|' || hash")} AS blob_id, resource_id, hash
    FROM placed""")
def reconcile_first_scan(spark, sf_dir):
    facts, content = bind.split_scan(bind.first_scan(spark, sf_dir))
    return rec.decide(facts, rec.Catalog.empty(spark), content).select(
        "ordinal", "provider", "external_id", "reason", "source_id", "blob_id", "resource_id",
        "hash")


# Facts of the second scan beside the source they already have, if any. Only photos carry
# metadata that changes while their version stays; documents change version with their text.
SECOND = f"""{o.CATALOG}, {o.facts(2)},
    matched AS (
      SELECT f.*, s.id AS s_id, s.blob_id AS s_blob, b.asset_id AS s_asset, b.hash AS s_hash,
        s.version_tag AS s_version, s.path AS s_path, s.name AS s_name,
        s.modified_at AS s_modified, s.meta AS s_meta
      FROM facts2 f LEFT JOIN sources s USING (provider, external_id)
        LEFT JOIN blobs b ON b.id = s.blob_id),
    staged AS (
      SELECT *, CASE WHEN kind = 'message' THEN hash ELSE version_tag END AS version,
        s_id IS NOT NULL AS known FROM matched),
    fresh AS (SELECT hash, min(ordinal) AS first_ordinal FROM staged
      WHERE NOT known AND kind = 'file' GROUP BY hash),
    moved AS (SELECT s_asset, hash, min(ordinal) AS ordinal FROM staged
      WHERE known AND version IS DISTINCT FROM s_version GROUP BY s_asset, hash),
    new_moved AS (SELECT m.* FROM moved m LEFT JOIN blobs b
      ON b.asset_id = m.s_asset AND b.hash = m.hash WHERE b.id IS NULL),
    existing AS (SELECT hash, count(*) AS n, min(id) AS blob_id, min(asset_id) AS asset_id
      FROM blobs GROUP BY hash),
    rivals AS (SELECT hash, list(struct_pack(o := ordinal, a := s_asset) ORDER BY ordinal) AS c
      FROM new_moved GROUP BY hash),
    judged AS (
      SELECT s.*, e.n AS e_n, e.blob_id AS e_blob, e.asset_id AS e_asset, fr.first_ordinal,
        nm.ordinal IS NOT NULL AS moves_first,
        CASE WHEN r.c IS NULL THEN 0 ELSE len(list_filter(r.c, lambda x: x.o < s.ordinal)) END AS before,
        coalesce(r.c[1].o < fr.first_ordinal, FALSE) AS rival_first, r.c[1].a AS rival_asset
      FROM staged s LEFT JOIN existing e ON e.hash = s.hash LEFT JOIN fresh fr ON fr.hash = s.hash
        LEFT JOIN rivals r ON r.hash = s.hash
        LEFT JOIN new_moved nm ON nm.ordinal = s.ordinal AND s.known),
    reasoned AS (
      SELECT *, CASE
        WHEN known AND version IS NOT DISTINCT FROM s_version AND path IS NOT DISTINCT FROM s_path
          AND name = s_name AND modified_at IS NOT DISTINCT FROM s_modified AND meta = s_meta
          THEN 'source_unchanged'
        WHEN known AND version IS NOT DISTINCT FROM s_version THEN 'source_metadata_changed'
        WHEN known AND moves_first THEN 'new_blob_for_existing_asset'
        WHEN known THEN 'source_returned_to_existing_blob_in_asset'
        WHEN kind = 'message' THEN 'new_message_source'
        WHEN coalesce(e_n, 0) >= 2 OR (e_n = 1 AND before >= 1)
          OR (e_n IS NULL AND (before >= 2 OR (NOT rival_first AND before >= 1)))
          THEN 'ambiguous_blob_hash'
        WHEN e_n IS NULL AND NOT rival_first AND ordinal = first_ordinal THEN 'new_source_new_blob'
        ELSE 'new_source_existing_blob' END AS reason
      FROM judged),
    decided AS (
      SELECT ordinal, provider, external_id, kind, reason, name, path, version, size, mime_type,
        observed_at, {o.uid("'source|' || provider || '|' || external_id")} AS source_id,
        CASE WHEN reason IN ('source_unchanged', 'source_metadata_changed') THEN s_blob
          WHEN known THEN {o.uid("'blob|' || s_asset || '|' || hash")}
          WHEN reason = 'ambiguous_blob_hash' THEN NULL
          WHEN e_n = 1 THEN e_blob
          WHEN rival_first THEN {o.uid("'blob|' || rival_asset || '|' || hash")}
          ELSE {o.uid("'blob|' || " + o.FILE_ID + " || '|' || hash")} END AS blob_id,
        CASE WHEN known THEN s_asset WHEN reason = 'ambiguous_blob_hash' THEN NULL
          WHEN e_n = 1 THEN e_asset WHEN rival_first THEN rival_asset
          ELSE {o.FILE_ID} END AS resource_id,
        CASE WHEN reason IN ('source_unchanged', 'source_metadata_changed')
          AND kind = 'file' THEN NULL ELSE hash END AS hash
      FROM reasoned),
    missing AS (SELECT s.* FROM sources s WHERE provider IN (SELECT provider FROM facts2)
      AND NOT EXISTS (SELECT 1 FROM facts2 f WHERE f.provider = s.provider
        AND f.external_id = s.external_id))"""


def _second_facts(spark, sf_dir):
    facts, content = bind.split_scan(bind.second_scan(spark, sf_dir))
    return materialise(facts, "second-facts"), content


def _second_decisions(spark, sf_dir):
    facts, content = _second_facts(spark, sf_dir)
    return rec.decide(facts, bind.catalog(spark, sf_dir), content)


def _next_catalog(spark, sf_dir):
    """The second run, decided once per application."""
    catalog = bind.catalog(spark, sf_dir)
    facts, decisions = bind.stored(
        spark, "second-run", sf_dir, ["facts", "decisions"], lambda: _second_run(spark, sf_dir))
    return rec.apply(rec.changes(decisions, rec.missing_sources(facts, catalog), catalog,
                                 bind.SECOND_RUN), catalog)


def _second_run(spark, sf_dir):
    facts, content = _second_facts(spark, sf_dir)
    return facts, rec.decide(facts, bind.catalog(spark, sf_dir), content)


@register("reconcile_second_scan", f"WITH {SECOND} {DECIDED} FROM decided")
def reconcile_second_scan(spark, sf_dir):
    return _second_decisions(spark, sf_dir).select(
        "ordinal", "provider", "external_id", "reason", "source_id", "blob_id", "resource_id",
        "hash")


@register("content_needed", f"""WITH {SECOND} SELECT provider, external_id FROM staged
    WHERE NOT known OR version IS DISTINCT FROM s_version OR kind = 'message'""")
def content_needed(spark, sf_dir):
    """What the second run reads: new things, changed versions, and messages, whose version is
    their content."""
    facts, _ = bind.split_scan(bind.second_scan(spark, sf_dir))
    return rec.content_needed(facts, bind.catalog(spark, sf_dir))


@register("missing_sources", f"WITH {SECOND} SELECT id, provider, external_id FROM missing")
def missing_sources(spark, sf_dir):
    facts, _ = bind.split_scan(bind.second_scan(spark, sf_dir))
    return rec.missing_sources(facts, bind.catalog(spark, sf_dir)).select(
        "id", "provider", "external_id")


@register("sync_totals", f"""WITH {SECOND}, lost AS (SELECT count(*) AS n FROM missing)
    SELECT count(*) AS facts,
      CAST(sum(CASE WHEN reason = 'new_source_new_blob' THEN 3
        WHEN reason = 'new_blob_for_existing_asset' THEN 2
        WHEN reason IN ('source_unchanged', 'ambiguous_blob_hash') THEN 0 ELSE 1 END) AS BIGINT)
        + (SELECT n FROM lost) AS actions,
      CAST(count(hash) AS BIGINT) AS hashes, (SELECT n FROM lost) AS missing
    FROM decided""")
def sync_totals(spark, sf_dir):
    facts, _ = bind.split_scan(bind.second_scan(spark, sf_dir))
    return rec.metrics(_second_decisions(spark, sf_dir),
                       rec.missing_sources(facts, bind.catalog(spark, sf_dir)))


@register("next_catalog_sources", f"""WITH {SECOND}
    SELECT s.id, coalesce(d.blob_id, s.blob_id) AS blob_id, s.provider, s.external_id,
      CASE WHEN d.source_id IS NULL THEN s.path ELSE d.path END AS path,
      CASE WHEN d.source_id IS NULL THEN s.name ELSE d.name END AS name,
      CASE WHEN d.source_id IS NULL THEN s.version_tag ELSE d.version END AS version_tag,
      m.id IS NULL AS is_active,
      CASE WHEN m.id IS NOT NULL THEN TIMESTAMP '2025-07-01' END AS deleted_at
    FROM sources s LEFT JOIN decided d ON d.source_id = s.id LEFT JOIN missing m ON m.id = s.id
    UNION ALL
    SELECT source_id, blob_id, provider, external_id, path, name, version, TRUE, NULL
    FROM decided WHERE reason IN ('new_source_new_blob', 'new_source_existing_blob')""")
def next_catalog_sources(spark, sf_dir):
    return _next_catalog(spark, sf_dir).sources.drop("metadata")


@register("next_catalog_contents", f"""WITH {SECOND}
    SELECT b.id, b.asset_id, b.hash, b.size, b.mime_type, r.title, r.resource_type, r.created_at
    FROM blobs b JOIN resources r ON r.id = b.asset_id
    UNION ALL
    SELECT d.blob_id, d.resource_id, d.hash, d.size, d.mime_type,
      coalesce(r.title, {o.TITLE.replace('kind', 'd.kind').replace('name', 'd.name')}),
      coalesce(r.resource_type, d.kind), coalesce(r.created_at, d.observed_at)
    FROM decided d LEFT JOIN resources r ON r.id = d.resource_id
    WHERE d.reason IN ('new_source_new_blob', 'new_blob_for_existing_asset')""")
def next_catalog_contents(spark, sf_dir):
    after = _next_catalog(spark, sf_dir)
    resources = after.resources.select(F.col("id").alias("asset_id"), "title", "resource_type",
                                       "created_at")
    return after.blobs.join(resources, "asset_id")


@register("content_hashes", """
    SELECT source AS provider, 'doc-' || doc_id AS external_id, sha256(text) AS computed_hash
    FROM documents""")
def content_hashes(spark, sf_dir):
    docs = bind.table(spark, sf_dir, "documents")
    return rec.content_hashes(docs.select(
        F.col("source").alias("provider"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("external_id"),
        F.encode("text", "UTF-8").alias("content")))
