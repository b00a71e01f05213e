"""Bind the given test tables to provider facts and to the world-model tables.

Every row of `documents`, `pages`, `embeddings` and `conversations` becomes one fact of a first
scan. The second scan lists the same things after edits that the data itself chooses: documents
labelled toxic are gone, those labelled low quality are rewritten, German ones are renamed,
photos of one label get new metadata, system messages are edited; `benchmark` items are new
files and every page is listed a second time by a mirror.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import extract as ex
from shelfmark.operators import publish as pub
from shelfmark.operators import reconcile as rec
from shelfmark.operators.ordered import number_rows
from shelfmark.schemas import FACTS, JOBS, TABLES, Catalog, Generator
from shelfmark.session import prepare, run_folder

FIRST_RUN = datetime(2025, 6, 1, tzinfo=timezone.utc)
SECOND_RUN = datetime(2025, 7, 1, tzinfo=timezone.utc)
YEAR_SECONDS = 31_536_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _instant(start: str, offset: Column) -> Column:
    return F.timestamp_micros(
        F.unix_micros(F.lit(start).cast("timestamp"))
        + F.pmod(offset, F.lit(YEAR_SECONDS)) * F.lit(1_000_000))


def _scan(df: DataFrame, seen_from: str) -> DataFrame:
    """Complete a scan: FACTS columns plus `content`."""
    seen = _instant(seen_from, F.col("ordinal") * 7919)
    return (
        df.withColumn("observed_at", seen).withColumn("content_hash", F.lit(None).cast("string"))
        .select(*FACTS.fieldNames(), F.encode("body", "UTF-8").alias("content"))
    )


def document_facts(docs: DataFrame, body: Column, version: Column, leaf: str,
                   seen_from: str) -> DataFrame:
    lang, n = F.col("lang"), F.col("n_chars")
    mime = (F.when(lang == "en", "text/plain").when(lang == "fr", "text/markdown")
            .when(lang == "de", "TEXT/Plain; charset=utf-8")
            .when(F.pmod(n, F.lit(2)) == 1, "malformed"))
    ext = (F.when(lang == "fr", ".md").when(lang.isin("en", "de"), ".txt")
           .when(F.pmod(n, F.lit(2)) == 1, ".bin").otherwise(""))
    base = F.concat(F.lit(leaf) if leaf else F.when(lang == "de", "renamed-").otherwise("doc-"),
                    F.col("doc_id").cast("string"), ext)
    modified = _instant("2023-01-01 00:00:00",
                        n * 3607 + F.when(lang == "fr", F.col("doc_id")).otherwise(0))
    modified_text = F.when((lang == "es") & (F.pmod(n, F.lit(2)) == 1), "not a date").otherwise(
        F.date_format(modified, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    return _scan(docs.select(
        (F.col("doc_id") * 4).alias("ordinal"), F.col("source").alias("provider"),
        F.lit("file").alias("kind"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("external_id"),
        base.alias("name"), F.concat_ws("/", F.lit(""), lang, F.col("source"), base).alias("path"),
        F.octet_length(body).cast("bigint").alias("size"), mime.alias("mime_type"),
        modified_text.alias("modified_at"), version.alias("version_tag"),
        F.to_json(F.struct(modified_text.alias("getlastmodified"), lang.alias("lang")))
        .alias("raw"),
        body.alias("body")), seen_from)


def page_facts(pages: DataFrame, provider: str, prefix: str, slot: int, seen_from: str):
    name = F.concat(F.lit(f"{prefix}-"), F.col("page_id").cast("string"), F.lit(".html"))
    return _scan(pages.select(
        (F.col("page_id") * 4 + slot).alias("ordinal"), F.lit(provider).alias("provider"),
        F.lit("file").alias("kind"),
        F.concat(F.lit(f"{prefix}-"), F.col("page_id").cast("string")).alias("external_id"),
        name.alias("name"),
        F.concat(F.lit("/"), F.regexp_replace("url", "^https?://", "")).alias("path"),
        F.octet_length("html").cast("bigint").alias("size"), F.lit("text/html").alias("mime_type"),
        F.lit(None).cast("string").alias("modified_at"), F.lit("1").alias("version_tag"),
        F.to_json(F.struct(F.col("url"))).alias("raw"), F.col("html").alias("body")), seen_from)


def photo_facts(vectors: DataFrame, moved_label: int | None, seen_from: str) -> DataFrame:
    vec, label = F.col("vec_id"), F.col("label")
    text = label.cast("string")
    captured = _instant("2022-01-01 00:00:00", vec * 40009)
    stamp = F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss")
    modified = _instant("2022-06-01 00:00:00", vec * 40009 + F.when(
        label == moved_label, 60).otherwise(0) if moved_label is not None else vec * 40009)
    iso_modified = F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    exif = F.struct(
        F.concat(F.lit("City"), vec.cast("string")).alias("city"),
        F.concat(F.lit("Country"), text).alias("country"),
        F.when(label == 0, stamp).otherwise(F.concat(stamp, F.lit("+00:00")))
        .alias("dateTimeOriginal"),
        (F.pmod(vec * 37, F.lit(20000)) / F.lit(100.0) - F.lit(100.0)).cast("double")
        .alias("latitude"),
        (F.pmod(vec * 91, F.lit(40000)) / F.lit(100.0) - F.lit(200.0)).cast("double")
        .alias("longitude"),
        F.when(label == 1, "  ").otherwise(F.concat(F.lit("Maker"), text)).alias("make"),
        F.concat(F.lit("Model "), text).alias("model"),
        F.when(label != 2, F.concat(F.lit("State"), text)).alias("state"))
    name = F.concat(F.lit("IMG_"), vec.cast("string"), F.lit(".jpg"))
    body = F.concat(F.lit("photo-"), vec.cast("string"))
    return _scan(vectors.select(
        (vec * 4 + 2).alias("ordinal"), F.lit("immich").alias("provider"),
        F.lit("file").alias("kind"),
        F.concat(F.lit("img-"), vec.cast("string")).alias("external_id"), name.alias("name"),
        F.concat_ws("/", F.lit("/photos"), text, name).alias("path"),
        F.octet_length(body).cast("bigint").alias("size"), F.lit("image/jpeg").alias("mime_type"),
        iso_modified.alias("modified_at"), F.concat(F.lit("p-"), text).alias("version_tag"),
        F.to_json(F.struct(exif.alias("exif"), iso_modified.alias("fileModifiedAt")),
                  {"ignoreNullFields": "false"}).alias("raw"),
        body.alias("body")), seen_from)


def message_key() -> Column:
    return F.col("conv_id") * 10_000 + F.col("turn")


def message_body(edited: bool) -> Column:
    tail = F.when(F.col("role") == "system", " (edited)").otherwise("") if edited else F.lit("")
    return F.concat(
        F.lit("From: "), F.col("role"), F.lit("@example.org\r\nTo: team@example.org\r\n"),
        F.lit("Subject: Conversation "), F.col("conv_id").cast("string"),
        F.lit("\r\n\tturn "), F.col("turn").cast("string"), F.lit("\r\n\r\n"),
        F.col("text"), tail)


def message_facts(conversations: DataFrame, edited: bool, seen_from: str) -> DataFrame:
    body = message_body(edited)
    millis = F.lit(1_700_000_000_000) + message_key() * 1000
    return _scan(conversations.select(
        (message_key() * 4 + 3).alias("ordinal"), F.lit("gmail").alias("provider"),
        F.lit("message").alias("kind"),
        F.concat_ws("-", F.lit("msg"), F.col("conv_id").cast("string"),
                    F.col("turn").cast("string")).alias("external_id"),
        F.concat_ws(" ", F.lit("Conversation"), F.col("conv_id").cast("string"), F.lit("turn"),
                    F.col("turn").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("path"),
        F.octet_length(body).cast("bigint").alias("size"),
        F.lit("message/rfc822").alias("mime_type"), F.lit(None).cast("string").alias("modified_at"),
        F.lit(None).cast("string").alias("version_tag"),
        F.to_json(F.struct(millis.cast("string").alias("internalDate"))).alias("raw"),
        body.alias("body")), seen_from)


def item_facts(items: DataFrame, seen_from: str) -> DataFrame:
    name = F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit(".txt"))
    return _scan(items.select(
        (F.col("item_id") * 4 + 2_000_000_000_000).alias("ordinal"),
        F.lit("src0").alias("provider"), F.lit("file").alias("kind"),
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("external_id"),
        name.alias("name"), F.concat(F.lit("/items/"), name).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.lit("text/plain").alias("mime_type"), F.lit(None).cast("string").alias("modified_at"),
        F.lit("1").alias("version_tag"), F.lit("{}").alias("raw"), F.col("text").alias("body")),
        seen_from)


def first_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACTS plus `content`, one row per listed thing."""
    at = "2024-01-01 00:00:00"
    docs = table(spark, sf_dir, "documents")
    version = F.concat(F.lit("v-"), F.col("n_chars").cast("string"))
    return (
        document_facts(docs, F.col("text"), version, "doc-", at)
        .unionByName(page_facts(table(spark, sf_dir, "pages"), "web", "page", 1, at))
        .unionByName(photo_facts(table(spark, sf_dir, "embeddings"), None, at))
        .unionByName(message_facts(table(spark, sf_dir, "conversations"), False, at))
    )


def second_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "2025-01-01 00:00:00"
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").filter(
        F.coalesce("toxic", F.lit(0)) == 0)
    poor = F.coalesce("quality", F.lit(1)) == 0
    body = F.when(poor, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    version = F.concat(F.lit("v-"), F.col("n_chars").cast("string"),
                       F.when(poor, "-2").otherwise(""))
    pages = table(spark, sf_dir, "pages")
    return (
        document_facts(docs, body, version, "", at)
        .unionByName(page_facts(pages, "web", "page", 1, at))
        .unionByName(page_facts(pages, "mirror", "mirror", 4_000_000_000_001, at))
        .unionByName(photo_facts(table(spark, sf_dir, "embeddings"), 3, at))
        .unionByName(message_facts(table(spark, sf_dir, "conversations"), True, at))
        .unionByName(item_facts(table(spark, sf_dir, "benchmark"), at))
    )


def split_scan(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    return scan.drop("content"), scan.select("provider", "external_id", "content")


_written: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, key: str, sf_dir: str, names: list[str], build) -> list[DataFrame]:
    """Tables derived once per application and read back as Parquet by every later query.

    Queries then see stored tables, as on a real catalog: filters and column lists reach the
    scan, and a lost executor costs a re-read only.
    """
    prepare(spark)
    slot = (spark.sparkContext.applicationId, key, sf_dir)
    if slot not in _written:
        folder = run_folder(spark, key)
        for name, df in zip(names, build()):
            df.write.parquet(f"{folder}/{name}")
        _written[slot] = folder
    return [spark.read.schema(TABLES[name]).parquet(f"{_written[slot]}/{name}") for name in names]


def stored_path(spark: SparkSession, key: str, sf_dir: str, name: str) -> str:
    """Folder of a table that `stored` has written."""
    return f"{_written[(spark.sparkContext.applicationId, key, sf_dir)]}/{name}"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog after the first scan."""
    def build():
        facts, content = split_scan(first_scan(spark, sf_dir))
        return rec.reconcile(facts, Catalog.empty(spark), FIRST_RUN, content,
                             complete=True).catalog

    return Catalog(*stored(spark, "catalog", sf_dir, ["resources", "blobs", "sources"], build))


DOCUMENT_PROVIDERS = tuple(f"src{i}" for i in range(20))


def document_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("provider"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("external_id"),
        F.encode("text", "UTF-8").alias("content"))


def message_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_facts(table(spark, sf_dir, "conversations"), False, "2024-01-01 00:00:00").select(
        "provider", "external_id", "content")


def scan_key() -> Column:
    return F.concat(F.lit("scan-"), F.col("doc_id").cast("string"))


def scan_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog after the first scan and, beside it, scanned pages: one photo per document."""
    known = catalog(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").select("doc_id").distinct()
    resource_id, blob_id = (fn.uuid_text(F.lit(kind), scan_key()) for kind in ("resource", "blob"))
    at, none = F.lit(FIRST_RUN).cast("timestamp"), F.lit(None).cast("string")
    scans = Catalog(
        rows.select(resource_id.alias("id"), F.lit("file").alias("resource_type"),
                    scan_key().alias("title"), F.lit("{}").alias("metadata"),
                    at.alias("created_at"), at.alias("updated_at")),
        rows.select(blob_id.alias("id"), resource_id.alias("asset_id"),
                    F.sha2(scan_key(), 256).alias("hash"),
                    F.lit(None).cast("bigint").alias("size"),
                    F.lit("image/jpeg").alias("mime_type")),
        rows.select(fn.uuid_text(F.lit("source"), scan_key()).alias("id"),
                    blob_id.alias("blob_id"), F.lit("immich").alias("provider"),
                    scan_key().alias("external_id"), none.alias("path"), none.alias("name"),
                    none.alias("version_tag"), F.lit("{}").alias("metadata"),
                    F.lit(True).alias("is_active"),
                    F.lit(None).cast("timestamp").alias("deleted_at")))
    return Catalog(*[one.unionByName(other) for one, other in zip(known, scans)])


def ocr_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed OCR responses: for every scan the lines of its document; for every photo that
    shares its number with a document that one's lines, photos of label 7 having moved, those of
    8 being unavailable and those of 9 not found."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    body = F.to_json(F.transform(F.split("text", "\n"), lambda l: F.struct(l.alias("text"))))
    status = (F.when(F.col("label") == 9, 404).when(F.col("label") == 8, 503)
              .when(F.col("label") == 7, 302).otherwise(200))
    photos = table(spark, sf_dir, "embeddings").select("vec_id", "label").join(
        docs.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return docs.select(scan_key().alias("locator"), F.lit(200).alias("status"),
                       body.alias("body")).unionByName(photos.select(
        F.concat(F.lit("img-"), F.col("vec_id").cast("string")).alias("locator"),
        status.alias("status"), body.alias("body")))


def text_excerpts(spark, sf_dir) -> ex.TextExcerpt:
    return ex.TextExcerpt(document_content(spark, sf_dir), providers=None)


def file_modified(spark: SparkSession, sf_dir: str) -> ex.FileModified:
    """The extractor for photos and for every source that the documents name."""
    return ex.FileModified(http_providers=table(spark, sf_dir, "documents").select(
        F.col("source").alias("provider")))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current statements of the photo, modification, text and header extractors."""
    def build():
        known = catalog(spark, sf_dir)
        made = []
        for extractor in (ex.PhotoMetadata(), ex.PhotoGeo(), file_modified(spark, sf_dir),
                          text_excerpts(spark, sf_dir),
                          ex.MessageHeaders(message_content(spark, sf_dir))):
            made.append(pub.new_statements(extractor.drafts(ex.usable(extractor, known)),
                                           extractor.generator, FIRST_RUN))
        rows = made[0]
        for more in made[1:]:
            rows = rows.unionByName(more)
        return [rows]

    return stored(spark, "statements", sf_dir, ["statements"], build)[0]


LABELLER = Generator("custom", "document_labels", "1")
LABEL_PREDICATES = {"label.quality": ("integer", "multi"), "label.toxic": ("boolean", "multi")}


def label_drafts(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """Labels as drafts about the resource of their document's text; copies share a resource, so
    both predicates may hold several values. The second version has toxic ones re-rated to 0 and
    French ones unrated."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", fn.uuid_text(F.lit("resource"), F.lit("file"), F.sha2("text", 256))
        .alias("resource_id"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    quality = F.col("quality")
    if second:
        rows = rows.filter(F.col("lang") != "fr")
        quality = F.when(F.col("toxic") == 1, 0).otherwise(quality)
    return ex.unpivot(
        rows, ex.draft("label.quality", "integer", quality, "resource_content", "labels.quality",
                       F.lit(0.5)),
        ex.draft("label.toxic", "boolean", F.col("toxic") == 1, "resource_content",
                 "labels.toxic")).distinct()


def label_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        return [pub.new_statements(label_drafts(spark, sf_dir), LABELLER, FIRST_RUN)]

    return stored(spark, "label-statements", sf_dir, ["statements"], build)[0]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is one run of the job its user stands for."""
    keys = F.array(*[F.lit(key) for key, _, _ in JOBS])
    kinds = F.array(*[F.lit(kind) for _, kind, _ in JOBS])
    job = F.pmod("user_id", F.lit(len(JOBS))).cast("int")
    status = (F.when(F.col("event_type") == "error", "failed")
              .when(F.col("event_type") == "signup", "running").otherwise("completed"))
    started = F.col("ts").cast("timestamp")
    ended = F.timestamp_micros(
        F.unix_micros(started) + F.round(F.col("value") * 1000).cast("bigint") * 1000)
    return table(spark, sf_dir, "events").select(
        fn.uuid_text(F.lit("run"), F.col("event_id").cast("string")).alias("id"),
        F.get(keys, job).alias("pipeline_key"), F.get(kinds, job).alias("kind"),
        status.alias("status"), started.alias("started_at"),
        F.when(status != "running", ended).alias("finished_at"),
        F.when(status == "failed", "execution_failed").alias("error_code"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is one run: its first event begins it unless it is an error."""
    event = (F.when(F.col("event_type") == "signup", "begin")
             .when(F.col("event_type") == "error", "fail").otherwise("complete"))
    return table(spark, sf_dir, "events").select(
        fn.uuid_text(F.lit("user-run"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").alias("seq"), event.alias("event"),
        F.get(F.array(*[F.lit(key) for key, _, _ in JOBS]),
              F.pmod("user_id", F.lit(len(JOBS))).cast("int")).alias("pipeline_key"),
        F.lit("enrichment").alias("kind"), F.col("ts").cast("timestamp").alias("at"),
        F.when(event == "fail", "execution_failed").alias("error_code"))


def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, "turns", sf_dir, ["turn_events"], lambda: [_turn_events(spark, sf_dir)])[0]


def _turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is one turn. Numbers follow arrival; a value of 200 or more skips a number,
    and the last event ends the turn."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("turn_id"), F.col("event_id").alias("arrival"),
        "event_type", "value", "props")
    rows = number_rows(rows, ["turn_id"], "arrival", "place")
    ends = rows.groupBy("turn_id").agg(F.max("place").alias("last"))
    rows = rows.join(ends, "turn_id")
    kind, value = F.col("event_type"), F.col("value")
    started, ended = F.col("place") == 1, F.col("place") == F.col("last")
    phase = (F.when(value < 10, "thinking").when(value < 25, "searching")
             .when(value < 50, "reviewing").when(value < 100, "computing")
             .otherwise("composing"))
    type_ = (
        F.when(ended, F.when(kind == "error", "turn.failed")
               .when(kind == "signup", "turn.cancelled").otherwise("turn.completed"))
        .when(started, "turn.started")
        .when(kind.isin("click", "purchase"), "phase.changed")
        .when(kind == "view", "message.delta")
        .when(kind == "signup", "tool.started").otherwise("tool.completed"))
    tool = F.col("type").isin("tool.started", "tool.completed")
    operation = F.floor(value / 4).cast("int")
    none = F.lit(None)
    return rows.withColumn("type", type_).select(
        "turn_id", "arrival",
        (F.col("place") + F.when((value >= 200) & ~ended & ~started, 1).otherwise(0))
        .alias("sequence"), "type",
        F.when(F.col("type") == "phase.changed", phase).alias("phase"),
        F.when(F.col("type") == "message.delta", F.col("props")).alias("delta"),
        F.when(F.col("type") == "turn.failed", "runtime_failed").alias("error_code"),
        F.array().cast("array<string>").alias("resource_refs"),
        F.when(tool, operation).alias("operation_id"), F.when(tool, "other").alias("category"),
        F.when(tool, "use_tool").alias("capability"),
        F.when(F.col("type") == "tool.completed", F.round(value * 1000).cast("bigint"))
        .otherwise(none).alias("duration_ms"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups, clicks and views start a call, errors and purchases complete one; the call is
    named by the tens of its value and the tool by its whole part."""
    names = F.array(*[F.lit(n) for n in ("search_resources", "get_resource", "exec_python",
                                         "unlisted_tool")])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("turn_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type").isin("error", "purchase"), "complete").otherwise("start")
        .alias("event"),
        F.floor(F.col("value") / 10).cast("string").alias("call_id"),
        F.get(names, F.pmod(F.floor("value"), F.lit(4)).cast("int")).alias("tool"))


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant message is one retrieval result whose rows are the lines of its text."""
    lines = F.split("text", "\n")
    nested = F.col("turn") == 3
    plain = F.to_json(F.struct(F.struct(
        (F.pmod(F.char_length("text"), F.lit(5)) != 0).alias("ok"),
        F.transform(lines, lambda l: F.struct(
            fn.resource_ref(fn.uuid_text(F.lit("line"), l)).alias("resource_ref")))
        .alias("resources")).alias("structuredContent")))
    deep = F.to_json(F.struct(F.struct(
        (F.pmod(F.char_length("text"), F.lit(5)) != 0).alias("ok"),
        F.transform(lines, lambda l: F.struct(F.struct(
            fn.resource_ref(fn.uuid_text(F.lit("line"), l)).alias("resource_ref"))
            .alias("resource"))).alias("hits")).alias("structuredContent")))
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        F.col("conv_id").cast("string").alias("turn_id"), F.col("turn").alias("start_no"),
        F.when(nested, "retrieve_resources").otherwise("search_resources").alias("tool"),
        F.when(nested, deep).otherwise(plain).alias("result"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_micros((F.lit(1_700_000_000) + message_key()) * 1_000_000)
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("conversation_id"), "role",
        F.col("text").alias("body"), at.alias("created_at"))


def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running turn of every conversation: it answers the last user message."""
    own = messages(spark, sf_dir).filter(F.col("role") == "user").groupBy("conversation_id").agg(
        F.max_by(F.struct("id", "created_at"), "created_at").alias("m"))
    none = F.lit(None).cast("string")
    return own.select(
        fn.uuid_text(F.lit("turn"), "conversation_id").alias("id"), "conversation_id",
        F.col("m.id").alias("user_message_id"), none.alias("assistant_message_id"),
        F.lit("running").alias("status"), F.col("m.created_at").alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), none.alias("error_code"))


def people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inventory, persons, person_sources): known customers are those of the first 20 nations,
    inactive if in debt; the inventory lists everyone but the furniture segment."""
    rows = table(spark, sf_dir, "customer").withColumn(
        "external_id", F.concat(F.lit("person-"), F.col("c_custkey").cast("string")))
    person = fn.uuid_text(F.lit("person"), F.lit("immich"), "external_id")
    known = rows.filter(F.col("c_nationkey") < 20)
    at = F.lit(FIRST_RUN).cast("timestamp")
    return (
        rows.filter(F.col("c_mktsegment") != "FURNITURE").select("external_id"),
        known.select(person.alias("id"), at.alias("created_at")),
        known.select(F.lit("immich").alias("provider"), "external_id", person.alias("person_id"),
                     F.when(F.col("c_acctbal") < 0, at).alias("inactive_at")))


def part_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """A photo catalog with one resource per part; parts of size 50 are inactive, parts of size 1
    share the resource of their type."""
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("external_id"),
        F.when(F.col("p_size") == 1, F.concat(F.lit("type-"), F.col("p_type")))
        .otherwise(F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))).alias("key"),
        (F.col("p_size") != 50).alias("is_active"))
    resource_id, blob_id = fn.uuid_text(F.lit("resource"), "key"), fn.uuid_text(F.lit("blob"), "key")
    at, none = F.lit(FIRST_RUN).cast("timestamp"), F.lit(None).cast("string")
    keys = rows.select("key").distinct()
    return Catalog(
        keys.select(resource_id.alias("id"), F.lit("file").alias("resource_type"),
                    F.col("key").alias("title"), F.lit("{}").alias("metadata"),
                    at.alias("created_at"), at.alias("updated_at")),
        keys.select(blob_id.alias("id"), resource_id.alias("asset_id"),
                    F.sha2("key", 256).alias("hash"), F.lit(None).cast("bigint").alias("size"),
                    F.lit("image/jpeg").alias("mime_type")),
        rows.select(fn.uuid_text(F.lit("source"), "external_id").alias("id"),
                    blob_id.alias("blob_id"), F.lit("immich").alias("provider"), "external_id",
                    none.alias("path"), none.alias("name"), none.alias("version_tag"),
                    F.lit("{}").alias("metadata"), "is_active",
                    F.lit(None).cast("timestamp").alias("deleted_at")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External (part, customer) pairs with the flags of their line items."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, "o_orderkey").select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("asset_external_id"),
        F.concat(F.lit("person-"), F.col("o_custkey").cast("string")).alias("person_external_id"),
        "l_returnflag", "l_linestatus")


def stored_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations known before: returned items are active relations, accepted ones ended ones."""
    rows = pairs(spark, sf_dir).filter(F.col("l_returnflag") != "N")
    _, _, sources = people(spark, sf_dir)
    mapped = rows.join(
        sources.select(F.col("external_id").alias("person_external_id"), "person_id"),
        "person_external_id").join(
        table(spark, sf_dir, "part").select(
            F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("asset_external_id"),
            fn.uuid_text(F.lit("resource"), F.when(
                F.col("p_size") == 1, F.concat(F.lit("type-"), F.col("p_type"))).otherwise(
                F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))).alias("resource_id")),
        "asset_external_id")
    return mapped.groupBy("resource_id", "person_id").agg(
        F.max("l_returnflag").alias("flag")).select(
        "resource_id", "person_id", F.lit("immich").alias("provider"),
        F.when(F.col("flag") == "A", F.lit(FIRST_RUN).cast("timestamp")).alias("inactive_at"))
