"""Registered queries over live tables, claims, inventories of several batches and turn streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import extract as ex
from shelfmark.operators import publish as pub
from shelfmark.operators import reconcile as rec
from shelfmark.operators import turns as tn
from shelfmark.plans import bind
from shelfmark.plans import oracle as o
from shelfmark.plans.workload import ORACLE, SECOND, _next_catalog, register
from shelfmark.plans.workload_sources import listings, photo_pages
from shelfmark.plans.workload_state import EXCERPTS, FILE_OF_TEXT, TEXT_SOURCE
from shelfmark.plans.workload_turns import FOLD
from shelfmark.schemas import Catalog, Generator, predicate_table
from shelfmark.session import materialise, run_folder
from shelfmark.sources import drive, enrichment, photos, provider, sync, tables
from shelfmark.streaming import ingest
from shelfmark.streaming import turns as stream_turns

# --- live tables ----------------------------------------------------------------------------


@register("live_catalog_sources", ORACLE["next_catalog_sources"])
def live_catalog_sources(spark, sf_dir):
    """The second run merged into live tables that hold the first."""
    root = run_folder(spark, "live-catalog")
    catalog = bind.catalog(spark, sf_dir)
    tables.commit_changes(spark, root, catalog._asdict())
    _next_catalog(spark, sf_dir)
    facts, decisions = bind.stored(spark, "second-run", sf_dir, ["facts", "decisions"], None)
    before = tables.read_catalog(spark, root)
    made = rec.changes(decisions, rec.missing_sources(facts, before), before, bind.SECOND_RUN)
    tables.commit_changes(spark, root, made._asdict())
    return tables.read_catalog(spark, root).sources.drop("metadata")


@register("live_statements", ORACLE["publish_statements"])
def live_statements(spark, sf_dir):
    """The second version of the labels published over live statements, history included."""
    root = run_folder(spark, "live-statements")
    tables.commit_changes(spark, root, {"statements": bind.label_statements(spark, sf_dir)})
    old = tables.read_statements(spark, root)
    batch = old.select(F.col("subject_asset_id").alias("resource_id")).distinct()
    done = pub.publish(old, bind.label_drafts(spark, sf_dir, True), batch, bind.LABELLER,
                       tuple(bind.LABEL_PREDICATES), bind.SECOND_RUN)
    tables.commit_statements(spark, root, done, "second")
    return tables.read_statements(spark, root, history=True).select(
        F.col("subject_asset_id").alias("subject"), "predicate", pub.value_text().alias("value"),
        "is_current", F.when(F.col("created_at") == F.lit(bind.FIRST_RUN), 1).otherwise(2)
        .alias("version"))


# --- claims and reruns ----------------------------------------------------------------------

_TEXTS = f"""{EXCERPTS},
    subjects AS (SELECT DISTINCT id, hash, size FROM joined WHERE {TEXT_SOURCE}),
    n AS (SELECT count(*) AS all_n, count(*) FILTER (WHERE size <= 1048576) AS good FROM subjects),
    made AS (SELECT count(*) AS n FROM excerpts)"""


def _unreadable(content):
    """Content that stops the query if any of it is read."""
    return content.withColumn("content", F.raise_error(F.lit("content was read")).cast("binary"))


@register("text_rerun", f"""WITH {o.CATALOG}, {o.JOINED}, {_TEXTS}
    SELECT 1 AS run, all_n AS discovered, good AS processed, 0 AS skipped, all_n - good AS failed,
      (SELECT n FROM made) AS writes, 0 AS deactivated FROM n
    UNION ALL SELECT 2, all_n, 0, good, all_n - good, 0, 0 FROM n""")
def text_rerun(spark, sf_dir):
    """Totals of the text extractor over stored tables, run twice: the second run skips all that
    was done and reads no content, which it could not."""
    root = run_folder(spark, "text-rerun")
    catalog = bind.catalog(spark, sf_dir)
    content = bind.document_content(spark, sf_dir)
    first = enrichment.run_stored(spark, root, ex.TextExcerpt(content, providers=None),
                                  bind.FIRST_RUN, catalog=catalog)
    again = enrichment.run_stored(
        spark, root, ex.TextExcerpt(_unreadable(content), providers=None), bind.SECOND_RUN,
        catalog=catalog)
    return first.totals.select(F.lit(1).alias("run"), "*").unionByName(
        again.totals.select(F.lit(2).alias("run"), "*"))


@register("claimed_photos", """SELECT worker, count(*) AS discovered,
      CASE WHEN worker = 'fresh' THEN 0 ELSE count(*) END AS claimed,
      CASE WHEN worker = 'fresh' THEN count(*) ELSE 0 END AS skipped
    FROM embeddings, (VALUES ('fresh'), ('first'), ('stale')) w(worker) GROUP BY worker""")
def claimed_photos(spark, sf_dir):
    """A worker claims every photo and dies; one that comes at once skips them all, one that comes
    after the claims have gone stale claims them again."""
    root = run_folder(spark, "claims")
    extractor, catalog = ex.PhotoMetadata(), bind.catalog(spark, sf_dir)
    rows = []
    for worker, late in (("first", 0), ("fresh", 29), ("stale", 31)):
        now = bind.FIRST_RUN + timedelta(minutes=late)
        judged = materialise(pub.gate(extractor.inputs(catalog), tables.read_states(spark, root),
                                      extractor.generator, now), f"judged-{worker}")
        wanted = judged.filter("gate = 'run'")
        tables.merge(spark, root, "enrichment_states",
                     pub.claims(wanted, extractor.generator, now))
        rows.append(judged.agg(
            F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("gate") == "run").alias("claimed"),
            F.count_if(F.col("gate") == "skip").alias("skipped")).select(
            F.lit(worker).alias("worker"), "*"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- inventories over several batches -------------------------------------------------------

@register("stream_inventory", """WITH n AS (SELECT count(*) AS n,
      count(*) FILTER (WHERE label = 3) AS gone FROM embeddings)
    SELECT step, CASE WHEN step = 3 THEN n - gone ELSE n END AS active,
      CASE WHEN step = 3 THEN gone ELSE 0 END AS ended FROM n, (VALUES (0), (1), (2), (3)) s(step)""")
def stream_inventory(spark, sf_dir):
    """A whole inventory, then one without the photos of label 3 that lands in three batches:
    they end with the third, not before."""
    landing, root = run_folder(spark, "inventory-landing"), run_folder(spark, "inventory-root")
    check = run_folder(spark, "inventory-checkpoint")
    bodies = bind.table(spark, sf_dir, "embeddings").select(
        F.lit("immich").alias("provider"),
        F.concat(F.lit("img-"), F.col("vec_id").cast("string")).alias("external_id"),
        F.encode(F.concat(F.lit("photo-"), F.col("vec_id").cast("string")), "UTF-8")
        .alias("content"))
    whole = photo_pages(spark, sf_dir, 50)
    later = photo_pages(spark, sf_dir, 50, F.col("label") != 3)
    number = F.get_json_object("body", "$.page").cast("int")
    third = F.pmod(number - 1, F.lit(3))
    out = None
    for step, pages in enumerate((whole, *[later.filter(third == k) for k in range(3)])):
        pages.select(F.col("body").alias("value")).write.mode("append").text(landing)
        ingest.ingest_stream(spark, landing, root, check, content=lambda session: bodies,
                             now=bind.FIRST_RUN, multi_line=False).awaitTermination()
        state = materialise(tables.read_catalog(spark, root).sources.agg(
            F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("ended"))
            .select(F.lit(step).alias("step"), "*"), f"inventory-{step}")
        out = state if out is None else out.unionByName(state)
    return out


# --- large listings -------------------------------------------------------------------------

@register("listing_file_facts", ORACLE["landed_directory_facts"])
def listing_file_facts(spark, sf_dir):
    """The directory listings as landed files, read entry by entry."""
    landing = run_folder(spark, "listing-files")
    listings(spark, sf_dir).select(
        F.col("listing_path").alias("listing"), F.col("body").alias("value")).write.partitionBy(
        "listing").text(landing)
    rows = drive.read_entries(spark, landing, F.col("listing"))
    return drive.entry_facts(rows.filter("broken IS NULL"), "u").select(
        "external_id", "kind", "name", "path", "size", "mime_type", "version_tag",
        fn.json_string("raw", "$.file_id").alias("file_id"))


@register("listing_file_problems", """WITH shards AS (SELECT DISTINCT doc_id // 100 AS s FROM documents)
    SELECT 'shard ' || s AS listing_path, 'broken listing' AS problem FROM shards WHERE s % 4 = 1
    UNION ALL SELECT 'shard ' || (s + 1), 'folder without listing' FROM shards
      WHERE s + 1 NOT IN (SELECT s FROM shards)""")
def listing_file_problems(spark, sf_dir):
    """Every fourth landed listing lacks its end; the last one names a directory that is not
    landed."""
    landing = run_folder(spark, "listing-files-cut")
    number = F.substring_index("listing_path", " ", -1).cast("int")
    whole = F.pmod(number, F.lit(4)) != 1
    listings(spark, sf_dir).select(
        F.col("listing_path").alias("listing"),
        F.when(whole, F.col("body")).otherwise(F.regexp_replace("body", drive.END_TAG, ""))
        .alias("value")).write.partitionBy("listing").text(landing)
    rows = drive.read_entries(spark, landing, F.col("listing"))
    files = drive.listing_files(spark, landing, F.col("listing"))
    return drive.file_problems(rows, files, "u")


# --- extensions -----------------------------------------------------------------------------

_LANDED = """SELECT 'img-' || vec_id AS external_id, 'IMG_' || vec_id || '.jpg' AS name,
      'u-' || label AS version_tag FROM embeddings"""


def _landed_pages(spark, sf_dir, name):
    """Pages as one file each, and the data source registered."""
    landing = run_folder(spark, name)
    photo_pages(spark, sf_dir, 50).repartition(8).select(F.col("body").alias("value")).write.option(
        "maxRecordsPerFile", 1).text(landing)
    spark.dataSource.register(provider.LandedPages)
    return landing


@register("provider_pages", _LANDED)
def provider_pages(spark, sf_dir):
    """Photo facts through the landed-pages data source, in batch."""
    landing = _landed_pages(spark, sf_dir, "source-pages")
    pages = spark.read.format("landed_pages").option("path", landing).load()
    return photos.photo_facts(photos.parse_pages(pages)).select("external_id", "name",
                                                                "version_tag")


@register("provider_page_stream", _LANDED)
def provider_page_stream(spark, sf_dir):
    """Photo facts through the landed-pages data source, as a stream in two drains."""
    landing = _landed_pages(spark, sf_dir, "stream-pages")
    out, check = run_folder(spark, "stream-facts"), run_folder(spark, "stream-facts-checkpoint")
    for _ in range(2):
        pages = spark.readStream.format("landed_pages").option("path", landing).load()
        (photos.photo_facts(photos.parse_pages(pages)).select("external_id", "name", "version_tag")
         .writeStream.format("parquet").option("checkpointLocation", check)
         .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.parquet(out)


WORDS = Generator("custom", "text_words", "1")
WORD_PREDICATES = {"text.words": ("integer", "single"), "text.longest_word": ("string", "single")}


class TextWords:
    """How many words a text has, and its longest word (the first of equals)."""

    def eval(self, text):
        import re
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield ("text.words", "integer", None, len(words), None, None, "text", 1.0)
        if words:
            yield ("text.longest_word", "string", max(words, key=len), None, None, None, "text",
                   None)


@register("function_statements", f"""WITH {o.CATALOG}, {o.JOINED}, {EXCERPTS},
    words AS (SELECT id, regexp_extract_all(excerpt, '[^\x20\x09-\x0D]+') AS w FROM excerpts)
    SELECT id AS resource_id, 'text.words' AS predicate, CAST(len(w) AS VARCHAR) AS value FROM words
    UNION ALL SELECT id, 'text.longest_word', w[list_position(list_transform(w, lambda x: length(x)),
      list_max(list_transform(w, lambda x: length(x))))] FROM words WHERE len(w) > 0""")
def function_statements(spark, sf_dir):
    """Statements of a Python table function over the texts, through an enrichment run."""
    function = F.udtf(TextWords, returnType=ex.UDTF_DRAFT, useArrow=True)
    spark.udtf.register("text_words", function)
    extractor = ex.TableFunctionExtractor(function, bind.text_excerpts(spark, sf_dir), WORDS,
                                          tuple(WORD_PREDICATES))
    root = run_folder(spark, "function-statements")
    enrichment.run_stored(spark, root, extractor, bind.FIRST_RUN,
                          catalog=bind.catalog(spark, sf_dir),
                          registry=predicate_table(spark, WORD_PREDICATES))
    return tables.read_statements(spark, root).select(
        F.col("subject_asset_id").alias("resource_id"), "predicate",
        pub.value_text().alias("value"))


# --- whole-inventory syncs ------------------------------------------------------------------

@register("synced_messages", """SELECT 'm-' || conv_id || '-' || turn AS external_id,
      sha256(text) AS version_tag, sha256(text) AS hash FROM conversations""")
def synced_messages(spark, sf_dir):
    """Messages synced from their landed id pages, metadata and raw content."""
    from shelfmark.plans.workload_sources import message_pages, raw_messages
    from shelfmark.sources import mail
    pages, metadata = message_pages(spark, sf_dir)
    run = sync.sync_message_pages(pages, metadata, Catalog.empty(spark), bind.FIRST_RUN,
                                  mail.message_content(raw_messages(spark, sf_dir)))
    return run.catalog.sources.join(
        run.catalog.blobs.select(F.col("id").alias("blob_id"), "hash"), "blob_id").select(
        "external_id", "version_tag", "hash")


# --- turn streams ---------------------------------------------------------------------------

def _verdicts(spark, sf_dir):
    """Folder of the verdicts that the streaming fold has written."""
    stored = bind.turn_events(spark, sf_dir)
    events = spark.readStream.schema(stored.schema).parquet(bind.stored_path(
        spark, "turns", sf_dir, "turn_events"))
    return _drained(spark, stream_turns.fold_stream(events), "verdicts")


def _drained(spark, rows, name):
    out = run_folder(spark, name)
    query = (rows.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", run_folder(spark, f"{name}-checkpoint"))
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    return out


@register("stream_turn_trace", ORACLE["turn_trace"])
def stream_turn_trace(spark, sf_dir):
    """Execution steps as the trace stream leaves them."""
    verdicts = spark.readStream.schema(stream_turns.OUTPUT).parquet(_verdicts(spark, sf_dir))
    out = _drained(spark, stream_turns.trace_stream(verdicts), "trace-changes")
    return stream_turns.current_steps(spark.read.schema(stream_turns.STEPS).parquet(out))


@register("stream_turn_texts", f"""WITH {FOLD}
    SELECT turn_id, sequence, delta FROM accepted WHERE delta IS NOT NULL""")
def stream_turn_texts(spark, sf_dir):
    """Texts joined to the verdicts of the streaming fold, which carries none."""
    verdicts = spark.read.schema(stream_turns.OUTPUT).parquet(_verdicts(spark, sf_dir))
    return stream_turns.with_texts(verdicts, bind.turn_events(spark, sf_dir)).filter(
        "accepted AND delta IS NOT NULL").select("turn_id", "sequence", "delta")


@register("stream_turn_registry", f"""WITH {FOLD},
    turns AS (SELECT turn_id, CAST(CAST(turn_id AS BIGINT) % 2 AS VARCHAR) AS registry,
        min(arrival) FILTER (WHERE type IN ('turn.completed', 'turn.failed', 'turn.cancelled'))
          AS ended FROM accepted GROUP BY turn_id),
    sizes AS (SELECT registry, count(*) AS n FROM turns GROUP BY registry)
    SELECT registry, turn_id, ended FROM (SELECT *, row_number() OVER (
        PARTITION BY registry ORDER BY ended) AS place FROM turns WHERE ended IS NOT NULL)
      JOIN sizes USING (registry) WHERE place <= n - 64""")
def stream_turn_registry(spark, sf_dir):
    """Two registries of 64 turns: those that ended first have left, running ones stay."""
    verdicts = spark.readStream.schema(stream_turns.OUTPUT).parquet(_verdicts(spark, sf_dir))
    registry = F.pmod(F.col("turn_id").cast("bigint"), F.lit(2)).cast("string")
    out = _drained(spark, stream_turns.registry_stream(verdicts, registry, 64), "evicted")
    return spark.read.schema(stream_turns.EVICTED).parquet(out).select(
        "registry", "turn_id", "ended")
