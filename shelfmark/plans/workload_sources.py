"""Registered queries over landed provider responses and the streaming jobs.

The landed responses are built from the given tables by Spark, one page per fixed range of keys,
then parsed by the same adapters that read landed files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import turns as tn
from shelfmark.operators.ordered import number_rows
from shelfmark.plans import bind
from shelfmark.plans import oracle as o
from shelfmark.plans.workload import register
from shelfmark.plans.workload_turns import FOLD
from shelfmark.session import run_folder
from shelfmark.sources import drive, gate, mail, photos, tables
from shelfmark.streaming import ingest
from shelfmark.streaming import turns as stream_turns

PAGE_SIZE = 100


# --- photo pages ----------------------------------------------------------------------------

def photo_pages(spark, sf_dir, page_size=PAGE_SIZE, listed=None):
    """Inventory pages as JSON text; the size field takes every shape a response may have."""
    vec, label = F.col("vec_id"), F.col("label")
    size = (F.when(label == 1, F.concat(F.lit('"'), vec.cast("string"), F.lit('"')))
            .when(label == 2, "-5").when(label == 3, "true").when(label == 4, "null")
            .when(label == 5, '"many"').otherwise(vec.cast("string")))
    item = F.concat(
        F.lit('{"id":"img-'), vec.cast("string"), F.lit('","originalFileName":"IMG_'),
        vec.cast("string"), F.lit('.jpg","originalPath":'),
        F.when(label == 6, "7").otherwise(F.concat(F.lit('"/p/'), label.cast("string"),
                                                   F.lit('"'))),
        F.lit(',"originalMimeType":"image/jpeg","updatedAt":"u-'), label.cast("string"),
        F.lit('","checksum":'), F.when(label == 7, "null").otherwise('"c="'),
        F.lit(',"isFavorite":true,"width":'), vec.cast("string"),
        F.lit(',"exifInfo":{"make":"M","fileSizeInByte":'), size, F.lit("}}"))
    rows = bind.table(spark, sf_dir, "embeddings")
    rows = (rows if listed is None else rows.filter(listed)).select(
        (F.floor(vec / page_size) + 1).alias("page"), F.struct(vec, item.alias("item")).alias("i"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("i")).alias("items"))
    last = pages.agg(F.max("page").alias("last")).scalar()
    more = F.when(F.col("page") < last, F.concat(
        F.lit(',"nextPage":"'), (F.col("page") + 1).cast("string"), F.lit('"'))).otherwise(
        ',"nextPage":null')
    return pages.select(F.concat(
        F.lit('{"page":'), F.col("page").cast("string"), F.lit(',"assets":{"items":['),
        F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit("]"), more,
        F.lit("}}")).alias("body"))


@register("landed_photo_facts", """SELECT (vec_id // 100 + 1) * 4294967296 + vec_id % 100 AS ordinal,
      'img-' || vec_id AS external_id, 'IMG_' || vec_id || '.jpg' AS name,
      CASE WHEN label <> 6 THEN '/p/' || label END AS path,
      CASE WHEN label NOT IN (2, 3, 4, 5) THEN vec_id END AS size, 'u-' || label AS version_tag,
      CASE WHEN label <> 7 THEN 'sha1' END AS algorithm, vec_id AS width, 'M' AS make
    FROM embeddings""")
def landed_photo_facts(spark, sf_dir):
    facts = photos.photo_facts(photos.parse_pages(photo_pages(spark, sf_dir)))
    return facts.select(
        "ordinal", "external_id", "name", "path", "size", "version_tag",
        fn.json_string("raw", "$.checksum_algorithm").alias("algorithm"),
        fn.json_path("raw", "$.width", "bigint").alias("width"),
        fn.json_string("raw", "$.exif.make").alias("make"))


@register("landed_people", """SELECT 'person-' || c_custkey AS external_id FROM customer""")
def landed_people(spark, sf_dir):
    key = F.col("c_custkey")
    rows = bind.table(spark, sf_dir, "customer").select(
        (F.floor(key / PAGE_SIZE) + 1).alias("page"),
        F.struct(F.concat(F.lit("person-"), key.cast("string")).alias("id")).alias("p"))
    bodies = rows.groupBy("page").agg(F.collect_list("p").alias("people")).select(F.to_json(
        F.struct("page", "people", F.lit(0).alias("total"), F.lit(False).alias("hasNextPage")))
        .alias("body"))
    return photos.people_inventory(photos.parse_pages(bodies, photos.PEOPLE_PAGE))


@register("landed_relations", """SELECT DISTINCT 'part-' || l_partkey AS asset_external_id,
      'person-' || o_custkey AS person_external_id
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def landed_relations(spark, sf_dir):
    """One landed page per order: the parts it shows for its customer."""
    lines = bind.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("id"))
        .alias("i"))
    orders = bind.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # Keys pack well in a shuffle, so partitions merged by their size there would unfold to
    # millions of pages in one task.
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    pages = lines.groupBy("o_orderkey").agg(F.collect_list("i").alias("items")).join(
        orders, "o_orderkey")
    bodies = pages.select(F.to_json(F.struct(
        F.concat(F.lit("person-"), F.col("o_custkey").cast("string")).alias("personId"),
        F.col("o_orderkey").alias("page"), F.struct("items").alias("assets"))).alias("body"))
    return photos.observed_pairs(photos.parse_pages(bodies, photos.RELATION_PAGE))


@register("landed_hits", """SELECT CAST(label AS BIGINT) * 1000000 + vec_id // 100 AS query_id,
      'img-' || vec_id AS locator,
      CAST(row_number() OVER (PARTITION BY label, vec_id // 100 ORDER BY vec_id) AS INTEGER) AS rank
    FROM embeddings""")
def landed_hits(spark, sf_dir):
    """Responses that list every hit twice, the second time backwards."""
    rows = bind.table(spark, sf_dir, "embeddings").select(
        (F.col("label").cast("bigint") * 1_000_000 + F.floor(F.col("vec_id") / PAGE_SIZE))
        .alias("query_id"), "vec_id")
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("vec_id")).alias("v"))
    items = F.transform(F.concat("v", F.reverse("v")), lambda v: F.struct(
        F.concat(F.lit("img-"), v.cast("string")).alias("id")))
    return photos.semantic_hits(lists.select("query_id", F.to_json(
        F.struct(F.struct(items.alias("items")).alias("assets"))).alias("body")))


@register("inventory_gate", """WITH links AS (
      SELECT DISTINCT 'l' || label AS listing, vec_id // 100 + 1 AS page, label,
        CASE WHEN label = 1 THEN vec_id // 100 ELSE 500 END AS total FROM embeddings),
    ends AS (SELECT max(vec_id // 100 + 1) AS last FROM embeddings)
    SELECT DISTINCT listing, 'total changed' AS problem FROM links, ends
      WHERE label = 1 AND last > 1
    UNION ALL SELECT DISTINCT listing, 'missing page' FROM links, ends WHERE label = 2 AND last > 1
    UNION ALL SELECT DISTINCT listing, 'unreachable page' FROM links, ends
      WHERE label = 2 AND last > 2
    UNION ALL SELECT DISTINCT listing, 'repeated page' FROM links WHERE label = 3
    UNION ALL SELECT DISTINCT listing, 'repeated next page' FROM links, ends
      WHERE label = 3 AND last > 1
    UNION ALL SELECT DISTINCT listing, 'not one terminal page' FROM links, ends
      WHERE (label = 3) OR (label = 2 AND last = 2)""")
def inventory_gate(spark, sf_dir):
    """A listing per label: 1 changes its total, 2 lacks its second page, 3 has every page twice."""
    label, page = F.col("label"), F.col("page")
    rows = bind.table(spark, sf_dir, "embeddings").select(
        "label", (F.floor(F.col("vec_id") / PAGE_SIZE) + 1).alias("page"))
    last = rows.agg(F.max("page").alias("last")).scalar()
    links = rows.distinct().select(
        F.concat(F.lit("l"), label.cast("string")).alias("listing"), "label",
        page.cast("string").alias("page"),
        F.when(page < last, (page + 1).cast("string")).alias("next"),
        F.when(label == 1, page - 1).otherwise(500).alias("total"))
    links = links.filter((label != 2) | (page != "2"))
    links = links.unionByName(links.filter(label == 3)).drop("label")
    return gate.inventory_problems(links, constant_total=True)


# --- directory listings ---------------------------------------------------------------------

def listings(spark, sf_dir):
    """A listing per hundred documents: its own row, its documents and the next directory."""
    doc, lang = F.col("doc_id"), F.col("lang")
    shard = F.floor(doc / PAGE_SIZE)
    root = F.lit("/remote.php/dav/files/u/shard%20")

    def response(path, props):
        return F.concat(F.lit("<d:response><d:href>"), path,
                        F.lit("</d:href><d:propstat><d:prop>"), *props,
                        F.lit("</d:prop></d:propstat></d:response>"))

    def folder(n):
        return response(F.concat(root, n, F.lit("/")), [
            F.lit("<oc:id>folder-"), n, F.lit("</oc:id><d:resourcetype><d:collection/>"
                                              "</d:resourcetype>")])

    body = response(
        F.concat(root, shard.cast("string"), F.lit("/doc+"), doc.cast("string"),
                 F.lit("%C3%A9.txt")),
        [F.lit("<oc:id>oc-"), doc.cast("string"), F.lit("</oc:id><oc:fileid>"),
         doc.cast("string"), F.lit("</oc:fileid><d:resourcetype/><d:getcontentlength>"),
         F.octet_length("text").cast("string"), F.lit("</d:getcontentlength><d:getcontenttype>"),
         F.when(lang == "fr", "text/markdown").otherwise("text/plain"),
         F.lit("</d:getcontenttype><d:getetag>&quot;e"), F.col("n_chars").cast("string"),
         F.lit("&quot;</d:getetag>")])
    rows = bind.table(spark, sf_dir, "documents").select(
        shard.alias("shard"), F.struct(doc, body.alias("body")).alias("r"))
    lists = rows.groupBy("shard").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    this, after = F.col("shard").cast("string"), (F.col("shard") + 1).cast("string")
    return lists.select(
        F.concat(F.lit("shard "), this).alias("listing_path"),
        F.concat(F.lit('<d:multistatus xmlns:d="DAV:" xmlns:oc="http://owncloud.org/ns">'),
                 folder(this), F.array_join(F.transform("rs", lambda r: r["body"]), ""),
                 folder(after), F.lit("</d:multistatus>")).alias("body"))


@register("landed_directory_facts", f"""SELECT 'oc-' || doc_id AS external_id, 'file' AS kind,
      'doc+' || doc_id || 'é.txt' AS name,
      'shard ' || doc_id // 100 || '/doc+' || doc_id || 'é.txt' AS path, {o.size('text')} AS size,
      CASE WHEN lang = 'fr' THEN 'text/markdown' ELSE 'text/plain' END AS mime_type,
      '"e' || n_chars || '"' AS version_tag, CAST(doc_id AS VARCHAR) AS file_id FROM documents
    UNION ALL SELECT DISTINCT 'folder-' || doc_id // 100 + 1, 'folder',
      'shard ' || doc_id // 100 + 1, 'shard ' || doc_id // 100 + 1 || '/', NULL, NULL, NULL, NULL
    FROM documents""".replace("doc_id // 100 + 1", "(doc_id // 100 + 1)").replace(
        "'shard ' || doc_id // 100 ||", "'shard ' || (doc_id // 100) ||"))
def landed_directory_facts(spark, sf_dir):
    return drive.drive_facts(listings(spark, sf_dir), "u").select(
        "external_id", "kind", "name", "path", "size", "mime_type", "version_tag",
        fn.json_string("raw", "$.file_id").alias("file_id"))


@register("unlisted_folders", """SELECT DISTINCT 'shard ' || (doc_id // 100 + 1) AS folder
    FROM documents WHERE doc_id // 100 + 1 NOT IN (SELECT doc_id // 100 FROM documents)""")
def unlisted_folders(spark, sf_dir):
    return drive.unlisted_folders(listings(spark, sf_dir), "u")


# --- messages -------------------------------------------------------------------------------

def _message_id():
    return F.concat_ws("-", F.lit("m"), F.col("conv_id").cast("string"),
                       F.col("turn").cast("string"))


@register("landed_message_facts", """SELECT 'm-' || conv_id || '-' || turn AS external_id,
      CASE WHEN turn <> 0 THEN 'About ' || conv_id END AS name,
      CAST(1700000000000 + conv_id * 10000 + turn AS VARCHAR) AS internal_date FROM conversations""")
def landed_message_facts(spark, sf_dir):
    return mail.message_facts(*message_pages(spark, sf_dir)).select(
        "external_id", "name", fn.json_string("raw", "$.internalDate").alias("internal_date"))


def message_pages(spark, sf_dir):
    """Id pages of a conversation each, in one chain, and the metadata of all messages."""
    rows = bind.table(spark, sf_dir, "conversations")
    convs = number_rows(rows.select(F.lit(0).alias("all"), "conv_id").distinct(), ["all"],
                        "conv_id", "number")
    last = convs.agg(F.max("number").alias("last")).scalar()
    pages = rows.groupBy("conv_id").agg(
        F.collect_list(F.struct(_message_id().alias("id"))).alias("messages")).join(
        convs, "conv_id").select(
        F.when(F.col("number") > 1, F.col("number").cast("string")).alias("token"), "messages",
        F.when(F.col("number") < last, (F.col("number") + 1).cast("string"))
        .alias("nextPageToken"))
    subject = F.when(F.col("turn") == 0, "  ").otherwise(
        F.concat(F.lit(" About "), F.col("conv_id").cast("string"), F.lit(" ")))
    headers = F.array(
        F.struct(F.lit("From").alias("name"), F.col("role").alias("value")),
        F.struct(F.lit("SUBJECT").alias("name"), subject.alias("value")))
    metadata = rows.select(
        _message_id().alias("id"), (F.lit(1_700_000_000_000) + bind.message_key()).cast("string")
        .alias("internalDate"), F.struct(headers.alias("headers")).alias("payload"))
    return pages, metadata


@register("landed_message_content", """SELECT 'm-' || conv_id || '-' || turn AS external_id,
      sha256(text) AS digest FROM conversations""")
def landed_message_content(spark, sf_dir):
    return mail.message_content(raw_messages(spark, sf_dir)).select(
        "external_id", F.sha2("content", 256).alias("digest"))


def raw_messages(spark, sf_dir):
    return bind.table(spark, sf_dir, "conversations").select(
        _message_id().alias("id"), F.rtrim(F.translate(F.base64(F.encode("text", "UTF-8")),
                                                       "+/=\r\n", "-_")).alias("raw"))


# --- stored versions and streams --------------------------------------------------------------

@register("stored_versions", f"""WITH {o.CATALOG}
    SELECT 1 AS version, provider, count(*) AS sources, count(*) AS active FROM sources GROUP BY provider
    UNION ALL SELECT 2, provider, count(*), count(*) FILTER (WHERE provider <> 'immich')
    FROM sources GROUP BY provider""")
def stored_versions(spark, sf_dir):
    """Two committed versions of the catalog, the second without active photos; both readable."""
    root = run_folder(spark, "versions")
    catalog = bind.catalog(spark, sf_dir)
    tables.write_tables(spark, root, catalog._asdict())
    first = tables.read_catalog(spark, root)
    left = first.sources.withColumn("is_active", F.col("provider") != "immich")
    tables.write_tables(spark, root, first._replace(sources=left)._asdict())
    second = tables.read_catalog(spark, root)

    def count(version, sources):
        return sources.groupBy("provider").agg(
            F.count(F.lit(1)).alias("sources"), F.count_if("is_active").alias("active")).select(
            F.lit(version).alias("version"), "provider", "sources", "active")

    return count(1, first.sources).unionByName(count(2, second.sources))


@register("stream_ingest", f"""SELECT {o.uid("'source|immich|img-' || vec_id")} AS id,
      'img-' || vec_id AS external_id, 'IMG_' || vec_id || '.jpg' AS name, TRUE AS is_active,
      sha256('photo-' || vec_id) AS hash FROM embeddings""")
def stream_ingest(spark, sf_dir):
    """Landed pages streamed into a new catalog root."""
    landing, root = run_folder(spark, "landing"), run_folder(spark, "catalog-root")
    photo_pages(spark, sf_dir).select(F.col("body").alias("value")).write.text(landing)
    bodies = bind.table(spark, sf_dir, "embeddings").select(
        F.lit("immich").alias("provider"),
        F.concat(F.lit("img-"), F.col("vec_id").cast("string")).alias("external_id"),
        F.encode(F.concat(F.lit("photo-"), F.col("vec_id").cast("string")), "UTF-8")
        .alias("content"))
    query = ingest.ingest_stream(
        spark, landing, root, run_folder(spark, "ingest-checkpoint"),
        content=lambda session: bodies, now=bind.FIRST_RUN, multi_line=False)
    query.awaitTermination()
    after = tables.read_catalog(spark, root)
    return after.sources.join(
        after.blobs.select(F.col("id").alias("blob_id"), "hash"), "blob_id").select(
        "id", "external_id", "name", "is_active", "hash")


@register("stream_two_roots", """SELECT 'img-' || vec_id AS external_id, TRUE AS is_active
    FROM embeddings""")
def stream_two_roots(spark, sf_dir):
    """Two streams with checkpoints of their own into one catalog: each lands half of the photos
    as part of an inventory, and neither loses the other's."""
    root = run_folder(spark, "two-streams-root")
    photos_ = photo_pages(spark, sf_dir)
    for half in (0, 1):
        landing = run_folder(spark, f"landing-{half}")
        photos_.filter(F.pmod(F.xxhash64("body"), F.lit(2)) == half).select(
            F.col("body").alias("value")).write.text(landing)
        bodies = bind.table(spark, sf_dir, "embeddings").select(
            F.lit("immich").alias("provider"),
            F.concat(F.lit("img-"), F.col("vec_id").cast("string")).alias("external_id"),
            F.encode(F.concat(F.lit("photo-"), F.col("vec_id").cast("string")), "UTF-8")
            .alias("content"))
        ingest.ingest_stream(
            spark, landing, root, run_folder(spark, f"two-streams-{half}"),
            content=lambda session, rows=bodies: rows, now=bind.FIRST_RUN,
            multi_line=False).awaitTermination()
    return tables.read_catalog(spark, root).sources.select("external_id", "is_active")


@register("stream_turn_fold", f"""WITH {FOLD}
    SELECT t.turn_id, t.arrival, a.arrival IS NOT NULL AS accepted, CASE
      WHEN a.arrival IS NULL THEN CASE WHEN coalesce(t.arrival > e.ended, FALSE)
        THEN 'turn_has_ended' ELSE 'out_of_sequence' END END AS reason
    FROM te t LEFT JOIN ends e USING (turn_id)
      LEFT JOIN accepted a ON a.turn_id = t.turn_id AND a.arrival = t.arrival""")
def stream_turn_fold(spark, sf_dir):
    """The streaming fold over the stored event table; equals its batch twin."""
    stored = bind.turn_events(spark, sf_dir)
    events = spark.readStream.schema(stored.schema).parquet(bind.stored_path(
        spark, "turns", sf_dir, "turn_events"))
    out = run_folder(spark, "folded")
    query = (
        stream_turns.fold_stream(events).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", run_folder(spark, "fold-checkpoint"))
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream_turns.OUTPUT).parquet(out).select(
        "turn_id", "arrival", "accepted", "reason")


@register("turn_assistant_messages", f"""WITH {FOLD}
    SELECT {o.uid("'assistant|' || turn_id")} AS id, CAST(coalesce(sum(length(delta)), 0) AS BIGINT)
      AS characters FROM accepted a WHERE EXISTS (SELECT 1 FROM accepted e
      WHERE e.turn_id = a.turn_id AND e.type = 'turn.completed') GROUP BY turn_id""")
def turn_assistant_messages(spark, sf_dir):
    from shelfmark.plans.workload_turns import _accepted, _turn_rows
    done = tn.complete_turns(_turn_rows(spark, sf_dir), _accepted(spark, sf_dir), bind.SECOND_RUN)
    return done.messages.groupBy("id").agg(
        F.sum(F.char_length("body")).cast("bigint").alias("characters"))
