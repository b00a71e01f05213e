from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import extract as ex
from shelfmark.operators import integrity as integ
from shelfmark.operators import publish as pub
from shelfmark.operators import retrieval as ret
from shelfmark.operators.query import InvalidQuery
from shelfmark.schemas import (
    BLOBS, ENRICHMENT_STATES, RESOURCES, SOURCES, STATEMENTS, Catalog, Generator, predicate_table,
)

T0 = datetime(2026, 8, 1, tzinfo=timezone.utc)


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def photo_catalog(spark, metadata, provider="immich", kind="file", digest=None, mime="image/jpeg",
                  copies=None):
    """One resource per metadata text; `copies` lists resources that get a second source."""
    resources, blobs, sources = [], [], []
    for n, text in enumerate(metadata, 1):
        h = (digest or {}).get(n, f"{n:064x}")
        resources.append((uid(n), kind, f"r{n}", "{}", T0, T0))
        blobs.append((uid(100 + n), uid(n), h, 5, mime))
        for c in range(2 if n in (copies or ()) else 1):
            sources.append((uid(200 + 10 * n + c), uid(100 + n), provider, f"loc{n}-{c}", f"/p{n}",
                            f"n{n}.jpg", "1", text, True, None))
    return Catalog(spark.createDataFrame(resources, RESOURCES),
                   spark.createDataFrame(blobs, BLOBS), spark.createDataFrame(sources, SOURCES))


def values(drafts):
    rows = drafts.withColumn("v", pub.value_text()).collect()
    return {(r["resource_id"][-2:], r["predicate"]): r["v"] for r in rows}


def test_photo_metadata_and_geo(spark):
    catalog = photo_catalog(spark, [
        '{"exif":{"dateTimeOriginal":"2026-08-10T00:00:00+08:00","latitude":90,"longitude":-180.0,'
        '"make":"M","model":" ","country":"C","state":" ","city":null}}',
        '{"exif":{"dateTimeOriginal":"2026-08-10T00:00:00","latitude":true,"longitude":1}}',
        '{"exif":{"latitude":91,"longitude":1,"country":"C"}}', "{}",
        '{"exif":{"latitude":1,"longitude":1,"country":5}}',
        '{"exif":{"make":"two"}}'], copies=[6])
    photo = ex.PhotoMetadata()
    inputs = photo.inputs(catalog)
    errors = {r["resource_id"][-2:]: r["error_code"] for r in inputs.collect()}
    assert errors["06"] == "ambiguous_active_immich_sources" and errors["01"] is None
    got = values(photo.drafts(inputs.filter("error_code is null")))
    assert got == {
        ("01", "media.captured_at"): str(int(datetime(2026, 8, 9, 16, tzinfo=timezone.utc)
                                             .timestamp()) * 1_000_000),
        ("01", "media.latitude"): "90.0", ("01", "media.longitude"): "-180.0",
        ("01", "media.camera_make"): "M", ("05", "media.latitude"): "1.0",
        ("05", "media.longitude"): "1.0"}
    geo = ex.PhotoGeo().inputs(catalog)
    codes = {r["resource_id"][-2:]: r["error_code"] for r in geo.collect()}
    assert codes["05"] == "invalid_immich_geo_metadata"
    assert values(ex.PhotoGeo().drafts(geo.filter("error_code is null"))) == {
        ("01", "geo.country"): "C"}


def test_fingerprints_see_only_relevant_input(spark):
    a, b, c = (photo_catalog(spark, [m]) for m in (
        '{"exif":{"make":"M"},"other":1}', '{"other":2,"exif":{"make":"M"}}',
        '{"exif":{"make":"N"}}'))
    prints = [ex.PhotoMetadata().inputs(x).first()["fingerprint"] for x in (a, b, c)]
    assert prints[0] == prints[1] != prints[2]


def test_file_modified_consensus(spark):
    http = '{"getlastmodified":"Sun, 10 Aug 2026 00:00:00 GMT"}'
    catalog = photo_catalog(spark, [http, '{"getlastmodified":"soon"}', "{}", http],
                            provider="nextcloud", copies=[4])
    other = catalog.sources.filter(F.col("external_id") == "loc4-1").select("id")
    catalog = catalog._replace(sources=catalog.sources.withColumn(
        "metadata", F.when(F.col("id") == other.first()[0], F.lit(
            '{"fileModifiedAt":"2026-08-10T00:00:01Z"}')).otherwise(F.col("metadata"))).withColumn(
        "provider", F.when(F.col("id") == other.first()[0], "immich").otherwise("nextcloud")))
    got = ex.FileModified().drafts(ex.FileModified().inputs(catalog)).collect()
    assert [(r["resource_id"][-2:], r["source_locator"]) for r in got] == [
        ("01", "nextcloud.webdav.getlastmodified")]


@pytest.mark.parametrize("status, body, code", [
    (200, '[{"text":"a  b"},{"text":"\\r\\n c "}]', None), (404, "", "provider_not_found"),
    (429, "", "provider_unavailable"), (500, "", "provider_unavailable"),
    (302, "", "provider_invalid_response"), (200, "{}", "provider_invalid_response"),
    (200, '[{"text":1}]', "provider_invalid_response"), (200, "[5]", "provider_invalid_response"),
    (200, "[]", None)])
def test_ocr(spark, status, body, code):
    catalog = photo_catalog(spark, ["{}"])
    payloads = spark.createDataFrame([("loc1-0", status, body)],
                                     "locator STRING, status INT, body STRING")
    extractor = ex.PhotoOcr(payloads)
    inputs = extractor.inputs(catalog)
    assert inputs.first()["error_code"] == code
    drafts = extractor.drafts(inputs.filter("error_code is null")).collect()
    assert [d["string_value"] for d in drafts] == (["a b\nc"] if "a  b" in body else [])


def test_text_excerpt_edges(spark):
    import hashlib
    bodies = [b"\xef\xbb\xbfhi\r\nthere\rx", b"bad \xff", b"nul \x00", b"bell \x07", b"", b"same",
              b"x" * 1_048_577, "é".encode() * 9000, b"tampered"]
    digests = {i: hashlib.sha256(b).hexdigest() for i, b in enumerate(bodies, 1)}
    digests[9] = "0" * 64
    catalog = photo_catalog(spark, ["{}"] * 9, "nextcloud", digest=digests, mime="Text/Plain; x=y",
                            copies=[6])
    content = spark.createDataFrame(
        [("nextcloud", f"loc{i}-0", bytearray(b)) for i, b in enumerate(bodies, 1)],
        "provider STRING, external_id STRING, content BINARY")
    extractor = ex.TextExcerpt(content)
    inputs = ex.load(extractor, extractor.inputs(catalog))
    codes = {int(r["resource_id"][-2:]): r["error_code"] for r in inputs.collect()}
    assert codes == {1: None, 2: "invalid_text_encoding", 3: "binary_content", 4: "binary_content",
                     5: None, 6: None, 7: "source_too_large", 8: None,
                     9: "content_changed_since_sync"}
    got = values(extractor.drafts(inputs.filter("error_code is null")))
    assert got["01", "document.text_excerpt"] == "hi\nthere\nx"
    assert got["06", "document.text_excerpt"] == "same"
    assert ("05", "document.text_excerpt") not in got
    long = got["08", "document.text_excerpt"]
    assert len(long.encode()) <= 16_384 and long.endswith(ex.TRUNCATION_MARKER)


def test_units_and_headers(spark):
    units = spark.createDataFrame([("d", 2, "b\r\nc"), ("d", 1, "a"), ("d", 3, ""), ("d", 4, "z"),
                                   ("e", 1, None)], "k STRING, unit_no INT, text STRING")
    got = {r["k"]: r["text"] for r in ex.join_units(units, ["k"], "\n\n").collect()}
    assert got == {"d": "a\n\nb\nc\n\n\n\nz", "e": ""}
    cut = {r["k"]: r["text"] for r in ex.join_units(units, ["k"], "\n\n", ceiling=4).collect()}
    assert cut["d"] == "a\n\nb"
    raw = b"Subject: one\r\n two\r\nTO: a@x\r\nto: b@x\r\nX-From: no\r\n\r\nSubject: body"
    content = spark.createDataFrame([("gmail", "m", bytearray(raw))],
                                    "provider STRING, external_id STRING, content BINARY")
    row = ex.read_headers(content).first()
    assert (row["subject"], row["to"], row["from"]) == ("one two", "a@x, b@x", None)


class Fixed:
    """An extractor whose drafts are given."""

    generator = Generator("custom", "fixed", "1")
    covered = ("media.ocr_text",)
    family = ()

    def __init__(self, text, mark):
        self.text, self.mark = text, mark

    def inputs(self, catalog):
        return catalog.resources.select(
            F.col("id").alias("resource_id"), F.lit(self.mark).alias("fingerprint"),
            F.when(F.col("title") == "r2", "boom").alias("error_code"),
            F.when(F.col("title") == "r2", F.repeat(F.lit("m"), 600)).alias("error_message"))

    def drafts(self, inputs):
        return ex.unpivot(inputs, ex.draft("media.ocr_text", "string",
                                           F.lit(self.text).cast("string"), "provider_metadata",
                                           "here"))


def test_publish_history(spark):
    """A, A, B, A, nothing: writes 1, 0, 1, 1, 0 and each change retires what was current."""
    catalog = photo_catalog(spark, ["{}", "{}"])
    statements = spark.createDataFrame([], STATEMENTS)
    states = spark.createDataFrame([], ENRICHMENT_STATES)
    foreign = pub.new_statements(Fixed("A", "x").drafts(
        catalog.resources.select(F.col("id").alias("resource_id"))),
        Generator("custom", "fixed", "2"), T0)
    statements = statements.unionByName(foreign)
    log = []
    for step, text in enumerate(["A", "A", "B", "A", None]):
        run = pub.run_enrichment(Fixed(text, f"f{step}"), catalog, statements, states,
                                 T0 + timedelta(hours=step))
        log.append(tuple(run.totals.first()))
        statements, states = run.statements.cache(), run.states.cache()
    assert [t[4:] for t in log] == [(1, 0), (0, 0), (1, 1), (1, 1), (0, 1)]
    assert all(t[:4] == (2, 1, 0, 1) for t in log)
    mine = statements.filter(pub.of_generator(Fixed.generator)).orderBy("created_at").collect()
    assert [(r["string_value"], r["is_current"]) for r in mine] == [
        ("A", False), ("B", False), ("A", False)]
    assert statements.filter("generator_version = '2' and is_current").count() == 2
    failed = states.filter("status = 'failed'").first()
    assert (failed["error_code"], len(failed["error_message"])) == ("boom", 512)
    again = pub.run_enrichment(Fixed(None, "f4"), catalog, statements, states,
                               T0 + timedelta(hours=9)).totals.first()
    assert (again["skipped"], again["failed"], again["writes"]) == (1, 1, 0)
    ref = "catalog:resource:" + uid(1)
    assert pub.get_statements(statements, ref).count() == 1
    assert pub.get_statements(statements, ref, "media.ocr_text", True).count() == 4
    for bad in (dict(predicate="no.such"), dict(limit=0)):
        with pytest.raises(InvalidQuery):
            pub.get_statements(statements, ref, **bad)


def text_world(spark):
    """Three text files and their content; the second is too large by its listed size."""
    import hashlib
    bodies = [b"one", b"two", b"three"]
    catalog = photo_catalog(spark, ["{}"] * 3, "nextcloud", mime="text/plain", digest={
        i: hashlib.sha256(b).hexdigest() for i, b in enumerate(bodies, 1)})
    catalog = catalog._replace(blobs=catalog.blobs.withColumn("size", F.when(
        F.col("asset_id") == uid(2), ex.MAX_TEXT_SOURCE_BYTES + 1).otherwise(F.col("size"))
        .cast("bigint")))
    content = spark.createDataFrame(
        [("nextcloud", f"loc{i}-0", bytearray(b)) for i, b in enumerate(bodies, 1)],
        "provider STRING, external_id STRING, content BINARY")
    return catalog, content


def unreadable(content, *keys):
    return content.withColumn("content", F.when(
        F.col("external_id").isin(*keys), F.raise_error(F.lit("read")).cast("binary"))
        .otherwise(F.col("content")))


def test_stored_run_claims_before_it_reads(spark):
    import tempfile

    from shelfmark.sources import enrichment, tables
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    catalog, content = text_world(spark)

    class Watched(ex.TextExcerpt):
        """While the first worker reads, a second one comes by."""

        def load(self, work):
            other = enrichment.run_stored(
                spark, root, ex.TextExcerpt(unreadable(content, "loc1-0", "loc2-0", "loc3-0")),
                T0 + timedelta(minutes=29), catalog=catalog)
            seen.append((tuple(other.totals.first()), {
                r["status"] for r in tables.read_states(spark, root).collect()}))
            return super().load(work)

    seen = []
    first = enrichment.run_stored(spark, root, Watched(unreadable(content, "loc2-0")), T0,
                                  catalog=catalog)
    assert seen == [((3, 0, 3, 0, 0, 0), {"running"})]
    assert tuple(first.totals.first()) == (3, 2, 0, 1, 2, 0)
    states = {r["subject_asset_id"][-1]: (r["status"], r["error_code"])
              for r in tables.read_states(spark, root).collect()}
    assert states == {"1": ("completed", None), "2": ("failed", "source_too_large"),
                      "3": ("completed", None)}
    # What is done is not read again; what failed for its size is judged without being read.
    again = enrichment.run_stored(spark, root, ex.TextExcerpt(unreadable(
        content, "loc1-0", "loc2-0", "loc3-0")), T0 + timedelta(hours=1), catalog=catalog)
    assert tuple(again.totals.first()) == (3, 0, 2, 1, 0, 0)
    assert tables.read_statements(spark, root).count() == 2
    # A new content of one: only that is read, its old statement goes to the history.
    import hashlib
    blobs = catalog.blobs.withColumn("hash", F.when(
        F.col("asset_id") == uid(3), hashlib.sha256(b"new").hexdigest()).otherwise(F.col("hash")))
    newer = content.filter("external_id <> 'loc3-0'").unionByName(spark.createDataFrame(
        [("nextcloud", "loc3-0", bytearray(b"new"))], content.schema))
    third = enrichment.run_stored(
        spark, root, ex.TextExcerpt(unreadable(newer, "loc1-0", "loc2-0")),
        T0 + timedelta(hours=2), catalog=catalog._replace(blobs=blobs))
    assert tuple(third.totals.first()) == (3, 1, 1, 1, 1, 1)
    rows = tables.read_statements(spark, root, history=True).collect()
    assert sorted((r["string_value"], r["is_current"]) for r in rows) == [
        ("new", True), ("one", True), ("three", False)]


def test_stale_claims_are_taken_again(spark):
    import tempfile

    from shelfmark.sources import enrichment, tables
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    catalog, content = text_world(spark)
    extractor = ex.TextExcerpt(content)
    inputs = extractor.inputs(catalog).filter(F.col("resource_id") == uid(1))
    tables.merge(spark, root, "enrichment_states", pub.claims(inputs, extractor.generator, T0))
    soon = enrichment.run_stored(spark, root, extractor, T0 + timedelta(minutes=29),
                                 catalog=catalog)
    assert tuple(soon.totals.first())[:4] == (3, 1, 1, 1)
    late = enrichment.run_stored(spark, root, extractor, T0 + timedelta(minutes=30),
                                 catalog=catalog)
    assert tuple(late.totals.first())[:4] == (3, 1, 1, 1)


def test_documents_and_headers_read_what_is_worked_on(spark):
    catalog, content = text_world(spark)
    units = spark.createDataFrame([("nextcloud", f"loc{i}-0", 1, f"t{i}") for i in (1, 3)],
                                  "provider STRING, external_id STRING, unit_no INT, text STRING")
    pdf = ex.DocumentExcerpt(units, mime_types=("text/plain",))
    work = pdf.inputs(catalog).filter(F.col("resource_id") == uid(3))
    assert values(pdf.drafts(ex.load(pdf, work))) == {("03", "document.text_excerpt"): "t3"}
    assert len(values(pdf.drafts(ex.usable(pdf, catalog)))) == 2


def test_table_function_extractor(spark):
    import tempfile

    from shelfmark.sources import enrichment, tables

    class Shout:
        """A table function that yields two drafts a text, one of them unusable for short ones."""

        def eval(self, text):
            yield ("text.loud", "string", text.upper(), None, None, None, "text", 0.5)
            yield ("text.size", "integer", None, len(text) if len(text) > 3 else None, None, None,
                   "text", None)

    catalog, content = text_world(spark)
    kinds = {"text.loud": ("string", "single"), "text.size": ("integer", "single")}
    function = F.udtf(Shout, returnType=ex.UDTF_DRAFT, useArrow=True)
    extractor = ex.TableFunctionExtractor(function, ex.TextExcerpt(content), Generator(
        "custom", "shout", "1"), tuple(kinds))
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    registry = predicate_table(spark, kinds)
    run = enrichment.run_stored(spark, root, extractor, T0, catalog=catalog, registry=registry)
    assert tuple(run.totals.first()) == (3, 2, 0, 1, 3, 0)
    rows = tables.read_statements(spark, root).withColumn("v", pub.value_text()).collect()
    assert {(r["subject_asset_id"][-1], r["predicate"], r["v"]) for r in rows} == {
        ("1", "text.loud", "ONE"), ("3", "text.loud", "THREE"), ("3", "text.size", "5")}
    again = enrichment.run_stored(spark, root, extractor, T0 + timedelta(hours=1),
                                  catalog=catalog, registry=registry)
    assert tuple(again.totals.first()) == (3, 0, 2, 1, 0, 0)
    # Another version of the function has another fingerprint and works anew.
    newer = ex.TableFunctionExtractor(function, ex.TextExcerpt(content), Generator(
        "custom", "shout", "2"), tuple(kinds))
    prints = [e.inputs(catalog).filter(F.col("resource_id") == uid(1)).first()["fingerprint"]
              for e in (extractor, newer)]
    assert prints[0] != prints[1]


def test_gate_and_families(spark):
    g = Fixed.generator
    inputs = spark.createDataFrame([(uid(i), "f" if i < 6 else None) for i in range(1, 7)],
                                   "resource_id STRING, fingerprint STRING")
    now = T0 + timedelta(hours=1)
    rows = [(1, "f", "completed", T0), (2, "old", "completed", T0),
            (3, "old", "running", now - timedelta(minutes=29)),
            (4, "f", "running", now - timedelta(minutes=30)), (5, "f", "failed", now)]
    states = spark.createDataFrame(
        [(uid(i), g.type, g.name, g.version, f, s, at, None, at, None, None)
         for i, f, s, at in rows], ENRICHMENT_STATES)
    got = {r["resource_id"][-1]: r["gate"] for r in pub.gate(inputs, states, g, now).collect()}
    assert got == {"1": "skip", "2": "run", "3": "skip", "4": "run", "5": "run", "6": "unreadable"}
    text = ex.unpivot(inputs.filter(F.col("resource_id") == uid(1)), ex.draft(
        "document.text_excerpt", "string", F.lit("t"), "resource_content", "x"))
    pdf = ex.DocumentExcerpt(units=None)
    held = pub.new_statements(text, ex.TextExcerpt(content=None).generator, T0)
    assert pub.family_conflicts(held, inputs, pdf.generator, pdf.covered, pdf.family).count() == 1
    own = pub.new_statements(text, pdf.generator, T0)
    assert pub.family_conflicts(own, inputs, pdf.generator, pdf.covered, pdf.family).count() == 0


def test_draft_rules_and_integrity(spark):
    ids = spark.createDataFrame([(uid(i),) for i in range(1, 6)], "resource_id STRING")

    def of(i, *drafts):
        return ex.unpivot(ids.filter(F.col("resource_id") == uid(i)), *drafts)

    def text(value, trust=None):
        return ex.draft("media.ocr_text", "string", F.lit(value), "provider_metadata", "x",
                        F.lit(trust))

    drafts = of(1, text("a")).unionByName(of(2, text("a"), text("b"))).unionByName(
        of(3, text("a", 1.5))).unionByName(of(4, ex.draft(
            "media.ocr_text", "integer", F.lit(1), "provider_metadata", "x"))).unionByName(
        of(5, ex.draft("geo.country", "string", F.lit("c"), "provider_metadata", "x")))
    found = {(r["resource_id"][-1], r["violation"]) for r in pub.draft_violations(
        drafts, ("media.ocr_text",), predicate_table(spark)).collect()}
    assert found == {("2", "several_values"), ("3", "bad_confidence"), ("4", "wrong_value_type"),
                     ("5", "not_covered")}
    rows = pub.new_statements(drafts, Fixed.generator, T0)
    broken = rows.withColumn("source_locator", F.lit(" ")).withColumn(
        "source_kind", F.lit("rumour")).withColumn("confidence", F.lit(float("nan")))
    report = {(r["rule"]): r["violations"] for r in integ.check_integrity(
        {"statements": broken, "resources": photo_catalog(spark, ["{}"]).resources}).collect()}
    assert report["check:not_blank"] == report["check:source_kind"] == 6
    assert report["check:confidence"] == 6 and report["reference:subject_asset_id"] == 5
    text_time = rows.withColumn("created_at", F.lit("yesterday"))
    report = {r["rule"]: r["violations"] for r in integ.conformance(text_time, "statements").collect()}
    assert report["type:created_at"] == 6 and report["required:id"] == 0


def test_funnel(spark):
    catalog = photo_catalog(spark, ["{}"] * 5, "nextcloud", mime="text/plain")
    ids = catalog.resources.select(F.col("id").alias("resource_id"))
    texts = ids.withColumn("t", F.when(F.col("resource_id") == uid(5), "other").otherwise("50%_\\ é"))
    drafts = ex.unpivot(texts, ex.draft("document.text_excerpt", "string", F.col("t"),
                                        "resource_content", "x"))
    when = ids.filter(F.col("resource_id").isin(uid(1), uid(2)))
    moved = ex.unpivot(when, ex.draft("file.modified_at", "datetime", F.lit(T0),
                                      "provider_metadata", "x"))
    rows = pub.new_statements(drafts.unionByName(moved), Fixed.generator, T0)
    gone = rows.withColumn("is_current", F.col("subject_asset_id") != uid(4))
    filters = ret.RichFilters(file_modified_from=T0, provider="nextcloud",
                              required_predicates=("file.modified_at", "file.modified_at"))
    got = ret.retrieve_filtered(catalog, gone, "document.text_excerpt", "0%_\\ É", filters, limit=1)
    assert [(r["stage"], r["input_count"], r["output_count"])
            for r in got.stages.orderBy("position").collect()] == [
        ("observation_text_primary", 0, 3), ("source_metadata_filter", 3, 3),
        ("file_modified_at_filter", 3, 2), ("required_predicates_filter", 2, 2),
        ("final_limit", 2, 1)]
    hit = got.hits.collect()
    assert [(h["title"], h["source_rank"], h["matched_predicates"]) for h in hit] == [
        ("r1", 1, ["document.text_excerpt", "file.modified_at"])]
    twice = gone.unionByName(gone.filter("predicate = 'file.modified_at'"))
    with pytest.raises(Exception, match="several current"):
        ret.retrieve_filtered(catalog, twice, "document.text_excerpt", "50", filters).hits.collect()
    for bad in (dict(resource_type="message"), dict(required_predicates=("x",)),
                dict(captured_from=T0, captured_to=T0)):
        with pytest.raises(InvalidQuery):
            ret.RichFilters(**bad)


def test_semantic_mapping(spark):
    catalog = photo_catalog(spark, ["{}"] * 3)
    vectors = spark.createDataFrame(
        [(f"loc{i}-0", [float(i), 1.0]) for i in range(1, 7)], "locator STRING, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(300)],
                                    "query_id BIGINT, embedding ARRAY<FLOAT>")
    got = ret.retrieve_semantic(catalog, vectors, queries, "immich", 5)
    rows = got.hits.filter("query_id = 299").orderBy("rank").collect()
    assert [(r["rank"], r["title"]) for r in rows] == [(4, "r3"), (5, "r2")]
    assert got.unmapped.filter("unmapped_hit_count = 3").count() == 300
    lost = catalog._replace(blobs=catalog.blobs.filter(F.col("asset_id") != uid(3)))
    with pytest.raises(Exception, match="broken mapping"):
        ret.retrieve_semantic(lost, vectors, queries.limit(1), "immich", 5).hits.collect()
    assert fn.REF_PREFIX.endswith(":")


def test_modified_consensus_of_any_source(spark, tmp_path):
    """Documents of a source that the test tables do not name are read like all others."""
    import os

    from shelfmark.plans import workload_state as ws

    sf = "/root/testdata/sf0.001"
    for name in os.listdir(sf):
        if name != "documents.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = F.when(F.col("source") == "src0", "odd").otherwise(F.col("source"))
    docs.withColumn("source", odd).write.parquet(str(tmp_path / "documents.parquet"))
    want, got = ({r.resource_id for r in ws.modified_consensus(spark, d).collect()}
                 for d in (sf, str(tmp_path)))
    assert got == want
