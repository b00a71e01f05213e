"""People, relations, the run ledger, landed sources, stored versions and ingest."""

import json
import os
import tempfile
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import integrity as integ
from shelfmark.operators import ledger as led
from shelfmark.operators import people as ppl
from shelfmark.schemas import (
    PERSON_SOURCES, PERSONS, RESOURCE_PERSON, RESOURCES, RUNS, Catalog, job_table,
)
from shelfmark.sources import drive, gate, mail, photos, tables
from shelfmark.streaming import ingest, stale

T0 = datetime(2026, 8, 1, tzinfo=timezone.utc)


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def outcomes(run):
    return {r["external_id"]: r["outcome"] for r in run.outcomes.collect()}


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "external_id STRING")


def test_people_lifecycle(spark):
    persons, sources = spark.createDataFrame([], PERSONS), spark.createDataFrame([], PERSON_SOURCES)
    run = ppl.reconcile_people("p", ids(spark, "a", "b"), persons, sources, T0)
    assert outcomes(run) == {"a": "created", "b": "created"}
    run = ppl.reconcile_people("p", ids(spark, "a"), run.persons, run.person_sources, T0)
    assert outcomes(run) == {"a": "existing", "b": "inactivated"}
    other = ppl.reconcile_people("q", ids(spark, "b"), run.persons, run.person_sources, T0)
    run = ppl.reconcile_people("p", ids(spark, "b"), other.persons, other.person_sources, T0)
    assert outcomes(run) == {"a": "inactivated", "b": "reactivated"}
    empty = ppl.reconcile_people("p", ids(spark, "x").limit(0), run.persons, run.person_sources, T0)
    assert outcomes(empty) == {"b": "inactivated"}
    one = ppl.get_or_create("p", ids(spark, "c"), run.persons, run.person_sources, T0)
    assert [r["external_id"] for r in ppl.active_person_ids(one.person_sources, "p").collect()] == [
        "b", "c"]
    assert one.person_sources.filter("provider = 'q' and inactive_at is null").count() == 1
    bad = ppl.inventory_violations(ids(spark, "a", "a", " "))
    assert {r["violation"] for r in bad.collect()} == {"blank_id", "duplicate_id"}


def asset_catalog(spark, n, provider="p"):
    return Catalog(
        spark.range(n).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("file").alias("resource_type"),
                              F.lit("t").alias("title"), F.lit("{}").alias("metadata"),
                              F.lit(T0).alias("created_at"), F.lit(T0).alias("updated_at")),
        spark.range(n).select(F.concat(F.lit("b"), "id").alias("id"),
                              F.concat(F.lit("r"), "id").alias("asset_id"),
                              F.concat(F.lit("h"), "id").alias("hash"),
                              F.lit(None).cast("bigint").alias("size"),
                              F.lit(None).cast("string").alias("mime_type")),
        spark.range(n).select(F.concat(F.lit("s"), "id").alias("id"),
                              F.concat(F.lit("b"), "id").alias("blob_id"),
                              F.lit(provider).alias("provider"),
                              F.concat(F.lit("a"), "id").alias("external_id"),
                              *[F.lit(None).cast("string").alias(c)
                                for c in ("path", "name", "version_tag", "metadata")],
                              (F.col("id") >= 114).alias("is_active"),
                              F.lit(None).cast("timestamp").alias("deleted_at")))


def test_relations_at_published_scale(spark):
    """10,574 pairs of which 114 show an inactive asset; a rerun changes nothing."""
    catalog = asset_catalog(spark, 10_574)
    persons = spark.createDataFrame([("p", "x", "px", None)], PERSON_SOURCES)
    pairs = spark.range(10_574).select(F.concat(F.lit("a"), "id").alias("asset_external_id"),
                                       F.lit("x").alias("person_external_id"))
    foreign = spark.createDataFrame([("r1", "py", "q", None)], RESOURCE_PERSON)
    first = ppl.reconcile_relations("p", pairs, catalog, persons, foreign, T0)
    assert tuple(first.totals.first()) == (10_460, 0, 0, 0, 114)
    kept = first.relations
    again = ppl.reconcile_relations("p", pairs, catalog, persons, kept, T0)
    assert tuple(again.totals.first()) == (0, 10_460, 0, 0, 114)
    part = ppl.reconcile_relations("p", pairs.filter("asset_external_id <> 'a200'"), catalog,
                                   persons, kept, T0)
    assert tuple(part.totals.first()) == (0, 10_459, 0, 1, 114)
    back = ppl.reconcile_relations("p", pairs, catalog, persons, part.relations, T0)
    assert tuple(back.totals.first()) == (0, 10_459, 1, 0, 114)
    assert back.relations.filter("provider = 'q' and inactive_at is null").count() == 1
    with pytest.raises(ValueError):
        ppl.reconcile_relations("p", pairs.withColumn("person_external_id", F.lit(" ")), catalog,
                                persons, foreign, T0)


def run(n, key, status, start, end=None, code=None):
    return (f"run{n}", key, "provider_sync", status, T0 + timedelta(hours=start),
            None if end is None else T0 + timedelta(hours=end), code)


def test_freshness(spark):
    a, b, c = "provider.immich.sync", "enrichment.immich_geo", "provider.gmail.sync"
    runs = spark.createDataFrame([
        run(1, a, "completed", 0, 1), run(2, a, "failed", 2, 3, "execution_failed"),
        run(3, b, "completed", 0, 0.5), run(4, c, "completed", 40, 41),
        run(5, c, "running", 40)], RUNS)
    status = {r["pipeline_key"]: r for r in led.job_status(
        runs, job_table(spark), T0 + timedelta(hours=2)).collect()}
    assert len(status) == 10
    assert (status[a]["latest_status"], status[a]["success_age_seconds"]) == ("failed", 3600.0)
    assert status[a]["validated_after_dependencies"] is None
    assert status[b]["validated_after_dependencies"] is False
    assert status[c]["success_age_seconds"] is None and status[c]["latest_status"] == "completed"
    assert status["enrichment.gmail_metadata"]["validated_after_dependencies"] is False
    ended = led.fail_interrupted(runs, job_table(spark), T0)
    assert ended.filter("status = 'running'").count() == 0
    assert integ.check_table(ended, "runs").filter("violations > 0").count() == 0
    assert integ.running_twice(runs.unionByName(runs), "pipeline_key").count() == 1
    counts = spark.createDataFrame([("Immich", 7)], "bucket STRING, bucket_count BIGINT")
    states = {r["provider"]: (r["operational_state"], r["resource_count"]) for r in
              led.provider_state(led.job_status(runs, job_table(spark), T0), counts,
                                 led.provider_table(spark)).collect()}
    assert states == {"immich": ("attention", 7), "gmail": ("attention", 0),
                      "nextcloud": ("not_synced", 0)}


@pytest.mark.parametrize("links, want", [
    ([("1", "2", 9), ("2", None, 9)], set()),
    ([("1", "2", 9), ("2", None, 8)], {"total changed"}),
    ([("1", "2", 9)], {"missing page", "not one terminal page"}),
    ([("1", "2", 9), ("2", "1", 9)], {"repeated next page", "not one terminal page"}),
    ([("1", None, 9), ("1", None, 9)], {"repeated page", "not one terminal page"}),
    ([("2", None, 9)], {"first page missing", "unreachable page"})])
def test_inventory_gate(spark, links, want):
    rows = spark.createDataFrame([("", *link) for link in links],
                                 "listing STRING, page STRING, next STRING, total BIGINT")
    got = {r["problem"] for r in gate.inventory_problems(rows, constant_total=True).collect()}
    assert got == want
    assert gate.is_complete(rows, constant_total=True) is (not want)


def photo(n, **more):
    return {"id": f"img{n}", "originalFileName": f"{n}.jpg", "originalPath": f"/{n}.jpg",
            "originalMimeType": "image/jpeg", "updatedAt": "v1",
            "exifInfo": {"fileSizeInByte": n}, **more}


def land(path, page, items, following=None):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/page-{page}-{time.time_ns()}.json", "w") as out:
        json.dump({"page": page, "assets": {"items": items, "nextPage": following}}, out, indent=1)


def test_stream_ingest_versions(spark):
    home = folder()
    landing, root, check = f"{home}/in", f"{home}/root", f"{home}/check"
    content = spark.createDataFrame([("immich", f"img{n}", f"bytes{min(n, 2)}".encode())
                                     for n in range(1, 5)],
                                    "provider STRING, external_id STRING, content BINARY")

    def drain():
        ingest.ingest_stream(spark, landing, root, check, content=lambda s: content,
                             now=T0).awaitTermination(200)

    land(landing, 1, [photo(1), photo(2)], "2")
    land(landing, 2, [photo(3)])
    drain()
    catalog = tables.read_catalog(spark, root)
    assert (catalog.resources.count(), catalog.blobs.count(), catalog.sources.count()) == (2, 2, 3)
    drain()
    assert tables.commits(spark, root).count() == 1
    land(landing, 2, [photo(4)], "3")  # part of an inventory: nothing may end
    drain()
    assert tables.read_catalog(spark, root).sources.filter("is_active").count() == 4
    land(landing, 1, [photo(1, updatedAt="v2", originalFileName="new.jpg")])
    drain()
    rows = {r["external_id"]: (r["is_active"], r["name"])
            for r in tables.read_catalog(spark, root).sources.collect()}
    assert rows["img1"] == (True, "new.jpg") and rows["img4"][0] is False
    assert tables.commits(spark, root).count() == 3
    before = tables.current(spark, root)
    newest = tables.commits(spark, root).orderBy(F.col("version").desc()).first()
    tables.write_tables(spark, root, catalog._asdict(), newest["stream"], newest["batch"])
    assert tables.current(spark, root) == before
    # Another stream counts its own batches.
    other = folder()
    ingest.ingest_stream(spark, landing, root, other, content=lambda s: content,
                         now=T0).awaitTermination(200)
    assert tables.current(spark, root)[0] > before[0]


def rows_of(spark, n, mark="1", start=0):
    """Sources with ids s<start> to s<start + n - 1>."""
    return spark.range(start, start + n).select(
        F.concat(F.lit("s"), "id").alias("id"), F.concat(F.lit("b"), "id").alias("blob_id"),
        F.lit("p").alias("provider"), F.concat(F.lit("x"), "id").alias("external_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("path", "name")],
        F.lit(mark).alias("version_tag"), F.lit("{}").alias("metadata"),
        F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("deleted_at"))


def files_of(root, name):
    """bucket -> (file, time of change) of a live table."""
    found = {}
    for folder, _, names in os.walk(f"{root}/live/{name}"):
        for file in names:
            if file.startswith("part-"):
                at = os.stat(f"{folder}/{file}")
                found.setdefault(os.path.basename(folder), set()).add((file, at.st_mtime_ns))
    return found


def test_a_commit_writes_the_buckets_it_touches(spark):
    root = folder()
    tables.commit_changes(spark, root, {"sources": rows_of(spark, 2000)})
    before = files_of(root, "sources")
    assert len(before) == tables.BUCKETS
    changed = rows_of(spark, 2, "2", 7).unionByName(rows_of(spark, 1, "new", 9000))
    written = tables.commit_changes(spark, root, {"sources": changed})["sources"]
    assert 1 <= len(written) <= 3
    after = files_of(root, "sources")
    same = {b for b in before if before[b] == after.get(b)}
    assert {f"bucket={b}" for b in written} == set(before) - same
    live = tables.read_catalog(spark, root).sources
    assert live.count() == 2001 and live.select("id").distinct().count() == 2001
    assert {r["version_tag"]: r["count"] for r in live.groupBy("version_tag").count().collect()
            } == {"1": 1998, "2": 2, "new": 1}
    # The same rows again, as after a run that died before its commit row.
    tables.merge(spark, root, "sources", changed)
    assert tables.read_catalog(spark, root).sources.count() == 2001
    # A bucket whose rows are all removed is empty.
    live = tables.read_catalog(spark, root).sources
    gone = live.filter(tables.bucket_of("sources") == written[0]).select("id")
    tables.merge(spark, root, "sources", rows_of(spark, 0), removed=gone)
    assert tables.read_catalog(spark, root).sources.filter(
        tables.bucket_of("sources") == written[0]).count() == 0
    assert tables.merge(spark, root, "sources", rows_of(spark, 0)) == []


def test_live_tables_begin_with_the_newest_version(spark):
    root = folder()
    none = Catalog.empty(spark)
    tables.write_tables(spark, root, none._replace(sources=rows_of(spark, 10))._asdict())
    tables.commit_changes(spark, root, {"sources": rows_of(spark, 1, "2", 3)}, "s", 0)
    catalog = tables.read_catalog(spark, root)
    assert catalog.sources.count() == 10 and catalog.resources.count() == 0
    assert tables.commit_changes(spark, root, {"sources": rows_of(spark, 1, "3", 3)}, "s", 0) == {}
    assert tables.read_catalog(spark, root).sources.filter("version_tag = '3'").count() == 0
    assert tables.commits(spark, root).count() == 2


def test_inventory_over_several_batches(spark):
    """Sources end with the batch that closes an unbroken inventory, against all its batches."""
    home = folder()
    landing, root, check = f"{home}/in", f"{home}/root", f"{home}/check"
    content = spark.createDataFrame([("immich", f"img{n}", f"bytes{n}".encode())
                                     for n in range(1, 9)],
                                    "provider STRING, external_id STRING, content BINARY")

    def drain():
        ingest.ingest_stream(spark, landing, root, check, content=lambda s: content,
                             now=T0).awaitTermination(200)
        rows = tables.read_catalog(spark, root).sources.filter("is_active").collect()
        return {int(r["external_id"][3:]) for r in rows}

    land(landing, 1, [photo(1), photo(2), photo(3), photo(4)])
    assert drain() == {1, 2, 3, 4}
    land(landing, 1, [photo(1)], "2")
    assert drain() == {1, 2, 3, 4}
    land(landing, 2, [photo(3)], "3")
    assert drain() == {1, 2, 3, 4}
    land(landing, 3, [photo(5)])
    assert drain() == {1, 3, 5}
    # The second page is lost: the inventory never closes, nothing ends.
    land(landing, 1, [photo(1)], "2")
    drain()
    land(landing, 3, [photo(6)])
    assert drain() == {1, 3, 5, 6}
    # Its late arrival closes it.
    land(landing, 2, [photo(3)], "3")
    assert drain() == {1, 3, 6}


def test_landed_files(spark):
    home = folder()
    xml = ('<d:multistatus xmlns:d="DAV:" xmlns:oc="http://owncloud.org/ns">'
           "<d:response><d:href>/remote.php/dav/files/me/a%20b/</d:href><d:propstat><d:prop>"
           "<oc:id>9</oc:id><d:resourcetype><d:collection/></d:resourcetype></d:prop></d:propstat>"
           "</d:response><d:response><d:href>/remote.php/dav/files/me/a%20b/c+%C3%A9.md</d:href>"
           "<d:propstat><d:prop><oc:id>10</oc:id><d:resourcetype/><d:getcontentlength>3"
           "</d:getcontentlength><d:getetag>e</d:getetag></d:prop></d:propstat></d:response>"
           "<d:response><d:href>/remote.php/dav/files/me/a%20b/sub/</d:href><d:propstat><d:prop>"
           "<oc:id>11</oc:id><d:resourcetype><d:collection/></d:resourcetype></d:prop></d:propstat>"
           "</d:response></d:multistatus>")
    with open(f"{home}/a%20b.xml", "w") as out:
        out.write(xml)
    listings = drive.read_listings(spark, home)
    facts = {r["external_id"]: r for r in drive.drive_facts(listings, "me").collect()}
    assert set(facts) == {"10", "11"} and facts["11"]["kind"] == "folder"
    assert (facts["10"]["path"], facts["10"]["size"], facts["10"]["version_tag"]) == (
        "a b/c+é.md", 3, "e")
    assert [r["folder"] for r in drive.unlisted_folders(listings, "me").collect()] == ["a b/sub"]
    pages = spark.createDataFrame([(None, [("m1",), ("m2",)], None)], mail.LIST_PAGE)
    metadata = [("m1", "5", ([("subject", " S ")],)), ("m2", "6", ([("Subject", "a"),
                                                                   ("SUBJECT", "b")],))]
    one = spark.createDataFrame(metadata[:1], mail.METADATA)
    first = mail.message_facts(pages, one.unionByName(
        spark.createDataFrame([("m2", "6", None)], mail.METADATA)))
    assert {r["external_id"]: r["name"] for r in first.collect()} == {"m1": "S", "m2": None}
    with pytest.raises(Exception, match="ambiguous"):
        mail.message_facts(pages, spark.createDataFrame(metadata, mail.METADATA)).collect()
    with pytest.raises(Exception, match="internalDate"):
        mail.message_facts(pages, one).collect()
    os.makedirs(f"{home}/content")
    with open(f"{home}/content/doc%201", "wb") as out:
        out.write(b"x")
    got = tables.read_content(spark, f"{home}/content", "p").first()
    assert (got["external_id"], bytes(got["content"])) == ("doc 1", b"x")
    old = spark.createDataFrame([("1", "t", "{}", T0, T0)],
                                "id STRING, title STRING, metadata STRING, created_at TIMESTAMP, "
                                "updated_at TIMESTAMP")
    new = tables.backfill_resource_type(old)
    assert new.schema.simpleString() == RESOURCES.simpleString()
    assert new.first()["resource_type"] == "file"


def test_stale_claims(spark):
    home = folder()
    spark.createDataFrame([("a", 1, "running"), ("b", 1, "running"), ("b", 2, "completed")],
                          "subject STRING, arrival BIGINT, status STRING").write.parquet(f"{home}/in")
    events = spark.readStream.schema("subject STRING, arrival BIGINT, status STRING").parquet(
        f"{home}/in")
    query = (stale.watch_claims(events, stale_ms=500).writeStream.format("parquet")
             .option("checkpointLocation", f"{home}/check").trigger(processingTime="1 second")
             .outputMode("append").start(f"{home}/out"))
    seen = set()
    for _ in range(45):
        time.sleep(1)
        if os.path.exists(f"{home}/out/_spark_metadata"):
            seen = {tuple(r) for r in spark.read.schema(stale.OUTPUT).parquet(f"{home}/out")
                    .collect()}
            if ("a", "stale") in seen:
                break
    query.stop()
    assert seen == {("a", "running"), ("b", "completed"), ("a", "stale")}


def test_people_inventory_rules(spark):
    persons, sources = spark.createDataFrame([], PERSONS), spark.createDataFrame([], PERSON_SOURCES)
    for wrong in (("a", "a"), ("a", " ")):
        with pytest.raises(ValueError):
            ppl.reconcile_people("p", ids(spark, *wrong), persons, sources, T0)


def test_detached_pages(spark):
    links = spark.createDataFrame(
        [("l", "1", "2", None), ("l", "2", None, None), ("l", "5", "6", None),
         ("l", "6", "5", None)], "listing STRING, page STRING, next STRING, total BIGINT")
    assert not gate.is_complete(links)
    assert gate.is_complete(links.filter("page < '5'"))


def _listing(path, *entries_):
    rows = "".join(
        f"<d:response><d:href>/remote.php/dav/files/me/{p}</d:href><d:propstat><d:prop>"
        + (f"<oc:id>{i}</oc:id>" if i else "") + "<d:resourcetype/></d:prop></d:propstat></d:response>"
        for p, i in ((path + "/", "0"), *entries_))
    return (path, f'<d:multistatus xmlns:d="DAV:" xmlns:oc="http://owncloud.org/ns">{rows}'
                  "</d:multistatus>")


def test_broken_listings_change_nothing(spark):
    from shelfmark.sources import sync

    def landed(*rows):
        return spark.createDataFrame(list(rows), "listing_path STRING, body STRING")

    content = spark.createDataFrame([("nextcloud", "10", bytearray(b"x"))],
                                    "provider STRING, external_id STRING, content BINARY")
    good = landed(_listing("d", ("d/a.md", "10")))
    first = sync.sync_listings(good, "me", Catalog.empty(spark), T0, content)
    assert first.catalog.sources.filter("is_active").count() == 1
    name, body = _listing("d", ("d/a.md", "10"))
    for wrong in (landed((name, body[:200])), landed(_listing("d", ("d/a.md", ""))),
                  landed((name, body), (name, body))):
        with pytest.raises(RuntimeError):
            sync.sync_listings(wrong, "me", first.catalog, T0, content)


ENTRY = ("<d:response><d:href>/remote.php/dav/files/me/{path}</d:href><d:propstat><d:prop>"
         "<oc:id>{id}</oc:id><d:resourcetype>{kind}</d:resourcetype><d:getetag>e</d:getetag>"
         "<d:getcontentlength>{size}</d:getcontentlength></d:prop></d:propstat></d:response>")


def listing(home, name, paths, end="</d:multistatus>", size="3"):
    """A landed listing file: the directory itself, folders (ending in /) and files."""
    from urllib.parse import quote
    os.makedirs(home, exist_ok=True)
    with open(f"{home}/{quote(name, safe='')}.xml", "w") as out:
        out.write('<d:multistatus xmlns:d="DAV:" xmlns:oc="http://owncloud.org/ns">')
        own = "" if name in ("", "root") else quote(name) + "/"
        for n, path in enumerate([own, *paths]):
            folder = path.endswith("/") or not path
            out.write(ENTRY.format(path=path, id=f"{name}:{n}",
                                   kind="<d:collection/>" if folder else "",
                                   size="" if folder else size))
        out.write(end)


def test_listing_files_are_read_entry_by_entry(spark):
    from shelfmark.sources import sync
    home = folder()
    many = [f"big/file-{n}.txt" for n in range(60_000)]
    listing(f"{home}/in", "big", many)
    listing(f"{home}/in", "big/sub", ["big/sub/x%20y.txt"])
    with open(f"{home}/in/{'big'}.xml") as text:
        assert len(text.read()) > 10 << 20
    rows = drive.read_entries(spark, f"{home}/in")
    files = drive.listing_files(spark, f"{home}/in")
    assert {(r["listing_path"], r["whole"]) for r in files.collect()} == {
        ("big", True), ("big/sub", True)}
    assert drive.file_problems(rows, files, "me").count() == 0
    facts = drive.entry_facts(rows, "me")
    assert facts.count() == 60_001 and facts.select("ordinal").distinct().count() == 60_001
    order = [r["path"] for r in facts.orderBy("ordinal").collect()]
    assert order == sorted(order[:-1], key=str.encode) + ["big/sub/x y.txt"]
    content = facts.selectExpr("provider", "external_id", "encode(external_id, 'UTF-8') content")
    run = sync.sync_listing_files(spark, f"{home}/in", "me", Catalog.empty(spark), T0, content)
    assert run.catalog.sources.count() == 60_001


@pytest.mark.parametrize("fault, want", [
    (dict(end=""), {"broken listing"}), (dict(end="<d:response><d:href>/x"), {"broken listing"}),
    (dict(size="many"), {"entry with a broken size"}), (dict(more=["a/sub/"]), {"folder without listing"})])
def test_a_broken_listing_file_stops_the_sync(spark, fault, want):
    from shelfmark.sources import sync
    home = folder()
    listing(f"{home}/in", "a", ["a/x.txt", *fault.pop("more", [])], **fault)
    rows = drive.read_entries(spark, f"{home}/in")
    found = drive.file_problems(rows, drive.listing_files(spark, f"{home}/in"), "me")
    assert {r["problem"] for r in found.collect()} == want
    with pytest.raises(RuntimeError):
        sync.sync_listing_files(spark, f"{home}/in", "me", Catalog.empty(spark), T0)


def test_page_source_in_batch_and_as_a_stream(spark):
    from shelfmark.sources import provider
    home = folder()
    spark.dataSource.register(provider.LandedPages)
    land(f"{home}/in", 1, [photo(1)], "2")
    land(f"{home}/in", 2, [photo(2), photo(3)])
    pages = spark.read.format("landed_pages").option("path", f"{home}/in").option(
        "filesPerTask", 1).load()
    assert pages.rdd.getNumPartitions() == 2
    assert photos.photo_facts(photos.parse_pages(pages)).count() == 3

    def drain():
        rows = spark.readStream.format("landed_pages").option("path", f"{home}/in").load()
        (rows.writeStream.format("parquet").option("checkpointLocation", f"{home}/check")
         .trigger(availableNow=True).start(f"{home}/out").awaitTermination(200))
        return spark.read.parquet(f"{home}/out").count()

    assert drain() == 2
    assert drain() == 2  # what was read is not read again
    land(f"{home}/in", 3, [photo(4)])
    assert drain() == 3
    os.makedirs(f"{home}/empty")
    assert spark.read.format("landed_pages").option("path", f"{home}/empty").load().count() == 0


def test_syncs_of_people_and_relations_stop_on_broken_inventories(spark):
    from shelfmark.sources import sync
    people_page = "page BIGINT, people ARRAY<STRUCT<id: STRING>>, total BIGINT, hasNextPage BOOLEAN"

    def people(*pages):
        return spark.createDataFrame([(n, [(i,) for i in ids_], 3, more)
                                      for n, ids_, more in pages], people_page)

    persons, sources = spark.createDataFrame([], PERSONS), spark.createDataFrame([], PERSON_SOURCES)
    run = sync.sync_people_pages(people((1, ["a", "b"], True), (2, ["c"], False)), persons,
                                 sources, T0)
    assert set(outcomes(run).values()) == {"created"}
    for broken in (people((1, ["a"], True)), people((1, ["a", "a"], False)),
                   people((1, [" "], False)), people((2, ["a"], False))):
        with pytest.raises(RuntimeError):
            sync.sync_people_pages(broken, run.persons, run.person_sources, T0)
    catalog = asset_catalog(spark, 200, "immich")
    page = {"page": 1, "assets": {"items": ['{"id":"a150"}'], "nextPage": None, "total": 1}}

    def relations(*ids_, **more):
        return spark.createDataFrame([{"personId": i, **page, **more} for i in ids_],
                                     photos.RELATION_PAGE)

    none = spark.createDataFrame([], RESOURCE_PERSON)
    known = run.person_sources
    done = sync.sync_relation_pages(relations("a", "b", "c"), catalog, known, none, T0)
    assert tuple(done.totals.first()) == (3, 0, 0, 0, 0)
    with pytest.raises(RuntimeError, match="person without pages"):
        sync.sync_relation_pages(relations("a", "b"), catalog, known, done.relations, T0)
    with pytest.raises(RuntimeError):
        sync.sync_relation_pages(relations("a", "b", "c", page=2), catalog, known, none, T0)
