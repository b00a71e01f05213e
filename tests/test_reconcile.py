"""The set-oriented reconcile against a fact-by-fact simulation over many random small worlds."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import reconcile as rec
from shelfmark.schemas import BLOBS, FACTS, RESOURCES, SOURCES, Catalog

NOW = datetime(2026, 8, 12, tzinfo=timezone.utc)


def fact(ordinal, ext, kind="file", name="a.txt", version="1", digest="h", path="/p", raw="{}",
         provider="p"):
    return dict(ordinal=ordinal, provider=provider, kind=kind, external_id=ext, name=name,
                path=path, size=1, mime_type="text/plain", modified_at=None, version_tag=version,
                content_hash=digest, raw=raw, observed_at=None)


def frame(spark, facts):
    return spark.createDataFrame([tuple(f[c] for c in FACTS.fieldNames()) for f in facts], FACTS)


def simulate(facts, sources, blobs):
    """Handle facts one by one. sources: ext -> dict, blobs: list of (asset, hash, blob name)."""
    sources = {k: dict(v) for k, v in sources.items()}
    blobs, reasons, refused = list(blobs), {}, set()
    for f in sorted(facts, key=lambda f: f["ordinal"]):
        ext, digest = f["external_id"], f["content_hash"]
        if ext in refused:  # once refused, a source stays refused for the scan
            reasons[f["ordinal"]] = ("ambiguous_blob_hash", None)
            continue
        have = sources.get(ext)
        state = (f["path"], f["name"], f["version_tag"], f["raw"])
        if have is None:
            same = [b for b in blobs if b[1] == digest]
            if f["kind"] == "message":
                reason, home = "new_message_source", (f"message:{ext}", digest)
            elif len(same) > 1:
                reasons[f["ordinal"]] = ("ambiguous_blob_hash", None)
                refused.add(ext)
                continue
            elif same:
                reason, home = "new_source_existing_blob", same[0][:2]
            else:
                reason, home = "new_source_new_blob", (f"file:{digest}", digest)
            if reason != "new_source_existing_blob":
                blobs.append(home)
        elif have["state"][2] == f["version_tag"]:
            reason = "source_unchanged" if have["state"] == state else "source_metadata_changed"
            home = have["home"]
        else:
            home = (have["home"][0], digest)
            if home in blobs:
                reason = "source_returned_to_existing_blob_in_asset"
            else:
                reason = "new_blob_for_existing_asset"
                blobs.append(home)
        sources[ext] = {"state": state, "home": home}
        reasons[f["ordinal"]] = (reason, home)
    return reasons, sources


def random_worlds(n, repeats):
    pick = random.Random(11 if repeats else 7)
    facts, worlds, ordinal = [], [], 0
    for w in range(n):
        digests = [f"w{w}-h{i}" for i in range(3)]
        sources, blobs = {}, []
        for i in range(pick.randint(0, 3)):
            digest, asset = pick.choice(digests), f"asset-{w}-{i}"
            if any(b[1] == digest for b in blobs) and pick.random() < .6:
                asset = next(b[0] for b in blobs if b[1] == digest)
            if (asset, digest) not in blobs:
                blobs.append((asset, digest))
            sources[f"w{w}-old{i}"] = {
                "state": ("/p", "a.txt", pick.choice("12"), "{}"), "home": (asset, digest)}
        mine = []
        names = list(sources) + [f"w{w}-new{i}" for i in range(3)]
        if repeats:
            ext = pick.choice(names)
            names = [ext] * pick.randint(2, 6)
        for ext in pick.sample(names, len(names)):
            ordinal += pick.randint(1, 3)
            mine.append(fact(ordinal, ext, name=pick.choice(["a.txt", "b.txt"]),
                             version=pick.choice("12"), digest=pick.choice(digests)))
        # A version names one content within a world's repeated listing.
        if repeats:
            for f in mine:
                f["content_hash"] = digests[int(f["version_tag"])]
        facts += mine
        worlds.append((mine, sources, blobs))
    return facts, worlds


def stored(spark, worlds):
    blob_id = lambda home: f"blob|{home[0]}|{home[1]}"
    resources, blobs, sources = {}, [], []
    for _, olds, homes in worlds:
        for home in homes:
            resources[home[0]] = (home[0], "file", "t", "{}", NOW, NOW)
            blobs.append((blob_id(home), home[0], home[1], 1, None))
        for ext, s in olds.items():
            path, name, version, raw = s["state"]
            sources.append((f"source|{ext}", blob_id(s["home"]), "p", ext, path, name, version, raw,
                            True, None))
    return Catalog(spark.createDataFrame(list(resources.values()), RESOURCES),
                   spark.createDataFrame(blobs, BLOBS), spark.createDataFrame(sources, SOURCES))


@pytest.mark.parametrize("repeats", [False, True])
def test_random_worlds(spark, repeats):
    facts, worlds = random_worlds(150, repeats)
    catalog = stored(spark, worlds)
    run = rec.reconcile(frame(spark, facts), catalog, NOW, complete=True)
    decided = {r["ordinal"]: r for r in run.decisions.collect()}
    contents = {r["id"]: (r["asset_id"], r["hash"]) for r in run.catalog.blobs.collect()}
    assert len(contents) == run.catalog.blobs.count()
    final = {r["external_id"]: r for r in run.catalog.sources.collect()}
    kinds = set()
    for mine, olds, homes in worlds:
        reasons, after = simulate(mine, olds, homes)
        for ordinal, (reason, home) in reasons.items():
            assert decided[ordinal]["reason"] == reason, (mine, olds, homes)
            kinds.add(reason)
            if home is not None:
                assert contents[decided[ordinal]["blob_id"]][1] == home[1]
        for ext, s in after.items():
            row = final[ext]
            assert (row["path"], row["name"], row["version_tag"], row["metadata"]) == s["state"]
            asset, digest = contents[row["blob_id"]]
            assert digest == s["home"][1]
            if s["home"][0].startswith("asset-"):
                assert asset == s["home"][0]
    assert len(kinds) >= (4 if repeats else 7)


def test_rejections_titles_and_messages(spark):
    facts = [
        fact(1, "x", provider=" "), fact(2, ""), fact(3, "y", kind="album"),
        fact(4, "dir", kind="folder"), fact(5, "m1", "message", "Hello.txt", None, "same"),
        fact(6, "m2", "message", None, None, "same"), fact(7, "f", name=".profile", digest="d1"),
        fact(8, "g", name="", digest="d2"), fact(9, "h", digest=None)]
    run = rec.reconcile(frame(spark, facts), Catalog.empty(spark), NOW, complete=True)
    reasons = {r["ordinal"]: r["reason"] for r in run.decisions.collect()}
    assert reasons == {
        1: "invalid_fact_missing_provider", 2: "invalid_fact_missing_external_id",
        3: "invalid_fact_kind", 4: "folder_ignored_in_v0_1", 5: "new_message_source",
        6: "new_message_source", 7: "new_source_new_blob", 8: "new_source_new_blob",
        9: "content_hash_required"}
    titles = sorted(r["title"] for r in run.catalog.resources.collect())
    assert titles == [".profile", "Hello.txt", "Untitled Asset", "Untitled Asset"]


def test_rerun_is_a_no_op_and_missing_sources_end(spark):
    content = spark.createDataFrame(
        [("p", "m", b"mail"), ("p", "f", b"file")],
        "provider STRING, external_id STRING, content BINARY")
    facts = [fact(1, "m", "message", "Hi", None, None), fact(2, "f", digest=None)]
    first = rec.sync_provider(frame(spark, facts), Catalog.empty(spark), NOW, content)
    again = rec.sync_provider(frame(spark, facts), first.catalog, NOW, content)
    assert {r["reason"] for r in again.decisions.collect()} == {"source_unchanged"}
    assert rec.metrics(again.decisions, again.missing).first().asDict() == {
        "facts": 2, "actions": 0, "hashes": 1, "missing": 0}
    gone = rec.sync_provider(frame(spark, facts[:1]), again.catalog, NOW, content, complete=True)
    states = {r["external_id"]: (r["is_active"], r["deleted_at"] is not None)
              for r in gone.catalog.sources.collect()}
    assert states == {"m": (True, False), "f": (False, True)}
    # A reappearing source is updated but stays inactive; no facts at all end nothing.
    back = rec.reconcile(frame(spark, [facts[0], fact(2, "f", digest=None, name="new.txt")]),
                         gone.catalog, NOW, content, complete=True)
    row = back.catalog.sources.filter("external_id = 'f'").first()
    assert (row["name"], row["is_active"]) == ("new.txt", False)
    none = rec.reconcile(frame(spark, [fact(1, "m")]).limit(0), first.catalog, NOW, complete=True)
    assert none.missing.count() == 0
    part = rec.reconcile(frame(spark, facts[:1]), first.catalog, NOW, content, complete=False)
    assert part.missing.count() == 0


def test_sync_refuses_mixed_scans_and_type_changes(spark):
    with pytest.raises(ValueError):
        rec.sync_provider(frame(spark, [fact(1, "a"), fact(2, "b", provider="q")]),
                          Catalog.empty(spark), NOW)
    first = rec.reconcile(frame(spark, [fact(1, "a")]), Catalog.empty(spark), NOW, complete=True)
    with pytest.raises(RuntimeError, match="type_mismatch"):
        rec.sync_provider(frame(spark, [fact(1, "a", "message")]), first.catalog, NOW)
    assert first.catalog.sources.select(F.count_if("is_active")).first()[0] == 1


def test_ids_of_different_keys_differ(spark):
    from shelfmark import functions as fn
    rows = [("a|b", "c"), ("a", "b|c"), ("a\\", "|b"), ("a\\|", "b"), ("a", None), (None, "a"),
            ("a", "\\0"), ("a", "0")]
    df = spark.createDataFrame(rows, "x STRING, y STRING")
    assert df.select(fn.uuid_text("x", "y")).distinct().count() == len(rows)


def test_metadata_is_compared_by_value(spark):
    one = fact(1, "a", raw='{"a":1,"b":2}')
    first = rec.reconcile(frame(spark, [one]), Catalog.empty(spark), NOW, complete=True)
    again = rec.reconcile(frame(spark, [fact(1, "a", raw='{"b": 2, "a": 1}')]), first.catalog, NOW,
                          complete=True)
    assert [r["reason"] for r in again.decisions.collect()] == ["source_unchanged"]
    other = rec.reconcile(frame(spark, [fact(1, "a", raw='{"b": 2, "a": "1"}')]), first.catalog, NOW,
                          complete=True)
    assert [r["reason"] for r in other.decisions.collect()] == ["source_metadata_changed"]


def test_facts_that_share_an_ordinal(spark):
    first = rec.reconcile(frame(spark, [fact(1, "a"), fact(2, "b", digest="2" * 64)]),
                          Catalog.empty(spark), NOW, complete=True)
    changed = [fact(1, "a", version="v2", digest="3" * 64),
               fact(1, "b", version="v2", digest="4" * 64)]
    again = rec.reconcile(frame(spark, changed), first.catalog, NOW, complete=True)
    assert sorted(r["external_id"] for r in again.decisions.collect()) == ["a", "b"]


def raising(spark, content, keys):
    """Content that cannot be read for the given external ids."""
    return content.withColumn("content", F.when(
        F.col("external_id").isin(*keys), F.raise_error(F.lit("content was read")).cast("binary"))
        .otherwise(F.col("content")))


def test_content_is_read_for_the_keys_that_need_it(spark):
    rows = [("p", n, n.encode()) for n in ("m", "a", "b", "c", "old")]
    content = spark.createDataFrame(rows, "provider STRING, external_id STRING, content BINARY")
    facts = [fact(1, "m", "message", "Hi", None, None), fact(2, "a", digest=None),
             fact(3, "b", digest=None), fact(4, "old", digest="given")]
    first = rec.sync_provider(frame(spark, facts), Catalog.empty(spark), NOW,
                              raising(spark, content, ["c", "old"]))
    # "a" is unchanged, "b" has a new version, "c" is new, the folder has no content.
    later = [fact(1, "a", digest=None, name="renamed.txt"), fact(2, "b", version="2", digest=None),
             fact(3, "c", digest=None), fact(4, "dir", kind="folder"),
             fact(5, "old", version="2", digest="given"), fact(6, "b", version="2", digest=None)]
    needed = rec.content_needed(frame(spark, later), first.catalog).collect()
    assert sorted(r["external_id"] for r in needed) == ["b", "c"]
    again = rec.sync_provider(frame(spark, later), first.catalog, NOW,
                              raising(spark, content, ["m", "a", "old"]))
    assert {r["ordinal"]: (r["reason"], r["hash_computed"]) for r in again.decisions.collect()} == {
        1: ("source_metadata_changed", False), 2: ("source_returned_to_existing_blob_in_asset", True),
        3: ("new_source_new_blob", True), 4: ("folder_ignored_in_v0_1", False),
        5: ("source_returned_to_existing_blob_in_asset", False), 6: ("source_unchanged", False)}
    # Nothing needs content: none is read, whatever it is.
    same = [fact(1, "a", digest=None, name="renamed.txt")]
    idle = rec.sync_provider(frame(spark, same), again.catalog, NOW,
                             raising(spark, content, ["m", "a", "b", "c", "old"]))
    assert [r["reason"] for r in idle.decisions.collect()] == ["source_unchanged"]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_content_matched_before_or_after_it_is_reduced(spark, monkeypatch, limit):
    from shelfmark.operators import content as cnt
    monkeypatch.setattr(cnt, "BROADCAST_BYTES", limit)
    content = spark.createDataFrame([("p", f"k{n}", b"x" * n) for n in range(50)], cnt.CONTENT)
    keys = content.filter("external_id IN ('k3', 'k40')").unionByName(content.limit(0))
    got = cnt.only(content, keys, rec.content_hashes)
    assert sorted(r["external_id"] for r in got.collect()) == ["k3", "k40"]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert ("strategy=broadcast" in plan) == (limit > 0)


def test_stored_and_landed_content(spark):
    import os
    import tempfile
    from urllib.parse import quote

    from shelfmark.sources.content import LandedFiles, StoredContent
    home = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    names = [f"k{n}" for n in range(40)] + ["a b/c", "x[1]*?{y}", "ü+%"]
    content = spark.createDataFrame([("p", n, n.encode()) for n in names],
                                    "provider STRING, external_id STRING, content BINARY")
    stored = StoredContent(spark, f"{home}/stored", buckets=16)
    stored.write(content)
    keys = content.filter("external_id IN ('k3', 'a b/c')").select("provider", "external_id")
    read = stored.read(keys)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert {"k3", "a b/c"} <= {r["external_id"] for r in read.collect()} and read.count() < 15
    os.makedirs(f"{home}/files")
    for n in names:
        with open(f"{home}/files/{quote(n, safe='')}", "wb") as out:
            out.write(n.encode())
    wanted = content.filter("external_id IN ('k3', 'a b/c', 'x[1]*?{y}', 'ü+%')")
    named = LandedFiles(spark, f"{home}/files", "p").read(wanted)
    assert {r["external_id"]: bytes(r["content"]).decode() for r in named.collect()} == {
        n: n for n in ("k3", "a b/c", "x[1]*?{y}", "ü+%")}
    assert LandedFiles(spark, f"{home}/files", "p", named_files=2).read(wanted).count() == len(names)
    assert LandedFiles(spark, f"{home}/files", "p").read(wanted.limit(0)).count() == 0
    facts = [fact(k, n, digest=None) for k, n in enumerate(("k3", "a b/c", "k9"))]
    for source in (stored, LandedFiles(spark, f"{home}/files", "p")):
        run = rec.sync_provider(frame(spark, facts), Catalog.empty(spark), NOW, source)
        assert run.catalog.blobs.count() == 3
