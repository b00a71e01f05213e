from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import presentation as pres
from shelfmark.operators import query as q
from shelfmark.schemas import BLOBS, RESOURCES, SOURCES, Catalog

NOW = datetime(2026, 8, 12, 12, tzinfo=timezone.utc)
FROM = NOW - timedelta(days=3)


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def build(spark, resources):
    """resources: (number, title, created, [(provider, mime, active, path)])."""
    rows, blobs, sources = [], [], []
    for n, title, created, listed in resources:
        rows.append((uid(n), "file", title, "{}", created, created))
        for i, (provider, mime, active, path) in enumerate(listed):
            blobs.append((uid(n * 1000 + i), uid(n), f"{n}-{i}", 10 + i, mime))
            sources.append((uid(n * 1000 + 500 + i), uid(n * 1000 + i), provider, f"x{n}-{i}", path,
                            f"n{n}", "1", "{}", active, None))
    return Catalog(spark.createDataFrame(rows, RESOURCES), spark.createDataFrame(blobs, BLOBS),
                   spark.createDataFrame(sources, SOURCES))


@pytest.fixture(scope="module")
def nine(spark):
    hour, day = timedelta(hours=1), timedelta(days=1)
    return build(spark, [
        (1, "boundary", FROM, [("P", "image/jpeg", True, "/Docs/100%_a")]),
        (2, "tied", NOW - 2 * day, [("P", "text/markdown", True, "/docs/b")]),
        (3, "tied", NOW - 2 * day, [("P", "text/markdown", True, "/other/b")]),
        (4, "multi", NOW - day, [("P", "text/markdown", True, "/m"), ("P", "image/png", True, "/m"),
                                 ("Q", "image/jpeg", True, "/m")]),
        (5, "unknown", NOW - 13 * hour, [("P", None, True, None)]),
        (6, "malformed", NOW - 12 * hour, [("P", "malformed", True, "/x\\y")]),
        (7, "inactive", NOW - 10 * hour, [("P", "image/jpeg", False, "/i")]),
        (8, "zero source", NOW - 9 * hour, []),
        (9, "exclusive boundary", NOW, [("P", "video/mp4", True, "/v")])])


PERIOD = q.Period(FROM, NOW)


def buckets(df):
    return [(r["bucket"], r["bucket_count"]) for r in df.collect()]


def test_aggregation_goldens(nine):
    assert q.aggregate(nine, period=PERIOD).first()["total_count"] == 6
    assert buckets(q.aggregate(nine, period=PERIOD, group_by="day")) == [
        ("2026-08-09", 1), ("2026-08-10", 2), ("2026-08-11", 2), ("2026-08-12", 1)]
    assert buckets(q.aggregate(nine, period=PERIOD, group_by="mime_category")) == [
        ("text", 3), ("image", 2), ("other", 1), ("unknown", 1)]
    providers = q.aggregate(nine, period=PERIOD, group_by="provider")
    assert buckets(providers) == [("P", 6), ("Q", 1)]
    assert {r["total_count"] for r in providers.collect()} == {6}
    for category, want in (("text", 0), ("image", 1)):
        filters = q.Filters(provider="Q", mime_category=category)
        assert q.aggregate(nine, filters, PERIOD).first()["total_count"] == want
    assert q.aggregate(nine, q.Filters(path_prefix="/DOCS/100%_"), PERIOD).first()[0] == 1
    assert q.aggregate(nine, q.Filters(path_prefix="/docs/1__%"), PERIOD).first()[0] == 0
    assert buckets(q.aggregate(nine, q.Filters(provider="none"), PERIOD, "provider")) == []


def test_buckets_are_cut_at_the_limit(spark):
    many = build(spark, [(1, "a", NOW, [(f"p{i:03d}", None, True, None) for i in range(101)])])
    rows = q.aggregate(many, group_by="provider").collect()
    assert len(rows) == 100 and rows[0]["truncated"] and rows[0]["total_count"] == 1
    exact = build(spark, [(1, "a", NOW, [(f"p{i:03d}", None, True, None) for i in range(100)])])
    rows = q.aggregate(exact, group_by="provider").collect()
    assert len(rows) == 100 and not rows[0]["truncated"]


def titles(page):
    return [r["title"] for r in page.heads.orderBy("position").collect()]


def test_recent_pages_are_stable(spark, nine):
    first = q.list_recent(nine, NOW, period=PERIOD, limit=2)
    assert titles(first) == ["malformed", "unknown"]
    token = first.next_token()
    later = build(spark, [(10, "late", NOW - timedelta(hours=1), [("P", None, True, "/l")])])
    grown = Catalog(*[a.unionByName(b) for a, b in zip(nine, later)])
    second = q.list_recent(grown, NOW + timedelta(hours=2), period=PERIOD, limit=3, cursor=token)
    assert titles(second) == ["multi", "tied", "tied"]
    third = q.list_recent(grown, NOW, period=PERIOD, limit=3, cursor=second.next_token())
    assert titles(third) == ["boundary"] and third.next_token() is None
    for bad in (token[:-2], "x" + token, "!!"):
        with pytest.raises(q.InvalidQuery):
            q.list_recent(nine, NOW, period=PERIOD, cursor=bad)
    with pytest.raises(q.InvalidQuery):
        q.list_recent(nine, NOW, q.Filters(provider="P"), PERIOD, cursor=token)
    assert titles(q.list_recent(nine, NOW, days=2)) == ["malformed", "unknown", "multi", "tied",
                                                         "tied"]


def test_default_window_pages(nine):
    first = q.list_recent(nine, NOW, limit=4)
    rest = q.list_recent(nine, NOW + timedelta(days=40), limit=4, cursor=first.next_token())
    assert titles(first) + titles(rest) == [
        "malformed", "unknown", "multi", "tied", "tied", "boundary"]


def test_search(nine):
    assert titles(q.search(nine, "TIED", NOW)) == ["tied", "tied"]
    assert titles(q.search(nine, "100%_", NOW)) == ["boundary"]
    assert titles(q.search(nine, "1%a", NOW)) == []
    assert titles(q.search(nine, "x\\y", NOW)) == ["malformed"]
    assert titles(q.search(nine, "inactive", NOW)) == []
    assert titles(q.search(nine, "u", NOW, q.Filters(mime_type="image/jpeg"))) == [
        "boundary", "multi"]
    page = q.search(nine, "tied", NOW, limit=1)
    assert titles(q.search(nine, "tied", NOW, limit=1, cursor=page.next_token())) == ["tied"]
    empty = q.search(nine, "tied", NOW, period=q.Period(NOW + timedelta(days=1)))
    assert titles(empty) == []


def test_rows_detail_payload_and_access(spark, nine):
    page = q.list_recent(nine, NOW, period=PERIOD)
    rows = [(r["position"], r["provider"]) for r in page.rows.collect()]
    assert rows == [(1, "P"), (2, "P"), (3, "P"), (3, "P"), (3, "Q"), (4, "P"), (5, "P"), (6, "P")]
    detail = q.get_resource(nine, "catalog:resource:" + uid(7))
    assert detail.heads.count() == 1 and detail.sources.count() == 1
    assert [r["checksum"] for r in q.get_resource(
        nine, "catalog:resource:" + uid(4)).contents.collect()] == ["4-0", "4-1", "4-2"]
    assert q.get_resource(nine, "nonsense").heads.count() == 0
    heads = nine.resources.filter(F.col("id").isin(uid(4), uid(8)))
    payloads = {r["resource_ref"]: r for r in pres.payloads(nine, heads).collect()}
    assert payloads["catalog:resource:" + uid(8)]["payload"].endswith('"sources":[]}')
    asked = nine.resources.select(fn.resource_ref("id").alias("resource_ref")).unionByName(
        spark.createDataFrame([("catalog:resource:" + uid(99),)], "resource_ref STRING"))
    states = {r["resource_ref"][-2:]: r["status"]
              for r in q.access_sources(nine, asked, "P").collect()}
    assert states["01"] == "available" and states["99"] == "not_found"
    assert states["02"] == "unavailable" and states["07"] == "unavailable"


def test_large_payloads_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(pres, "SOURCES_PER_PART", 7)
    many = build(spark, [(1, "a", NOW, [(f"p{i:03d}", None, True, None) for i in range(40)])])
    parts = pres.payloads(many, many.resources)
    names = parts.select(F.explode(F.from_json(
        "payload", "sources ARRAY<STRUCT<provider: STRING>>")["sources"]["provider"]).alias("p"))
    assert parts.count() > 1 and names.distinct().count() == names.count() == 40


@pytest.mark.parametrize("make", [
    lambda: q.Filters(mime_type="a/b", mime_category="a"), lambda: q.Filters(mime_category="a/b"),
    lambda: q.Filters(provider=" "), lambda: q.Filters(resource_type="album"),
    lambda: q.Period(NOW, NOW), lambda: q.Period(datetime(2026, 1, 1)),
    lambda: q.check_limit(0), lambda: q.check_limit(101), lambda: q.check_limit(True)])
def test_arguments_are_checked(make):
    with pytest.raises(q.InvalidQuery):
        make()


def test_grouping_arguments(nine):
    for period in (q.Period(), q.Period(NOW - timedelta(days=400), NOW)):
        with pytest.raises(q.InvalidQuery):
            q.aggregate(nine, period=period, group_by="day")
    with pytest.raises(q.InvalidQuery):
        q.aggregate(nine, group_by="title")
    with pytest.raises(q.InvalidQuery):
        q.list_recent(nine, NOW, period=PERIOD, days=3)
