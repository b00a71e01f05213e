from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [
    ("2026-08-10T00:00:00.000Z", datetime(2026, 8, 10)),
    ("2026-08-10T08:00:00+08:00", datetime(2026, 8, 10)),
    ("2026-08-10T00:00:00", None), ("2026-08-10", None), ("soon", None), (None, None)])
def test_iso_instant(spark, text, want):
    assert one(spark, fn.iso_instant(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [
    ("Sun, 10 Aug 2026 00:00:00 GMT", datetime(2026, 8, 10)),
    ("Mon, 10 Aug 2026 08:00:00 +0800", datetime(2026, 8, 10)),
    ("10 Aug 2026 00:00:00 -0000", None), ("not a date", None)])
def test_http_instant(spark, text, want):
    assert one(spark, fn.http_instant(F.lit(text))) == want


@pytest.mark.parametrize("json, want", [
    ("12", 12), ('"12"', 12), ("true", None), ("-3", None), ('"x"', None), ("null", None),
    ("1.5", None)])
def test_fact_size(spark, json, want):
    assert one(spark, fn.fact_size(F.lit(json))) == want


@pytest.mark.parametrize("size, want", [
    (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1280, "1.2 KiB"), (1536, "1.5 KiB"),
    (1048576, "1.0 MiB"), (3 * 1048576 + 1, "3.0 MiB")])
def test_size_label(spark, size, want):
    assert one(spark, fn.size_label(F.lit(size))) == want


@pytest.mark.parametrize("mime, want", [
    (None, "unknown"), ("", "unknown"), ("IMAGE/png", "image"), ("malformed", "other")])
def test_mime_category(spark, mime, want):
    assert one(spark, fn.mime_category(F.lit(mime).cast("string"))) == want


@pytest.mark.parametrize("name, want", [
    ("a.txt", "a"), (".bashrc", ".bashrc"), ("a.tar.gz", "a.tar"), ("plain", "plain"),
    ("a.", "a.")])
def test_without_extension(spark, name, want):
    assert one(spark, fn.without_extension(F.lit(name))) == want


@pytest.mark.parametrize("ref, good", [
    ("catalog:resource:0b0f3a3e-0000-4000-8000-000000000001", True),
    ("catalog:resource:0B0F3A3E-0000-4000-8000-000000000001", False),
    ("catalog:resource:0b0f3a3e00004000800000000000001", False),
    ("other:0b0f3a3e-0000-4000-8000-000000000001", False), (None, False)])
def test_resource_refs(spark, ref, good):
    assert one(spark, fn.is_resource_ref(F.lit(ref).cast("string"))) is good


def brute_truncate(text, limit, marker, trim):
    if len(text.encode()) <= limit:
        return text
    head = text.encode()[:limit - len(marker.encode())].decode("utf-8", "ignore")
    return (head.rstrip(" \n") if trim else head) + marker


@pytest.mark.parametrize("trim", [False, True])
def test_truncate_utf8_at_every_boundary(spark, trim):
    marker = "\n[…cut]"
    texts = [("é" * n + "a " * m + "𝄞" * k) for n in range(0, 20, 3) for m in range(4)
             for k in range(0, 14, 2)]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select(
        "t", fn.truncate_utf8(F.col("t"), 32, marker, trim).alias("v")).collect()
    for row in rows:
        assert row["v"] == brute_truncate(row["t"], 32, marker, trim)
        assert len(row["v"].encode()) <= 32


def test_regions_and_numbers(spark):
    assert one(spark, fn.normalise_region(F.lit("a  b\r\n\t c \r\r d"))) == "a b\nc\nd"
    doc = F.lit('{"a": 1.5, "b": true, "c": "1", "d": null}')
    assert one(spark, fn.json_number(doc, "$.a")) == 1.5
    assert one(spark, fn.json_number(doc, "$.b")) is None
    assert one(spark, fn.json_number(doc, "$.c")) is None
    assert one(spark, fn.canonical_json(F.lit('{"b":1, "a":[2 ]}'))) == '{"a":[2],"b":1}'
    assert one(spark, fn.base64url(F.lit("aGk_")).cast("string")) == "hi?"
    assert one(spark, fn.base64url(F.lit("aGk")).cast("string")) == "hi"


def test_fingerprint_sees_nulls_and_ignores_argument_order(spark):
    a, b = F.lit(1), F.lit(None).cast("string")
    assert one(spark, fn.fingerprint(x=a, y=b)) == one(spark, fn.fingerprint(y=b, x=a))
    assert one(spark, fn.fingerprint(x=a, y=b)) != one(spark, fn.fingerprint(x=a))
