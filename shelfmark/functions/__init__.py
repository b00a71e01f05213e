"""Column functions; all of them stay inside JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REF_PREFIX = "catalog:resource:"
UUID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- references and ids -------------------------------------------------------------------

def uuid_text(*parts: Column | str) -> Column:
    """A UUID-shaped id cut from the SHA-256 of its natural key: same key, same id.

    Parts are joined by `|`; a `|` or backslash inside a part is escaped and a null part has a
    mark of its own, so different keys never join to one text.
    """
    escaped = [F.regexp_replace(col(p), r"([|\\])", r"\\$1") for p in parts]
    joined = F.concat_ws("|", *[F.coalesce(e, F.lit("\\0")) for e in escaped])
    digest = F.sha2(joined, 256)
    return F.regexp_replace(
        digest, r"\A(.{8})(.{4})(.{4})(.{4})(.{12}).*\z", "$1-$2-$3-$4-$5")


def resource_ref(resource_id: Column | str, prefix: str = REF_PREFIX) -> Column:
    return F.concat(F.lit(prefix), col(resource_id))


def is_resource_ref(ref: Column | str, prefix: str = REF_PREFIX) -> Column:
    """True only for the prefix followed by a lower-case, hyphenated UUID."""
    value = col(ref)
    return F.coalesce(
        value.startswith(prefix)
        & F.substr(value, F.lit(len(prefix) + 1)).rlike(rf"\A{UUID_PATTERN}\z"),
        F.lit(False),
    )


def parse_ref(ref: Column | str, prefix: str = REF_PREFIX) -> Column:
    """The resource id of a well-formed reference, else null."""
    return F.when(is_resource_ref(ref, prefix), F.substr(col(ref), F.lit(len(prefix) + 1)))


# --- text ---------------------------------------------------------------------------------

def strip(value: Column | str) -> Column:
    """Trim every kind of white space, as well as blanks."""
    return F.regexp_replace(col(value), r"(?U)\A\s+|\s+\z", "")


def optional_text(value: Column | str) -> Column:
    return F.nullif(strip(value), F.lit(""))


def contains_ci(value: Column, needle: str) -> Column:
    """Case-insensitive literal containment: %, _ and \\ carry no meaning."""
    return F.lower(value).contains(needle.lower())


def startswith_ci(value: Column, prefix: str) -> Column:
    return F.lower(value).startswith(prefix.lower())


def mime_base(value: Column | str) -> Column:
    """Type and subtype only, lower case; '' when absent."""
    return F.lower(strip(F.coalesce(F.split_part(col(value), F.lit(";"), F.lit(1)), F.lit(""))))


def mime_category(value: Column | str) -> Column:
    mime = col(value)
    return (
        F.when(mime.isNull() | (mime == ""), "unknown")
        .when(mime.contains("/"), F.lower(F.split_part(mime, F.lit("/"), F.lit(1))))
        .otherwise("other")
    )


def extension(name: Column | str) -> Column:
    """Lower-case suffix of the last path segment with its dot; '' for none or a dotfile."""
    leaf = F.element_at(F.split(col(name), "/"), -1)
    return F.lower(F.regexp_extract(leaf, r"(?<=[^.])(\.[^.]+)\z", 1))


def without_extension(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"(?<=.)\.[^.]+\z", "")


def newlines(value: Column | str) -> Column:
    return F.regexp_replace(col(value), r"\r\n?", "\n")


def normalise_region(text: Column | str) -> Column:
    """One OCR region: lines with single blanks, trimmed, none empty."""
    lines = F.split(newlines(text), "\n")
    lines = F.transform(lines, lambda l: strip(F.regexp_replace(l, r"(?U)[^\S\r\n]+", " ")))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def truncate_utf8(text: Column, limit: int, marker: str, trim_tail: bool = False) -> Column:
    """At most `limit` UTF-8 bytes; a cut text ends in `marker` and never splits a character."""
    room = limit - len(marker.encode())
    raw = F.encode(text, "UTF-8")
    # A character has at most four bytes, so one of four cuts is on a boundary.
    cuts = [F.try_validate_utf8(F.substring(raw, 1, room - back).cast("string")) for back in range(4)]
    head = F.coalesce(*cuts)
    if trim_tail:
        head = F.regexp_replace(head, r"[ \n]+\z", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(head, F.lit(marker)))


def clip(text: Column | str, length: int) -> Column:
    return F.left(col(text), F.lit(length))


def size_label(size: Column | str) -> Column:
    """B, KiB or MiB; one decimal, halves to even on the exact quotient."""
    s = col(size)

    def per(unit: int) -> Column:
        exact = s.cast("decimal(18,0)") * F.lit(1 / unit).cast("decimal(20,20)")
        return F.bround(exact, 1).cast("decimal(20,1)").cast("string")

    return (
        F.when(s < 1024, F.concat(s.cast("string"), F.lit(" B")))
        .when(s < 1024 ** 2, F.concat(per(1024), F.lit(" KiB")))
        .otherwise(F.concat(per(1024 ** 2), F.lit(" MiB")))
    )


# --- times --------------------------------------------------------------------------------

ISO_WITH_OFFSET = (
    r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})\z"
)


# The last millisecond of the year 9999.
LAST_MILLIS = 253_402_300_799_999


def iso_instant(value: Column | str) -> Column:
    """ISO text with an explicit offset; zoneless, date-only and malformed text give null."""
    text = col(value)
    return F.when(text.rlike(ISO_WITH_OFFSET), text.try_cast("timestamp"))


def http_instant(value: Column | str) -> Column:
    """RFC date text ('Sun, 10 Aug 2026 00:00:00 GMT'); `-0000` means no known zone."""
    text = F.regexp_replace(strip(value), r"\A[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.when(~text.endswith("-0000"), text)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss xx")),
    )


def epoch_millis(value: Column | str) -> Column:
    """Digits as milliseconds since 1970; none past the year 9999."""
    text = col(value)
    millis = text.try_cast("bigint")
    return F.when(text.rlike(r"\A[0-9]{1,15}\z") & (millis <= LAST_MILLIS),
                  F.timestamp_millis(millis))


# --- JSON, hashes, numbers ----------------------------------------------------------------

def canonical_json(value: Column | str) -> Column:
    """One spelling per value: keys sorted, no blanks. Malformed text gives null."""
    return F.to_json(F.try_parse_json(col(value)))


def json_path(doc: Column | str, path: str, as_type: str) -> Column:
    return F.try_variant_get(F.try_parse_json(col(doc)), path, as_type)


def json_kind(doc: Column | str, path: str) -> Column:
    """Type name of the value at `path` ('STRING', 'BIGINT', 'BOOLEAN', 'VOID', ...)."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(col(doc)), path, "variant"))


def json_string(doc: Column | str, path: str) -> Column:
    """The value at `path` only if it is a JSON string."""
    return F.when(json_kind(doc, path) == "STRING", json_path(doc, path, "string"))


def json_number(doc: Column | str, path: str) -> Column:
    """The value at `path` only if it is a JSON number (true and "1" are not)."""
    kind = json_kind(doc, path)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
                  json_path(doc, path, "double"))


def is_finite(value: Column | str) -> Column:
    v = col(value)
    return F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))


def valid_coordinates(latitude: Column, longitude: Column) -> Column:
    return F.coalesce(
        is_finite(latitude) & is_finite(longitude)
        & latitude.between(-90, 90) & longitude.between(-180, 180),
        F.lit(False),
    )


def fingerprint(**fields: Column) -> Column:
    """SHA-256 over a compact JSON object whose keys are in sorted order; nulls count."""
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def is_sha256(value: Column | str) -> Column:
    return F.coalesce(col(value).rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit(False))


def fact_size(raw_size: Column | str) -> Column:
    """Byte count of a JSON scalar: a non-negative integer or its decimal text, else null."""
    variant = F.try_parse_json(col(raw_size))
    kind = F.schema_of_variant(variant)
    text = F.try_variant_get(variant, "$", "string")
    return F.when(
        (kind == "BIGINT") | ((kind == "STRING") & text.rlike(r"\A[0-9]+\z")),
        F.when(~text.startswith("-"), text.try_cast("bigint")),
    )


def base64url(value: Column | str) -> Column:
    """Decode URL-safe base64 with or without padding; malformed text gives null."""
    text = F.translate(F.rtrim(col(value)), "-_=", "+/")
    padded = F.rpad(text, F.ceil(F.length(text) / F.lit(4)).cast("int") * 4, "=")
    return F.try_to_binary(padded, F.lit("base64"))
