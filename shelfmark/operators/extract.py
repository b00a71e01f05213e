"""Extractors: from a resource's active sources to drafts of typed statements.

An extractor offers `generator`, `covered` predicates, `inputs(catalog)` and `drafts(inputs)`.
`inputs` has one row per eligible resource: resource_id, fingerprint, error_code, error_message
and whatever its drafts need. A null fingerprint means the input itself could not be read.
Fingerprints come from stored hashes and metadata. An extractor that needs content has `load(work)`
too: it reads the content of the given inputs only, once they are known to be worked on.

All sources of one resource are folded with aggregates that combine before the shuffle, so a
resource with very many copies never becomes one array. Content is reduced to the few bytes a
statement keeps where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators.content import ContentSource, matching, only
from shelfmark.operators.ordered import running_sum
from shelfmark.schemas import Catalog, Generator

# Bounds and markers of stored texts.
MAX_TEXT_SOURCE_BYTES = 1_048_576
MAX_DECODED_CHARACTERS = 1_048_576
MAX_STORED_TEXT_BYTES = 16_384
MAX_OCR_TEXT_BYTES = 8_192
MAX_MESSAGE_BYTES = 33_554_432
TRUNCATION_MARKER = "\n[…truncated]"
TEXT_FAULT = "Text content could not be used"
MESSAGE_FAULT = "Message content could not be used"
TEXT_MIME_TYPES = ("text/plain", "text/markdown", "application/markdown")
TEXT_EXTENSIONS = (".md", ".markdown")
# Generators of which one resource may have only one current excerpt.
DOCUMENT_FAMILY = ("nextcloud_text", "nextcloud_pdf", "nextcloud_odt", "nextcloud_docx")

DRAFT_VALUES = ["string_value", "integer_value", "float_value", "boolean_value",
                "datetime_value", "resource_value_asset_id"]
_CAST = dict(zip(DRAFT_VALUES, ["string", "bigint", "double", "boolean", "timestamp", "string"]))
_TYPE_COLUMN = {"string": "string_value", "integer": "integer_value", "float": "float_value",
                "boolean": "boolean_value", "datetime": "datetime_value",
                "resource_ref": "resource_value_asset_id"}


def draft(predicate: str, value_type: str, value: Column, kind: str, locator: Column | str,
          confidence: Column | None = None) -> Column:
    """One draft as a struct; drafts whose value is null are dropped by `unpivot`."""
    mine = _TYPE_COLUMN[value_type]
    values = [(value if c == mine else F.lit(None)).cast(_CAST[c]).alias(c) for c in DRAFT_VALUES]
    place = F.lit(locator) if isinstance(locator, str) else locator
    trust = confidence if confidence is not None else F.lit(None)
    return F.struct(
        F.lit(predicate).alias("predicate"), F.lit(value_type).alias("value_type"), *values,
        F.lit(kind).alias("source_kind"), place.alias("source_locator"),
        trust.cast("double").alias("confidence"))


def unpivot(inputs: DataFrame, *drafts: Column) -> DataFrame:
    rows = inputs.select("resource_id", F.inline(F.array(*drafts)))
    return rows.filter(F.coalesce(*[F.col(c).cast("string") for c in DRAFT_VALUES]).isNotNull())


def discover(catalog: Catalog, providers: tuple[str, ...] | None, resource_type: str = "file"
             ) -> DataFrame:
    """Active sources of the providers (null: any), one row per source with its content facts."""
    sources = catalog.sources.filter("is_active")
    if providers is not None:
        sources = sources.filter(F.col("provider").isin(*providers))
    blobs = catalog.blobs.select(F.col("id").alias("blob_id"), F.col("asset_id").alias("resource_id"),
                                 "hash", "size", "mime_type")
    typed = catalog.resources.filter(F.col("resource_type") == resource_type).select(
        F.col("id").alias("resource_id"))
    return (
        sources.select("blob_id", F.col("id").alias("source_id"), "provider",
                       F.col("external_id").alias("locator"), "metadata", "path", "name")
        .join(blobs, "blob_id").join(typed, "resource_id", "left_semi").drop("blob_id")
    )


def set_digest(*cols: Column | str) -> Column:
    """Digest of a group's set of rows, independent of their order, as a combinable aggregate."""
    h = F.xxhash64(*cols)
    return F.sha2(F.concat_ws(
        ":", F.count(F.lit(1)).cast("string"), F.bit_xor(h).cast("string"),
        F.sum(h.cast("decimal(20,0)")).cast("string"), F.min(h).cast("string"),
        F.max(h).cast("string")), 256)


def single_source(sources: DataFrame, keep: list[str], ambiguous: str) -> DataFrame:
    """One row per resource with its only source; more than one is the error `ambiguous`."""
    folded = sources.groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("source_id", *keep), "source_id").alias("s"),
        set_digest("source_id").alias("source_set"))
    several = F.col("n") > 1
    return folded.select(
        "resource_id", "n", "source_set", "s.*",
        F.when(several, ambiguous).alias("error_code"),
        F.when(several, "Several active sources are ambiguous").alias("error_message"))


def same_content(sources: DataFrame, keep: list[str], ambiguous: str) -> DataFrame:
    """One row per resource whose sources all hold one content: the lowest source id."""
    digest = F.lower("hash")
    folded = sources.groupBy("resource_id").agg(
        F.min(digest).alias("low"), F.max(digest).alias("high"),
        F.bool_and(fn.is_sha256("hash")).alias("digests_ok"),
        F.min_by(F.struct("source_id", "hash", *keep), "source_id").alias("s"))
    code = (F.when(~F.col("digests_ok"), "invalid_blob_digest")
            .when(F.col("low") != F.col("high"), ambiguous))
    return folded.select("resource_id", "s.*", code.alias("error_code")).withColumn(
        "error_message", F.when(F.col("error_code").isNotNull(), "No single valid content"))


def load(extractor, work: DataFrame) -> DataFrame:
    """The given inputs with the content that their drafts need."""
    read = getattr(extractor, "load", None)
    return work if read is None else read(work)


def usable(extractor, catalog: Catalog) -> DataFrame:
    """All inputs without an error, loaded: what `drafts` takes outside of an enrichment run."""
    found = load(extractor, extractor.inputs(catalog).filter("error_code IS NULL"))
    return found.filter("error_code IS NULL")


def _place(work: DataFrame) -> DataFrame:
    return work.select("provider", F.col("locator").alias("external_id"))


def _generator_text(g: Generator) -> Column:
    return F.lit(f"{g.type}/{g.name}/{g.version}")


@dataclass
class PhotoMetadata:
    provider: str = "immich"
    generator: Generator = Generator("deterministic_extractor", "immich_metadata", "1")
    covered: tuple[str, ...] = ("media.captured_at", "media.latitude", "media.longitude",
                                "media.camera_make", "media.camera_model")
    family: tuple[str, ...] = ()

    def inputs(self, catalog: Catalog) -> DataFrame:
        rows = single_source(discover(catalog, (self.provider,)), ["metadata"],
                             "ambiguous_active_immich_sources")
        fields = ("dateTimeOriginal", "latitude", "longitude", "make", "model")
        exif = F.to_json(F.struct(*[
            fn.json_path("metadata", f"$.exif.{f}", "variant").alias(f) for f in fields]))
        return rows.withColumn("fingerprint", F.when(
            F.col("n") == 1, fn.fingerprint(source_id=F.col("source_id"), exif=exif))
            .otherwise(fn.fingerprint(ambiguous=F.col("source_set"))))

    def drafts(self, inputs: DataFrame) -> DataFrame:
        at = "asset_source.metadata.exif."
        captured = fn.iso_instant(fn.json_string("metadata", "$.exif.dateTimeOriginal"))
        rows = (inputs
                .withColumn("lat", fn.json_number("metadata", "$.exif.latitude"))
                .withColumn("lon", fn.json_number("metadata", "$.exif.longitude")))
        pair = fn.valid_coordinates(F.col("lat"), F.col("lon"))

        def label(field: str) -> Column:
            text = fn.json_string("metadata", f"$.exif.{field}")
            return F.when(fn.strip(text) != "", text)

        kind = "provider_metadata"
        return unpivot(
            rows,
            draft("media.captured_at", "datetime", captured, kind, at + "dateTimeOriginal"),
            draft("media.latitude", "float", F.when(pair, F.col("lat")), kind, at + "latitude"),
            draft("media.longitude", "float", F.when(pair, F.col("lon")), kind, at + "longitude"),
            draft("media.camera_make", "string", label("make"), kind, at + "make"),
            draft("media.camera_model", "string", label("model"), kind, at + "model"))


@dataclass
class PhotoGeo:
    provider: str = "immich"
    generator: Generator = Generator("deterministic_extractor", "immich_geo", "1")
    covered: tuple[str, ...] = ("geo.country", "geo.admin1", "geo.locality")
    family: tuple[str, ...] = ()
    # Predicate -> metadata field.
    FIELDS = (("geo.country", "country"), ("geo.admin1", "state"), ("geo.locality", "city"))

    def inputs(self, catalog: Catalog) -> DataFrame:
        rows = single_source(discover(catalog, (self.provider,)), ["metadata"],
                             "ambiguous_active_immich_sources")
        paths = ("latitude", "longitude", "country", "state", "city")
        geo = F.to_json(F.struct(*[
            fn.json_path("metadata", f"$.exif.{f}", "variant").alias(f) for f in paths]))
        broken = F.lit(False)
        for _, name in self.FIELDS:
            kind = F.coalesce(fn.json_kind("metadata", f"$.exif.{name}"), F.lit("VOID"))
            broken = broken | ~kind.isin("STRING", "VOID")
        only = F.col("n") == 1
        return (
            rows.withColumn("fingerprint", F.when(only, fn.fingerprint(
                generator=_generator_text(self.generator), source_id=F.col("source_id"), geo=geo))
                .otherwise(fn.fingerprint(generator=_generator_text(self.generator),
                                          ambiguous=F.col("source_set"))))
            .withColumn("error_code", F.coalesce("error_code", F.when(
                broken, "invalid_immich_geo_metadata")))
            .withColumn("error_message", F.coalesce("error_message", F.when(
                broken, "A geo label must be a string or null")))
        )

    def drafts(self, inputs: DataFrame) -> DataFrame:
        pair = fn.valid_coordinates(fn.json_number("metadata", "$.exif.latitude"),
                                    fn.json_number("metadata", "$.exif.longitude"))
        made = []
        for predicate, name in self.FIELDS:
            text = fn.json_string("metadata", f"$.exif.{name}")
            made.append(draft(predicate, "string", F.when(pair & (fn.strip(text) != ""), text),
                              "provider_metadata", f"immich.asset.exifInfo.{name}"))
        return unpivot(inputs, *made)


@dataclass
class FileModified:
    """One modification time per resource, only if all its supported sources agree on it.

    `http_providers` are names, or a DataFrame (provider) of any length.
    """

    http_providers: tuple[str, ...] | DataFrame = ("nextcloud",)
    iso_providers: tuple[str, ...] = ("immich",)
    generator: Generator = Generator("deterministic_extractor", "file_metadata", "1")
    covered: tuple[str, ...] = ("file.modified_at",)
    family: tuple[str, ...] = ()

    def inputs(self, catalog: Catalog) -> DataFrame:
        if isinstance(self.http_providers, DataFrame):
            http = self.http_providers.select("provider").distinct().withColumn(
                "_http", F.lit(True))
            rows = discover(catalog, None).join(http, "provider", "left").filter(
                F.col("_http") | F.col("provider").isin(*self.iso_providers))
        else:
            rows = discover(catalog, (*self.http_providers, *self.iso_providers))
        is_http = ~F.col("provider").isin(*self.iso_providers)
        raw = F.when(is_http, fn.json_path("metadata", "$.getlastmodified", "string")).otherwise(
            fn.json_path("metadata", "$.fileModifiedAt", "string"))
        text = F.when(is_http, fn.json_string("metadata", "$.getlastmodified")).otherwise(
            fn.json_string("metadata", "$.fileModifiedAt"))
        value = F.when(is_http, fn.http_instant(text)).otherwise(fn.iso_instant(text))
        rows = rows.select("resource_id", "provider", "source_id", raw.alias("raw"),
                           value.alias("value"), is_http.alias("is_http"))
        state = (F.when(F.coalesce("raw", F.lit("")) == "", "missing")
                 .when(F.col("value").isNull(), "invalid").otherwise("valid"))
        folded = rows.groupBy("resource_id").agg(
            F.bool_and(state == "valid").alias("all_valid"), F.min("value").alias("low"),
            F.max("value").alias("high"), F.bool_and("is_http").alias("all_http"),
            F.bool_or("is_http").alias("any_http"),
            set_digest("provider", "source_id", F.coalesce("raw", F.lit("\x00")), state)
            .alias("input_set"))
        return folded.select(
            "resource_id", "all_valid", "low", "high", "all_http", "any_http",
            fn.fingerprint(generator=_generator_text(self.generator),
                           sources=F.col("input_set")).alias("fingerprint"),
            F.lit(None).cast("string").alias("error_code"),
            F.lit(None).cast("string").alias("error_message"))

    def drafts(self, inputs: DataFrame) -> DataFrame:
        agreed = F.col("all_valid") & (F.col("low") == F.col("high"))
        locator = (F.when(F.col("all_http"), "nextcloud.webdav.getlastmodified")
                   .when(~F.col("any_http"), "immich.asset.fileModifiedAt")
                   .otherwise("file_metadata.active_supported_sources_consensus"))
        return unpivot(inputs, draft("file.modified_at", "datetime",
                                     F.when(agreed, F.col("low")), "provider_metadata", locator))


def ocr_regions(payloads: DataFrame) -> DataFrame:
    """(locator, regions, ocr_error) from landed responses (locator, status, body)."""
    status = F.col("status")
    body = F.from_json("body", "array<struct<text string>>")
    kinds = F.try_parse_json("body")
    # Every element must be an object whose text is a string.
    well_formed = F.coalesce(
        F.schema_of_variant(kinds).startswith("ARRAY<")
        & F.forall(F.coalesce(F.try_variant_get(kinds, "$", "array<variant>"), F.array()),
                   lambda v: F.coalesce(F.schema_of_variant(
                       F.try_variant_get(v, "$.text", "variant")) == "STRING", F.lit(False))),
        F.lit(False))
    error = (F.when(status.isin(400, 401, 403, 404), "provider_not_found")
             .when((status == 429) | (status >= 500), "provider_unavailable")
             .when(~status.between(200, 299) | ~well_formed, "provider_invalid_response"))
    texts = F.filter(F.transform(body, lambda r: fn.normalise_region(r["text"])),
                     lambda t: t != "")
    return payloads.select("locator", error.alias("ocr_error"),
                           F.when(error.isNull(), texts).alias("regions"))


@dataclass
class PhotoOcr:
    payloads: DataFrame = field(repr=False)
    provider: str = "immich"
    marker: str = TRUNCATION_MARKER
    generator: Generator = Generator("provider_native_ml", "immich_ocr", "1")
    covered: tuple[str, ...] = ("media.ocr_text",)
    family: tuple[str, ...] = ()

    def inputs(self, catalog: Catalog) -> DataFrame:
        rows = single_source(discover(catalog, (self.provider,)), ["locator"],
                             "ambiguous_active_immich_source")
        rows = rows.join(ocr_regions(self.payloads), "locator", "left")
        code = F.coalesce("error_code", "ocr_error",
                          F.when(F.col("locator").isNull(), "provider_not_found"),
                          F.when(F.col("regions").isNull(), "provider_unavailable"))
        text = fn.strip(F.array_join("regions", "\n"))
        return rows.select(
            "resource_id", code.alias("error_code"),
            F.when(code.isNotNull(), "OCR result could not be read").alias("error_message"),
            F.when(code.isNull(), fn.fingerprint(
                format=F.lit("ocr.input.v1"), locator=F.col("locator"),
                provider=F.lit(self.provider), regions=F.col("regions"))).alias("fingerprint"),
            fn.truncate_utf8(text, MAX_OCR_TEXT_BYTES, self.marker, trim_tail=True).alias("text"))

    def drafts(self, inputs: DataFrame) -> DataFrame:
        text = F.nullif(F.col("text"), F.lit(""))
        return unpivot(inputs, draft("media.ocr_text", "string", text, "provider_metadata",
                                     "immich.api.asset_ocr"))


def read_text(content: DataFrame, marker: str = TRUNCATION_MARKER) -> DataFrame:
    """Reduce (provider, external_id, content) to (provider, external_id, digest, bytes,
    text_error, excerpt): decoding, control characters, newlines, stored size, at the scan."""
    raw = F.col("content")
    bom = F.substring(raw, 1, 3) == F.unhex(F.lit("EFBBBF"))
    plain = F.when(bom, F.substr(raw, F.lit(4))).otherwise(raw)
    text = plain.cast("string")
    error = (
        F.when(F.octet_length(raw) > MAX_TEXT_SOURCE_BYTES, "source_too_large")
        .when(~F.is_valid_utf8(text), "invalid_text_encoding")
        .when(F.char_length(text) > MAX_DECODED_CHARACTERS, "decoded_text_too_large")
        .when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "binary_content")
    )
    excerpt = fn.truncate_utf8(fn.newlines(text), MAX_STORED_TEXT_BYTES, marker)
    return content.select(
        "provider", "external_id", F.sha2(raw, 256).alias("digest"),
        F.octet_length(raw).alias("bytes"), error.alias("text_error"),
        F.when(error.isNull(), excerpt).alias("excerpt"))


def is_text_source() -> Column:
    ext = fn.extension(F.coalesce(F.nullif(F.col("name"), F.lit("")), "path", F.lit("")))
    return fn.mime_base("mime_type").isin(*TEXT_MIME_TYPES) | ext.isin(*TEXT_EXTENSIONS)


@dataclass
class TextExcerpt:
    content: DataFrame | ContentSource = field(repr=False)
    providers: tuple[str, ...] | None = ("nextcloud",)
    marker: str = TRUNCATION_MARKER
    generator: Generator = Generator("deterministic_extractor", "nextcloud_text", "1")
    covered: tuple[str, ...] = ("document.text_excerpt",)
    family: tuple[str, ...] = ()

    def inputs(self, catalog: Catalog) -> DataFrame:
        sources = discover(catalog, self.providers).filter(is_text_source())
        rows = same_content(sources, ["provider", "locator", "size", "mime_type"],
                            "ambiguous_active_nextcloud_content")
        size = F.col("size")
        wrong = (F.when(size < 0, "invalid_source_size")
                 .when(size > MAX_TEXT_SOURCE_BYTES, "source_too_large"))
        return rows.select(
            "resource_id", "provider", "locator", "hash",
            F.when(F.col("error_code").isNull(), fn.fingerprint(
                format=F.lit("text.input.v1"), blob_sha256=F.lower("hash"),
                mime_type=fn.mime_base("mime_type"), extractor_version=F.lit("1")))
            .alias("fingerprint"),
            F.coalesce("error_code", wrong).alias("error_code"),
            F.coalesce("error_message", F.when(wrong.isNotNull(), TEXT_FAULT))
            .alias("error_message"))

    def load(self, work: DataFrame) -> DataFrame:
        texts = only(self.content, _place(work), lambda c: read_text(c, self.marker))
        rows = work.join(texts.withColumnRenamed("external_id", "locator"),
                         ["provider", "locator"], "left")
        code = F.coalesce("error_code", (
            F.when(F.col("digest").isNull(), "provider_read_failed")
            .when(F.col("bytes") > MAX_TEXT_SOURCE_BYTES, "source_too_large")
            .when(F.col("digest") != F.lower("hash"), "content_changed_since_sync")
            .otherwise(F.col("text_error"))))
        return rows.select(
            "resource_id", "fingerprint", code.alias("error_code"),
            F.coalesce("error_message", F.when(code.isNotNull(), TEXT_FAULT))
            .alias("error_message"), F.when(code.isNull(), F.col("excerpt")).alias("excerpt"))

    def drafts(self, inputs: DataFrame) -> DataFrame:
        return unpivot(inputs, draft(
            "document.text_excerpt", "string", F.nullif(F.col("excerpt"), F.lit("")),
            "resource_content", "nextcloud.webdav.content"))


def join_units(units: DataFrame, keys: list[str], separator: str,
               ceiling: int = MAX_DECODED_CHARACTERS) -> DataFrame:
    """(*keys, text): ordered text units (unit_no, text) joined up to `ceiling` characters.

    Units that start beyond the ceiling are dropped before a document is put together, so what
    one document collects is bounded by the ceiling whatever its length.
    """
    rows = units.withColumn("text", fn.newlines(F.regexp_replace(
        F.coalesce("text", F.lit("")), "\f", "\n")))
    rows = running_sum(rows, keys, "unit_no",
                       F.char_length("text") + F.lit(len(separator)), "_end")
    starts = F.col("_end") - F.char_length("text") - F.lit(len(separator))
    kept = rows.filter(starts < ceiling).select(
        *keys, F.struct("unit_no", F.left("text", F.lit(ceiling)).alias("text")).alias("u"))
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("u")).alias("units")).select(
        *keys, F.left(F.array_join(F.transform("units", lambda u: u["text"]), separator),
                      F.lit(ceiling)).alias("text"))


@dataclass
class DocumentExcerpt:
    """Excerpt of a document whose container was already decoded to text units
    (provider, external_id, unit_no, text)."""

    units: DataFrame = field(repr=False)
    mime_types: tuple[str, ...] = ("application/pdf",)
    extensions: tuple[str, ...] = (".pdf",)
    separator: str = "\n\n"
    providers: tuple[str, ...] | None = ("nextcloud",)
    marker: str = TRUNCATION_MARKER
    generator: Generator = Generator("deterministic_extractor", "nextcloud_pdf", "1")
    covered: tuple[str, ...] = ("document.text_excerpt",)
    family: tuple[str, ...] = DOCUMENT_FAMILY

    def inputs(self, catalog: Catalog) -> DataFrame:
        ext = fn.extension(F.coalesce(F.nullif(F.col("name"), F.lit("")), "path", F.lit("")))
        sources = discover(catalog, self.providers).filter(
            fn.mime_base("mime_type").isin(*self.mime_types) | ext.isin(*self.extensions))
        rows = same_content(sources, ["provider", "locator", "mime_type"],
                            "ambiguous_active_nextcloud_content")
        return rows.select(
            "resource_id", "error_code", "error_message", "provider", "locator",
            F.when(F.col("error_code").isNull(), fn.fingerprint(
                format=F.lit("document.input.v1"), blob_sha256=F.lower("hash"),
                mime_type=fn.mime_base("mime_type"),
                generator=_generator_text(self.generator))).alias("fingerprint"))

    def load(self, work: DataFrame) -> DataFrame:
        units = matching(self.units, _place(work))
        texts = join_units(units, ["provider", "external_id"], self.separator)
        texts = texts.select("provider", F.col("external_id").alias("locator"), F.when(
            fn.strip("text") != "", fn.truncate_utf8(
                F.col("text"), MAX_STORED_TEXT_BYTES, self.marker)).alias("excerpt"))
        return work.join(texts, ["provider", "locator"], "left").select(
            "resource_id", "fingerprint", "error_code", "error_message", "excerpt")

    def drafts(self, inputs: DataFrame) -> DataFrame:
        return unpivot(inputs, draft("document.text_excerpt", "string", F.col("excerpt"),
                                     "resource_content", "nextcloud.webdav.content"))


def header_block(text: Column) -> Column:
    """Everything before the first blank line, unfolded."""
    ends = [F.when(F.instr(text, mark) > 0, F.instr(text, mark)) for mark in ("\r\n\r\n", "\n\n")]
    end = F.least(*ends)
    head = F.coalesce(F.left(text, end - 1), text)
    return F.regexp_replace(head, r"\r?\n[ \t]+", " ")


def header_values(block: Column, name: str) -> Column:
    found = F.regexp_extract_all(block, F.lit(rf"(?im)^{name}:([^\r\n]*)"), 1)
    found = F.filter(F.transform(found, lambda v: fn.strip(v)), lambda v: v != "")
    return F.nullif(F.array_join(found, ", "), F.lit(""))


# Predicate, header and evidence locator.
MESSAGE_HEADERS = (
    ("gmail.subject", "subject", "gmail.raw.headers.subject"),
    ("gmail.from", "from", "gmail.raw.headers.from"),
    ("gmail.to", "to", "gmail.raw.headers.to"),
)


def read_headers(content: DataFrame) -> DataFrame:
    """Reduce raw messages to their digest and header values where they are read."""
    block = header_block(F.col("content").cast("string"))
    return content.select(
        "provider", "external_id", F.sha2("content", 256).alias("digest"),
        F.octet_length("content").alias("bytes"), block.alias("block")).select(
        "provider", "external_id", "digest", "bytes",
        *[header_values(F.col("block"), name).alias(name) for _, name, _ in MESSAGE_HEADERS])


@dataclass
class MessageHeaders:
    content: DataFrame | ContentSource = field(repr=False)
    provider: str = "gmail"
    generator: Generator = Generator("deterministic_extractor", "gmail_metadata", "1")
    covered: tuple[str, ...] = ("gmail.subject", "gmail.from", "gmail.to", "gmail.internal_date")
    family: tuple[str, ...] = ()

    def inputs(self, catalog: Catalog) -> DataFrame:
        rows = single_source(
            discover(catalog, (self.provider,), "message"),
            ["provider", "locator", "metadata", "hash"], "ambiguous_active_gmail_sources")
        code = F.coalesce("error_code", F.when(~fn.is_sha256("hash"), "invalid_blob_digest"))
        date = fn.json_string("metadata", "$.internalDate")
        return rows.select(
            "resource_id", "provider", "locator", "hash", code.alias("error_code"),
            F.coalesce("error_message", F.when(code.isNotNull(), MESSAGE_FAULT))
            .alias("error_message"),
            F.when(code.isNull(), fn.fingerprint(
                format=F.lit("message.input.v1"), blob_sha256=F.lower("hash"),
                internalDate=date, extractor_version=F.lit("1"))).alias("fingerprint"),
            fn.epoch_millis(date).alias("received"))

    def load(self, work: DataFrame) -> DataFrame:
        found = only(self.content, _place(work), read_headers)
        rows = work.join(found.withColumnRenamed("external_id", "locator"),
                         ["provider", "locator"], "left")
        code = F.coalesce(
            "error_code", F.when(F.col("digest").isNull(), "provider_read_failed")
            .when(F.col("bytes") > MAX_MESSAGE_BYTES, "source_too_large")
            .when(F.col("digest") != F.lower("hash"), "content_changed_since_sync"))
        return rows.select(
            "resource_id", "fingerprint", code.alias("error_code"),
            F.coalesce("error_message", F.when(code.isNotNull(), MESSAGE_FAULT))
            .alias("error_message"), *[name for _, name, _ in MESSAGE_HEADERS], "received")

    def drafts(self, inputs: DataFrame) -> DataFrame:
        made = [draft(predicate, "string", F.col(name), "resource_content", locator)
                for predicate, name, locator in MESSAGE_HEADERS]
        made.append(draft("gmail.internal_date", "datetime", F.col("received"),
                          "provider_metadata", "asset_source.metadata.internalDate"))
        return unpivot(inputs, *made)


#: What a table function of an extractor yields: one draft a row.
UDTF_DRAFT = ("predicate STRING, value_type STRING, string_value STRING, integer_value BIGINT, "
              "float_value DOUBLE, boolean_value BOOLEAN, source_locator STRING, "
              "confidence DOUBLE")


@dataclass
class TableFunctionExtractor:
    """An extractor whose drafts come from a Python table function over a resource's text.

    `function` is a registered or plain UDTF that takes (text) and yields UDTF_DRAFT rows. Texts are
    read, gated, claimed and checked as those of `texts`, an extractor with `inputs` and `load`
    that gives the column `excerpt`; the function sees one text at a time, batched by Arrow.
    """

    function: object = field(repr=False)
    texts: object = field(repr=False)
    generator: Generator
    covered: tuple[str, ...]
    family: tuple[str, ...] = ()

    def inputs(self, catalog: Catalog) -> DataFrame:
        own = F.sha2(F.concat(F.col("fingerprint"), F.lit("|"), _generator_text(self.generator)),
                     256)
        return self.texts.inputs(catalog).withColumn("fingerprint", own)

    def load(self, work: DataFrame) -> DataFrame:
        return load(self.texts, work)

    def drafts(self, inputs: DataFrame) -> DataFrame:
        rows = inputs.filter(F.col("excerpt").isNotNull()).select("resource_id", "excerpt")
        made = rows.lateralJoin(self.function(F.col("excerpt").outer()))
        given = [part.split()[0] for part in UDTF_DRAFT.split(", ")]
        columns = {c: F.col(c) if c in given else F.lit(None).cast(_CAST[c]) for c in DRAFT_VALUES}
        return made.select(
            "resource_id", "predicate", "value_type",
            *[column.alias(name) for name, column in columns.items()],
            F.lit("resource_content").alias("source_kind"), "source_locator", "confidence").filter(
            F.coalesce(*[F.col(c).cast("string") for c in DRAFT_VALUES]).isNotNull())
