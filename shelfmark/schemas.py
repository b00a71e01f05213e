"""Schemas of the world-model tables and the two small registries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _ddl(text: str) -> T.StructType:
    """Read 'name TYPE, ...' without a session, so schemas exist at import time."""
    pairs = [column.split() for column in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RESOURCES = _ddl(
    "id STRING, resource_type STRING, title STRING, metadata STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
BLOBS = _ddl("id STRING, asset_id STRING, hash STRING, size BIGINT, mime_type STRING")
SOURCES = _ddl(
    "id STRING, blob_id STRING, provider STRING, external_id STRING, path STRING, name STRING, "
    "version_tag STRING, metadata STRING, is_active BOOLEAN, deleted_at TIMESTAMP"
)
STATEMENTS = _ddl(
    "id STRING, subject_asset_id STRING, predicate STRING, value_type STRING, "
    "string_value STRING, integer_value BIGINT, float_value DOUBLE, boolean_value BOOLEAN, "
    "datetime_value TIMESTAMP, resource_value_asset_id STRING, "
    "generator_type STRING, generator_name STRING, generator_version STRING, "
    "source_kind STRING, source_locator STRING, confidence DOUBLE, "
    "created_at TIMESTAMP, is_current BOOLEAN"
)
ENRICHMENT_STATES = _ddl(
    "subject_asset_id STRING, extractor_type STRING, extractor_name STRING, "
    "extractor_version STRING, input_fingerprint STRING, status STRING, "
    "started_at TIMESTAMP, completed_at TIMESTAMP, updated_at TIMESTAMP, "
    "error_code STRING, error_message STRING"
)
RUNS = _ddl(
    "id STRING, pipeline_key STRING, kind STRING, status STRING, started_at TIMESTAMP, "
    "finished_at TIMESTAMP, error_code STRING"
)
PERSONS = _ddl("id STRING, created_at TIMESTAMP")
PERSON_SOURCES = _ddl(
    "provider STRING, external_id STRING, person_id STRING, inactive_at TIMESTAMP"
)
RESOURCE_PERSON = _ddl(
    "resource_id STRING, person_id STRING, provider STRING, inactive_at TIMESTAMP"
)
FACTS = _ddl(
    "ordinal BIGINT, provider STRING, kind STRING, external_id STRING, name STRING, path STRING, "
    "size BIGINT, mime_type STRING, modified_at STRING, version_tag STRING, content_hash STRING, "
    "raw STRING, observed_at TIMESTAMP"
)
DECISIONS = _ddl(
    "ordinal BIGINT, provider STRING, external_id STRING, kind STRING, reason STRING, "
    "confidence DOUBLE, action STRING, source_id STRING, blob_id STRING, resource_id STRING, "
    "hash STRING, hash_computed BOOLEAN, name STRING, path STRING, version_tag STRING, "
    "raw STRING, size BIGINT, mime_type STRING, observed_at TIMESTAMP"
)
CONVERSATIONS = _ddl(
    "id STRING, title STRING, created_at TIMESTAMP, updated_at TIMESTAMP, archived_at TIMESTAMP"
)
# A body longer than one part is several rows with the same id.
MESSAGES = _ddl(
    "id STRING, conversation_id STRING, role STRING, part BIGINT, body STRING, "
    "created_at TIMESTAMP"
)
TURNS = _ddl(
    "id STRING, conversation_id STRING, user_message_id STRING, assistant_message_id STRING, "
    "status STRING, started_at TIMESTAMP, completed_at TIMESTAMP, error_code STRING"
)
MESSAGE_REFS = _ddl("message_id STRING, resource_ref STRING, ordinal INT")
TURN_EVENTS = _ddl(
    "turn_id STRING, arrival BIGINT, sequence BIGINT, type STRING, phase STRING, delta STRING, "
    "error_code STRING, resource_refs ARRAY<STRING>, operation_id INT, category STRING, "
    "capability STRING, duration_ms BIGINT"
)

TABLES = {
    "resources": RESOURCES,
    "blobs": BLOBS,
    "sources": SOURCES,
    "statements": STATEMENTS,
    "enrichment_states": ENRICHMENT_STATES,
    "runs": RUNS,
    "persons": PERSONS,
    "person_sources": PERSON_SOURCES,
    "resource_person": RESOURCE_PERSON,
    "conversations": CONVERSATIONS,
    "messages": MESSAGES,
    "turns": TURNS,
    "message_refs": MESSAGE_REFS,
    "turn_events": TURN_EVENTS,
    "facts": FACTS,
    "decisions": DECISIONS,
}


def empty(spark: SparkSession, schema) -> DataFrame:
    """No rows of a schema. The limit tells the optimizer so, and joins with it cost nothing."""
    return spark.createDataFrame([], schema).limit(0)


class Catalog(NamedTuple):
    """The three tables every read query joins."""

    resources: DataFrame
    blobs: DataFrame
    sources: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> "Catalog":
        return Catalog(
            empty(spark, RESOURCES),
            empty(spark, BLOBS),
            empty(spark, SOURCES),
        )


# Names that stored rows carry.
RESOURCE_TYPES = ("file", "message")
FACT_KINDS = ("file", "folder", "message")
VALUE_COLUMNS = {
    "string": "string_value",
    "integer": "integer_value",
    "float": "float_value",
    "boolean": "boolean_value",
    "datetime": "datetime_value",
    "resource_ref": "resource_value_asset_id",
}
SOURCE_KINDS = ("provider_metadata", "resource_content")
ENRICHMENT_STATUSES = ("running", "completed", "failed")
RUN_STATUSES = ("running", "completed", "failed")
RUN_ERROR_CODES = ("execution_failed", "interrupted_previous_run")
TURN_STATUSES = ("running", "completed", "failed", "cancelled", "interrupted")
MESSAGE_ROLES = ("user", "assistant")
RUN_KINDS = ("provider_sync", "enrichment")

# Predicate name -> value type. All are single-valued.
PREDICATES = {
    "media.captured_at": "datetime",
    "media.latitude": "float",
    "media.longitude": "float",
    "media.camera_make": "string",
    "media.camera_model": "string",
    "media.ocr_text": "string",
    "document.text_excerpt": "string",
    "file.modified_at": "datetime",
    "geo.country": "string",
    "geo.admin1": "string",
    "geo.locality": "string",
    "gmail.subject": "string",
    "gmail.from": "string",
    "gmail.to": "string",
    "gmail.internal_date": "datetime",
}


def predicate_table(spark: SparkSession, extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(predicate, value_type, cardinality); `extra` adds predicates of custom extractors."""
    rows = [(name, value_type, "single") for name, value_type in PREDICATES.items()]
    rows += [(name, vt, card) for name, (vt, card) in (extra or {}).items()]
    return spark.createDataFrame(rows, "predicate STRING, value_type STRING, cardinality STRING")


@dataclass(frozen=True)
class Generator:
    """Who made a statement."""

    type: str
    name: str
    version: str


# Scheduled jobs whose freshness is reported, (key, kind, dependencies).
JOBS = (
    ("provider.nextcloud.sync", "provider_sync", ()),
    ("provider.immich.sync", "provider_sync", ()),
    ("provider.gmail.sync", "provider_sync", ()),
    ("enrichment.nextcloud_text", "enrichment", ("provider.nextcloud.sync",)),
    ("enrichment.nextcloud_documents", "enrichment", ("provider.nextcloud.sync",)),
    ("enrichment.file_metadata", "enrichment",
     ("provider.nextcloud.sync", "provider.immich.sync")),
    ("enrichment.immich_geo", "enrichment", ("provider.immich.sync",)),
    ("enrichment.immich_metadata", "enrichment", ("provider.immich.sync",)),
    ("enrichment.immich_ocr", "enrichment", ("provider.immich.sync",)),
    ("enrichment.gmail_metadata", "enrichment", ("provider.gmail.sync",)),
)


def job_table(spark: SparkSession, jobs=JOBS) -> DataFrame:
    return spark.createDataFrame(
        [(i, key, kind, list(deps)) for i, (key, kind, deps) in enumerate(jobs)],
        "position INT, pipeline_key STRING, kind STRING, dependencies ARRAY<STRING>",
    )
