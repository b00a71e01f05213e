"""Constraints of the world model as queries that return what violates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators.publish import GENERATOR
from shelfmark.schemas import (
    ENRICHMENT_STATUSES, MESSAGE_ROLES, RESOURCE_TYPES, RUN_ERROR_CODES, RUN_KINDS, RUN_STATUSES,
    SOURCE_KINDS, TABLES, TURN_STATUSES, VALUE_COLUMNS,
)

# Keys that must be unique, references that must resolve, required columns.
KEYS = {
    "resources": [["id"]],
    "blobs": [["id"], ["asset_id", "hash"]],
    "sources": [["id"], ["provider", "external_id"]],
    "statements": [["id"]],
    "enrichment_states": [["subject_asset_id", "extractor_type", "extractor_name",
                           "extractor_version"]],
    "runs": [["id"]],
    "persons": [["id"]],
    "person_sources": [["provider", "external_id"]],
    "resource_person": [["resource_id", "person_id", "provider"]],
    "conversations": [["id"]],
    "messages": [["id", "part"]],
    "turns": [["id"]],
    "message_refs": [["message_id", "resource_ref"], ["message_id", "ordinal"]],
}
# Tables of which a key may have one running row.
RUNNING = {"runs": "pipeline_key", "turns": "conversation_id"}
REFERENCES = (
    ("blobs", "asset_id", "resources", "id"),
    ("sources", "blob_id", "blobs", "id"),
    ("statements", "subject_asset_id", "resources", "id"),
    ("statements", "resource_value_asset_id", "resources", "id"),
    ("enrichment_states", "subject_asset_id", "resources", "id"),
    ("person_sources", "person_id", "persons", "id"),
    ("resource_person", "resource_id", "resources", "id"),
    ("resource_person", "person_id", "persons", "id"),
    ("messages", "conversation_id", "conversations", "id"),
    ("turns", "conversation_id", "conversations", "id"),
    ("turns", "user_message_id", "messages", "id"),
    ("turns", "assistant_message_id", "messages", "id"),
    ("message_refs", "message_id", "messages", "id"),
)
OPTIONAL = {
    "blobs": {"size", "mime_type"},
    "sources": {"path", "name", "version_tag", "deleted_at"},
    "statements": {*VALUE_COLUMNS.values(), "confidence"},
    "enrichment_states": {"completed_at", "error_code", "error_message"},
    "runs": {"finished_at", "error_code"},
    "person_sources": {"inactive_at"},
    "resource_person": {"inactive_at"},
    "conversations": {"archived_at"},
    "turns": {"assistant_message_id", "completed_at", "error_code"},
}


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return child.filter(F.col(column).isNotNull()).join(
        parent.select(F.col(key).alias(column)), column, "left_anti")


def _blank(name: str) -> Column:
    return F.coalesce(fn.strip(name), F.lit("")) == ""


def _outside(name: str, values) -> Column:
    return ~F.coalesce(F.col(name).isin(*values), F.lit(False))


def row_rules(table: str) -> dict[str, Column]:
    """Rule name -> condition that a violating row satisfies."""
    if table == "resources":
        return {"resource_type": _outside("resource_type", RESOURCE_TYPES)}
    if table == "statements":
        filled = sum((F.col(c).isNotNull().cast("int") for c in VALUE_COLUMNS.values()), F.lit(0))
        right = F.lit(False)
        for kind, column in VALUE_COLUMNS.items():
            right = right | ((F.col("value_type") == kind) & F.col(column).isNotNull())
        confidence = F.col("confidence")
        return {
            "exactly_one_value": filled != 1,
            "value_discriminator": ~F.coalesce(right, F.lit(False)),
            "confidence": confidence.isNotNull() & ~(
                fn.is_finite(confidence) & confidence.between(0, 1)),
            "not_blank": _blank("predicate") | _blank("source_locator") | _blank(GENERATOR[0])
            | _blank(GENERATOR[1]) | _blank(GENERATOR[2]),
            "source_kind": _outside("source_kind", SOURCE_KINDS),
        }
    if table == "enrichment_states":
        return {
            "status": _outside("status", ENRICHMENT_STATUSES),
            "not_blank": _blank("extractor_type") | _blank("extractor_name")
            | _blank("extractor_version") | _blank("input_fingerprint"),
        }
    if table == "runs":
        ended, code = F.col("finished_at").isNotNull(), F.col("error_code").isNotNull()
        status = F.col("status")
        coherent = (((status == "running") & ~ended & ~code)
                    | ((status == "completed") & ended & ~code)
                    | ((status == "failed") & ended & code))
        return {
            "not_blank": _blank("pipeline_key"),
            "kind": _outside("kind", RUN_KINDS), "status": _outside("status", RUN_STATUSES),
            "lifecycle": ~F.coalesce(coherent, F.lit(False)),
            "error_code": code & _outside("error_code", RUN_ERROR_CODES),
        }
    if table == "messages":
        return {"role": _outside("role", MESSAGE_ROLES)}
    if table == "turns":
        return {"status": _outside("status", TURN_STATUSES)}
    if table == "person_sources":
        return {"not_blank": _blank("provider") | _blank("external_id")}
    if table == "resource_person":
        return {"not_blank": _blank("provider")}
    return {}


def conformance(df: DataFrame, table: str) -> DataFrame:
    """(table_name, rule, violations) per column: required values missing, or text that does not
    read as the declared type. One pass over the table."""
    counts = []
    for column in TABLES[table].fields:
        if column.name not in df.columns:
            counts.append((f"missing:{column.name}", F.lit(1).cast("bigint")))
            continue
        value = F.col(column.name)
        if column.name not in OPTIONAL.get(table, set()):
            counts.append((f"required:{column.name}", F.count_if(value.isNull())))
        kind = column.dataType.simpleString()
        if df.schema[column.name].dataType.simpleString() != kind:
            counts.append((f"type:{column.name}", F.count_if(
                value.isNotNull() & value.try_cast(kind).isNull())))
    return _unpivot(df.agg(*[c.alias(f"c{i}") for i, (_, c) in enumerate(counts)]),
                    table, [name for name, _ in counts])


def _unpivot(one: DataFrame, table: str, names: list[str]) -> DataFrame:
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("rule"),
                 F.col(f"c{i}").alias("violations")) for i, name in enumerate(names)])))


def check_table(df: DataFrame, table: str) -> DataFrame:
    """Row rules, required columns and types in one pass; each key in one aggregate."""
    result = conformance(df, table)
    rules = row_rules(table)
    if rules:
        one = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(rules.values())])
        result = result.unionByName(_unpivot(one, table, [f"check:{n}" for n in rules]))
    for key in KEYS[table]:
        count = duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("violations"))
        result = result.unionByName(count.select(
            F.lit(table).alias("table_name"), F.lit("unique:" + ",".join(key)).alias("rule"),
            "violations"))
    return result


def running_twice(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one running row."""
    return duplicate_keys(df.filter(F.col("status") == "running"), [key])


def check_integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, violations) over the given tables; references are checked where both
    sides are given."""
    parts = [check_table(df, name) for name, df in tables.items()]
    for child, column, parent, key in REFERENCES:
        if child in tables and parent in tables:
            lost = orphans(tables[child], column, tables[parent], key)
            parts.append(lost.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(child).alias("table_name"), F.lit(f"reference:{column}").alias("rule"),
                "violations"))
    for name, key in RUNNING.items():
        if name in tables:
            parts.append(running_twice(tables[name], key).agg(
                F.count(F.lit(1)).alias("violations")).select(
                F.lit(name).alias("table_name"), F.lit(f"one_running:{key}").alias("rule"),
                "violations"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
