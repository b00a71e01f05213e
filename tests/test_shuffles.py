"""What a shuffle or a task must not carry, seen in the plans."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import extract as ex
from shelfmark.operators import publish as pub
from shelfmark.operators.content import KEY
from shelfmark.plans import (
    bind, workload_payloads, workload_reads, workload_sources, workload_state,
)
from shelfmark.schemas import FACTS, Catalog, predicate_table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_drafts_of_one_predicate_are_not_one_task(spark):
    """no exchange by predicate, and none that carries long values."""
    texts = bind.table(spark, SF, "documents").select(
        F.col("doc_id").cast("string").alias("resource_id"), "text")
    drafts = ex.unpivot(texts, ex.draft("document.text_excerpt", "string", F.col("text"),
                                        "resource_content", "x"))
    found = pub.draft_violations(drafts, ("document.text_excerpt",), predicate_table(spark))
    assert "hashpartitioning(predicate" not in plan(found)
    assert found.count() == 0
    twice = pub.draft_violations(drafts.unionByName(drafts), ("document.text_excerpt",),
                                 predicate_table(spark))
    violations = {r["violation"] for r in twice.collect()}
    assert violations == {"duplicate_value", "several_values"}


@pytest.mark.parametrize("query", [
    workload_payloads.limited_enrichment, workload_state.enrichment_rerun])
def test_a_first_run_builds_no_statements(spark, monkeypatch, query):
    """statements of other extractors are not made where none are used."""
    def fail(*_):
        raise AssertionError("statements were built")
    bind.catalog(spark, SF)
    monkeypatch.setattr(bind, "statements", fail)
    assert query(spark, SF).count() > 0


def test_the_funnel_searches_once(spark):
    """F7, F9, F16: hits and stages are read from the written candidates."""
    found = workload_reads._semantic_funnel(spark, SF)
    assert "CoGroups" not in plan(found.hits) + plan(found.stages)


def test_an_empty_catalog_costs_no_shuffle(spark):
    """The first scan is not shuffled to meet tables that hold nothing."""
    facts = spark.range(10).select(*[F.col("id").cast(f.dataType).alias(f.name) if f.name in
                                     ("ordinal", *KEY) else F.lit(None).cast(f.dataType)
                                     .alias(f.name) for f in FACTS.fields])
    sources = Catalog.empty(spark).sources.select(*KEY, F.col("id").alias("p_source_id"))
    assert "Exchange" not in plan(facts.join(sources, KEY, "left"))


def test_pages_of_relations_are_not_merged_into_few_tasks(spark):
    """the lines of an order meet in partitions that are not merged by their packed size."""
    found = workload_sources.landed_relations(spark, SF)
    assert "hashpartitioning(o_orderkey" in plan(found)
    lines = [line for line in plan(found).splitlines() if "hashpartitioning(o_orderkey" in line]
    assert any("REPARTITION_BY_NUM" in line for line in lines)
    assert found.count() == found.distinct().count() > 0
