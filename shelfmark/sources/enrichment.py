"""Enrichment over stored tables: claims are stored before content is read."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.publish import IDENTITY, STALE_AFTER, Enriched, gate, run_enrichment
from shelfmark.schemas import Catalog
from shelfmark.session import materialise
from shelfmark.sources import tables


def run_stored(spark: SparkSession, root: str, extractor, now: datetime,
               limit: int | None = None, stale_after=STALE_AFTER,
               catalog: Catalog | None = None, registry: DataFrame | None = None) -> Enriched:
    """One enrichment run over the live tables of a root.

    Claims go to the stored states first, those that another worker has claimed meanwhile left
    out; then content is read, and statements and final states are stored. A worker that dies
    leaves running claims, which anyone may take after `stale_after`. Commits are one at a time.
    """
    catalog = catalog or tables.read_catalog(spark, root)

    def claim(rows: DataFrame) -> DataFrame:
        rows = materialise(rows, "wanted-claims")
        asked = rows.withColumnsRenamed({"subject_asset_id": "resource_id",
                                         "input_fingerprint": "fingerprint"})
        held = gate(asked, tables.read_states(spark, root), extractor.generator, now, stale_after)
        got = materialise(rows.join(
            held.filter("gate = 'run'").select(held["resource_id"].alias("subject_asset_id")),
            "subject_asset_id", "left_semi"), "claims")
        tables.merge(spark, root, "enrichment_states", got)
        return got.select(*IDENTITY)

    statements = tables.read_statements(spark, root)
    done = run_enrichment(extractor, catalog, statements, tables.read_states(spark, root), now,
                          limit, stale_after, registry, claim)
    # The outcome is read from written tables; what it came from may now be replaced.
    totals = materialise(done.totals, "enrichment-totals")
    finished = materialise(done.finished, "finished-states")
    tables.commit_statements(spark, root, done.published, uuid.uuid4().hex)
    tables.merge(spark, root, "enrichment_states", finished)
    return done._replace(totals=totals, finished=finished,
                         statements=tables.read_statements(spark, root),
                         states=tables.read_states(spark, root))
