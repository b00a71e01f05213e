"""The public functions in one place, and what an extension has to offer.

* An extractor has `generator`, `covered`, `family`, `inputs(catalog)` and `drafts(inputs)`; see
  `Extractor`. Its two methods may use any DataFrame operation, `mapInPandas` included.
* A provider adapter turns landed responses into rows of `schemas.FACTS` (see `sources`); content
  comes as (provider, external_id, content).
* A candidate provider returns (query_id, locator, rank) for `retrieval.map_hits`.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from shelfmark.operators.integrity import check_integrity
from shelfmark.operators.ledger import job_status
from shelfmark.operators.people import reconcile_people, reconcile_relations
from shelfmark.operators.publish import get_statements, run_enrichment
from shelfmark.operators.query import (
    Filters, InvalidQuery, Period, aggregate, get_resource, list_recent, search,
)
from shelfmark.operators.reconcile import reconcile, sync_provider
from shelfmark.operators.retrieval import RichFilters, retrieve_filtered, retrieve_semantic
from shelfmark.operators.turns import fold_events
from shelfmark.schemas import Catalog, Generator
from shelfmark.streaming.ingest import ingest_stream
from shelfmark.streaming.turns import fold_stream


class Extractor(Protocol):
    generator: Generator
    covered: tuple[str, ...]
    family: tuple[str, ...]

    def inputs(self, catalog: Catalog) -> DataFrame:
        """resource_id, fingerprint, error_code, error_message and what `drafts` needs."""

    def drafts(self, inputs: DataFrame) -> DataFrame:
        """Rows made with `extract.unpivot` from `extract.draft` columns."""


__all__ = [
    "Catalog", "Extractor", "Filters", "Generator", "InvalidQuery", "Period", "RichFilters",
    "aggregate", "check_integrity", "fold_events", "fold_stream", "get_resource",
    "get_statements", "ingest_stream", "job_status", "list_recent", "reconcile",
    "reconcile_people", "reconcile_relations", "retrieve_filtered", "retrieve_semantic",
    "run_enrichment", "search", "sync_provider",
]
