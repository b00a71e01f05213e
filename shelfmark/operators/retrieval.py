"""Retrieval: candidates by meaning or by statement text, then a funnel of exact filters."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from datetime import datetime
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import query as q
from shelfmark.schemas import PREDICATES, Catalog
from shelfmark.session import materialise

# Fixed values.
CANDIDATE_LIMIT = 50
DEFAULT_RESULT_LIMIT = 10
MAX_RESULT_LIMIT = 20
TEXT_PREDICATES = ("media.ocr_text", "document.text_excerpt")
CAPTURED, MODIFIED = "media.captured_at", "file.modified_at"
# Vectors and query vectors that meet in one task.
VECTOR_BLOCK, QUERY_BLOCK = 8_192, 256


def _unit(rows: pd.Series) -> np.ndarray:
    matrix = np.stack(rows.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(norms == 0, 1, norms)[:, None]


def _best_in_block(k: int):
    """The k best rows of a block of vectors for every query of a block of queries."""
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "locator", "score"]
        if vectors.empty or queries.empty:
            return pd.DataFrame({n: pd.Series(dtype=t) for n, t in zip(
                names, ("int64", "object", "float64"))})
        vectors = vectors.sort_values("locator", ignore_index=True)
        scores = _unit(queries["embedding"]) @ _unit(vectors["embedding"]).T
        found = []
        for query_id, row in zip(queries["query_id"], scores):
            near = np.arange(len(row))
            if len(row) > k:
                near = np.flatnonzero(row >= np.partition(row, -k)[-k])
            near = near[np.argsort(-row[near], kind="stable")][:k]
            found.append(pd.DataFrame({
                "query_id": query_id, "locator": vectors["locator"].to_numpy()[near],
                "score": row[near]}))
        return pd.concat(found)
    return search


def semantic_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k: (query_id, locator, rank, score) of `vectors` (locator STRING,
    embedding ARRAY) for every row of `queries` (query_id BIGINT, embedding ARRAY).

    Blocks of vectors meet blocks of queries; only the k best of a block per query leave its
    task. Vectors that are or hold null take no part, and those of different lengths are not
    compared.
    """
    q.check_limit(k)
    whole = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)"
    vectors = vectors.filter(whole).select(
        "locator", "embedding", F.size("embedding").alias("_dim"))
    queries = queries.filter(whole).select(
        "query_id", "embedding", F.size("embedding").alias("_dim"))
    n = max(1, -(-vectors.count() // VECTOR_BLOCK))
    m = max(1, -(-queries.count() // QUERY_BLOCK))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = vectors.withColumn("_v", F.pmod(F.xxhash64("locator"), F.lit(n)).cast("int")) \
        .withColumn("_q", every(m))
    right = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int")) \
        .withColumn("_v", every(n))
    keys = ["_dim", "_v", "_q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _best_in_block(k), "query_id BIGINT, locator STRING, score DOUBLE")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("locator"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Mapped(NamedTuple):
    hits: DataFrame
    unmapped: DataFrame


def map_hits(catalog: Catalog, hits: DataFrame, provider: str) -> Mapped:
    """Hits (query_id, locator, rank) with the file resource they name; ranks keep their gaps.

    A locator whose chain of content and resource is broken, or that names two resources, is an
    error; one without an active file is counted as unmapped. Hits are written once and the chain
    is followed from them, so that the tables are read and not shuffled.
    """
    hits = materialise(hits, "semantic-hits")
    sources = catalog.sources.filter(F.col("is_active") & (F.col("provider") == provider)).select(
        F.col("external_id").alias("locator"), "blob_id")
    wanted = materialise(sources.join(hits.select("locator").distinct(), "locator", "left_semi"),
                         "hit-sources")
    contents = materialise(
        catalog.blobs.select(F.col("id").alias("blob_id"), F.col("asset_id").alias("resource_id"))
        .join(wanted.select("blob_id"), "blob_id", "left_semi"), "hit-contents")
    named = materialise(
        catalog.resources.select(F.col("id").alias("resource_id"), "resource_type", "title")
        .join(contents.select("resource_id"), "resource_id", "left_semi"), "hit-resources")
    chain = wanted.join(contents, "blob_id", "left").join(named, "resource_id", "left")
    per_locator = chain.groupBy("locator").agg(
        F.count_if(F.col("resource_type").isNull()).alias("broken"),
        F.count_if(F.col("resource_type") == "file").alias("files"),
        F.min(F.when(F.col("resource_type") == "file",
                     F.struct("resource_id", "title"))).alias("r"))
    checked = per_locator.select("locator", F.when(
        F.col("broken") > 0, F.raise_error(F.lit("active source has a broken mapping"))).when(
        F.col("files") > 1, F.raise_error(F.lit("hit has an ambiguous mapping"))).otherwise(
        F.col("r")).alias("r"))
    joined = hits.join(checked, "locator", "left")
    mapped = joined.filter(F.col("r").isNotNull()).select(
        *hits.columns, F.col("r.resource_id").alias("resource_id"), F.col("r.title").alias("title"))
    unmapped = joined.groupBy("query_id").agg(
        F.count_if(F.col("r").isNull()).alias("unmapped_hit_count"))
    return Mapped(mapped, unmapped)


def retrieve_semantic(catalog: Catalog, vectors: DataFrame, queries: DataFrame, provider: str,
                      limit: int = 20) -> Mapped:
    return map_hits(catalog, semantic_top_k(vectors, queries, limit), provider)


@dataclass(frozen=True)
class RichFilters(q.Filters):
    captured_from: datetime | None = None
    captured_to: datetime | None = None
    file_modified_from: datetime | None = None
    file_modified_to: datetime | None = None
    required_predicates: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in ("provider", "resource_type", "mime_type", "mime_category", "path_prefix"):
            value = getattr(self, name)
            if value is not None:
                object.__setattr__(self, name, q._text(value, name))
        q.Filters(self.provider, self.resource_type, self.mime_type, self.mime_category,
                  self.path_prefix)
        if self.mime_category is not None:
            object.__setattr__(self, "mime_category", self.mime_category.lower())
        if self.resource_type not in (None, "file"):
            raise q.InvalidQuery("resource_type must be file")
        for kind in ("captured", "file_modified"):
            begin = q.instant(getattr(self, f"{kind}_from"), f"{kind}_from")
            end = q.instant(getattr(self, f"{kind}_to"), f"{kind}_to")
            if begin and end and begin >= end:
                raise q.InvalidQuery(f"{kind}_from must be earlier than {kind}_to")
            object.__setattr__(self, f"{kind}_from", begin)
            object.__setattr__(self, f"{kind}_to", end)
        required = tuple(dict.fromkeys(
            q._text(p, "required_predicate") for p in self.required_predicates))
        for name in required:
            if name not in PREDICATES:
                raise q.InvalidQuery(f"unknown required predicate: {name}")
        object.__setattr__(self, "required_predicates", required)

    @property
    def on_metadata(self) -> bool:
        return bool(self.on_source or self.resource_type)

    @property
    def on_captured(self) -> bool:
        return self.captured_from is not None or self.captured_to is not None

    @property
    def on_modified(self) -> bool:
        return self.file_modified_from is not None or self.file_modified_to is not None


def text_candidates(catalog: Catalog, statements: DataFrame, predicate: str, text: str,
                    limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """File resources whose current statement holds `text` literally, by title and id:
    (resource_id, title, source_rank, primary)."""
    if predicate not in TEXT_PREDICATES:
        raise q.InvalidQuery("observation text predicate is unsupported")
    text = q._text(text, "query")
    subjects = statements.filter(
        F.col("is_current") & (F.col("predicate") == predicate)
        & (F.col("value_type") == "string") & fn.contains_ci(F.col("string_value"), text)).select(
        F.col("subject_asset_id").alias("id"))
    files = q.matching_resources(catalog, q.Filters(resource_type="file"), q.Period())
    order = [F.col("title").asc(), F.col("id").asc()]
    top = files.join(subjects, "id", "left_semi").select("id", "title").orderBy(*order).limit(limit)
    return top.select(
        F.col("id").alias("resource_id"), "title",
        F.row_number().over(Window.orderBy(*order)).alias("source_rank"),
        F.array(F.lit(predicate)).alias("primary"))


def semantic_candidates(mapped: Mapped) -> DataFrame:
    """Candidates of every query: (query_id, resource_id, title, source_rank, primary)."""
    return mapped.hits.select("query_id", "resource_id", "title",
                              F.col("rank").alias("source_rank"),
                              F.array().cast("array<string>").alias("primary"))


def _one_claim(predicate: str) -> Column:
    """The single current value of a datetime predicate; several, or no datetime, is an error."""
    here = F.col("predicate") == predicate
    wrong = F.count_if(here & ((F.col("value_type") != "datetime")
                               | F.col("datetime_value").isNull())) > 0
    return (
        F.when(wrong, F.raise_error(F.lit(f"current {predicate} has an invalid typed value")))
        .when(F.count_if(here) > 1, F.raise_error(F.lit(f"several current {predicate} claims")))
        .otherwise(F.min(F.when(here, F.col("datetime_value"))))
    )


def around(catalog: Catalog, ids: DataFrame) -> Catalog:
    """The catalog of few resources (resource_id) alone, found without shuffling its tables."""
    contents = materialise(catalog.blobs.join(
        ids.select(F.col("resource_id").alias("asset_id")), "asset_id", "left_semi").select(
        *catalog.blobs.columns), "near-contents")
    sources = catalog.sources.join(contents.select(F.col("id").alias("blob_id")), "blob_id",
                                   "left_semi").select(*catalog.sources.columns)
    return Catalog(catalog.resources.join(ids.select(F.col("resource_id").alias("id")), "id",
                                          "left_semi"), contents, sources)


def signals(catalog: Catalog, statements: DataFrame, candidates: DataFrame,
            filters: RichFilters) -> DataFrame:
    """Candidates with what the filters in use need; unused signals cost nothing."""
    rows = candidates
    if filters.on_metadata:
        catalog = around(catalog, candidates)
    if filters.on_metadata:
        kind = filters.resource_type or "file"
        typed = catalog.resources.filter(F.col("resource_type") == kind).select(
            F.col("id").alias("resource_id"))
        match = typed
        if filters.on_source:
            match = typed.join(q.eligible_resources(catalog, filters), "resource_id", "left_semi")
        match = match.join(candidates.select("resource_id"), "resource_id", "left_semi")
        rows = rows.join(match.withColumn("metadata_match", F.lit(True)), "resource_id", "left")
    needed = list(dict.fromkeys([
        *filters.required_predicates, *([CAPTURED] if filters.on_captured else []),
        *([MODIFIED] if filters.on_modified else [])]))
    if needed:
        claims = (
            statements.filter(F.col("is_current") & F.col("predicate").isin(*needed))
            .select(F.col("subject_asset_id").alias("resource_id"), "predicate", "value_type",
                    "datetime_value")
            .join(candidates.select("resource_id"), "resource_id", "left_semi")
            .groupBy("resource_id").agg(
                F.collect_set("predicate").alias("current_predicates"),
                _one_claim(CAPTURED).alias("captured_at"),
                _one_claim(MODIFIED).alias("file_modified_at"))
        )
        rows = rows.join(claims, "resource_id", "left")
    return rows


def _within(value: Column, begin: datetime | None, end: datetime | None) -> Column:
    test = value.isNotNull()
    if begin is not None:
        test = test & (value >= F.lit(begin))
    if end is not None:
        test = test & (value < F.lit(end))
    return F.coalesce(test, F.lit(False))


class Retrieved(NamedTuple):
    hits: DataFrame
    stages: DataFrame


def funnel(catalog: Catalog, statements: DataFrame, candidates: DataFrame, filters: RichFilters,
           limit: int = DEFAULT_RESULT_LIMIT, primary_stage: str = "observation_text_primary"
           ) -> Retrieved:
    """Filter bounded candidates step by step; candidates lost are never refilled.

    Only the filters in use make a stage. Every stage count comes from one pass over flags.
    Candidates with a `query_id` are those of many queries: hits and stages then carry it.
    """
    q.check_limit(limit, MAX_RESULT_LIMIT)
    # Written once: the search for candidates is not repeated, and few rows meet large tables.
    candidates = materialise(candidates, "candidates")
    rows = materialise(signals(catalog, statements, candidates, filters), "signals")
    tests: list[tuple[str, Column]] = []
    if filters.on_metadata:
        tests.append(("source_metadata_filter", F.coalesce("metadata_match", F.lit(False))))
    if filters.on_captured:
        tests.append(("captured_at_filter", _within(
            F.col("captured_at"), filters.captured_from, filters.captured_to)))
    if filters.on_modified:
        tests.append(("file_modified_at_filter", _within(
            F.col("file_modified_at"), filters.file_modified_from, filters.file_modified_to)))
    if filters.required_predicates:
        needed = F.array(*[F.lit(p) for p in filters.required_predicates])
        tests.append(("required_predicates_filter", F.coalesce(
            F.size(F.array_except(needed, F.col("current_predicates"))) == 0, F.lit(False))))
    alive, counts = F.lit(True), [("primary", F.lit(True))]
    for name, test in tests:
        alive = alive & test
        counts.append((name, alive))
    left = rows.withColumn("alive", alive)

    matched = [F.col("primary")]
    if filters.on_captured:
        matched.append(F.array(F.lit(CAPTURED)))
    if filters.on_modified:
        matched.append(F.array(F.lit(MODIFIED)))
    if filters.required_predicates:
        matched.append(F.array(*[F.lit(p) for p in filters.required_predicates]))

    def signal(name: str, predicate: str, asked: bool) -> Column:
        shown = asked or predicate in filters.required_predicates
        return (F.col(name) if shown else F.lit(None).cast("timestamp")).alias(name)

    by = ["query_id"] if "query_id" in candidates.columns else []
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("source_rank"))
        best = left.filter("alive").withColumn("_place", place).filter(F.col("_place") <= limit)
    else:
        best = left.filter("alive").orderBy("source_rank").limit(limit)
    hits = (
        best.select(*by, fn.resource_ref("resource_id").alias("resource_ref"), "title", "source_rank",
                F.array_distinct(F.concat(*matched)).alias("matched_predicates"),
                signal("captured_at", CAPTURED, filters.on_captured),
                signal("file_modified_at", MODIFIED, filters.on_modified))
    )
    one = rows.groupBy(*by).agg(*[F.count_if(flag).alias(f"c{i}") for i, (_, flag) in enumerate(counts)])
    stages = [F.struct(F.lit(0).alias("position"), F.lit(primary_stage).alias("stage"),
                       F.lit(0).cast("bigint").alias("input_count"),
                       F.col("c0").alias("output_count"))]
    for i, (name, _) in enumerate(counts[1:], start=1):
        stages.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"),
                               F.col(f"c{i - 1}").alias("input_count"),
                               F.col(f"c{i}").alias("output_count")))
    last = F.col(f"c{len(counts) - 1}")
    stages.append(F.struct(
        F.lit(len(counts)).alias("position"), F.lit("final_limit").alias("stage"),
        last.alias("input_count"),
        F.least(last, F.lit(limit).cast("bigint")).alias("output_count")))
    return Retrieved(hits, one.select(*by, F.inline(F.array(*stages))))


def retrieve_filtered(catalog: Catalog, statements: DataFrame, predicate: str, text: str,
                      filters: RichFilters = RichFilters(), limit: int = DEFAULT_RESULT_LIMIT
                      ) -> Retrieved:
    return funnel(catalog, statements, text_candidates(catalog, statements, predicate, text),
                  filters, limit)


# Executors get the scan function itself, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
