"""Exact top-k by inner product with vector-approximation files.

Vectors are whole numbers: floor(256 * component). They are written once to approximation files, one
row per block of vectors: of every component one byte, the number of its cell between the block's
least and greatest value, beside the cells' bounds. A scan of the files bounds each inner product from
both sides; a block gives, per query, the rows that its own k best lower bounds do not rule out.
The k-th best lower bound over all blocks then rules out most of these, and only what is left is
joined with exact vectors and scored exactly. No bound is trusted beyond its rounding error, so the
k-th result is certain.

Every row is a candidate for every query but itself, rows with equal ids and equal vectors included;
of equal vectors only the k + 1 that come first on ties can be among the best, and only these are
written to the files. Vectors that are null or hold a null or non-finite component take no part.
Only vectors of equal length are compared. A null id is no query and ranks after all others on ties.
Ties go to the smaller id; fewer than k candidates give fewer rows; an empty table gives none. Scores
beyond 64 bits stop at the largest or smallest long. Very long vectors are worked on whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise

BLOCK = 1024
CELLS = 256
LONG = np.iinfo(np.int64)
FILE = "_dim int, _vb int, rows array<long>, low array<double>, width array<double>, cells binary"
FOUND = "_q long, _row long, lower double, upper double"


def whole(rows: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles, which hold it exactly."""
    return np.floor(256.0 * rows)


def approximate(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and cell width of every component, and the cells of all rows."""
    low, high = rows.min(axis=0), rows.max(axis=0)
    width = np.nextafter(high / CELLS - low / CELLS, np.inf)
    with np.errstate(all="ignore"):
        cells = np.floor((rows - low) / np.where(width > 0, width, 1.0))
    return low, width, np.clip(np.nan_to_num(cells), 0, CELLS - 1).astype(np.uint8)


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every query with every row of cells.

    Cell numbers may be off by one at an edge and sums are rounded: the bounds are wide enough
    for both. What overflows bounds nothing.
    """
    with np.errstate(all="ignore"):
        inner = (queries @ low)[:, None] + (queries * width) @ cells.astype(np.float64).T
        reach = queries * width
        over = 2 * np.maximum(reach, 0).sum(axis=1) - np.minimum(reach, 0).sum(axis=1)
        under = 2 * np.minimum(reach, 0).sum(axis=1) - np.maximum(reach, 0).sum(axis=1)
        size = np.abs(queries) @ (np.abs(low) + (CELLS + 1) * width)
        slack = size * (len(low) + 16) * 2.0 ** -50
        upper = inner + (over + slack)[:, None]
        lower = inner + (under - slack)[:, None]
    return (np.where(np.isfinite(lower), lower, -np.inf),
            np.where(np.isfinite(upper), upper, np.inf))


def _write_block(part: pd.DataFrame) -> pd.DataFrame:
    low, width, cells = approximate(whole(np.stack(part["embedding"].to_numpy())))
    return pd.DataFrame([(int(part["_dim"].iloc[0]), int(part["_vb"].iloc[0]),
                          part["_row"].to_numpy(), low, width, cells.tobytes())],
                        columns=["_dim", "_vb", "rows", "low", "width", "cells"])


def _scan(k: int):
    """Rows of a block of the file that its bounds leave open, for each query of a block."""
    def run(file: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if len(file) and len(asked):
            queries = whole(np.stack(asked["embedding"].to_numpy()))
            own = asked["_row"].to_numpy(np.int64)
            for block in file.itertuples():
                rows = np.asarray(block.rows, np.int64)
                cells = np.frombuffer(block.cells, np.uint8).reshape(len(rows), -1)
                lower, upper = bounds(queries, np.asarray(block.low), np.asarray(block.width),
                                      cells)
                itself = own[:, None] == rows
                lower[itself], upper[itself] = -np.inf, -np.inf
                open_ = ~itself
                if len(rows) > k + 1:
                    bar = np.partition(lower, -k, axis=1)[:, -k]
                    open_ &= upper >= bar[:, None]
                n, at = np.nonzero(open_)
                parts.append((own[n], rows[at], lower[n, at], upper[n, at]))
        return pd.DataFrame({name: np.concatenate(column) for name, column in zip(
            ("_q", "_row", "lower", "upper"), zip(*parts))})
    return run


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Inner products as Python integers where doubles would round, within the range of long."""
    for batch in batches:
        score = []
        for a, b in zip(batch["asked"], batch["embedding"]):
            a, b = whole(np.asarray(a, np.float64)), whole(np.asarray(b, np.float64))
            if len(a) == 0 or np.abs(a).max() * np.abs(b).max() * len(a) < 2.0 ** 52:
                score.append(int(a @ b))
            else:
                exact = sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))
                score.append(min(max(exact, int(LONG.min)), int(LONG.max)))
        yield pd.DataFrame({"_q": batch["_q"], "query_id": batch["query_id"],
                            "vec_id": batch["vec_id"].astype("Int64"), "_row": batch["_row"],
                            "score": score})


def _finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _blocks(n: int) -> int:
    return max(1, math.ceil(n / BLOCK))


def open_pairs(rows: DataFrame, k: int) -> DataFrame:
    """`_q, _row, lower, upper`: pairs of query row and candidate row that the bounds of all blocks
    together leave open, from rows `_row, vec_id, embedding, _dim, _query`."""
    first = Window.partitionBy("embedding").orderBy(F.col("vec_id").asc_nulls_last(), "_row")
    kept = rows.select("_row", "vec_id", "embedding", "_dim").withColumn(
        "_place", F.row_number().over(first)).filter(F.col("_place") <= k + 1)
    kept = materialise(kept.drop("_place", "vec_id"), "va-rows")
    counts = rows.agg(F.count_if("_query").alias("q")).first()
    n_blocks, q_blocks = _blocks(kept.count()), _blocks(counts.q)
    files = materialise(
        kept.withColumn("_vb", F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).cast("int"))
        .groupBy("_dim", "_vb").applyInPandas(_write_block, FILE), "va-files")
    # Files meet every block of queries, a byte a component; queries meet every file.
    left = files.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = rows.filter("_query").select("_row", "embedding", "_dim").withColumns({
        "_qb": F.pmod(F.xxhash64("_row"), F.lit(q_blocks)).cast("int"),
        "_vb": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))})
    keys = ["_dim", "_vb", "_qb"]
    found = materialise(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _scan(k), FOUND), "va-bounds")
    best = Window.partitionBy("_q").orderBy(F.col("lower").desc())
    bar = (found.select("_q", "lower").withColumn("_n", F.row_number().over(best))
           .filter(F.col("_n") == k).select("_q", F.col("lower").alias("bar")))
    return found.join(bar, "_q", "left").filter(
        F.col("bar").isNull() | (F.col("upper") >= F.col("bar"))).drop("bar")


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """`query_id, rank, vec_id, score`: the k best rows for every row that satisfies `is_query`."""
    rows = materialise(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                       F.col(embedding).cast("array<double>").alias("embedding"),
                       F.coalesce(is_query & F.col(vec_id).isNotNull(), F.lit(False))
                       .alias("_query"))
        .filter(_finite(F.col("embedding"))).withColumns({
            "_dim": F.size("embedding"), "_row": F.monotonically_increasing_id()}), "va-vectors")
    pairs = materialise(open_pairs(rows, k).select("_q", "_row"), "va-open")
    asked = rows.filter("_query").select(F.col("_row").alias("_q"), F.col("vec_id")
                                         .alias("query_id"), F.col("embedding").alias("asked"))
    scored = pairs.join(rows.select("_row", "vec_id", "embedding"), "_row").join(
        asked, "_q").select("_q", "query_id", "asked", "_row", "vec_id", "embedding").mapInPandas(
        _exact, "_q long, query_id long, vec_id long, _row long, score long")
    best = Window.partitionBy("_q").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "_row")
    return (scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
