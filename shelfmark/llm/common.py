"""Helpers of the training-data operators: document keys, numbering over all rows, task caches.

Documents may repeat rows and ids, so operators address a row by its id and a hash of its text
(`_id`, `_th`). Rows that agree in both are copies and get the same answer.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import run_folder

#: Words are maximal runs of anything but these characters.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = "[ \\t-\\r]+"


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def keyed(docs: DataFrame, text: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """`_id` (nulls stay null), `_th` and `_text` (null as empty) of every document."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(body).alias("_th"),
                       body.alias("_text"), *also)


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_th"] == right["_th"])


def _held() -> types.ModuleType:
    return sys.modules.setdefault("_shelfmark_llm_cache", types.ModuleType("cache"))


def task_cache(name: str, build: Callable[[], object]) -> object:
    """A model or lookup built once per Python worker process and reused by its later tasks."""
    held = _held()
    if not hasattr(held, name):
        setattr(held, name, build())
    return getattr(held, name)


def release(kind: str) -> None:
    """Forget what this worker holds under names that begin with `kind`.

    Workers outlive the stages of a pipeline; a task that needs no model gives its memory back.
    """
    held = _held()
    for name in [n for n in vars(held) if n.startswith(kind)]:
        delattr(held, name)
    pa.default_memory_pool().release_unused()


class Recent:
    """A bounded memory of what was used lately: two generations of `size` entries each.

    Look up in `new` first; `again` finds what the older generation still holds.
    """

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def again(self, key):
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value


def fields(df: DataFrame, names: Sequence[str], made: str = "") -> T.StructType:
    """Columns of `df` followed by new ones (DDL), all nullable: the schema of a task's rows."""
    own = [T.StructField(n, df.schema[n].dataType) for n in names]
    return T.StructType(own + (T.StructType.fromDDL(made).fields if made else []))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write once to the shared folder, densely, and read the table back."""
    path = run_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, groups: Sequence[str], order: Sequence[str],
                   values: dict[str, str], name: str) -> DataFrame:
    """Add, for each (output, column) of `values`, the sum of the column over all earlier rows.

    Rows are ordered by `order` within `groups` (may be empty: all rows). No group is one task:
    rows are dealt by range, each range is summed for itself, and one row per range and group
    carries the sums on. Rows equal in the whole order are taken in any order. Columns must be
    narrow; the rows are written once so that ranges stay as they were dealt.
    """
    dealt = materialise(
        df.repartitionByRange(partitions(df), *groups, *order)
        .withColumn("_part", F.spark_partition_id()), name)
    here = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumns({
        out: F.sum(col).over(here) - F.col(col) for out, col in values.items()})
    per_part = dealt.groupBy("_part", *groups).agg(
        *[F.sum(col).alias(f"_s_{out}") for out, col in values.items()])
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = per_part.select("_part", *groups, *[
        F.coalesce(F.sum(f"_s_{out}").over(earlier), F.lit(0)).alias(f"_b_{out}")
        for out in values])
    on = inside["_part"] == carried["_part"]
    for g in groups:
        on &= inside[g].eqNullSafe(carried[g])
    joined = inside.join(carried, on)
    return joined.select(*[inside[c] for c in df.columns], *[
        (inside[out] + carried[f"_b_{out}"]).alias(out) for out in values])


def group_starts(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """First row of every run of equal keys (whole numbers without nulls)."""
    new = np.zeros(table.num_rows, bool)
    if len(new):
        new[0] = True
    for k in keys:
        values = table.column(k).to_numpy(zero_copy_only=False) if isinstance(
            table, pa.RecordBatch) else table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables in which every group of rows with equal keys is complete.

    The rows come sorted by the keys; the group that a batch ends in waits for the next batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = int(group_starts(table, keys)[-1])
        if last:
            yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def unnest(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Lengths of a list-of-structs column's rows (null: 0) and the fields of all items."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    items = column.flatten()
    fields_ = items.flatten()
    return sizes, {items.type.field(i).name: f.to_numpy(zero_copy_only=False)
                   for i, f in enumerate(fields_)}


def nest(sizes: np.ndarray, **items: pa.Array) -> pa.Array:
    """The list-of-structs column whose rows take the next `sizes` items each."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
        list(items.values()), names=list(items)))


def squeezed(docs: DataFrame, text: str = "text", also: Sequence[Column] = (),
             names: Sequence[str] = ()) -> DataFrame:
    """`_id, _th`, the columns `also`, named `names`, and `_z`, the compressed text, for shuffles
    of texts."""
    rows = keyed(docs, text, also)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        release("bpe:")
        release("chunks:")
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            body = batch.column("_text").cast(pa.binary())
            out = pa.array([packer.compress(v.as_buffer()) for v in body], pa.binary())
            rest = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in rest], out], names=[*rest, "_z"])

    return rows.mapInArrow(run, fields(rows, ["_id", "_th", *names], "_z binary"))
