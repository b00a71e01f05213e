"""Content on demand: the keys that need it come first, and only their content is read.

Content is a DataFrame (provider, external_id, content) or an object whose `read(keys)` gives such
rows for at least the wanted keys, pruned where it is stored (see `sources.content`).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialise

KEY = ["provider", "external_id"]
CONTENT = "provider STRING, external_id STRING, content BINARY"
#: Wanted keys of at most so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20


class ContentSource(Protocol):
    def read(self, keys: DataFrame) -> DataFrame:
        """Rows (provider, external_id, content) of at least the wanted keys."""


def _measured(keys: DataFrame) -> tuple[DataFrame, int, int]:
    """The wanted keys, written once, with their number and size in bytes."""
    keys = materialise(keys.select(*KEY).distinct(), "wanted-keys")
    size = F.octet_length(F.concat_ws("", *KEY)) + F.lit(64)
    row = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint")).alias("b")).first()
    return keys, row["n"], row["b"] or 0


def matching(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the wanted keys; few keys go to where the rows are read."""
    keys, n, size = _measured(keys)
    if n == 0:
        return rows.sparkSession.createDataFrame([], rows.schema)
    return rows.join(F.broadcast(keys) if size <= BROADCAST_BYTES else keys, KEY, "left_semi")


def only(content: DataFrame | ContentSource, keys: DataFrame,
         reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`reduce` over the content of the wanted keys; it keeps the key and shrinks content at once.

    Few keys are matched before any content is touched. Very many are matched after `reduce`, so
    that a shuffle carries what is left of the content and never its bytes.
    """
    keys, n, size = _measured(keys)
    if n == 0:
        return reduce(keys.sparkSession.createDataFrame([], CONTENT))
    rows = content.read(keys) if hasattr(content, "read") else content
    if size <= BROADCAST_BYTES:
        return reduce(rows.join(F.broadcast(keys), KEY, "left_semi"))
    return reduce(rows).join(keys, KEY, "left_semi")
