"""Removal of repeated word windows by super-k-mer partitioning.

A window is 35 consecutive words of one document. Its minimiser is the first of its four-word
groups of least hash. Consecutive windows with one minimiser make a super-k-mer. A minimiser that
occurs once has no repeated window, so only super-k-mers of shared minimisers travel, each as one
packed string, to the bucket of its minimiser. There the windows of all strings are sorted by
their 128-bit hashes and equal neighbours counted. A minimiser of very many super-k-mers is
spread over several buckets by a number derived from its own count; windows that such a bucket
sees once are counted again over all buckets.

Null texts have no words. Repeated rows are further places of the same windows. Documents under
35 words lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import fields, keyed, materialise, partitions, squeezed, whole_groups
from shelfmark.llm.texthash import (
    BASES, Ranges, Words, chunks, covered, runs, signed, sliding_first_min, unsqueeze,
)

WINDOW = 35
GROUP = 4  # words of a minimiser
#: Super-k-mers of one minimiser that one bucket takes.
BUCKET = 2048


def _super_kmers(docs: DataFrame, text: str) -> DataFrame:
    """`_id, _th, s, n, v`: first window, number of windows and minimiser of every run."""
    rows = keyed(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column("_text")):
                words = Words(data, at)
                ranges = Ranges(words.hashes(data), BASES[0])
                n = len(words.start)
                if n < WINDOW:
                    continue
                head = np.arange(n - GROUP + 1)
                groups = ranges.hash(head, head + GROUP)
                least = sliding_first_min(groups, WINDOW - GROUP + 1)
                place = np.arange(len(least))
                inside = words.row[place] == words.row[place + WINDOW - 1]
                place, least = place[inside], least[inside]
                a, b = runs(least)
                row = words.row[place[a]]
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(pa.array(first + row)) for c in ("_id", "_th")],
                    pa.array((place[a] - words.first[row]).astype(np.int32)),
                    pa.array((b - a).astype(np.int32)),
                    pa.array(signed(groups[least[a]]))], names=["_id", "_th", "s", "n", "v"])

    return materialise(rows.mapInArrow(
        run, fields(rows, ["_id", "_th"], "s int, n int, v long")), "super-kmers")


def _result(words: list[bytes], spans: list, texts: bool) -> tuple[int, str]:
    gone = covered(len(words), *np.array(spans).T) if spans else np.zeros(len(words), bool)
    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if spans \
        else b" ".join(words)
    return int(gone.sum()), kept.decode() if texts else hashlib.sha256(kept).hexdigest()


def _packed(docs: DataFrame, text: str, shared: DataFrame, texts: bool) -> DataFrame:
    """One row per document: the result where nothing is shared, else text and packed strings."""
    body = squeezed(docs, text)
    per_doc = shared.groupBy(F.col("_id").alias("_kid"), F.col("_th").alias("_kth")).agg(
        F.collect_set(F.struct("s", "n", "v", "c")).alias("kmers"))
    joined = body.join(per_doc, body["_id"].eqNullSafe(per_doc["_kid"]) & (
        body["_th"] == per_doc["_kth"]), "left").select("_id", "_th", "_z", "kmers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {c: [] for c in ("_z", "n_words", "kept", "packs")}
                for z, kmers in zip(part.column("_z").to_pylist(),
                                    part.column("kmers").to_pylist()):
                    words = unsqueeze(z).split()
                    out["n_words"].append(len(words))
                    out["_z"].append(z if kmers else None)
                    out["kept"].append(None if kmers else _result(words, [], texts)[1])
                    out["packs"].append([{**k, "packed": b" ".join(
                        words[k["s"]:k["s"] + k["n"] + WINDOW - 1])} for k in kmers or []])
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), part.column("_th"), pa.array(out["_z"], pa.binary()),
                    pa.array(out["n_words"], pa.int64()), pa.array(out["kept"], pa.string()),
                    pa.array(out["packs"], PACKS)],
                    names=["_id", "_th", "_z", "n_words", "kept", "packs"])

    made = ("n_words long, kept string, "
            "packs array<struct<s:int,n:int,v:bigint,c:bigint,packed:binary>>")
    return materialise(joined.mapInArrow(
        run, fields(joined, ["_id", "_th", "_z"], made)), "packed-texts")


PACKS = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32()), ("v", pa.int64()),
                            ("c", pa.int64()), ("packed", pa.binary())]))


def _windows(packed: pa.Array, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, place in the row and both hashes of every window of the packed strings."""
    out = []
    for first, data, at in chunks(packed):
        words = Words(data, at)
        here = n[first:first + len(at) - 1]
        row = np.repeat(np.arange(len(here)), here)
        place = np.arange(len(row)) - np.repeat(np.cumsum(here) - here, here)
        start = words.first[row] + place
        hashes = [Ranges(words.hashes(data, k), BASES[k]).hash(start, start + WINDOW)
                  for k in (0, 1)]
        out.append((row + first, place, *hashes))
    return tuple(np.concatenate(x) for x in zip(*out))


def _count_in_buckets(packs: DataFrame) -> DataFrame:
    """Spans `a, b` of words that repeated windows cover; `w1, w2, times` where still open."""
    salts = F.ceil(F.col("c") / BUCKET)
    dealt = packs.withColumn("salt", F.pmod(F.xxhash64("_id", "_th", "s"), salts).cast("int"))
    dealt = dealt.repartition(partitions(packs), "v", "salt").sortWithinPartitions("v", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["v", "salt"]):
            table = table.combine_chunks()
            start = table.column("s").to_numpy()
            spread = table.column("c").to_numpy() > BUCKET
            column = table.column("packed").chunk(0)
            row, place, h1, h2 = _windows(column, table.column("n").to_numpy())
            order = np.lexsort((h2, h1))
            a, b = runs(h1[order], h2[order])
            times = np.repeat(b - a, b - a)
            repeated = np.zeros(len(row), bool)
            repeated[order] = times > 1
            at = np.flatnonzero(repeated)
            x, y = runs(row[at], place[at] - np.arange(len(at)))
            # Windows of spread minimisers: single ones wait, of the others one stands for all.
            first = np.zeros(len(row), bool)
            first[order[a]] = True
            still = np.flatnonzero(spread[row] & first)
            single = ~repeated[still]
            pick = np.concatenate([row[at[x]], row[still]])
            begin = start[pick] + np.concatenate([place[at[x]], place[still]])
            end = start[pick] + np.concatenate(
                [place[at[y - 1]] if len(at) else place[:0], place[still]]) + WINDOW
            none = np.concatenate([np.ones(len(x), bool), np.zeros(len(still), bool)])
            yield pa.RecordBatch.from_arrays([
                *[table.column(c).chunk(0).take(pa.array(pick)) for c in ("_id", "_th")],
                pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)),
                *[pa.array(np.concatenate([np.zeros(len(x), np.int64), signed(h[still])]),
                           mask=none) for h in (h1, h2)],
                pa.array(np.concatenate([np.zeros(len(x), np.int32),
                                         np.where(single, 1, 2).astype(np.int32)]), mask=none)],
                names=["_id", "_th", "a", "b", "w1", "w2", "times"])

    made = "a int, b int, w1 long, w2 long, times int"
    return materialise(dealt.mapInArrow(
        run, fields(packs, ["_id", "_th"], made)), "window-counts")


def remove_repeats(docs: DataFrame, text: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: `doc_id, n_words, n_removed, kept`.

    `kept` is the SHA-256 of the kept words joined by single spaces or, with `texts`, that text.
    """
    refs = _super_kmers(docs, text)
    often = materialise(refs.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1"),
                        "shared-minimisers")
    packed = _packed(docs, text, refs.join(often, "v"), texts)
    packs = packed.select("_id", "_th", F.explode("packs").alias("p")).select("_id", "_th", "p.*")
    counted = _count_in_buckets(packs)
    still = counted.filter("times IS NOT NULL")
    again = materialise(still.groupBy("w1", "w2").agg(F.sum("times").alias("total"))
                        .filter("total > 1").drop("total"), "windows-again")
    spans = counted.filter("times IS NULL").select("_id", "_th", "a", "b").unionByName(
        still.filter("times = 1").join(again, ["w1", "w2"]).select("_id", "_th", "a", "b"))
    per_doc = spans.groupBy(F.col("_id").alias("_kid"), F.col("_th").alias("_kth")).agg(
        F.collect_set(F.struct("a", "b")).alias("spans"))
    open_docs = packed.filter("_z IS NOT NULL").select("_id", "_th", "_z", "n_words")
    joined = open_docs.join(per_doc, open_docs["_id"].eqNullSafe(per_doc["_kid"]) & (
        open_docs["_th"] == per_doc["_kth"]), "left").select("_id", "n_words", "_z", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [_result(unsqueeze(z).split(), [(s["a"], s["b"]) for s in spans or []], texts)
                        for z, spans in zip(part.column("_z").to_pylist(),
                                            part.column("spans").to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), part.column("n_words"),
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([d[1] for d in done], pa.string())],
                    names=["_id", "n_words", "n_removed", "kept"])

    schema = fields(joined, ["_id", "n_words"], "n_removed long, kept string")
    done = packed.filter("_z IS NULL").select(
        "_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return done.unionByName(joined.mapInArrow(run, schema)).withColumnRenamed("_id", "doc_id")
