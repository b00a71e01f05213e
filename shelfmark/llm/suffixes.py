"""Removal of byte strings that repeat, by a distributed difference-cover suffix sort.

Strings of 400 bytes of one document are compared. Sorting all suffixes is far more than this
needs, so the cover is chosen by content: of every 190 neighbouring positions the one whose eight
bytes hash least is sampled. Equal 400-byte strings sample the same offset, which is what a
difference cover is for, and only about one position in 95 is sampled.

1. A sampled position's symbol names its next 211 bytes. Positions whose symbol is unique start
   no repeat and are discarded. Symbol and distance to the next sample depend on the text ahead
   alone, so equal text gives equal runs of symbols.
2. Triples of symbols are sorted and named by rank, unique ones discarded; equal runs of symbols
   are named once. Then names recur: the prefix of a sampled suffix that covers a stretch of
   400-byte strings is a triple of names, which may overlap to span any number of symbols from
   three to nine.
3. Prefixes are sorted by their names, and neighbours are compared. Where two are equal, all
   strings of the stretch repeat: the stretch is decided, and the first neighbour stands for all.
   A stretch that needs more symbols, or has none before it to start from, stays open.
4. The remaining suffixes, which start between samples of open stretches, are merged in: each is
   its distance to its sample plus that sample's suffix. They are grouped in stretches of up to
   32 starts around a sample; stretches whose shared text repeats are compared as wholes, and
   only where the wholes differ is each 400-byte string counted by a 128-bit hash.

Null texts are empty. Repeated rows are further places of the same strings. Texts under 400 bytes
lose nothing. An empty table gives no rows. Removal may cut characters; a kept text drops the
bytes left of them, the digest does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import (
    fields, keyed, materialise, nest, partitions, squeezed, unnest,
)
from shelfmark.llm.texthash import (
    BASES, BYTE_VALUES, Ranges, U64, chunks, covered, mix, runs, signed, sliding_first_min,
    unsqueeze,
)

LENGTH = 400
#: Neighbouring starts that share a sample, bytes that are hashed to choose it, bytes it names.
SPREAD, SEED_BYTES = 190, 8
NAMED = LENGTH + 1 - SPREAD
#: Starts that are compared as one.
STRETCH = 32
SHARED_TEXT = LENGTH + 1 - STRETCH
#: Symbols of a name, and of the three names that a prefix has at most.
TRIPLE = 3
LONGEST = 3 * TRIPLE
#: Documents that a task works on at once.
BATCH_ROWS = 256
UNDECIDED, STANDS, DECIDED = 0, 1, 2


def _samples(docs: DataFrame, text: str) -> DataFrame:
    """`_id, _th, t, x, s, e, k`: number, place and symbol of each sample, and the first and
    last start that it serves."""
    rows = keyed(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column("_text")):
                if len(data) < LENGTH:
                    continue
                eight = np.lib.stride_tricks.sliding_window_view(data, SEED_BYTES)
                seeds = mix(np.ascontiguousarray(eight).view("<u8").reshape(-1))
                least = sliding_first_min(seeds, SPREAD)
                size = np.diff(at)
                starts = np.maximum(size - LENGTH + 1, 0)
                row = np.repeat(np.arange(len(size)), starts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + at[row]
                if not len(row):
                    continue
                sample = least[place]
                a, b = runs(sample)
                x, owner = sample[a], row[a]
                names = Ranges(BYTE_VALUES[0][data], BASES[0], long=True).hash(x, x + NAMED)
                number = np.arange(len(a)) - np.searchsorted(owner, owner)
                base = at[owner]
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(pa.array(first + owner)) for c in ("_id", "_th")],
                    *[pa.array(v.astype(np.int32)) for v in (
                        number, x - base, place[a] - base, place[b - 1] - base)],
                    pa.array(signed(names))], names=["_id", "_th", "t", "x", "s", "e", "k"])

    made = "t int, x int, s int, e int, k long"
    return materialise(rows.mapInArrow(run, fields(rows, ["_id", "_th"], made)), "samples")


def _strings(samples: DataFrame) -> DataFrame:
    """`sid, _id, _th, samples`: the samples of shared symbols of every document, in order."""
    shared = materialise(samples.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1")
                         .select("k"), "shared-symbols")
    return materialise(
        samples.join(shared, "k").groupBy("_id", "_th").agg(
            F.sort_array(F.collect_set(F.struct("t", "x", "s", "e", "k"))).alias("samples"))
        .withColumn("sid", F.monotonically_increasing_id()), "symbol-strings")


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the items of consecutive rows: the row, and the place in it."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(strings: DataFrame) -> DataFrame:
    """`sid, v, keys, places`: the unbroken runs of three shared symbols and more, the number of
    each one's first sample in its string, its symbols, and `x, s, e` of its samples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, p = unnest(batch.column("samples"))
            row, u = _spread(sizes)
            if not len(row):
                continue
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (p["t"][1:] != p["t"][:-1] + 1)
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(row)))
            long = length >= TRIPLE
            at = np.flatnonzero(long[np.cumsum(new) - 1])
            first, length = first[long], length[long]
            offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sid").take(pa.array(row[first])), _int32(u[first]),
                 pa.ListArray.from_arrays(offsets, pa.array(p["k"][at])),
                 nest(length, **{c: _int32(p[c][at]) for c in ("x", "s", "e")})],
                names=["sid", "v", "keys", "places"])

    made = "sid long, v int, keys array<long>, places array<struct<x:int,s:int,e:int>>"
    return materialise(strings.select("sid", "samples").mapInArrow(run, made), "symbol-runs")


def _names(runs: DataFrame) -> DataFrame:
    """`keys, names`: for every different run, the places `u` in it where a shared triple of
    symbols begins, with the triple's name, its rank among all shared triples.

    Copies of a run are named once, so the join with the names follows the different runs, not
    their copies; a triple is shared if it occurs twice, copies counted.
    """
    kinds = materialise(runs.groupBy("keys").agg(F.count("*").alias("copies"))
                        .withColumn("rid", F.monotonically_increasing_id()), "different-runs")
    triple = ["k0", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("keys").value_lengths().to_numpy().astype(np.int64)
            keys = batch.column("keys").flatten().to_numpy()
            row, u = _spread(sizes - (TRIPLE - 1))
            at = (np.cumsum(sizes) - sizes)[row] + u
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(row)) for c in ("rid", "copies")], _int32(u),
                 *[pa.array(keys[at + d]) for d in range(TRIPLE)]],
                names=["rid", "copies", "u", *triple])

    suffixes = materialise(kinds.mapInArrow(
        run, "rid long, copies long, u int, k0 long, k1 long, k2 long"), "suffixes")
    ranked = materialise(
        suffixes.groupBy(*triple).agg(F.sum("copies").alias("c")).filter("c > 1")
        .select(*triple).orderBy(*triple)
        .withColumn("name", F.monotonically_increasing_id() + 1), "triple-names")
    named = suffixes.join(ranked, triple).groupBy("rid").agg(
        F.collect_list(F.struct("u", "name")).alias("names"))
    return kinds.join(named, "rid").select("keys", "names")


def _prefixes(runs: DataFrame) -> DataFrame:
    """`shape, n0, n1, n2, sid, v`: the names of the prefix that covers stretch `v` of a string.

    The prefix begins some samples before that of the same number (`back`) and has q symbols, 0
    if its run ends before or it would be too long; its names are those at its start and,
    overlapping if need be, up to its end. Neighbouring stretches may have one prefix: the shape
    tells q and which of the symbols (`back`) is the stretch's own.
    """
    named = runs.join(_names(runs), "keys").select("sid", "v", "places", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, p = unnest(batch.column("places"))
            row, u = _spread(sizes)
            n = len(row)
            index = np.arange(n)
            first = index - u
            end = first + sizes[row]
            base = row << 32
            place = base + p["x"]
            start = np.searchsorted(place, base + p["s"], side="right") - 1
            last = np.searchsorted(place, base + p["e"] + (LENGTH - NAMED), side="left")
            q = np.maximum(last - start + 1, TRIPLE)
            known = (start >= first) & (last < end) & (start + q <= end) & (q <= LONGEST)
            start, q = np.where(known, start, index), np.where(known, q, 0)
            said, m = unnest(batch.column("names"))
            names = np.zeros(n, np.int64)
            names[(np.cumsum(sizes) - sizes)[_spread(said)[0]] + m["u"]] = m["name"]
            tail = np.maximum(start + q - TRIPLE, 0)
            n0, n1, n2 = (np.zeros(n, np.int64) for _ in range(3))
            n0[known] = names[start[known]]
            middle, long = (q > TRIPLE) & (q <= 2 * TRIPLE), q > 2 * TRIPLE
            n1[middle] = names[tail[middle]]
            n1[long] = names[start[long] + TRIPLE]
            n2[long] = names[tail[long]]
            whole = known & (n0 > 0) & ((q <= TRIPLE) | (n1 > 0)) & (~long | (n2 > 0))
            at = np.flatnonzero(whole)
            v = batch.column("v").to_numpy()[row] + u
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c[at]) for c in (q * LONGEST + (index - start), n0, n1, n2)],
                 batch.column("sid").take(pa.array(row[at])), _int32(v[at])],
                names=["shape", "n0", "n1", "n2", "sid", "v"])

    made = "shape long, n0 long, n1 long, n2 long, sid long, v int"
    return materialise(named.mapInArrow(run, made), "prefixes")


PREFIX = ["shape", "n0", "n1", "n2"]


def _decided(prefixes: DataFrame) -> DataFrame:
    """`sid, v, state` of the stretches whose prefix equals a neighbour's in the sorted order."""
    ordered = prefixes.repartitionByRange(partitions(prefixes), *PREFIX, "sid", "v") \
        .sortWithinPartitions(*PREFIX, "sid", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last two rows stay: one waits for the row after it, which is compared with both.
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            yield _states(table, held is not None and held.num_rows > 1, False)
            held = table.slice(max(table.num_rows - 2, 0))
        if held is not None:
            yield _states(held, held.num_rows > 1, True)

    return materialise(ordered.mapInArrow(run, "sid long, v int, state int"), "decided")


def _states(table: pa.Table, begun: bool, ends: bool) -> pa.RecordBatch:
    """What neighbours decide about all rows but the last, which is told only if the order
    `ends` with it; the first was told before if `begun`."""
    same = np.ones(table.num_rows - 1, bool)
    for name in PREFIX:
        c = table.column(name).to_numpy()
        same &= c[1:] == c[:-1]
    back, on = np.append(False, same), np.append(same, False)
    state = np.where(back, DECIDED, np.where(on, STANDS, UNDECIDED))
    told = np.ones(table.num_rows, bool)
    told[0] = not begun
    told[-1] = ends
    at = np.flatnonzero(told & (state != UNDECIDED))
    return pa.RecordBatch.from_arrays(
        [pa.array(table.column("sid").to_numpy()[at]), pa.array(table.column("v").to_numpy()[at]),
         _int32(state[at])], names=["sid", "v", "state"])


def _finished(body: bytes, starts: np.ndarray, ends: np.ndarray, texts: bool) -> tuple:
    """n_bytes, n_removed, n_spans, kept."""
    if not len(starts):
        kept, removed, n_spans = body, 0, 0
    else:
        gone = covered(len(body), starts, ends)
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        removed, n_spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    return (len(body), removed, n_spans, kept.decode("utf-8", "ignore") if texts
            else hashlib.sha256(kept).hexdigest())


RESULT = ["n_bytes", "n_removed", "n_spans", "kept"]
RESULT_DDL = "n_bytes long, n_removed long, n_spans long, kept string"


def _result_arrays(rows: list[tuple | None]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return [pa.array([r and r[k] for r in rows], t) for k, t in enumerate(kinds)]


SPANS_DDL = "array<struct<a:int,b:int>>"


def _int32(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _nested_spans(rows: int, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Spans [a, b) of the rows, in order of row and start, neighbours that touch joined."""
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (a[1:] > b[:-1])
        first = np.flatnonzero(new)
        row, a, b = row[first], a[first], np.maximum.reduceat(b, first)
    return nest(np.bincount(row, minlength=rows), a=_int32(a), b=_int32(b))


def _hashed(bodies: list[bytes]) -> tuple[list[Ranges], np.ndarray]:
    """Range hashes over all bodies end to end, and where each begins."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.cumsum([0, *map(len, bodies)])
    return [Ranges(values[data], b, long=True) for values, b in zip(BYTE_VALUES, BASES)], base


def _stretches(hashes: list[Ranges], base: np.ndarray, rows: int, row, x, s, e, state) -> pa.Array:
    """The stretches of open samples: what they share (`g`) and what they hold (`c1, c2`)."""
    low, high = (x - e) // STRETCH, (x - s) // STRETCH
    owner, j = _spread(high - low + 1)
    j = j + low[owner]
    xo, bo = x[owner], base[row[owner]]
    first = np.maximum(s[owner], xo - j * STRETCH - STRETCH + 1)
    last = np.minimum(e[owner], xo - j * STRETCH)
    common = bo + xo - j * STRETCH
    shared = mix(hashes[0].hash(common, common + SHARED_TEXT) + j.astype(U64))
    places = mix(((xo - first) * 1_000 + (xo - last)).astype(U64))
    whole = [mix(h.hash(bo + first, bo + last + LENGTH) + places) for h in hashes]
    return nest(np.bincount(row[owner], minlength=rows), g=pa.array(signed(shared)),
                c1=pa.array(signed(whole[0])), c2=pa.array(signed(whole[1])), s=_int32(first),
                e=_int32(last), times=_int32(np.where(state[owner] == STANDS, 2, 1)))


def _join_texts(texts: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnsRenamed({"_id": "_kid", "_th": "_kth"})
    return texts.join(found, texts["_id"].eqNullSafe(found["_kid"]) & (
        texts["_th"] == found["_kth"]), "left").drop("_kid", "_kth")


def _first_pass(docs: DataFrame, text: str, strings: DataFrame, texts: bool,
                carry: list[str]) -> DataFrame:
    """Finished documents without shared symbols; of the others the text, the decided spans and
    the stretches left to merge."""
    states = _decided(_prefixes(_runs(strings))).groupBy("sid").agg(
        F.collect_list(F.struct("v", "state")).alias("states"))
    found = strings.join(states, "sid", "left").select("_id", "_th", "samples", "states")
    # The other columns of a document travel as one, whatever their names.
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row")
            for _ in carry]
    joined = _join_texts(squeezed(docs, text, rest, carry), found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                sizes, p = unnest(batch.column("samples"))
                row, _ = _spread(sizes)
                said, q = unnest(batch.column("states"))
                state = np.full(len(row), UNDECIDED)
                state[(np.cumsum(sizes) - sizes)[_spread(said)[0]] + q["v"]] = q["state"]
                zs = batch.column("_z").to_pylist()
                bodies = [unsqueeze(z) for z in zs]
                none = np.zeros(0, np.int64)
                done = [None if n else _finished(body, none, none, texts)
                        for n, body in zip(sizes, bodies)]
                x, s, e = (p[c].astype(np.int64) for c in ("x", "s", "e"))
                sure, left = state != UNDECIDED, state != DECIDED
                hashes, base = _hashed([body if n else b"" for n, body in zip(sizes, bodies)])
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c) for c in ["_id", "_th", *carry]],
                    pa.array([z if n else None for n, z in zip(sizes, zs)], pa.binary()),
                    *_result_arrays(done),
                    _nested_spans(len(zs), row[sure], s[sure], e[sure] + LENGTH),
                    _stretches(hashes, base, len(zs), *[c[left] for c in (row, x, s, e, state)])],
                    names=["_id", "_th", *carry, "_z", *RESULT, "spans", "stretches"])

    made = (f"{RESULT_DDL}, spans {SPANS_DDL}, "
            "stretches array<struct<g:long,c1:long,c2:long,s:int,e:int,times:int>>")
    return materialise(joined.mapInArrow(
        run, fields(joined, ["_id", "_th", *carry, "_z"], made)), "first-pass")


def _merged(first: DataFrame) -> DataFrame:
    """`_id, _th, merged`: stretches that repeat whole, or whose strings must be counted.

    `sure`: the stretch as it is occurs twice or more. `count`: other stretches share its text,
    and this one stands for all like it.
    """
    rows = first.select("_id", "_th", F.explode("stretches").alias("p")).select("_id", "_th", "p.*")
    whole = ["g", "c1", "c2"]
    wholes = materialise(rows.groupBy(*whole).agg(
        F.sum("times").alias("total"),
        F.min(F.struct("_id", "_th", "s")).alias("stand")), "whole-stretches")
    mixed = materialise(wholes.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
                        .select("g", F.lit(True).alias("mixed")), "mixed-stretches")
    judged = materialise(wholes.join(mixed, "g", "left").filter("total > 1 OR mixed").select(
        *whole, "total", "stand", F.coalesce("mixed", F.lit(False)).alias("mixed")),
        "judged-stretches")
    stands = (F.col("stand._id").eqNullSafe(F.col("_id")) & (F.col("stand._th") == F.col("_th"))
              & (F.col("stand.s") == F.col("s")))
    kept = rows.join(judged, whole).select(
        "_id", "_th", "s", "e", (F.col("total") > 1).alias("sure"),
        (F.col("mixed") & stands).alias("count"))
    return kept.filter("sure OR count").groupBy("_id", "_th").agg(
        F.collect_set(F.struct("s", "e", "sure", "count")).alias("merged"))


def _second_pass(first: DataFrame, texts: bool, carry: list[str]) -> DataFrame:
    """Finished documents, or text and spans of those with strings left to count; `windows`."""
    open_docs = first.filter("_z IS NOT NULL").select("_id", "_th", *carry, "_z", "spans")
    joined = _join_texts(open_docs, _merged(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                n = batch.num_rows
                zs = batch.column("_z").to_pylist()
                bodies = [unsqueeze(z) for z in zs]
                sizes, p = unnest(batch.column("spans"))
                merged, m = unnest(batch.column("merged"))
                owner = _spread(merged)[0]
                sure, count = (m[c].astype(bool) for c in ("sure", "count"))
                row = np.concatenate([_spread(sizes)[0], owner[sure]])
                a = np.concatenate([p["a"], m["s"][sure]]).astype(np.int64)
                b = np.concatenate([p["b"], m["e"][sure] + LENGTH]).astype(np.int64)
                order = np.lexsort((b, a, row))
                row, a, b = row[order], a[order], b[order]
                ends = np.searchsorted(row, np.arange(n + 1))
                waits = np.zeros(n, bool)
                waits[owner[count & ~sure]] = True
                done = [None if w else _finished(body, a[i:j], b[i:j], texts)
                        for w, body, i, j in zip(waits, bodies, ends, ends[1:])]
                keep = waits[row]
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c) for c in ["_id", "_th", *carry]],
                    pa.array([z if w else None for w, z in zip(waits, zs)], pa.binary()),
                    *_result_arrays(done), _nested_spans(n, row[keep], a[keep], b[keep]),
                    _windows(bodies, owner[count], *[m[c][count].astype(np.int64)
                                                     for c in ("s", "e")], sure[count])],
                    names=["_id", "_th", *carry, "_z", *RESULT, "spans", "windows"])

    made = (f"{RESULT_DDL}, spans {SPANS_DDL}, "
            "windows array<struct<i:int,w1:long,w2:long,times:int>>")
    return materialise(joined.mapInArrow(
        run, fields(joined, ["_id", "_th", *carry, "_z"], made)), "second-pass")


def _windows(bodies: list[bytes], row: np.ndarray, s: np.ndarray, e: np.ndarray,
             sure: np.ndarray) -> pa.Array:
    """Both hashes of every string that starts in one of the stretches of the rows."""
    order = np.argsort(row, kind="stable")
    row, s, e, sure = row[order], s[order], e[order], sure[order]
    owner, place = _spread(e + 1 - s)
    used = np.isin(np.arange(len(bodies)), row)
    hashes, base = _hashed([body if u else b"" for body, u in zip(bodies, used)])
    start = s[owner] + place
    at = base[row[owner]] + start
    w1, w2 = (signed(h.hash(at, at + LENGTH)) for h in hashes)
    return nest(np.bincount(row[owner], minlength=len(bodies)), i=_int32(start),
                w1=pa.array(w1), w2=pa.array(w2), times=_int32(np.where(sure[owner], 2, 1)))


def _third_pass(second: DataFrame, texts: bool, carry: list[str]) -> DataFrame:
    """The documents that waited for the count of single strings."""
    rows = second.select("_id", "_th", F.explode("windows").alias("w")).select("_id", "_th", "w.*")
    often = materialise(rows.groupBy("w1", "w2").agg(F.sum("times").alias("n")).filter("n > 1")
                        .select("w1", "w2"), "repeated-strings")
    found = rows.filter("times = 1").join(often, ["w1", "w2"]).groupBy("_id", "_th").agg(
        F.collect_set("i").alias("starts"))
    waiting = second.filter("_z IS NOT NULL").select(
        "_id", "_th", *carry, "_z", "spans")
    joined = _join_texts(waiting, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for z, spans, starts in zip(*[batch.column(c).to_pylist() for c in (
                    "_z", "spans", "starts")]):
                more = np.array(starts or [], np.int64)
                done.append(_finished(
                    unsqueeze(z), np.append(more, [p["a"] for p in spans]).astype(np.int64),
                    np.append(more + LENGTH, [p["b"] for p in spans]).astype(np.int64), texts))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ["_id", *carry]], *_result_arrays(done)],
                names=["_id", *carry, *RESULT])

    return joined.mapInArrow(run, fields(joined, ["_id", *carry], RESULT_DDL))


def _results(docs: DataFrame, text: str, texts: bool, carry: list[str]) -> DataFrame:
    strings = _strings(_samples(docs, text))
    first = _first_pass(docs, text, strings, texts, carry)
    second = _second_pass(first, texts, carry)
    done = [d.filter("kept IS NOT NULL").select("_id", *carry, *RESULT) for d in (first, second)]
    return done[0].unionByName(done[1]).unionByName(_third_pass(second, texts, carry))


def remove_repeats(docs: DataFrame, text: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: `doc_id, n_bytes, n_removed, n_spans, kept`.

    `kept` is the SHA-256 of the kept bytes or, with `texts`, the kept text.
    """
    return _results(docs, text, texts, []).withColumnRenamed("_id", "doc_id")


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all their columns, with the kept text in place of the text."""
    done = _results(docs, text, True, ["_row"])
    return done.select(*[F.col("kept").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c)
                         for c in docs.columns])
