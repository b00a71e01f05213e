"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct five-word shingles (words of its lower-cased text; the
whole sequence if it has fewer words). For each register every shingle draws an exponential
value; the register keeps the exponent, to a base slightly above one, of the smallest. Equal
sets form one class. Classes that agree in all registers of some band meet in that band's
bucket. Where they meet, similarity is first estimated from both sketches together, by maximum
likelihood over the numbers of larger, equal and smaller registers; pairs the estimate does not
rule out are confirmed on the full sets. Links have 100 * intersection >= 75 * union.

Every class first meets the class it shares most buckets with. Buckets that still hold several
components are then searched whole, in blocks, for links between components. So no pair is lost
that shares a bucket, copies are never paired, and no bucket is one task. A pair at the threshold
shares no bucket with a probability of 5e-6; higher similarities far less.

Null texts and texts without words have no shingles, link with nothing, and are their own
component. Repeated rows are copies of one class. Null ids are passed over when the smallest id
of a component is taken. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import (
    fields, group_starts, keyed, materialise, partitions, release, squeezed, whole_groups,
)
from shelfmark.llm.graph import components
from shelfmark.llm.outliers import HAS_WORD
from shelfmark.llm.texthash import (
    TO_LOWER, Ranges, U64, Words, chunks, mix, signed, unsqueeze,
)

WIDTH = 5
ROWS, BANDS = 4, 32
REGISTERS = ROWS * BANDS
#: Rate and base of the register values, and the largest exponent.
RATE, BASE, TOP = 20.0, 1.001, 65_535
#: Similarity at least SHARED / 100; pairs are ruled out below the estimate RULED_OUT, five
#: standard deviations of the estimate under the threshold.
SHARED, RULED_OUT = 75, 0.56
#: Classes that meet in one block.
BLOCK = 512
SHINGLE_BASE = 0xA24BAED4963EE407
_draw = np.random.default_rng(20_240_601)
SALT = _draw.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
FACTOR = _draw.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row of a chunk of texts."""
    data = TO_LOWER[data]
    words = Words(data, at)
    ranges = Ranges(words.hashes(data), SHINGLE_BASE)
    out = []
    starts = np.arange(len(words.start))
    last = words.first[1:][words.row]  # end of the row of each word
    ends = np.minimum(starts + WIDTH, last)
    hashes = ranges.hash(starts, ends)
    for r, n in enumerate(words.count):
        first = words.first[r]
        keep = max(1, n - WIDTH + 1) if n else 0
        out.append(np.unique(hashes[first:first + keep]))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set of shingle hashes."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (shingles >> U64(32)).astype(np.uint32)
    for at in range(0, len(short), 256):
        x = (short[at:at + 256, None] ^ SALT) * FACTOR
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        np.minimum(least, x.min(axis=0), out=least)
    smallest = -np.log1p(-(least + 0.5) / 2.0 ** 32) / RATE
    exponent = np.floor(1.0 - np.log(smallest) / np.log(BASE))
    return np.clip(exponent, 0, TOP).astype(np.uint16)


def _sketches(docs: DataFrame, text: str) -> DataFrame:
    """Per document: number of shingles, 128-bit fingerprint of the set, sketch."""
    rows = keyed(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column("_text")):
                sets = shingle_sets(data, at)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(first, len(sets)) for c in ("_id", "_th")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(signed(mix(s).sum(keepdims=True))[0]) for s in sets], pa.int64()),
                    pa.array([int(signed(mix(s ^ U64(SHINGLE_BASE)).sum(keepdims=True))[0])
                              for s in sets], pa.int64()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets],
                             pa.binary())],
                    names=["_id", "_th", "n", "f1", "f2", "regs"])

    made = "n long, f1 long, f2 long, regs binary"
    return materialise(rows.mapInArrow(run, fields(rows, ["_id", "_th"], made)), "sketches")


def _buckets(classes: DataFrame) -> DataFrame:
    """`bucket, cid`: one row per class and band, for buckets of two classes or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = mix(np.arange(1, ROWS + 1, dtype=U64))
        band = mix(np.arange(100, 100 + BANDS, dtype=U64))
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16)
            values = mix((regs.reshape(-1, BANDS, ROWS).astype(U64) * scale).sum(axis=2) ^ band)
            cid = batch.column("cid").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(values.reshape(-1))), pa.array(np.repeat(cid, BANDS))],
                names=["bucket", "cid"])

    every = materialise(classes.select("cid", "regs").mapInArrow(run, "bucket long, cid long"),
                        "band-values")
    shared = materialise(every.groupBy("bucket").agg(
        F.count("*").alias("members"), F.min("cid").alias("leader")).filter("members > 1"),
        "shared-buckets")
    return materialise(every.join(shared, "bucket"), "buckets")


def _sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """`cid, n, regs, shingles` for the wanted classes, read from one document of each."""
    texts = squeezed(docs, text).dropDuplicates(["_id", "_th"])
    rows = texts.join(wanted, texts["_id"].eqNullSafe(wanted["rid"]) & (
        texts["_th"] == wanted["rth"])).select("cid", "n", "regs", "_z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.array([unsqueeze(v) for v in batch.column("_z").to_pylist()], pa.binary())
            for first, data, at in chunks(plain):
                sets = shingle_sets(data, at)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(first, len(sets)) for c in ("cid", "n", "regs")],
                     pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["cid", "n", "regs", "shingles"])

    return materialise(rows.mapInArrow(
        run, "cid long, n long, regs binary, shingles binary"), "shingle-sets")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Likeliest similarity of each pair of sketches, given the sizes of the two sets."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = REGISTERS - more - less
    u = na / (na + nb)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.linspace(0.002, 0.998, 250)
    best, value = np.full(len(a), -np.inf), np.zeros(len(a))
    for j in grid:
        j = np.minimum(j, most - 1e-9)
        pa_, pb_ = (-np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
                    for x in (u - (1 - u) * j, (1 - u) - u * j))
        score = (more * np.log(pa_) + less * np.log(pb_)
                 + equal * np.log(np.maximum(1 - pa_ - pb_, 1e-12)))
        better = score > best
        best[better], value[better] = score[better], j[better]
    return value


def links_in(cid: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray,
             sets: list[bytes]) -> list[tuple[int, int]]:
    """Links that join components within one group, enough to join all that are linked."""
    i, j = np.triu_indices(len(cid), 1)
    keep = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= SHARED * np.maximum(n[i], n[j]))
    i, j = i[keep], j[keep]
    if not len(i):
        return []
    guess = np.concatenate([estimate(regs[i[k:k + 8192]], regs[j[k:k + 8192]],
                                     n[i[k:k + 8192]], n[j[k:k + 8192]])
                            for k in range(0, len(i), 8192)])
    order = np.argsort(-guess, kind="stable")
    order = order[guess[order] >= RULED_OUT]
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out, plain = [], [np.frombuffer(s, U64) for s in sets]
    for k in order:
        x, y = int(i[k]), int(j[k])
        cx, cy = find(int(comp[x])), find(int(comp[y]))
        if cx == cy:
            continue
        both = len(np.intersect1d(plain[x], plain[y], assume_unique=True))
        if 100 * both >= SHARED * (len(plain[x]) + len(plain[y]) - both):
            root[cx] = cy
            out.append((int(cid[x]), int(cid[y])))
    return out


def _links(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Links found in groups of rows `*keys, cid, comp, n, regs, shingles`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("bpe:")
        for table in whole_groups(batches, keys):
            starts = np.append(group_starts(table, keys), table.num_rows)
            found = []
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a < 2:
                    continue
                part = table.slice(a, b - a)
                regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16)
                found += links_in(
                    part.column("cid").to_numpy(), part.column("comp").to_numpy(),
                    part.column("n").to_numpy(), regs.reshape(-1, REGISTERS),
                    part.column("shingles").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = groups.repartition(partitions(groups), *keys).sortWithinPartitions(*keys)
    return materialise(dealt.mapInArrow(run, "a long, b long"), name)


def _first_meetings(buckets: DataFrame) -> DataFrame:
    """`leader, block, cid`: each class with the leader it shares most buckets with.

    The leader joins every block of its group.
    """
    pairs = buckets.filter("cid <> leader").groupBy("cid", "leader").agg(F.count("*").alias("n"))
    chosen = materialise(pairs.groupBy("cid").agg(
        F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader")), "leaders")
    sizes = materialise(chosen.groupBy("leader").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "leader-blocks")
    members = chosen.join(sizes, "leader").select(
        "leader", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"), "cid")
    own = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
                       .alias("block"), F.col("leader").alias("cid"))
    return members.unionByName(own)


def _mixed_buckets(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """`g1, g2, i, j, cid, comp`: members of buckets that hold several components.

    Buckets with the same members are searched once. A member of a large bucket meets every
    block of it in pairs of blocks (i, j).
    """
    labelled = buckets.select("bucket", "cid").join(
        comps.withColumnRenamed("node", "cid"), "cid", "left").select(
        "bucket", "cid", F.coalesce("component", "cid").alias("comp"))
    labelled = materialise(labelled, "labelled-buckets")
    groups = labelled.groupBy("bucket").agg(
        F.count("*").alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.sum(F.xxhash64("cid").bitwiseAND((1 << 40) - 1)).alias("g1"),
        F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("g2")).filter("low <> high")
    once = materialise(groups.groupBy("g1", "g2").agg(
        F.min("bucket").alias("bucket"), F.first("members").alias("members")), "mixed-buckets")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    member = labelled.join(once, "bucket").withColumn("nb", blocks).withColumn(
        "own", F.pmod(F.xxhash64("cid"), "nb").cast("int"))
    met = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return met.select("g1", "g2", F.least("own", "other").alias("i"),
                      F.greatest("own", "other").alias("j"), "cid", "comp")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: `doc_id, _id, _th, n_shingles, component_id, kept, group`.

    `group` numbers the components, also those without an id; null without shingles.
    """
    sketches = _sketches(docs, text)
    grouped = sketches.filter("n > 0").groupBy("f1", "f2").agg(
        F.min("_id").alias("min_id"), F.first("n").alias("n"),
        F.min(F.struct("_id", "_th", "regs")).alias("r"))
    classes = materialise(grouped.select(
        F.monotonically_increasing_id().alias("cid"), "f1", "f2", "min_id", "n",
        F.col("r._id").alias("rid"), F.col("r._th").alias("rth"), F.col("r.regs").alias("regs")),
        "set-classes")
    buckets = _buckets(classes)
    wanted = classes.select("cid", "n", "regs", "rid", "rth").join(
        buckets.select("cid").distinct(), "cid")
    sets = _sets(docs, text, wanted)
    first = _links(_first_meetings(buckets).join(sets, "cid").withColumn("comp", F.col("cid")),
                   ["leader", "block"], "first-links")
    comps = materialise(components(first, "first"), "first-components")
    rest = _links(_mixed_buckets(buckets, comps).join(sets, "cid"),
                  ["g1", "g2", "i", "j"], "rest-links")
    comps = materialise(components(first.unionByName(rest), "all"), "components")
    labelled = classes.select("cid", "f1", "f2", "min_id").join(
        comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    lowest = materialise(labelled.groupBy("component").agg(
        F.min("min_id").alias("component_id")), "lowest-ids")
    named = materialise(labelled.join(lowest, "component").select(
        F.col("f1").alias("g1"), F.col("f2").alias("g2"), "component_id",
        F.col("component").alias("group")), "class-names")
    on = (sketches["f1"] == named["g1"]) & (sketches["f2"] == named["g2"]) & (sketches["n"] > 0)
    return sketches.join(named, on, "left").select(
        F.col("_id").alias("doc_id"), "_id", "_th", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
        .alias("component_id"), "group").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents without their near-duplicates: of every group the row of smallest id stays
    (nulls last, then the smallest text hash), of repeated rows one. Wordless rows all stay."""
    found = near_duplicates(docs, text)
    chosen = found.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct(
        F.col("_id").isNull().alias("no_id"), "_id", "_th")).alias("r"))
    stays = chosen.select(F.col("r._id").alias("_kid"), F.col("r._th").alias("_kth"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col("doc_id").alias("_id"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"),
                       F.coalesce(F.col(text).rlike(HAS_WORD), F.lit(False)).alias("_worded"))
    kept = rows.filter("_worded").join(
        stays, rows["_id"].eqNullSafe(stays["_kid"]) & (rows["_th"] == stays["_kth"]),
        "left_semi").dropDuplicates(["_id", "_th"])
    return kept.select("_row.*").unionByName(rows.filter("NOT _worded").select("_row.*"))
