"""Jaccard join of documents' n-gram sets over prefix trees.

A document is the set of its distinct three-word shingles (words of its lower-cased text; the
whole sequence if it has fewer words). Equal sets form one class; classes link when 100 *
intersection >= 90 * union.

All shingles have one global order: first those of a sixth of the hash space, by the number of
classes that hold them, then the others by hash. Two linked sets share a shingle among the first
tenth or so of each (a set of n may miss n - ceil(0.9 n) of its own), so classes meet in shards
named by such a shingle. Shingles of one class name no shard, so most shards hold true neighbours.

A shard stores its sets in a prefix tree, shingles ordered by the number of its sets that hold
them, so that sets with a common beginning share its nodes. The sets then descend the tree: a
node's overlap is counted once for all sets under it, and a set leaves a subtree as soon as its
overlap so far plus the shingles left on either side cannot reach the limit for any set size under
it. Subtrees that are known to be in the probing set's component, or that met it before, are passed
over. Overlaps at the leaves are exact.

Every class first meets the class it shares most shards with, its leader, and all others of that
leader, in blocks. A shard whose members met in one block, or are one component by then, is done.
The others are searched whole: their members are dealt to blocks by where they met first, and
blocks meet in pairs. No link between components is lost, no shard is one task, and classes that
met before do not meet again in blocks of their own.

Null texts and texts without words have no shingles, link with nothing and are their own
component. Repeated rows and copies are one class. Null ids are passed over when the smallest id
of a component is taken. Very long texts are worked on whole. An empty table gives no rows; other
columns of the table are not read.
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
from shelfmark.llm.texthash import TO_LOWER, U64, Words, chunks, mix, signed, unsqueeze

WIDTH = 3
#: Similarity of at least SHARED / 100.
SHARED = 90
#: Sets of fewer shingles link with equal ones only.
LEAST = SHARED // (100 - SHARED)
#: Shingles with hashes below this are counted and come first in the global order.
COUNTED = (1 << 64) // 6
#: Sets that meet in one block.
BLOCK = 512
#: Sets that descend a tree at once, and cells (shingles by sets) that this may take.
PROBES, CELLS = 128, 1 << 22
_STEP = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_FINGER = U64(0x165667B19E3779F9)
_TOP = 1 << 63


def ngram_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row of a chunk of texts."""
    data = TO_LOWER[data]
    words = Words(data, at)
    one = words.hashes(data)
    two = mix(mix(one[:-1]) + one[1:] * _STEP[0])
    three = mix(two[:-1] + one[2:] * _STEP[1])
    out = []
    for first, n in zip(words.first.tolist(), words.count.tolist()):
        if n >= WIDTH:
            out.append(np.unique(three[first:first + n - WIDTH + 1]))
        else:
            out.append(two[first:first + 1] if n == 2 else mix(one[first:first + n]))
    return out


def prefix_size(n: int) -> int:
    """Shingles of a set of n of which a linked set must share one."""
    return n - -(-SHARED * n // 100) + 1


def _sketches(docs: DataFrame, text: str) -> DataFrame:
    """`_id, _th, n, f1, f2, counted, keys`: size and 128-bit fingerprint of each set, and the
    shingles that may be in its prefix (hashes as longs of the same order), `counted` of them from
    the counted part."""
    rows = keyed(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column("_text")):
                sets = ngram_sets(data, at)
                counted = [int(np.searchsorted(s, U64(COUNTED))) for s in sets]
                keys = [signed(s[:max(c, prefix_size(len(s)))] ^ U64(_TOP))
                        if len(s) >= LEAST else np.zeros(0, np.int64)
                        for s, c in zip(sets, counted)]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(first, len(sets)) for c in ("_id", "_th")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    *[pa.array([int(signed(mix(s ^ f).sum(keepdims=True))[0]) for s in sets],
                               pa.int64()) for f in (U64(0), _FINGER)],
                    pa.array(counted, pa.int32()),
                    pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate(keys))],
                    names=["_id", "_th", "n", "f1", "f2", "counted", "keys"])

    made = "n long, f1 long, f2 long, counted int, keys array<long>"
    return materialise(rows.mapInArrow(run, fields(rows, ["_id", "_th"], made)), "ngram-sketches")


def _shards(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """`shard, cid, leader`: the prefix shingles that two classes or more have in their prefix,
    with the smallest of these classes."""
    reps = classes.select("cid", F.col("rid").alias("_id"), F.col("rth").alias("_th"))
    own = sketches.filter(f"n >= {LEAST}").select("_id", "_th", "keys")
    on = own["_id"].eqNullSafe(reps["_id"]) & (own["_th"] == reps["_th"])
    pairs = materialise(
        own.join(reps, on).dropDuplicates(["cid"]).select("cid", F.explode("keys").alias("key")),
        "ngram-keys")
    shared = materialise(pairs.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"),
                         "shared-ngrams")
    late = (F.col("key") >= COUNTED - _TOP).cast("int")
    ordered = pairs.join(shared, "key").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct(
        late.alias("late"), F.when(late == 0, F.col("c")).otherwise(0).alias("c"), "key")))
        .alias("keys"))
    early = F.filter("keys", lambda k: k["late"] == 0)
    prefix = F.col("n") - F.ceil(F.col("n") * SHARED / 100) + 1
    # The counted shingles of this class alone come first in the order and name no shard.
    left = F.greatest(prefix - (F.col("counted") - F.size(early)), F.lit(0)).cast("int")
    named = ordered.join(classes.select("cid", "n", "counted"), "cid").select("cid", F.explode(
        F.concat(F.slice(early, F.lit(1), left), F.filter("keys", lambda k: k["late"] == 1)))
        .alias("k")).select("cid", F.col("k.key").alias("shard"))
    named = materialise(named, "prefix-ngrams")
    several = named.groupBy("shard").agg(F.count("*").alias("c"), F.min("cid").alias("leader"))
    return materialise(named.join(several.filter("c > 1").drop("c"), "shard"), "ngram-shards")


def _sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """`cid, shingles` for the wanted classes, from the text of one document of each."""
    texts = squeezed(docs, text)
    rows = texts.join(wanted, texts["_id"].eqNullSafe(wanted["rid"]) & (
        texts["_th"] == wanted["rth"])).dropDuplicates(["cid"]).select("cid", "_z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.array([unsqueeze(v) for v in batch.column("_z").to_pylist()], pa.binary())
            for first, data, at in chunks(plain):
                sets = ngram_sets(data, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cid").slice(first, len(sets)),
                     pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["cid", "shingles"])

    return materialise(rows.mapInArrow(run, "cid long, shingles binary"), "ngram-sets")


class Tree:
    """A prefix tree over sets of ranks, sorted; a node holds the ranks that its sets share next.

    `rows` are the sets in the order of the tree; node k covers rows begin[k] to end[k] - 1.
    """

    def __init__(self, rows: list[np.ndarray]):
        common = [0]
        for a, b in zip(rows[:-1], rows[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        lcp, size = np.array(common), np.array([len(r) for r in rows])
        self.part, self.depth, self.begin, self.end = [], [], [], []
        self.low, self.high, self.whole, self.children = [], [], [], []
        todo = [(0, len(rows), 0, -1)]
        while todo:
            a, b, depth, parent = todo.pop()
            to = int(lcp[a + 1:b].min()) if b - a > 1 else len(rows[a])
            k = len(self.part)
            if parent >= 0:
                self.children[parent].append(k)
            self.part.append(rows[a][depth:to])
            self.depth.append(to)
            self.begin.append(a)
            self.end.append(b)
            self.low.append(int(size[a:b].min()))
            self.high.append(int(size[a:b].max()))
            self.children.append([])
            self.whole.append(len(rows[a]) == to)  # the first set ends here
            if b - a > 1:
                cuts = [a, *(a + 1 + np.flatnonzero(lcp[a + 1:b] == to)).tolist(), b]
                todo += [(x, y, to, k) for x, y in zip(cuts[:-1], cuts[1:])
                         if not (self.whole[k] and x == a)]


def tree_links(cid: list[int], comp: list[int], sets: list[np.ndarray],
               met: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between the components of one block, enough to join all that are linked.

    Sets with equal `met` were compared before. All sets descend the tree together: at a node the
    overlaps of those still active grow by how many of the node's shingles each holds.
    """
    if len(set(comp)) < 2:
        return []
    every, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.uint32)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(every), dtype=np.uint32)
    shared = int((count > 1).sum())  # ranks from here on are held by one set and overlap nothing
    ends = np.cumsum([len(s) for s in sets])
    rows = [np.sort(r) for r in np.split(rank[place], ends[:-1])]
    order = sorted(range(len(rows)), key=lambda k: rows[k].astype(">u4").tobytes())
    rows = [rows[k] for k in order]
    cid, label = [cid[k] for k in order], np.array([comp[k] for k in order])
    before = np.arange(len(rows)) if met is None else np.array([met[k] for k in order])
    size = np.array([len(r) for r in rows])
    tree = Tree(rows)
    out: list[tuple[int, int]] = []
    at_once = max(1, min(PROBES, CELLS // (shared + 1)))
    for first in range(0, len(rows), at_once):
        probes = np.arange(first, min(first + at_once, len(rows)))
        held = np.zeros((shared + 1, len(probes)), np.uint8)
        for k, x in enumerate(probes):
            held[rows[x][rows[x] < shared] + 1, k] = 1
        passed = np.cumsum(held, axis=0, dtype=np.uint16 if shared < 1 << 16 else np.uint32)
        todo = [(0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while todo:
            k, active, overlap = todo.pop()
            a, b, depth = tree.begin[k], tree.end[k], tree.depth[k]
            # Sets up to x have met x; neither its component nor what met it needs to be found.
            x = probes[active]
            keep = x < b - 1
            for known in (label, before):
                if (known[a:b] == known[a]).all():
                    keep &= known[x] != known[a]
            if not keep.all():
                active, overlap, x = active[keep], overlap[keep], x[keep]
            part = tree.part[k]
            part = part[part < shared]
            if len(part) and len(active):
                found = held[part + 1]
                found = found if len(active) == len(probes) else found[:, active]
                overlap = overlap + found.sum(axis=0, dtype=np.int64)
            # The overlap that any set under this node can still reach.
            last = int(rows[a][depth - 1]) + 1 if depth else 0
            left = passed[-1, active].astype(np.int64) - passed[min(last, shared), active]
            m = np.clip(depth + left, tree.low[k], tree.high[k])
            keep = (100 + SHARED) * (overlap + np.minimum(left, m - depth)) >= SHARED * (
                size[x] + m)
            active, overlap, x = active[keep], overlap[keep], x[keep]
            if not len(active):
                continue
            if tree.whole[k]:
                linked = ((100 + SHARED) * overlap >= SHARED * (size[x] + len(rows[a]))) & (x < a)
                for y in x[linked]:
                    if label[y] != label[a]:
                        out.append((cid[y], cid[a]))
                        label[label == label[y]] = label[a]
            todo += [(c, active, overlap) for c in tree.children[k]]
    return out


def _links(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Links found in groups of rows `*keys, cid, comp, met, shingles`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("bpe:")
        for table in whole_groups(batches, keys):
            starts = np.append(group_starts(table, keys), table.num_rows)
            found = []
            for a, b in zip(starts[:-1], starts[1:]):
                part = table.slice(a, b - a)
                found += tree_links(
                    part.column("cid").to_pylist(), part.column("comp").to_pylist(),
                    [np.frombuffer(v.as_buffer(), U64) for v in part.column("shingles")],
                    part.column("met").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = groups.repartition(partitions(groups), *keys).sortWithinPartitions(*keys)
    return materialise(dealt.mapInArrow(run, "a long, b long"), name)


def _first_meetings(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`leader, block, cid, comp, met`: each class with the leader it shares most shards with, which
    joins every block of its group; and `cid, met`, the block where a class met the others."""
    common = shards.filter("cid <> leader").groupBy("cid", "leader").agg(F.count("*").alias("c"))
    chosen = materialise(common.groupBy("cid").agg(
        F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader")), "ngram-leaders")
    sizes = chosen.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = materialise(sizes, "ngram-leader-blocks")
    members = chosen.join(sizes, "leader").select(
        "leader", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"), "cid")
    own = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
                       .alias("block"), F.col("leader").alias("cid"))
    place = F.xxhash64("leader", "block")
    met = members.select("cid", place.alias("met")).unionByName(
        own.join(chosen.select("cid"), "cid", "left_anti").filter("block = 0").select(
            "cid", place.alias("met")))
    group = members.unionByName(own).withColumns({"comp": F.col("cid"), "met": F.col("cid")})
    return group, materialise(met, "ngram-met")


def meeting_blocks(members: DataFrame) -> DataFrame:
    """`shard, c1, b1, c2, b2, cid, comp, met`: members of shards (`shard, cid, comp, met`) dealt to
    pairs of blocks, so that members of different `met` meet in one pair.

    Those of one `met` that fill a block or more have blocks of their own, which never meet each
    other; smaller ones share blocks (-1) and stay whole.
    """
    sizes = members.groupBy("shard", "met").agg(F.count("*").alias("size"))
    small = F.when(F.col("size") < BLOCK, F.col("size")).otherwise(0)
    pools = materialise(sizes.groupBy("shard").agg(F.sum(small).alias("pool")), "ngram-pools")
    sizes = materialise(sizes.join(pools, "shard"), "ngram-shard-meetings")
    large = F.col("size") >= BLOCK
    home = members.join(sizes, ["shard", "met"]).select(
        "shard", "cid", "comp", "met", F.when(large, F.pmod("met", F.lit(1 << 62))).otherwise(-1)
        .alias("c"),
        F.pmod(F.when(large, F.xxhash64("cid")).otherwise(F.xxhash64("met")), F.ceil(
            F.when(large, F.col("size")).otherwise(F.col("pool")) / BLOCK)).cast("int").alias("b"))
    home = materialise(home, "ngram-homes")
    blocks = home.groupBy("shard", "c", "b").agg(F.count("*").alias("rows"))
    blocks = materialise(blocks.drop("rows"), "ngram-blocks")
    one, two = (blocks.select("shard", F.col("c").alias(f"c{k}"), F.col("b").alias(f"b{k}"))
                for k in (1, 2))
    pairs = materialise(one.join(two, "shard").filter(
        "(c1 < c2 OR c1 = c2 AND b1 <= b2) AND (c1 <> c2 OR c1 = -1)"), "ngram-block-pairs")
    first = pairs.join(home.withColumnsRenamed({"c": "c1", "b": "b1"}), ["shard", "c1", "b1"])
    second = pairs.filter("c1 <> c2 OR b1 <> b2").join(
        home.withColumnsRenamed({"c": "c2", "b": "b2"}), ["shard", "c2", "b2"])
    return first.unionByName(second)


def _open_shards(shards: DataFrame, comps: DataFrame, met: DataFrame) -> DataFrame:
    """The members of shards that hold several components which met in several blocks, in pairs of
    blocks; shards with the same members count once."""
    members = materialise(shards.select("shard", "cid").join(
        comps.withColumnRenamed("node", "cid"), "cid", "left").join(met, "cid", "left").select(
        "shard", "cid", F.coalesce("component", "cid").alias("comp"),
        # A leader that nobody chose met nobody.
        F.coalesce("met", F.xxhash64("cid")).alias("met")), "labelled-shards")
    still = members.groupBy("shard").agg(
        F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.min("met").alias("one"), F.max("met").alias("two"),
        F.bit_xor(F.xxhash64("cid")).alias("g1"),
        F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("g2")).filter("low <> high AND one <> two")
    once = materialise(still.groupBy("c", "g1", "g2").agg(F.min("shard").alias("shard"))
                       .select("shard"), "open-shards")
    return meeting_blocks(members.join(once, "shard"))


def jaccard_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: `doc_id, n_shingles, component_id` (the smallest id reachable)."""
    sketches = _sketches(docs, text)
    grouped = sketches.filter("n > 0").groupBy("f1", "f2").agg(
        F.min("_id").alias("min_id"), F.first("n").alias("n"), F.first("counted").alias("counted"),
        F.min(F.struct("_id", "_th")).alias("r"))
    classes = materialise(grouped.select(
        F.monotonically_increasing_id().alias("cid"), "f1", "f2", "min_id", "n", "counted",
        F.col("r._id").alias("rid"), F.col("r._th").alias("rth")), "ngram-classes")
    shards = _shards(sketches, classes)
    sets = _sets(docs, text, classes.select("cid", "rid", "rth").join(
        shards.select("cid").distinct(), "cid"))
    meetings, met = _first_meetings(shards)
    first = _links(meetings.join(sets, "cid"), ["leader", "block"], "first-ngram-links")
    comps = materialise(components(first, "ngram-first"), "first-ngram-components")
    rest = _links(_open_shards(shards, comps, met).join(sets, "cid"),
                  ["shard", "c1", "b1", "c2", "b2"], "rest-ngram-links")
    comps = components(first.unionByName(rest), "ngram")
    labelled = classes.select("cid", "f1", "f2", "min_id").join(
        comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    labelled = materialise(labelled, "ngram-labels")
    lowest = labelled.groupBy("component").agg(F.min("min_id").alias("component_id"))
    named = materialise(labelled.join(lowest, "component").select(
        F.col("f1").alias("g1"), F.col("f2").alias("g2"), "component_id"), "ngram-names")
    on = (sketches["f1"] == named["g1"]) & (sketches["f2"] == named["g2"]) & (sketches["n"] > 0)
    return sketches.join(named, on, "left").select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
        .alias("component_id"))
