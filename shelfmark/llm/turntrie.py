"""The trie of conversation prefixes, as burst tries.

A node of depth d is a distinct sequence of the first d turns (role and text) of conversations;
its members are the conversations that start with it. Every distinct turn has a number, equal
conversations are one path, and paths are sequences of these numbers.

Containers hold the suffixes of paths below one trie head. A container of more than CONTAINER turn
numbers bursts: what all its suffixes share becomes a chain of nodes, and the suffixes are dealt by
their next turn to containers of their own. Only oversized containers burst again, each into two
parts at least. The remaining containers are dealt to shards, sorted there by their suffixes, and
swept into nodes, so no task holds more than one container. Totals of subtrees (children, leaves,
saved text) rise from the containers through the burst heads to the root. Conversations of more
than STRATUM turns are cut: what follows the cut is the suffix of a container at the node where
the cut lies, and the strata are built from the deepest up.

Order and cases: turns are ordered by turn number (null first), turns of one number by the SHA-256
of role and text; null role or text is empty; repeated rows are further turns. A conversation
that holds a third of all rows is numbered in ranges and cut into strata, never gathered. Rows
without conversation id belong to none and build no path. A table without conversations has no node,
not even a root. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import (
    group_starts, materialise, partitions, running_totals, whole_groups,
)

#: Turn numbers that a container holds at most (one suffix is never split), and turns of a stratum.
CONTAINER = 1 << 12
STRATUM = 1024
#: Ids of a part of a node's member list.
PART = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SUFFIX = ("rnd int, cont long, depth int, off int, tids array<long>, sizes array<long>, "
          "w long, cid long, end_cid long, x_children long, x_leaves long, x_below long")
SWEPT = ("rnd int, cont long, is_head boolean, conv_id long, depth int, parent_conv_id long, "
         "n_convs long, n_children long, n_leaves long, below long, size long, end_cid long")


def numbered(turns: DataFrame) -> DataFrame:
    """`conv, pos, digest, size`: every turn with its place in the conversation, the digest of
    role and text, and the UTF-8 bytes of the text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text),
                            256))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"),
        F.octet_length(text).cast("long").alias("size"))
    once = rows.groupBy("conv", "turn", "digest").agg(
        F.first("size").alias("size"), F.count("*").alias("times"))
    placed = running_totals(once, ["conv"], ["turn", "digest"], {"at": "times"}, "turn-places")
    return materialise(placed.select(
        "conv", F.explode(F.sequence("at", F.col("at") + F.col("times") - 1)).alias("pos"),
        "digest", "size"), "turns")


def rebuilt(turns: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """`conv, pos, digest, size, turns` with conversations that share beginnings by rule, `turns`
    being the conversation's length (one row with null `pos` where it is 0).

    Of conversation c, the first h = crc32(c) % modulus turns are those of conversation c - c %
    family, if it exists; then c's own turns after its first h follow.
    """
    own = numbered(turns)
    sizes = materialise(own.groupBy("conv").agg(F.count("*").alias("n")).select(
        "conv", "n", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")),
                            F.lit(modulus)).alias("h"),
        (F.col("conv") - F.pmod("conv", F.lit(family))).alias("head")), "conversations")
    heads = sizes.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    convs = sizes.join(heads, "head", "left").withColumn(
        "take", F.least("h", F.coalesce("head_n", F.lit(0))))
    convs = materialise(convs.withColumn(
        "turns", F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt-sizes")
    taken = own.filter(F.col("pos") < modulus - 1).withColumnRenamed("conv", "head").join(
        convs.select("conv", "head", "h", "turns"), "head").filter("pos < h")
    rest = own.join(convs.select("conv", "h", "take", "turns"), "conv").filter("pos >= h")
    none = convs.filter("turns = 0").select(
        "conv", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"),
        F.lit(None).cast("long").alias("size"), "turns")
    return taken.select("conv", "pos", "digest", "size", "turns").unionByName(rest.select(
        "conv", (F.col("pos") - F.col("h") + F.col("take")).alias("pos"), "digest", "size",
        "turns")).unionByName(none)


def conversations(turns: DataFrame) -> DataFrame:
    """The conversations as they are, in the form of `rebuilt`."""
    own = numbered(turns)
    return own.join(own.groupBy("conv").agg(F.count("*").alias("turns")), "conv")


def _chunks(paths: DataFrame) -> DataFrame:
    """`conv, k, tids, sizes, before, after`: the turn numbers of every stratum of every path,
    and 128-bit digests (h1, h2) of all turns before and up to the end of it."""
    paths = materialise(paths, "paths")
    numbers = materialise(paths.filter("pos IS NOT NULL").select("digest").distinct()
                          .withColumn("tid", F.monotonically_increasing_id()), "turn-numbers")
    cut = paths.join(numbers, "digest", "left").groupBy(
        "conv", F.coalesce(F.floor(F.col("pos") / STRATUM), F.lit(0)).cast("int").alias("k")).agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct(
            "pos", "tid", "size")))).alias("t"), F.max("turns").alias("turns"))
    cut = materialise(cut.select("conv", "k", "turns", F.col("t.tid").alias("tids"),
                                 F.col("t.size").alias("sizes")), "path-chunks")
    marks = cut.select("conv", "k", *[
        F.when(F.size("tids") > 0, F.xxhash64(F.lit(s), "k", "tids")).otherwise(0).alias(f"h{s}")
        for s in (1, 2)])
    so_far = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.select("conv", "k", *[
        e for s in (1, 2) for e in (
            F.bit_xor(f"h{s}").over(so_far).alias(f"after{s}"),
            F.bit_xor(f"h{s}").over(so_far).bitwiseXOR(F.col(f"h{s}")).alias(f"before{s}"))])
    return materialise(cut.join(marks, ["conv", "k"]), "path-strata")


def _member_digests(members: DataFrame) -> DataFrame:
    """`cid, ends`: SHA-256 of the ascending, comma-joined ids of the conversations of each path.

    Lists are made in parts where the ids were dealt by range, so a path that a third of all
    conversations take is a few rows when its parts are hashed one after the other.
    """
    alone = members.groupBy("cid").agg(F.count("*").alias("w"))
    alone = materialise(alone, "path-weights")
    single = alone.filter("w = 1").select(
        "cid", F.sha2(F.col("cid").cast("string").cast("binary"), 256).alias("ends"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, conv = batch.column("cid").to_pylist(), batch.column("conv").to_pylist()
            cuts = group_starts(batch, ["cid"]).tolist()
            cuts = sorted({*cuts, *[a for s, e in zip(cuts, cuts[1:] + [len(cid)])
                                    for a in range(s, e, PART)]})
            spans = list(zip(cuts, cuts[1:] + [len(cid)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([cid[a] for a, _ in spans], pa.int64()),
                 pa.array([conv[a] for a, _ in spans], pa.int64()),
                 pa.array([",".join(map(str, conv[a:b])) for a, b in spans], pa.string())],
                names=["cid", "first", "list"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for cid, part in zip(batch.column("cid").to_pylist(), batch.column("list").to_pylist()):
                if cid != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = cid, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part.encode())
            yield _batch(done, ["cid", "ends"], [pa.int64(), pa.string()])
        if now is not None:
            yield _batch([(now, state.hexdigest())], ["cid", "ends"], [pa.int64(), pa.string()])

    n = partitions(members)
    several = members.join(alone.filter("w > 1").select("cid"), "cid").repartitionByRange(
        n, "cid", "conv").sortWithinPartitions("cid", "conv")
    lists = several.select("cid", "conv").mapInArrow(parts, "cid long, first long, list string")
    many = lists.repartition(n, "cid").sortWithinPartitions("cid", "first").select(
        "cid", "list").mapInArrow(hashed, "cid long, ends string")
    return single.unionByName(many)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=names)


def sweep(suffixes: list[tuple]) -> list[list]:
    """The nodes of one container from its sorted suffixes, the head first.

    A suffix is (tids, sizes, w, cid, end_cid, children, leaves, below): turn numbers and text
    sizes below the head, members, the smallest of them, the path that ends here, and the totals of
    what hangs below its end. A node is [parent, depth below the head, size, members, smallest
    member, children, leaves, below, end_cid].
    """
    nodes = [[-1, 0, 0, 0, None, 0, 0, 0, None]]
    path, last = [0], []
    for tids, sizes, w, cid, end_cid, children, leaves, below in suffixes:
        same = 0
        while same < len(last) and same < len(tids) and last[same] == tids[same]:
            same += 1
        del path[same + 1:]
        for d in range(same, len(tids)):
            nodes.append([path[-1], d + 1, sizes[d], 0, None, 0, 0, 0, None])
            path.append(len(nodes) - 1)
        node = nodes[path[-1]]
        node[3] += w
        node[4] = cid if node[4] is None else min(node[4], cid)
        node[5] += children
        node[6] += leaves
        node[7] += below
        node[8] = end_cid if node[8] is None else node[8]
        last = tids
    for node in reversed(nodes):
        if not node[5]:
            node[6] = 1
        if node[0] >= 0:
            up = nodes[node[0]]
            up[3] += node[3]
            up[4] = node[4] if up[4] is None else min(up[4], node[4])
            up[5] += 1
            up[6] += node[6]
            up[7] += node[7] + (node[3] - 1) * node[2]
    return nodes


def _swept(suffixes: DataFrame) -> DataFrame:
    """The nodes of all containers, sorted by suffix within their shards; heads are marked."""
    columns = [part.split()[0] for part in SWEPT.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["rnd", "cont"]):
            starts = group_starts(table, ["rnd", "cont"]).tolist()
            found = []
            for a, b in zip(starts, starts[1:] + [table.num_rows]):
                rows = table.slice(a, b - a).to_pylist()
                rnd, cont, depth, off = (rows[0][c] for c in ("rnd", "cont", "depth", "off"))
                nodes = sweep([(r["tids"][off:], r["sizes"][off:], r["w"], r["cid"], r["end_cid"],
                                r["x_children"], r["x_leaves"], r["x_below"]) for r in rows])
                found += [(rnd, cont, up < 0, cid, depth + d, nodes[up][4] if up >= 0 else None,
                           n, children, leaves, below, size, end)
                          for up, d, size, n, cid, children, leaves, below, end in nodes]
            yield _batch(found, columns, kinds)

    dealt = suffixes.repartition(partitions(suffixes), "rnd", "cont").sortWithinPartitions(
        "rnd", "cont", "tids")
    return dealt.mapInArrow(run, SWEPT)


def _burst(suffixes: DataFrame, rnd: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Burst the oversized containers: what they were, their children, and the suffixes dealt to
    these. None if no container is oversized."""
    rest = F.slice("tids", F.col("off") + 1, F.size("tids") - F.col("off"))
    held = suffixes.withColumn("rest", rest).groupBy("rnd", "cont", "depth", "off").agg(
        F.sum(F.size("rest")).alias("ids"), F.count("*").alias("rows"), F.sum("w").alias("n"),
        F.min("cid").alias("head_cid"), F.min("rest").alias("low"), F.max("rest").alias("high"))
    differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
    held = materialise(
        held.filter((F.col("ids") > CONTAINER) & (F.col("rows") > 1)).select(
            "rnd", "cont", "depth", "off", "n", "head_cid",
            (differ - 1).cast("int").alias("shared")), "oversized")
    if held.isEmpty():
        return None
    moved = suffixes.join(held.select("rnd", "cont", "shared", "head_cid"), ["rnd", "cont"])
    to = F.col("off") + F.col("shared")
    moved = materialise(moved.withColumn("to", to).withColumn(
        "next", F.get("tids", F.col("to"))), "bursting")
    ends = moved.filter("next IS NULL").select(
        "rnd", "cont", F.col("end_cid"), "x_children", "x_leaves", "x_below")
    chains = moved.groupBy("rnd", "cont").agg(F.first(
        F.slice("sizes", F.col("off") + 1, F.col("shared"))).alias("chain"))
    was = materialise(held.join(chains, ["rnd", "cont"]).join(ends, ["rnd", "cont"], "left"),
                      "burst-heads")
    children = materialise(
        moved.filter("next IS NOT NULL").groupBy(
            F.col("rnd").alias("up_rnd"), F.col("cont").alias("up_cont"), "next").agg(
            F.sum("w").alias("n"), F.min("cid").alias("cid"),
            F.first("head_cid").alias("up_cid"),
            F.first(F.get("sizes", F.col("to"))).alias("size"),
            F.first(F.col("depth") + F.col("shared") + 1).alias("depth"))
        .withColumn("cont", F.monotonically_increasing_id()).withColumn("rnd", F.lit(rnd)),
        "burst-children")
    keys = children.select(F.col("up_rnd").alias("rnd"), F.col("up_cont").alias("cont"), "next",
                           F.col("cont").alias("new_cont"))
    dealt = moved.join(keys, ["rnd", "cont", "next"]).select(
        F.lit(rnd).alias("rnd"), F.col("new_cont").alias("cont"),
        (F.col("depth") + F.col("shared") + 1).alias("depth"), (F.col("to") + 1).alias("off"),
        *[c.split()[0] for c in SUFFIX.split(", ")[4:]])
    return was, children, dealt


def _chain_nodes(was: DataFrame) -> DataFrame:
    """The nodes that all suffixes of a burst container share, with totals from `z_*` (the last
    of them)."""
    sizes = F.slice("chain", F.col("j"), F.col("shared") - F.col("j") + 1)
    saved = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)
    last = F.col("j") == F.col("shared")
    return was.filter("shared > 0").withColumn(
        "j", F.explode(F.sequence(F.lit(1), F.col("shared")))).select(
        F.col("head_cid").alias("conv_id"), (F.col("depth") + F.col("j")).alias("depth"),
        F.col("head_cid").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("z_children")).otherwise(1).alias("n_children"),
        F.col("z_leaves").alias("n_leaves"),
        (F.col("z_below") + (F.col("n") - 1) * saved).alias("saved_tokens"),
        F.when(last, F.col("end_cid")).alias("end_cid"))


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "end_cid"]
SAVED = "below + (n_convs - 1) * size"


def _stratum(suffixes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All nodes of a stratum below its heads, and the totals of the heads (`cont`)."""
    rounds, kept = [], []
    while burst := _burst(suffixes, len(rounds) + 1):
        was, children, dealt = burst
        rounds.append((was, children))
        kept.append(suffixes.join(was.select("rnd", "cont"), ["rnd", "cont"], "left_anti"))
        suffixes = materialise(dealt, "dealt-suffixes")
    kept.append(suffixes)
    whole = kept[0]
    for k in kept[1:]:
        whole = whole.unionByName(k)
    swept = materialise(_swept(whole), "swept")
    nodes = [swept.filter("NOT is_head").withColumn("saved_tokens", F.expr(SAVED)).select(*NODE)]
    total = ["rnd", "cont", "n_children", "n_leaves", "below", "end_cid"]
    heads = swept.filter("is_head").select(*total)
    for was, children in reversed(rounds):
        known = materialise(children.join(heads, ["rnd", "cont"]).select(
            "up_rnd", "up_cont", "up_cid", F.col("cid").alias("conv_id"), "depth",
            F.col("up_cid").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
            "n_leaves", "below", "size", "end_cid").withColumn(
            "saved_tokens", F.expr(SAVED)), "head-nodes")
        nodes.append(known.select(*NODE))
        below = known.groupBy(F.col("up_rnd").alias("rnd"), F.col("up_cont").alias("cont")).agg(
            F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        none = F.lit(0).cast("long")
        ended = materialise(was.join(below, ["rnd", "cont"]).withColumns({
            "z_children": F.col("c") + F.coalesce("x_children", none),
            "z_leaves": F.col("l") + F.coalesce("x_leaves", none),
            "z_below": F.col("s") + F.coalesce("x_below", none)}), "burst-totals")
        nodes.append(_chain_nodes(ended))
        through = F.aggregate("chain", none, lambda a, b: a + b) * (F.col("n") - 1)
        short = F.col("shared") == 0
        heads = heads.unionByName(ended.select(
            "rnd", "cont", F.when(short, F.col("z_children")).otherwise(1).alias("n_children"),
            F.col("z_leaves").alias("n_leaves"), (F.col("z_below") + through).alias("below"),
            F.when(short, F.col("end_cid")).alias("end_cid")))
    return nodes, heads.filter("rnd = 0")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie over paths (`conv, pos, digest, size, turns`), one row each.

    `conv_id` (smallest member) and `depth` name a node; `saved_tokens` is the text that its
    subtree holds once instead of once a member; `ends_sha256` digests the members that end here.
    """
    chunks = _chunks(paths)
    whole = chunks.groupBy("conv").agg(F.max("turns").alias("turns"), *[F.max_by(
        f"after{s}", "k").alias(f"h{s}") for s in (1, 2)])
    whole = materialise(whole, "path-digests")
    key = ["h1", "h2", "turns"]
    classes = materialise(whole.groupBy(*key).agg(
        F.min("conv").alias("cid"), F.count("*").alias("w")), "path-classes")
    ends = _member_digests(whole.join(classes, key).select("cid", "conv"))
    own = chunks.join(classes.select(F.col("cid").alias("conv"), "w"), "conv").withColumn(
        "end_cid", F.when(F.col("turns") <= (F.col("k") + 1) * STRATUM, F.col("conv")))
    # Paths that agree up to the end of a stratum are one suffix of it.
    before, after = ["before1", "before2"], ["after1", "after2"]
    strata = materialise(own.groupBy("k", *before, *after).agg(
        F.sum("w").alias("w"), F.min("conv").alias("cid"), F.max("end_cid").alias("end_cid"),
        F.first("tids").alias("tids"), F.first("sizes").alias("sizes")), "strata")
    nodes, totals = [], None
    for k in range(strata.agg(F.max("k")).first()[0] or 0, -1, -1):
        here = strata.filter(F.col("k") == k)
        tops = materialise(here.select(*before).distinct().withColumns({
            "rnd": F.lit(0), "cont": F.monotonically_increasing_id()}), "stratum-heads")
        rows = here.join(tops, before)
        if totals is None:
            rows = rows.withColumns({x: F.lit(0).cast("long") for x in (
                "x_children", "x_leaves", "x_below")})
        else:
            rows = rows.join(totals, after, "left").fillna(0, ["x_children", "x_leaves", "x_below"])
        rows = rows.withColumns({"depth": F.lit(k * STRATUM), "off": F.lit(0)})
        made, heads = _stratum(materialise(
            rows.select(*[c.split()[0] for c in SUFFIX.split(", ")]), "suffixes"))
        if k:
            # The heads are nodes of the stratum above; theirs is the smallest member there.
            upper = strata.filter(F.col("k") == k - 1).select(
                F.col("after1").alias("before1"), F.col("after2").alias("before2"),
                F.col("cid").alias("up"))
            made = [_with_parents(m, k * STRATUM + 1, here, before, upper) for m in made]
            totals = materialise(heads.join(tops, ["rnd", "cont"]).select(
                F.col("before1").alias("after1"), F.col("before2").alias("after2"),
                F.col("n_children").alias("x_children"), F.col("n_leaves").alias("x_leaves"),
                F.col("below").alias("x_below")), "stratum-totals")
        else:
            members = here.groupBy(F.lit(0).alias("rnd")).agg(
                F.min("cid").alias("conv_id"), F.sum("w").alias("n_convs"))
            made.append(heads.join(members, "rnd").select(
                "conv_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
                "n_convs", "n_children", "n_leaves", F.col("below").alias("saved_tokens"),
                "end_cid"))
        nodes += made
    every = nodes[0]
    for m in nodes[1:]:
        every = every.unionByName(m)
    return every.join(ends.withColumnRenamed("cid", "end_cid"), "end_cid", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
        "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def _with_parents(nodes: DataFrame, depth: int, here: DataFrame, before: list[str],
                  upper: DataFrame) -> DataFrame:
    """The nodes right below a cut with the parent's smallest member in the stratum above."""
    up = here.select("cid", *before).join(upper, before).select(F.col("cid").alias("conv_id"), "up")
    return nodes.join(up, "conv_id", "left").withColumn("parent_conv_id", F.when(
        F.col("depth") == depth, F.col("up")).otherwise(F.col("parent_conv_id"))).select(*NODE)
