"""Maximal periodic runs of words, by descending-LCP union of suffix classes.

A run is a stretch of consecutive words of one document with smallest period q, at least
max(6, 4 q) words long, that no neighbouring word extends. Per document the suffixes that share
words are ranked by doubling, and the common prefixes (LCP) of neighbours in suffix order taken.
From the longest LCP down, the classes of suffixes of such neighbours are united (union-find); each
class keeps its positions in order. Positions that become neighbours in a class when it is united
at LCP l, at a distance p of at most a third of l, seed a run: the text at both agrees for l
words, so p + l words have period p. The pair at a run's first word is such a pair, and its p is the
smallest period: a smaller one would have put a position of the class between them. So every run
is seeded exactly once, by the seed that no word before it extends.

Suffixes of documents in one batch are ranked together, the document leading, so runs never cross
documents. Only positions whose next four words recur in their document are ranked further.

Null and empty texts and texts without words have no run, the digest of nothing and null columns
for the longest run. Very long texts are worked on whole, with some 100 bytes a word and 4 bytes a
word for every doubling. Documents are judged one by one: repeated rows get the same answer, a null
id counts as the empty string in the rule that makes texts periodic, ties of length fall to the
smallest start and period, an empty table gives no rows, and other columns of the table are not
read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texthash import Words, chunks

#: A run has at least SHORTEST words and EXPONENT periods.
SHORTEST, EXPONENT = 6, 4
#: The least common prefix that can seed a run (of period one).
LEAST_LCP = SHORTEST - 1
MADE = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string")


def _dense(first: np.ndarray, second: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Start of a new pair (first, second) along `order`."""
    new = np.ones(len(order), bool)
    a, b = first[order], second[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return new


def neighbours(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes (left, right) of one document with an LCP of LEAST_LCP or more.

    `doc` is the non-descending document number, `word` the word of each place. Ranks are places
    in suffix order, equal for suffixes that agree so far; doubling ranks anew only those that
    are not alone yet.
    """
    n = len(word)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    order = np.lexsort((word, doc))
    new = _dense(doc, word, order)
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    last = np.searchsorted(doc, doc, side="right")  # one past the document's end
    levels, span, ranked = [rank], 1, None
    alone = np.append(new, True)
    live = order[~(alone[:-1] & alone[1:])]
    while len(live):
        ahead = live + span
        inside = ahead < last[live]
        second = np.full(len(live), -1, np.int64)
        second[inside] = rank[ahead[inside]]
        first = rank[live].astype(np.int64)
        sort = np.lexsort((second, first))
        live, first, second = live[sort], first[sort], second[sort]
        group = np.searchsorted(first, first)  # place of the group's head among the live
        new = np.ones(len(live), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank = rank.copy()
        rank[live] = first + (head - group)
        span *= 2
        levels.append(rank)
        alone = np.append(new, True)
        live = live[~(alone[:-1] & alone[1:])]
        if span == 4:
            ranked = live
    if ranked is None or not len(ranked):
        return none, none, none
    ranked = ranked[np.argsort(rank[ranked])]
    left, right = ranked[:-1], ranked[1:]
    same = levels[2][left] == levels[2][right]
    left, right = left[same], right[same]
    lcp = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = left + lcp, right + lcp
        inside = (i < last[left]) & (j < last[right])
        i, j = np.where(inside, i, 0), np.where(inside, j, 0)
        lcp += np.where(inside & (levels[k][i] == levels[k][j]), 1 << k, 0)
    enough = lcp >= LEAST_LCP
    return left[enough], right[enough], lcp[enough]


def seeds(left: list[int], right: list[int], lcp: list[int]) -> set[tuple[int, int, int]]:
    """(place, distance, LCP) of the pairs that seed runs, from neighbours by descending LCP."""
    root: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    found = set()
    for i, j, l in zip(left, right, lcp):
        for x in (i, j):
            if x not in root:
                root[x] = x
                places[x] = [x]
        a, b = find(i), find(j)
        if a == b:
            continue
        if len(places[a]) < len(places[b]):
            a, b = b, a
        large, small = places[a], places.pop(b)
        root[b] = a
        moved = set(small)
        for x in small:
            insort(large, x)
        for x in small:
            at = bisect_left(large, x)
            if at and large[at - 1] not in moved:
                p = x - large[at - 1]
                if EXPONENT * p <= p + l >= SHORTEST:
                    found.add((x - p, p, l))
            if at + 1 < len(large) and large[at + 1] not in moved:
                p = large[at + 1] - x
                if EXPONENT * p <= p + l >= SHORTEST:
                    found.add((x, p, l))
    return found


def runs_of(doc: np.ndarray, word: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, place, length, period) of every run, by place and period."""
    left, right, lcp = neighbours(doc, word)
    if not len(left):
        return []
    order = np.lexsort((-lcp, doc[left]))
    left, right, lcp = left[order], right[order], lcp[order]
    cuts = np.flatnonzero(np.append(True, doc[left][1:] != doc[left][:-1]))
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(left))):
        d = int(doc[left[a]])
        for place, p, l in sorted(seeds(left[a:b].tolist(), right[a:b].tolist(),
                                        lcp[a:b].tolist())):
            before = place - 1
            if before >= 0 and doc[before] == d and word[before] == word[before + p]:
                continue  # the run begins earlier
            out.append((d, place, p + l, p))
    return out


def made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """Original number of each word where the rule makes the text periodic, else None."""
    h = crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray,
           rows: int) -> list[bytes]:
    """The given words (byte ranges, by row) of each row, joined by single spaces."""
    if not len(start):
        return [b""] * rows
    size = end - start + 1
    total = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(total[-1]) + np.repeat(start - total[:-1], size)
    body = data[np.minimum(source, len(data) - 1)]
    body[total[1:] - 1] = 32
    edge = total[np.searchsorted(row, np.arange(rows + 1))]
    plain = body.tobytes()
    return [plain[a:max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def judge_chunk(ids: list, data: np.ndarray, at: np.ndarray, periodic: bool) -> list[tuple]:
    """The result rows of some documents."""
    words = Words(data, at)
    pick = np.arange(len(words.start))
    if periodic:
        for r, n in enumerate(words.count.tolist()):
            moved = made_periodic(ids[r], n)
            if moved is not None:
                pick[words.first[r]:words.first[r] + n] = words.first[r] + moved
    _, word = np.unique(words.hashes(data), return_inverse=True)
    word = word[pick]
    found: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    change = np.zeros(len(pick) + 1, np.int64)
    for d, place, length, p in runs_of(words.row, word):
        found[d].append((place - int(words.first[d]), length, p))
        change[place + p] += 1
        change[place + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    texts = joined(data, words.start[pick[kept]], words.end[pick[kept]], words.row[kept], len(ids))
    out = []
    for doc_id, mine, text in zip(ids, found, texts):
        best = min(mine, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listing = "".join(f"{s},{n},{p}\n" for s, n, p in mine)
        out.append((doc_id, len(mine), *best, 1000 * best[1] // best[2] if mine else None,
                    hashlib.sha256(listing.encode()).hexdigest(),
                    hashlib.sha256(text).hexdigest()))
    return out


def find_runs(docs: DataFrame, text: str = "text", periodic: bool = False) -> DataFrame:
    """Per document: `doc_id, n_runs`, the longest run's `start, length, period, exponent_milli`,
    `runs_sha256` over all runs and `collapsed_sha256` over the words that no run repeats.

    `periodic` first makes the texts that the id's checksum chooses periodic, as a known input.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [part.split()[0] for part in MADE.split(", ")]
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, data, at in chunks(batch.column("_text")):
                out = judge_chunk(ids[first:first + len(at) - 1], data, at, periodic)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, MADE)
