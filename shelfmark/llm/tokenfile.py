"""Token ids in binary files: ids ranked by frequency, lengths in control bytes of their own.

File layout, all integers little-endian: `SMTF`, u32 documents, u64 ids, u32 ranks in use; the
ids by rank (u32 each); the number of ids of each document (u32 each); one control byte per four
ids (two bits each: bytes used less one, lowest bits first); the rank bytes. Frequent ids have
small ranks and so take one byte. A reader looks the four lengths of a control byte up in a
table of 256 rows and finds every rank by one running sum.

Null texts count as empty and get the end id alone. Documents with equal ids of their own are
ordered by a hash of their tokens, so repeated rows keep a defined order; null ids come first. An empty
table makes no file and reads back as no rows.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shelfmark.llm.bpe import WHITE, byte_characters
from shelfmark.llm.common import Recent, materialise, partitions, task_cache
from shelfmark.llm.texthash import buffers
from shelfmark.session import run_folder

MAGIC = b"SMTF"
#: Ids after which a task begins its next file; one document is never split.
FILE_IDS = 4_000_000
#: Longest chunk, and numbers of chunks and pieces, that a worker remembers.
CACHED_LENGTH = 48
CACHED_CHUNKS = 450_000
CACHED_PIECES = 450_000
BATCH_ROWS = 512
#: Chunks of ASCII and Latin letters that are their own composed form, and how such a chunk in
#: lower case splits into pieces (fixed pattern).
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
SIMPLE = re.compile(f"[!-~{LATIN}]*").fullmatch
SIMPLE_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z{LATIN}0-9]+").findall
#: Characters that Python's split takes for white space beyond the library's.
ODD_SPACE = re.compile("[\x1c-\x1f]").search


class ChunkEncoder:
    """A tokenizer of white-space separated chunks that remembers what it has encoded.

    Only for vocabularies that drop white space, lower the case of single characters and split
    words from numbers and signs, so that the pieces of a chunk can be encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = self._plain(["Ab1'sä,c", "ab1'sä,c", " ab1's \n ä,c "])
        parts = self._plain(["ab", "1", "'s", "ä", ",", "c"])
        if probe[0] != sum(parts, []) or len({tuple(p) for p in probe}) != 1:
            raise ValueError("the tokenizer does not split texts into independent pieces")
        self.chunks = re.compile(f"[^{WHITE}]+").findall
        self.code = {"<u2": "H", "<u4": "I"}[id_type(path)]
        self.tokens = self.tokenizer.model.tokenize
        self.letters = byte_characters()
        self.cache = Recent(CACHED_CHUNKS)
        self.pieces = Recent(CACHED_PIECES)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.new.get(piece) or self.pieces.again(piece)
        if ids is None:
            shown = piece if piece.isascii() else "".join(
                [self.letters[b] for b in piece.encode()])
            ids = array(self.code, [t.id for t in self.tokens(shown)]).tobytes()
            self.pieces.put(piece, ids)
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk not met lately: simple ones piece by piece, others whole."""
        ids = self.cache.new.get(chunk) or self.cache.again(chunk)
        if ids is None:
            plain = chunk.isascii() and len(chunk) <= CACHED_LENGTH
            if plain and chunk.isalpha():
                ids = self._piece(chunk.lower())
            elif plain and chunk[:-1].isalpha() and "!" <= chunk[-1] <= "~":  # one sign after
                ids = self._piece(chunk[:-1].lower()) + self._piece(chunk[-1])
            elif len(chunk) <= CACHED_LENGTH and SIMPLE(chunk) and "<|" not in chunk:
                ids = b"".join([self._piece(p) for p in SIMPLE_PIECES(chunk.lower())])
            else:
                ids = array(self.code, self._plain([chunk])[0]).tobytes()
            if len(chunk) <= CACHED_LENGTH:
                self.cache.put(chunk, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the text, each of the width `id_type` names."""
        # Latin-1 has no character whose lower case depends on others or on composition.
        if "<|" not in text and (text.isascii() or _latin1(text)):
            text = text.lower()
        chunks = self.chunks(text) if ODD_SPACE(text) else text.split()
        ids = list(map(self.cache.new.get, chunks))
        at = -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            ids[at] = self._chunk(chunks[at])
        return b"".join(ids)


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and rank bytes."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    used = np.arange(4) < size[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data


#: The four lengths that each control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks that `pack` wrote."""
    size = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    starts = ends - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    ranks = padded[starts].astype(np.uint32)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(size > byte)
        ranks[longer] |= padded[starts[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks


def tokenize(docs: DataFrame, path: str, end_id: int, text: str = "text") -> DataFrame:
    """`doc_id` and `ids` (BINARY, unsigned 16-bit where the vocabulary allows, else 32-bit)."""
    width = id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = task_cache(f"chunks:{path}", lambda: ChunkEncoder(path))
        tail = np.array([end_id], width).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                out = [ids + tail for ids in map(model.encode, texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", text).mapInArrow(run, T.StructType([
        docs.schema["doc_id"], T.StructField("ids", T.BinaryType())]))


def id_type(path: str) -> str:
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def count_ids(encoded: DataFrame, width: str) -> DataFrame:
    """How often each id occurs in all documents; one row per id and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = np.bincount(buffers(batch.column(0))[0].view(width), minlength=len(total))
            counts[:len(total)] += total
            total = counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total[seen])], names=["id", "n"])

    return (encoded.select("ids").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")))


def rank_of_ids(counts: DataFrame) -> np.ndarray:
    """Ids by falling frequency, ties by id. At most one row per vocabulary entry is collected."""
    rows = counts.orderBy(F.col("n").desc(), "id").select("id").collect()
    return np.array([r.id for r in rows], np.uint32)


def _file(ids: list[np.ndarray], ranked: np.ndarray, rank: np.ndarray) -> bytes:
    flat = np.concatenate(ids)
    control, data = pack(rank[flat])
    return b"".join([
        MAGIC, np.array([len(ids)], "<u4").tobytes(), np.array([len(flat)], "<u8").tobytes(),
        np.array([len(ranked)], "<u4").tobytes(), ranked.astype("<u4").tobytes(),
        np.array([len(x) for x in ids], "<u4").tobytes(), control, data])


def parse(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a file and the number of ids of each of its documents."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, = np.frombuffer(content, "<u4", 1, 4)
    n, = np.frombuffer(content, "<u8", 1, 8)
    ranks, = np.frombuffer(content, "<u4", 1, 16)
    docs, n, ranks, at = int(docs), int(n), int(ranks), 20
    ranked = np.frombuffer(content, "<u4", ranks, at)
    at += 4 * ranks
    sizes = np.frombuffer(content, "<u4", docs, at)
    at += 4 * docs
    control = np.frombuffer(content, np.uint8, -(-n // 4), at)
    data = np.frombuffer(content, np.uint8, -1, at + len(control))
    return ranked[unpack(control, data, n)], sizes


def write(encoded: DataFrame, folder: str, width: str) -> DataFrame:
    """Write the files in ascending doc_id order; returns one row per document.

    Rows: path, place in the file, doc_id. Each task writes its range of ids under its own name
    and moves the finished file into place, so a repeated task leaves the same files.
    """
    ranked = rank_of_ids(count_ids(encoded, width))
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    sent = encoded.sparkSession.sparkContext.broadcast((ranked, rank))
    id_field = encoded.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        held: list[np.ndarray] = []
        keys: list[pa.Array] = []
        n, number = 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{task.partitionId():06d}-{number:05d}.smtf"
            own = f"{root}/.{name}-{task.taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(_file(held, *sent.value))
            store.move(own, f"{root}/{name}")
            ids = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(ids)), pa.array(range(len(ids)), pa.int32()), ids],
                names=["file", "place", "doc_id"])

        for batch in batches:
            for at in range(batch.num_rows):
                held.append(np.frombuffer(batch.column(1)[at].as_buffer(), width))
                keys.append(batch.column(0).slice(at, 1))
                n += len(held[-1])
                if n >= FILE_IDS:
                    yield flush()
                    held, keys, n, number = [], [], 0, number + 1
        if held:
            yield flush()

    keyed = encoded.select("doc_id", "ids", F.xxhash64("ids").alias("_tie"))
    ordered = keyed.repartitionByRange(partitions(encoded), "doc_id", "_tie") \
        .sortWithinPartitions("doc_id", "_tie")
    return ordered.mapInArrow(run, T.StructType([
        T.StructField("file", T.StringType()), T.StructField("place", T.IntegerType()),
        id_field]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: file, place, first id's place in the file, number of
    ids, ids (BINARY, unsigned 32-bit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, sizes = parse(content)
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                for at in range(0, len(sizes), BATCH_ROWS):
                    e, s = ends[at:at + BATCH_ROWS], sizes[at:at + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([path.rsplit("/", 1)[1]] * len(s)),
                        pa.array(range(at, at + len(s)), pa.int32()),
                        pa.array(e - s), pa.array(s.astype(np.int64)),
                        pa.array([raw[4 * (b - c):4 * b] for b, c in zip(e.tolist(), s.tolist())],
                                 pa.binary())],
                        names=["file", "place", "first", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.smtf").load(folder)
    return files.select("path", "content").mapInArrow(
        run, "file string, place int, first long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Encode, write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    encoded = materialise(tokenize(docs, path, end_id), "token-ids")
    folder = run_folder(spark, "token-files")
    written = materialise(write(encoded, folder, id_type(path)), "token-index")
    if written.isEmpty():
        return written.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in (
            "start", "n_tokens", "ids_crc32")])
    back = materialise(read(spark, folder).select(
        "file", "place", "first", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-back")
    # File names ascend with the ids; one row per file carries the ids of all earlier files.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = back.groupBy("file").agg(F.sum("n_tokens").alias("_n")).select(
        "file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (written.join(back, ["file", "place"]).join(offsets, "file")
            .select("doc_id", (F.col("_before") + F.col("first")).alias("start"),
                    "n_tokens", "ids_crc32"))
