"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a piece has exactly one last token in its BPE result. The candidates for it are
the vocabulary tokens that end there (one pass of a suffix-linked automaton over the piece); the
right one is that which may follow the last token of the shorter prefix, by a test on the two
tokens alone. Following the stored last tokens back from the end gives the exact ids.

Null texts count as empty and have no ids. Repeated rows are encoded alike; further columns pass
through untouched. A text of any length is read once, piece by piece.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shelfmark.llm.common import Recent, release, task_cache

#: The Unicode White_Space characters (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Longest text, and numbers of what texts are split into (pieces of Latin text, chunks of other),
#: of pieces of chunks and of token pairs, that a worker remembers.
CACHED_LENGTH = 48
CACHED_CHUNKS = 90_000
CACHED_PIECES = 20_000
CACHED_PAIRS = 100_000
#: Latin letters (U+00C0 to U+024F hold nothing else but two signs), and text of these and ASCII
#: without U+001C to U+001F, which only Python's \\s takes for white space.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN = re.compile("[\\x00-\\x1b\\x20-\\x7f\u00c0-\u024f]*").fullmatch
#: How such text splits into pieces (fixed pattern; other text is split by the library).
LATIN_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+").findall
#: Rows per batch handed back by a task.
BATCH_ROWS = 256


class PrefixBPE:
    """The tables of one byte-level BPE vocabulary file and the encoder over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        plain = not (spec["normalizer"] or model.get("dropout") or model.get("ignore_merges")
                     or pre.get("add_prefix_space"))
        if not plain or pre.get("type") != "ByteLevel" or any(
                t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only plain byte-level BPE files are supported")
        # Splitting needs no vocabulary, which the library would hold a second time.
        split = spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [],
                        "post_processor": None}
        self.pieces = Tokenizer.from_str(json.dumps(split)).pre_tokenizer.pre_tokenize_str
        self._read(model["vocab"], [m.split(" ") if isinstance(m, str) else m
                                    for m in model["merges"]])
        self.added = {t["content"]: t["id"] for t in added}
        self.specials = re.compile(
            "(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")"
        ) if added else None
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        self.cache = Recent(CACHED_CHUNKS)
        self.known_pieces = Recent(CACHED_PIECES)

    def _read(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        """Order tokens by the merge that makes them; single characters come first."""
        made = [a + b for a, b in merges]
        if len(set(made)) != len(made):
            raise ValueError("a token is made by two merges")
        known = set(made)
        tokens = [t for t in vocab if t not in known and len(t) == 1] + made
        number = {t: i for i, t in enumerate(tokens)}
        self.ids = [vocab[t] for t in tokens]
        self.packed = [array("I", [i]).tobytes() for i in self.ids]
        self.sizes = [len(t) for t in tokens]
        first = len(tokens) - len(made)
        self.left = list(range(first)) + [number[a] for a, _ in merges]
        self.right = list(range(first)) + [number[b] for _, b in merges]
        self.first = first
        self.merged = {(number[a], number[b]): number[a + b] for a, b in merges}
        self.follows: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in number.items():
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.visible = {b: c for b, c in byte_characters().items() if chr(b) != c}
        self.space = self.visible[32]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' joined string gives these two tokens again.

        Undo merges on either side of the border, the latest first. The pair stands unless some
        pair across the border merges earlier than the merge undone there.
        """
        key = a * len(self.ids) + b
        bound, stands = len(self.ids), True
        while True:
            merge = self.merged.get((a, b))
            if merge is not None and merge < bound:
                stands = False
                break
            undo_left = a > b
            token = a if undo_left else b
            if token < self.first:  # both are single characters
                break
            if undo_left:
                bound, a = a, self.right[a]
            else:
                bound, b = b + 1, self.left[b]
        if len(self.follows) >= CACHED_PAIRS:
            self.follows.clear()
        self.follows[key] = stands
        return stands

    def encode_piece(self, piece: str) -> bytes:
        whole = self.automaton.get(piece, None)
        if whole:  # no token comes before one that begins the piece
            return self.packed[whole[0]]
        size = len(piece)
        last = [-1] * size  # token number that ends the prefix up to each character
        tokens, follows = len(self.ids), self.follows
        for end, (token, length) in self.automaton.iter(piece):
            if last[end] >= 0:
                continue
            start = end - length
            if start >= 0:
                before = last[start]
                if before < 0:
                    continue
                stands = follows.get(before * tokens + token)
                if stands is None:
                    stands = self.may_follow(before, token)
                if not stands:
                    continue
            last[end] = token
        ids, end = [], size - 1
        while end >= 0:
            token = last[end]
            if token < 0:
                raise ValueError("a byte of the text is not in the vocabulary")
            ids.append(self.packed[token])
            end -= self.sizes[token]
        ids.reverse()
        return b"".join(ids)

    def _bytes_of(self, piece: str) -> str:
        """The piece as the characters that stand for its bytes."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
        elif piece.isprintable():
            return piece.replace(" ", self.space)
        return piece.translate(self.visible)

    def _piece(self, piece: str, memory: Recent) -> bytes:
        ids = memory.new.get(piece) or memory.again(piece)
        if ids is None:
            ids = self.encode_piece(self._bytes_of(piece))
            if len(piece) <= CACHED_LENGTH:
                memory.put(piece, ids)
        return ids

    def _chunk(self, chunk: str, memory: Recent) -> bytes:
        ids = memory.new.get(chunk) or memory.again(chunk)
        if ids is None:
            pieces = LATIN_PIECES(chunk) if LATIN(chunk) else [
                chunk[a:b] for _, (a, b) in self.pieces(chunk)]
            ids = b"".join([self._piece(p, self.known_pieces) for p in pieces])
            if len(chunk) <= CACHED_LENGTH:
                memory.put(chunk, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.specials.split(text) if self.specials else [text]
        out: list[bytes] = []
        for n, part in enumerate(parts):
            if n % 2:
                out.append(array("I", [self.added[part]]).tobytes())
            else:
                split, made = (LATIN_PIECES, self._piece) if LATIN(part) else (
                    self.chunks, self._chunk)
                texts = split(part)
                ids = list(map(self.cache.new.get, texts))
                at = -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    ids[at] = made(texts[at], self.cache)
                out += ids
        return b"".join(out)


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in byte_characters().items()}
    table = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    return table | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def decode_ids(ids: bytes, table: dict[int, bytes]) -> str:
    return b"".join([table[i] for i in array("I", ids)]).decode("utf-8", "replace")


def token_array(path: str) -> pa.Array:
    """The bytes of each id, by id."""
    table = token_bytes(path)
    return pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.large_binary())


def decode_all(ids: list[bytes], tokens: pa.Array) -> list[str]:
    """The text of each list of ids: the tokens of all are taken at once and lie end to end."""
    taken = tokens.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
    if not len(taken):
        return [""] * len(ids)
    starts = np.frombuffer(taken.buffers()[1], np.int64)
    ends = starts[np.cumsum([0, *[len(v) // 4 for v in ids]])]
    body = memoryview(taken.buffers()[2])
    return [str(body[a:b], "utf-8", "replace") for a, b in zip(ends, ends[1:])]


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """Replace the text by BINARY `ids`, little-endian unsigned 32-bit; one row per input row.

    With `decoded`, a column of that name holds the text that the ids stand for.
    """
    rest = [f for f in docs.schema.fields if f.name not in (text, ids, decoded)]
    # The other columns pass through the task as one, whatever their names.
    row = [F.struct(*[F.col(f"`{f.name}`") for f in rest]).alias("_row")] if rest else []
    body = docs.select(*row, F.col(text).alias("_text"))
    made = [T.StructField(ids, T.BinaryType())]
    if decoded:
        made.append(T.StructField(decoded, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("powers:")
        release("chunks:")
        model = task_cache(f"bpe:{path}", lambda: PrefixBPE(path))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                out = [model.encode(t) if t else b"" for t in part.column("_text").to_pylist()]
                columns = [*part.columns[:-1], pa.array(out, pa.binary())]
                if decoded:
                    tokens = task_cache(f"tokens:{path}", lambda: token_array(path))
                    columns.append(pa.array(decode_all(out, tokens), pa.string()))
                yield pa.RecordBatch.from_arrays(
                    columns, names=[*(["_row"] if rest else []), *[f.name for f in made]])

    schema = [T.StructField("_row", T.StructType(rest))] if rest else []
    out = body.mapInArrow(run, T.StructType(schema + made))
    return out.select(*[F.col(f"_row.`{f.name}`").alias(f.name) for f in rest],
                      *[f.name for f in made])


def decode(ids: Column, path: str) -> Column:
    """The text of BINARY ids as `encode` writes them; special tokens are kept."""
    @F.pandas_udf(T.StringType())
    def text_of(values: pd.Series) -> pd.Series:
        table = task_cache(f"bytes:{path}", lambda: token_bytes(path))
        return values.map(lambda v: decode_ids(v, table) if v else "")

    return text_of(ids)
