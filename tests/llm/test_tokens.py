import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import bpe, queries, tokenfile
from tests.llm import fixtures as fx

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
WIDTH = tokenfile.id_type(WORDS)


@pytest.fixture(scope="module")
def models():
    return (bpe.PrefixBPE(BYTES), Tokenizer.from_file(BYTES),
            tokenfile.ChunkEncoder(WORDS), Tokenizer.from_file(WORDS))


ODD = "ab  \n\t'sS<|endoftext|>é1२ ́  x \x1c᠎​\x85中😀!!tl\x00ΣİIﬁÅŸƁ½²"


def same(models, texts):
    fast, plain, chunked, words = models
    table = bpe.token_bytes(BYTES)
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert list(array("I", fast.encode(text))) == ids
        assert bpe.decode_ids(fast.encode(text), table) == plain.decode(
            ids, skip_special_tokens=False)
        assert np.frombuffer(chunked.encode(text), WIDTH).tolist() == words.encode(
            text, add_special_tokens=False).ids


def test_encoders_equal_the_library_on_odd_texts(models):
    rng = random.Random(4)
    same(models, ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60)))
                  for _ in range(1500)])
    same(models, [t or "" for t in fx.make_texts()])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoders_equal_the_library(text):
    if not hasattr(test_encoders_equal_the_library, "models"):
        test_encoders_equal_the_library.models = (
            bpe.PrefixBPE(BYTES), Tokenizer.from_file(BYTES),
            tokenfile.ChunkEncoder(WORDS), Tokenizer.from_file(WORDS))
    same(test_encoders_equal_the_library.models, [text])


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 5)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 4)
    model, plain = bpe.PrefixBPE(BYTES), Tokenizer.from_file(BYTES)
    for text in fx.make_texts()[:20]:
        assert list(array("I", model.encode(text))) == plain.encode(text).ids
    assert len(model.cache.new) <= 5 and len(model.follows) <= 4


def test_digests(spark):
    rows = fx.make_rows()
    plain = Tokenizer.from_file(BYTES)
    want = []
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode())
                     .hexdigest()))
    got = queries.bpe_digests(fx.documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert queries.bpe_digests(fx.documents(spark, [])).count() == 0


def test_decode_column(spark):
    rows = [(1, "a <|endoftext|> ß", *[None] * 8), (2, None, *[None] * 8)]
    ids = bpe.encode(fx.documents(spark, rows), BYTES)
    got = {r[0]: r[1] for r in ids.select("doc_id", bpe.decode(ids["ids"], BYTES)).collect()}
    assert got == {1: "a <|endoftext|> ß", 2: ""}


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1001])
def test_pack_round_trip(top, n):
    ranks = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    control, data = tokenfile.pack(ranks)
    assert len(control) == -(-n // 4)
    back = tokenfile.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
    assert (back == ranks).all()


@pytest.mark.parametrize("file_ids", [4_000_000, 500])
def test_files(spark, monkeypatch, file_ids):
    monkeypatch.setattr(tokenfile, "FILE_IDS", file_ids)
    rows = fx.make_rows()
    plain = Tokenizer.from_file(WORDS)
    want = []
    for r in rows:
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = tokenfile.write_and_read(fx.documents(spark, rows), WORDS, end_id=1).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(
        want, key=str)
    got.sort(key=lambda r: r.start)
    before = 0
    for r in got:
        assert r.start == before
        before += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_no_files(spark):
    assert tokenfile.write_and_read(fx.documents(spark, []), WORDS, end_id=1).count() == 0


def test_a_worker_remembers_a_bounded_part_of_its_texts():
    """pipeline: two workers and the JVM share the memory of an executor."""
    model = bpe.PrefixBPE(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(160_000):
        model.encode(f"{k}x{k}")
    held = [v for c in (model.cache, model.known_pieces) for v in (c.new, c.old)]
    assert sum(map(len, held)) <= 220_000 and len(model.follows) <= 100_000


def test_latin_text_is_split_into_pieces_at_once():
    """op10: splitting into chunks first made and remembered most words twice."""
    model, plain = bpe.PrefixBPE(BYTES), Tokenizer.from_file(BYTES)
    model.chunks = model.pieces = None
    letters = [chr(c) for c in range(0xc0, 0x250)]
    for text in ["Été, l'été's naïve  señor\n\n Łódź ×2÷3 !\t", "".join(letters), " ".join(letters),
                 "1".join(letters), "!".join(letters), " \x00\x7f é\x1b\r\n"]:
        assert list(array("I", model.encode(text))) == plain.encode(
            text, add_special_tokens=False).ids
    assert not model.known_pieces.new


def test_ids_of_many_texts_are_decoded_at_once():
    """Lists of ids that are empty or break characters give what each gives alone."""
    model, table = bpe.PrefixBPE(BYTES), bpe.token_bytes(BYTES)
    whole = [model.encode(t) for t in ("", "née à Þórshöfn", "日本語 🙂", "<|endoftext|> x")]
    ids = [*whole, *[v[4:] for v in whole], *[v[:-4] for v in whole], b""]
    tokens = bpe.token_array(BYTES)
    assert bpe.decode_all(ids, tokens) == [bpe.decode_ids(v, table) for v in ids]
    assert bpe.decode_all([b"", b""], tokens) == ["", ""] and bpe.decode_all([], tokens) == []
