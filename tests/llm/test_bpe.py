"""Byte-level BPE against the library: odd texts, long unsplit text, added tokens, joins of every size, null and empty."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palisade.llm import byte_bpe
from tests.conftest import DATA
from tests.llm.test_operators import by_id, frame, odd_texts

FILE = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def data():
    with open(FILE, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def encoder(data):
    return byte_bpe.Encoder(data)


@pytest.fixture(scope="module")
def library(data):
    return Tokenizer.from_buffer(data)


def texts(n=1500, seed=1):
    rng = random.Random(seed)
    parts = ["a", "b", "'", "s", "ll", "'ll", "'s", " ", "  ", "\n", "1", "é", "日", "!", "\t", " ", "re", "'re", "\U0001f600", END, "²", "٣", "́", "\x1c", "\x85", "　"]
    fixed = ["", " ", "'s", "''s", " 's", "it's we'll I'd they've x'reb 'LL \n's 1's", "  a  b   ", "\n\n a\n", "a \n b", END, f"x {END}  {END} y", f"  {END}", "<|endoftext", "a" * 9000, "ab" * 3000 + " " + "日本語" * 900, "1" * 3000 + "!" * 2500 + " " * 3000, " " * 3000 + "x"]
    return fixed + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def test_texts_equal_the_library(encoder, library):
    some = texts()
    flat, cuts = encoder.encode_texts(some)
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == want
    assert [raw.decode("utf-8", "replace") for raw in encoder.decode(flat, cuts).to_pylist()] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_every_code_point_has_the_librarys_kind(encoder, library):
    for at in range(0, 0x110000, 1 << 15):
        some = [c for c in range(at, at + (1 << 15)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{chr(c)}1!{chr(c)}1" for c in some)
        starts = [a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert encoder.words([text])[2][:-1].tolist() == starts


def test_decoding_any_ids(encoder, library):
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        raw = encoder.decode(np.array(ids, np.int32), np.array([0, len(ids)])).to_pylist()[0]
        assert raw.decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("word_bytes, window_tokens, window_chars", [(16, 4, 64), (5, 1, 1), (1 << 11, 2, 3)])
def test_trees_of_pieces_equal_the_library(encoder, library, monkeypatch, word_bytes, window_tokens, window_chars):
    for name, value in (("WORD_BYTES", word_bytes), ("WINDOW_TOKENS", window_tokens), ("WINDOW_CHARS", window_chars)):
        monkeypatch.setattr(byte_bpe, name, value)
    monkeypatch.setattr(encoder, "place", {})
    monkeypatch.setattr(encoder, "known_ids", np.zeros(0, np.int32))
    monkeypatch.setattr(encoder, "known_sizes", np.zeros(0, np.int64))
    rng = random.Random(5)
    some = [t.replace(END, "<|") for t in texts(400, 2)] + ["".join(rng.choices("ab'srethin \n", k=2500)) for _ in range(2)] + ["".join(rng.choices("etaoinshrdlu", k=3000))]
    for text in some:
        want = library.encode(text, add_special_tokens=False).ids
        for size in (1, 2, 3, 7, 50) if len(text) < 200 else (97, 800):
            piece = encoder.tree([encoder.piece(text[i : i + size]) for i in range(0, len(text), size)] or [encoder.piece("")])
            assert piece.ids.tolist() == want, (text[:80], size)
            assert piece.chars.sum() == len(text) and piece.tokens.sum() == len(want) and piece.text == text


@pytest.mark.parametrize("block", [1 << 15, 40])
def test_documents(spark, library, monkeypatch, block):
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 50)
    some = [*odd_texts(), f"x {END}  {END} y" * 9, "q" * 300, "q" * 300, f"{END}{'ab' * 90}{END}"]
    df = frame(spark, some)
    got = by_id(byte_bpe.encode(df, FILE, block=block))
    assert sum(map(len, got.values())) == df.count()
    for doc, text in {(r["doc_id"], r["text"]) for r in df.collect()}:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        for r in got[doc]:
            assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == decoded, doc
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_documents_without_rows_or_ids(spark, library):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(empty, FILE).collect() == []
    none = spark.createDataFrame([(None, "one two"), (None, None), (None, "z" * 90)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in byte_bpe.encode(none, FILE, block=40).collect()) == sorted(len(library.encode(t, add_special_tokens=False).ids) for t in ("one two", "", "z" * 90))


def test_a_long_unsplit_text(spark, library):
    rng = random.Random(8)
    text = "".join(rng.choices("etaoinshrdlu", k=300_000))
    row = byte_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), FILE).collect()[0]
    assert row["ids"] == library.encode(text, add_special_tokens=False).ids and row["decoded"] == text


def test_other_tokenizers_are_refused(data):
    said = json.loads(data)
    for change in ({"normalizer": {"type": "NFC"}}, {"model": said["model"] | {"ignore_merges": True}}, {"model": said["model"] | {"merges": said["model"]["merges"][::-1]}}):
        with pytest.raises(ValueError):
            byte_bpe.Encoder(json.dumps(said | change).encode())


def test_query(spark, library):
    from palisade.llm import queries

    got = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and set(next(iter(got.values())).asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
