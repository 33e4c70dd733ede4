"""Byte-level BPE against the public library, and the odd cases of tables."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from sqlcheck import SF_DIR

from arborql.llm import byte_bpe, queries

VOCAB, PATTERN = queries.byte_vocab()


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(VOCAB))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts() -> list[str | None]:
    r = random.Random(7)
    any_char = [chr(c) for _ in range(3000) if not 0xD800 <= (c := r.randrange(0x110000)) < 0xE000]
    return [
        None, "", " ", "\n\n  \t x", "It's we'll 'S 12345 a1b2", "é ÀÉ ß naïve 漢字かな 한국어 🙂👩‍👩‍👧", "\x00\x01\x7f\x80 ", "▁▁ <unk> <s> not a piece <|endoftext|>",
        "".join(any_char), " ".join(any_char), "a" * 50_000, " " * 50_000, "=-" * 20_000, "".join(r.choice("abcdefgh") for _ in range(200_000)),
        " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 12))) for _ in range(40_000)), "It's we'll 'S 12345 a1b2",
    ]


def test_every_token_alone_is_itself():
    c = byte_bpe.Codec(VOCAB, PATTERN)
    tokens = byte_bpe.read_ranks(VOCAB)
    mapped = [t.decode("latin-1").translate(c.mapped) for t in tokens]
    assert c.model.encode(mapped, out_type=int) == [[i] for i in range(len(tokens))]
    assert c.pieces.to_pylist() == tokens


def test_every_code_point_is_split_alike(library):
    c = byte_bpe.Codec(VOCAB, PATTERN)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a1!{x}b2?{x}{x} {x}  x" for x in every[k:k + 500]) for k in range(0, len(every), 500)]
    assert list(map(c.encode, texts)) == library.encode_ordinary_batch(texts)


def test_stretches(library):
    """White space of every kind beside spaces, and a pattern that may match across them."""
    c = byte_bpe.Codec(VOCAB, PATTERN)
    assert c.by_space
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b1", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\r\n", "'s", "'", ".", "é", "中", "\u0301", "\u200b"]) for _ in range(r.randrange(1, 14)))
        assert c.encode(text) == library.encode_ordinary(text), repr(text)
    other = r"[a-z]+ [a-z]+|\s+|\S+"
    c = byte_bpe.Codec(VOCAB, other)
    library = tiktoken.Encoding("other", pat_str=other, mergeable_ranks={t: i for i, t in enumerate(byte_bpe.read_ranks(VOCAB))}, special_tokens={})
    assert not c.by_space and c.encode("one two three") == library.encode_ordinary("one two three")


def test_words_beyond_the_store(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 10)
    c = byte_bpe.Codec(VOCAB, PATTERN)
    r = random.Random(1)
    for _ in range(30):
        text = " ".join(f"word{r.randrange(40)}" for _ in range(20))
        assert c.encode(text) == library.encode_ordinary(text)
    assert len(c.kept) + len(c.older) < 100


def test_refused_vocabularies(tmp_path):
    for name, lines in {"gap": b"YQ== 0\nYg== 2\n", "bytes": b"YQ== 0\nYg== 1\n"}.items():
        (tmp_path / name).write_bytes(lines)
        with pytest.raises(ValueError):
            byte_bpe.read_ranks(str(tmp_path / name))


@pytest.mark.parametrize("packed", [False, True])
def test_tables(spark, library, packed, monkeypatch):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)] + [(None, "no id", None, None)], "doc_id long, text string, decoded_sha256 string, n_tokens int").repartition(3)
    both = byte_bpe.decode(byte_bpe.encode(df, VOCAB, PATTERN, packed=packed), VOCAB, PATTERN)
    rows = {r["doc_id"]: r for r in both.collect()}
    assert len(rows) == len(texts) + 1 and rows[None]["decoded"] == b"no id"
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        ids = rows[i]["ids"]
        assert (list(struct.unpack(f"<{len(ids) // 4}I", ids)) if packed else ids) == want, i
        assert bytes(rows[i]["decoded"]) == (t or "").encode()
    assert byte_bpe.encode(df.limit(0), VOCAB, PATTERN).count() == 0
    for f in (lambda: byte_bpe.encode(df, VOCAB, PATTERN, out_col="N_TOKENS"), lambda: byte_bpe.decode(byte_bpe.encode(df, VOCAB, PATTERN), VOCAB, PATTERN, out_col="text")):
        with pytest.raises(ValueError):
            f()
    nulls = spark.createDataFrame([(None,), ([],), ([262],)], "ids array<int>")
    assert [bytes(r[0]) for r in byte_bpe.decode(nulls, VOCAB, PATTERN).select("decoded").collect()] == [b"", b"", library.decode_bytes([262])]


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.QUERIES["op11_byte_bpe"](spark, SF_DIR)
    assert rows.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r["doc_id"]: tuple(r)[1:4] for r in rows.collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
