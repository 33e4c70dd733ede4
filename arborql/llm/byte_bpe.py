"""Byte-level BPE by a rank file, through a sentencepiece model that is written from the vocabulary itself.

The rank file (a line a token: its bytes in base64, and its rank) becomes a sentencepiece BPE model: every token's bytes
are mapped to printable characters, a character a byte, and scored by the negative rank; normalisation is the identity.
Both algorithms merge the adjacent pair whose joined bytes have the least rank, leftmost first, so a pre-token's ids are
equal. The vocabulary's path is a parameter (a file that every executor can read); nothing is trained or copied."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import chain, compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborql.llm.bpe import _fresh, _parts, printable_bytes
from arborql.llm.common import release

#: Stretches of text whose ids a worker keeps, in two generations; longer ones than this are not kept.
KEPT, KEPT_CHARS = 200_000, 100
#: Fixed value: the pattern by which a space between two characters that are no white space always begins a match.
SPACE_BEGINS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Such a space, and a space beside other white space or at an end.
LONE_SPACE, ODD_SPACE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\A |\s | \s| \Z")
#: Fixed values of the model file's format: kinds of pieces and of models, and a name that no mapped text can hold.
NORMAL, UNKNOWN, BPE_MODEL, UNKNOWN_PIECE = 1, 2, 2, "not a piece"


def read_ranks(path: str) -> list[bytes]:
    """The tokens' bytes by rank. Ranks must be 0, 1, ..., and every single byte a token."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(pairs))) or len({*tokens.values()}) != len(pairs):
        raise ValueError(f"{path}: ranks must be 0, 1, ... and tokens distinct")
    if not {bytes([b]) for b in range(256)} <= {*tokens.values()}:
        raise ValueError(f"{path}: every single byte must be a token")
    return [tokens[r] for r in range(len(tokens))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message: bytes with their length, a number as varint, or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece i is token i. Ranks under 2^24 are exact as 32-bit scores."""
    if len(tokens) >= 1 << 24:
        raise ValueError("too many tokens for exact scores")
    alphabet = printable_bytes()
    pieces = [
        _field(1, _field(1, "".join([alphabet[b] for b in t]).encode()) + _field(2, float(-rank)) + _field(3, NORMAL))
        for rank, t in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, UNKNOWN_PIECE.encode()) + _field(2, 0.0) + _field(3, UNKNOWN)))
    trainer = _field(3, BPE_MODEL) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(45, UNKNOWN_PIECE.encode())
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, spaces kept as they are
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class Codec:
    """One vocabulary: ids of pre-tokens by sentencepiece, bytes of ids by the inverse mapping of its pieces."""

    def __init__(self, path: str, pattern: str):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        alphabet = printable_bytes()
        self.mapped = {b: c for b, c in enumerate(alphabet)}
        back = {c: b for b, c in enumerate(alphabet)}
        self.pieces = pa.array([bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(len(tokens))], pa.large_binary())
        self.words_of = regex.compile(pattern)
        self.by_space = pattern == SPACE_BEGINS
        #: packed ids of stretches met lately; beyond half the bound they become the older ones
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def stretches(self, text: str) -> list[str]:
        """Parts of a text between which a match always ends, so that each has its ids whatever stands around it."""
        if not self.by_space:
            return [text]
        if ODD_SPACE.search(text):
            cut = LONE_SPACE.split(text)
        else:
            cut = text.split(" ")
        return [cut[0], *[" " + x for x in cut[1:]]]

    def matches(self, stretch: str) -> list[str]:
        """The pre-tokens of a stretch; by the pattern that is known, letters after at most one space are one."""
        if self.by_space and stretch[1:].isalpha() and (stretch[0] == " " or stretch[0].isalpha()):
            return [stretch]
        return self.words_of.findall(stretch)

    def mapped_words(self, words: list[str]) -> list[str]:
        """Words with a character for each byte, all in one pass: what stands between them is a byte that UTF-8 has not."""
        if not words:
            return []
        whole = "\udcff".join(words).encode("utf-8", "surrogateescape").decode("latin-1")
        return whole.translate(self.mapped | {0xFF: "\n"}).split("\n")

    def packed_ids(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, by one call of the model."""
        coded = self.model.encode(self.mapped_words(words), out_type=int, num_threads=1)
        ends = np.cumsum([0, *map(len, coded)])
        whole = np.fromiter(chain.from_iterable(coded), np.dtype("<i4"), ends[-1]).tobytes()
        ends = (4 * ends).tolist()
        return [whole[i:j] for i, j in zip(ends, ends[1:])]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's packed ids. The pre-tokens of stretches that are not kept go to the model in one call."""
        cut = [self.stretches(t) if t else [] for t in texts]
        kept = self.kept
        found = [list(map(kept.get, ws)) for ws in cut]
        every = chain.from_iterable
        fresh = {*compress(every(cut), map(is_, every(found), repeat(None)))}
        missing = [*fresh.difference(self.older)]
        kept |= {w: self.older[w] for w in fresh.intersection(self.older)}
        words = list(map(self.matches, missing))
        each = [*{*every(words)}]
        packed = dict(zip(each, self.packed_ids(each)))
        kept |= zip(missing, [b"".join(map(packed.__getitem__, ws)) for ws in words])
        out = [b"".join(map(kept.__getitem__, ws) if None in got else got) for ws, got in zip(cut, found)]
        for w in missing:
            if len(w) > KEPT_CHARS:
                del kept[w]
        if len(kept) > KEPT // 2:
            self.older, self.kept = kept, {}
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<i4").tolist()

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of ids by rows, which end at ends[1:]: the pieces taken in order are the rows' bytes already."""
        taken = self.pieces.take(pa.array(ids))
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:taken.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int32)), taken.buffers()[2]])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _cut(whole: pa.RecordBatch, at: int, a_char: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch by the length of column ``at``, of which ``a_char`` units stand for a character of text."""
    column = whole.column(at)
    lists = pa.types.is_list(column.type)
    sizes = pa.compute.list_value_length(column) if lists else pa.compute.binary_length(column)
    return _parts(whole, [(n or 0) // a_char for n in sizes.to_pylist()])


def encode(df: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", out_col: str = "ids", keep: list[str] | None = None, packed: bool = False) -> DataFrame:
    """``keep`` (default: all columns) plus ``out_col``: the ids of each text's pre-tokens (matches of ``pattern``) as
    array<int>, or ``packed`` as binary of little-endian unsigned 32-bit integers. A null or empty text has no ids;
    texts of any length are taken whole; repeated rows are encoded alike; an empty table gives an empty result; a
    clashing out_col is refused."""
    _fresh(df, out_col)
    keep = df.columns if keep is None else keep
    fields = [df.schema[c] for c in keep]

    def run(batches):
        c = codec(vocab_path, pattern)
        for whole in batches:
            for b in _cut(whole, 0):
                ids = c.encode_batch(b.column(0).to_pylist())
                if packed:
                    out = pa.array(ids, pa.binary())
                else:
                    ends = np.cumsum([0, *map(len, ids)]) // 4
                    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], out], [*keep, out_col])
                ids = out = None
        release()

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    src = df.select(F.col(text_col).alias("__text"), *[F.col(k) for k in keep])
    return src.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, kind)]))


def decode(df: DataFrame, vocab_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns plus ``out_col``: the bytes of the ids, array<int> or packed. Null or empty ids give no bytes; an id
    that is no rank is an error."""
    _fresh(df, out_col)
    names = df.columns
    packed = isinstance(df.schema[ids_col].dataType, T.BinaryType)

    def flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, and where each row's end."""
        sizes = pa.compute.binary_length(ids) if packed else pa.compute.list_value_length(ids)
        ends = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        if packed:
            at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1] if len(ids) else [0]
            return np.frombuffer((ids.buffers()[2] or b"")[at[0]:at[-1]], "<i4"), ends // 4
        return ids.flatten().to_numpy(zero_copy_only=False), ends

    def run(batches):
        c, at = codec(vocab_path, pattern), names.index(ids_col)
        for whole in batches:
            for b in _cut(whole, at, 4 if packed else 1):
                out = c.decode_batch(*flat(b.column(at)))
                yield pa.RecordBatch.from_arrays([*b.columns, out], [*names, out_col])
                out = None
        release()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())]))


def digests(df: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """Per document: n_tokens, and SHA-256 of the packed ids and of the decoded bytes."""
    both = decode(encode(df, vocab_path, pattern, keep=["doc_id"], packed=True), vocab_path, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
