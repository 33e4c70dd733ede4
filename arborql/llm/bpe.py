"""BPE encoding and decoding with a merge-rank heap over a doubly linked symbol list.

The vocabulary file is a parameter (a path that every executor can read); it is never copied or trained.
Supported file: a JSON tokenizer whose normalizer is NFC + white space to one space + lower case, whose
pre-tokenizer splits by a pattern and maps bytes to printable characters, and whose model is BPE with an
end-of-word suffix. Special tokens in a text become their own ids, as in the public library."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborql.llm.common import release

#: The pre-tokenizer's pattern, and Unicode's White_Space characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = r"[\t-\r \x85\xa0  -     　]+"

#: Words whose ids a worker keeps; beyond it the store starts anew, so memory is bounded.
WORDS_KEPT = 240_000
#: Text characters handled and sent back at once by a worker.
CHARS_AT_ONCE = 2_000_000


def printable_bytes() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Codec:
    """One vocabulary. ``encode`` gives ids, ``decode`` the text that the library gives for ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocab
        #: left id << 32 | right id -> rank; rank -> merged id
        self.ranks = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.words_of = regex.compile(PATTERN)
        self.space = regex.compile(SPACE)
        self.by_special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special else None
        )
        self.marks = tuple({s[0] for s in self.special})
        alphabet = printable_bytes()
        self.byte_ids = [ids.get(c, -1) for c in alphabet]
        self.last_ids = [ids.get(c + self.suffix, -1) for c in alphabet]
        self.strings = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in [*ids.items(), *self.special.items()]:
            self.strings[i] = s
        #: ids of words met lately, and of their pieces
        self.kept = Kept(self.word_ids)
        self.pieces: dict[str, list[int]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge symbol ids by rank. nxt/prv link the list; a heap entry (rank and place in one number) is
        stale when the rank now at its place is another."""
        n = len(symbols)
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(symbols[i] << 32 | symbols[i + 1], -1) for i in range(n - 1)]
        ranks.append(-1)
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return symbols
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        while heap:
            e = heappop(heap)
            i, r = e & 0xFFFFFFFF, e >> 32
            if ranks[i] != r:
                continue
            j = nxt[i]
            symbols[i] = m = merged[r]
            symbols[j] = ranks[j] = -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                ranks[i] = r = rank_of(m << 32 | symbols[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                ranks[i] = -1
            h = prv[i]
            if h >= 0:
                ranks[h] = r = rank_of(symbols[h] << 32 | m, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def piece_ids(self, piece: str) -> list[int]:
        body = piece.encode("utf-8", "surrogatepass")
        symbols = [self.byte_ids[b] for b in body]
        symbols[-1] = self.last_ids[body[-1]]
        if len(symbols) == 1:
            return symbols if symbols[0] >= 0 else []
        return self.merge(symbols if min(symbols) >= 0 else [s for s in symbols if s >= 0])

    def word_ids(self, word: str) -> list[int]:
        """Ids of a stretch without white space."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        out: list[int] = []
        kept = self.pieces
        for piece in self.words_of.findall(word.lower()):
            found = kept.get(piece)
            if found is None:
                found = self.piece_ids(piece)
                if len(piece) <= 200:
                    kept[piece] = found
            out += found
        if len(kept) >= WORDS_KEPT:
            self.pieces = {}
        return out

    def parts(self, text: str | None) -> list[list[int]]:
        """Ids of a text, in lists that follow one another."""
        if not text:
            return []
        if self.by_special is None or not any(m in text for m in self.marks):
            return self.plain(text)
        out: list[list[int]] = []
        for k, part in enumerate(self.by_special.split(text)):
            if k % 2:
                out.append([self.special[part]])
            elif part:
                out += self.plain(part)
        return out

    def plain(self, text: str) -> list[list[int]]:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return list(map(self.kept.__getitem__, filter(None, self.space.split(text)) if odd else text.split()))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def decode(self, ids) -> str:
        """Vocabulary strings joined; this file names no decoder, so they stand with a space between."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


class Kept(dict):
    """Ids of words met lately: a missing word is encoded; when half the bound is reached, the words met since
    become the older generation, from which a word met again comes back."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> list[int]:
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
        if len(self) >= WORDS_KEPT // 2:
            self.older = dict(self)
            self.clear()
        if len(word) <= 200:
            self[word] = found
        return found


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _parts(batch: pa.RecordBatch, lengths) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about CHARS_AT_ONCE; a single longer row is a part of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > CHARS_AT_ONCE:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _fresh(df: DataFrame, *names: str) -> None:
    for n in names:
        if n.lower() in {c.lower() for c in df.columns}:
            raise ValueError(f"column {n} exists already; pass another out_col")


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", out_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) plus ``out_col`` array<int>. A null or empty text has no ids. Any length;
    repeated rows are encoded alike; an empty table gives an empty result; a clashing out_col is refused."""
    _fresh(df, out_col)
    keep = df.columns if keep is None else keep
    fields = [df.schema[c] for c in keep]

    def run(batches):
        c = codec(vocab_path)
        for whole in batches:
            sizes = [0 if n is None else n for n in pa.compute.binary_length(whole.column(0)).to_pylist()]
            for b in _parts(whole, sizes):
                texts = [c.parts(t) for t in b.column(0).to_pylist()]
                ends = np.cumsum([0, *[sum(map(len, x)) for x in texts]])
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(texts)), np.int32, ends[-1])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], ids], [*keep, out_col])
                texts = flat = ids = None
        release()

    src = df.select(F.col(text_col).alias("__text"), *[F.col(k) for k in keep])
    return src.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns plus ``out_col``: the text of the ids. Null or empty ids give an empty text."""
    _fresh(df, out_col)
    names = df.columns

    def run(batches):
        c = codec(vocab_path)
        at = names.index(ids_col)
        vocabulary = pa.array(c.strings, pa.string())
        for whole in batches:
            sizes = [4 * (n or 0) for n in pa.compute.list_value_length(whole.column(at)).to_pylist()]
            for b in _parts(whole, sizes):
                # the vocabulary's strings are taken and joined by Arrow, a list at a time
                ids = b.column(at)
                ends = ids.offsets.to_numpy()
                own = vocabulary.take(ids.values.slice(ends[0], ends[-1] - ends[0]))
                texts = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), own), " ")
                texts = pa.compute.if_else(ids.is_null(), "", texts)
                yield pa.RecordBatch.from_arrays([*b.columns, texts], [*names, out_col])
                own = texts = ids = None
        release()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def digests(df: DataFrame, vocab_path: str) -> DataFrame:
    """Per document: n_tokens and SHA-256 of the ids (decimal, one space between) and of the decoded text."""
    both = decode(encode(df, vocab_path, keep=["doc_id"]), vocab_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
