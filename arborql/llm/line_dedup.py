"""Line dedup over documents: lines that many documents hold stay in one of them.

Line keys are hashed to 128 bits; (hash, document, place) rows are range-partitioned on the hash and the
document, so that one very common line spreads over many partitions, and sorted with the largest document
first. A stream over each partition meets a key's first document, which keeps the line, and drops it in the
others once enough documents have come; it holds no more of a key than the rows before that. Keys at a partition's
edges may go on next door: their counts, one row for each edge, are summed and joined back. Decisions return as compressed bitmaps, not as text."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborql.llm.common import WS_CHARS, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id among the hashed rows: the least long, so such a document never keeps a shared line.
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WS_CHARS)), UPPER, LOWER)


def hashed_lines(df: DataFrame, least_chars: int, text_col: str = "text") -> DataFrame:
    """(h1, h2, doc, th, pos) of every line whose key is long enough; th tells apart texts of one doc_id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = df.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"),
        F.posexplode(F.transform(F.split(text, "\n", -1), line_key)).alias("pos", "key"),
    ).where(F.char_length("key") >= least_chars)
    return x.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "th", "pos")


STREAM = T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("h1", "h2", "doc", "th", "pos", "docs")]])


#: Rows of one key that a worker holds; beyond it they go out undecided.
HELD = 1 << 18


class _Key:
    """The key that a stream is in: its largest document, which comes first, and how many have come. Rows are held until
    as many documents as drop the line have been seen, and after that only those of the largest document."""

    def __init__(self, cols: list[np.ndarray]):
        self.hash, self.top, self.docs, self.last = (cols[0][0], cols[1][0]), cols[2][0], 0, None
        self.held: list[list[np.ndarray]] = []
        self.rows, self.sent, self.decided = 0, False, False

    def _hold(self, cols):
        if len(cols[0]):
            self.held.append(cols)
            self.rows += len(cols[0])

    def add(self, cols, least_docs: int):
        doc = cols[2]
        self.docs += int((doc[1:] != doc[:-1]).sum()) + (self.last is None or doc[0] != self.last)
        self.last = doc[-1]
        if not self.decided and self.docs >= least_docs:
            self.decided = True
            for old in self.take():
                yield from self.parted(old)
        if self.decided:
            yield from self.parted(cols)
        else:
            self._hold(cols)
        if self.rows > HELD:
            self.sent = True
            yield from (("edge", old) for old in self.take())

    def take(self) -> list:
        out, self.held, self.rows = self.held, [], 0
        return out

    def parted(self, cols):
        """The largest document's rows stay held, as its key may go on next door; the others are dropped."""
        top = cols[2] == self.top
        if top.any():
            self._hold([c[top] for c in cols])
            cols = [c[~top] for c in cols]
        if len(cols[0]):
            yield "drop", cols

    def end(self, first: bool, last: bool):
        if last or first and not self.decided or self.sent:
            yield from (("edge", old) for old in self.take())
        if first or last or self.sent:
            one = lambda x: np.array([x], np.int64)
            yield "sum", [one(self.hash[0]), one(self.hash[1]), one(self.top), one(0), one(0)], one(self.docs)


def _stream(least_docs: int):
    """kind 'drop': a decided line. 'edge': a line that a key's count decides, of the partition's first or last key, or of
    one that held too many rows. 'sum': such a key's number of documents here, with the largest in doc. A key of any
    number of rows is decided as it goes by, so memory does not grow with it."""
    names = ["h1", "h2", "doc", "th", "pos"]

    def between(cols: list[np.ndarray]):
        """The lines that go, of whole keys that neither begin nor end the partition."""
        new = np.ones(len(cols[0]), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        other = new.copy()
        other[1:] |= cols[2][1:] != cols[2][:-1]
        run = np.cumsum(new) - 1
        docs = np.bincount(run, weights=other)
        drop = (docs[run] >= least_docs) & (cols[2] != cols[2][np.flatnonzero(new)][run])
        if drop.any():
            yield "drop", [c[drop] for c in cols]

    def batch(kind: str, cols, docs=None):
        n = len(cols[0])
        docs = np.zeros(n, np.int64) if docs is None else docs
        return pa.RecordBatch.from_arrays([pa.array([kind]).take(pa.array(np.zeros(n, np.int32))), *[pa.array(c, pa.int64()) for c in cols], pa.array(docs, pa.int64())], STREAM.names)

    def run(batches):
        key, first = None, True
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
            edges = [0, *(np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1), len(cols[0])]
            part = lambda i, j: [c[i:j] for c in cols]  # noqa: E731, B023
            head = part(0, edges[1])
            if key is not None and key.hash != (head[0][0], head[1][0]):
                yield from (batch(*x) for x in key.end(first, False))
                key, first = None, False
            key = key or _Key(head)
            yield from (batch(*x) for x in key.add(head, least_docs))
            if len(edges) > 2:
                yield from (batch(*x) for x in key.end(first, False))
                first = False
                if edges[-2] > edges[1]:
                    yield from (batch(*x) for x in between(part(edges[1], edges[-2])))
                tail = part(edges[-2], edges[-1])
                key = _Key(tail)
                yield from (batch(*x) for x in key.add(tail, least_docs))
        if key is not None:
            yield from (batch(*x) for x in key.end(first, True))

    return run


def pack(places: list[int]) -> bytes:
    """The keep bitmap up to the last dropped line: bit i is 0 where line i goes."""
    bits = np.ones(max(places) + 1, np.uint8)
    bits[places] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes() + bytes([len(bits) % 8]))


def unpack(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8), bitorder="little")
    return bits[: len(bits) - (8 - raw[-1]) % 8].astype(bool)


def keep_bitmaps(df: DataFrame, tables, least_chars: int = 20, least_docs: int = 3, text_col: str = "text") -> DataFrame:
    """(doc, th, bitmap) of the documents that lose lines; the others keep all."""
    rows = hashed_lines(df, least_chars, text_col)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", F.col("doc").desc(), "th", "pos")
    seen = tables.write(dealt.mapInArrow(_stream(least_docs), STREAM))
    # two rows a partition (and one for each HELD rows of a key in fewer documents than drop it), so a very common line
    # need not be dealt by its key again
    sums = seen.where("kind = 'sum'").groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("doc").alias("top"))
    edges = seen.where("kind = 'edge'").drop("docs").join(F.broadcast(sums), ["h1", "h2"]).where((F.col("n") >= least_docs) & (F.col("doc") != F.col("top")))
    drops = seen.where("kind = 'drop'").select("doc", "th", "pos").union(edges.select("doc", "th", "pos"))
    per = drops.groupBy("doc", "th").agg(F.collect_list("pos").alias("places"))

    def run(batches):
        for b in batches:
            packed = [pack(sorted(x)) for x in b.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("th"), pa.array(packed, pa.binary())], ["doc", "th", "bitmap"])

    return per.mapInArrow(run, "doc long, th long, bitmap binary")


def dedup(df: DataFrame, tables, least_chars: int = 20, least_docs: int = 3, text_col: str = "text", count: bool = True) -> DataFrame:
    """df with its text replaced by the kept lines, and (count) n_lines, n_dropped.

    A key is a line trimmed of ASCII white space with A-Z lower-cased; keys of least_chars code points or more
    that least_docs distinct doc_ids hold lose their lines except in the largest doc_id. Null and empty texts
    are one empty line and become empty. Rows with one doc_id are one document; a null doc_id is one document,
    the least, and the same as that of the least long. All columns stay; n_lines and n_dropped may not be among them. Any length of text or line."""
    taken = {c.lower() for c in df.columns}
    if count and taken & {"n_lines", "n_dropped"}:
        raise ValueError("columns n_lines, n_dropped exist already")
    doc, th, bitmap, own_doc, own_th = unused(df, "__doc", "__th", "__bitmap", "__d", "__t")
    maps = keep_bitmaps(df, tables, least_chars, least_docs, text_col).select(
        F.col("doc").alias(doc), F.col("th").alias(th), F.col("bitmap").alias(bitmap))
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = df.withColumn(text_col, text)
    src = src.withColumns({own_doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), own_th: F.xxhash64(F.col(text_col))})
    j = src.join(maps, (F.col(own_doc) == F.col(doc)) & (F.col(own_th) == F.col(th)), "left").select(*df.columns, bitmap)
    at = df.columns.index(text_col)
    extra = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if count else []
    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in df.schema.fields]

    def run(batches):
        for b in batches:
            texts, lines, drops = [], [], []
            for t, packed in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                n = t.count("\n") + 1 if packed is None or count else 0
                gone = 0
                if packed is not None:
                    every, keep = t.split("\n"), unpack(packed)
                    n = len(every)
                    stay = [x for x, k in zip(every, keep) if k] + every[len(keep):]
                    gone, t = n - len(stay), "\n".join(stay)
                texts.append(t)
                lines.append(n)
                drops.append(gone)
            cols = [*b.columns[:-1]]
            cols[at] = pa.array(texts, pa.string())
            if count:
                cols += [pa.array(lines, pa.int64()), pa.array(drops, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in [*fields, *extra]])

    return j.mapInArrow(run, T.StructType([*fields, *extra]))


def digests(df: DataFrame, tables) -> DataFrame:
    out = dedup(df.select("doc_id", "text"), tables)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
