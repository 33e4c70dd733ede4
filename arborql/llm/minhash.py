"""MinHash near-dedup with min-max hashing, banding, and confirmation on full shingle sets.

Each of PERMUTATIONS hashes of a document's shingles gives two signature values, its minimum and its maximum:
both match with probability equal to the Jaccard similarity, so half the hash evaluations do for a signature,
and the two are less than independently spread. Documents of equal sets are merged first.

Candidates share a band. Their links are confirmed on full sets, but pairs are never written out:
1. every member is confirmed with the leader (least member) of the bucket that it shares most bands with;
2. buckets that still hold several components make up families (what buckets join). A family meets as a whole, or bucket
   by bucket where that sends fewer rows to tiles, as where it is a long loose chain. The rows of a group (family or
   bucket) are cut into tiles, those of a large component into tiles of its own, and two tiles that are not of one
   component meet in one task, which confirms every pair of different components and possible set sizes that shares a
   band (in a bucket: none before the bucket's), and returns a forest of confirmed links.
A pair within one component need not be confirmed, since only components are asked for. Full sets come only for rows
with a pair left. With 32 bands of 4 values, a pair at similarity 0.8 shares no band once in 20 million times; every
pair that shares one is confirmed or joined already."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.llm.common import connected_components, release, unused

PERMUTATIONS, BAND = 64, 4
VALUES = 2 * PERMUTATIONS
BANDS = VALUES // BAND
SEED = 20240901
#: Words whose hashes a worker keeps; rows of a bucket's tile, and shingles of their sets, on average.
WORDS_KEPT, ROWS_A_TILE, SHINGLES_A_TILE = 150_000, 256, 1 << 21
#: Shingles whose hashes under all permutations are made at once, to stay in a core's cache.
HASHES_AT_ONCE = 512
#: Members that are compared with one leader in one task.
MEMBERS_A_TASK = 512


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


_hashes = WordHashes()
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; fewer words than size: the whole as one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    get = _hashes
    h = np.fromiter([get[w] for w in words], np.uint64, len(words))
    n = len(h) - size + 1
    if n < 1:
        size_here, n = len(h), 1
    else:
        size_here = size
    out = np.full(n, np.uint64(size_here))
    for k in range(size_here):
        out = _mix(out * _MIX[2] + h[k:k + n])
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(SEED)
    odd = r.randint(0, 1 << 32, (2, PERMUTATIONS), dtype=np.uint64)
    a = (odd[0] << np.uint64(32) | odd[1]) | np.uint64(1)
    b = r.randint(0, 1 << 32, (2, PERMUTATIONS), dtype=np.uint64)
    return a, b[0] << np.uint64(32) | b[1]


_A, _B = _permutations()

def signature(s: np.ndarray) -> np.ndarray:
    """VALUES 32-bit values: minimum and maximum of each permutation, side by side, so in one band."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(s), HASHES_AT_ONCE):
        v = s[None, k:k + HASHES_AT_ONCE] * _A[:, None]
        v += _B[:, None]
        v ^= v >> np.uint64(29)
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    out = np.empty(VALUES, np.uint64)
    out[0::2], out[1::2] = low, high
    return (_mix(out) >> np.uint64(32)).astype("<u4")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


SKETCH = "doc_id long, th long, n_shingles long, f1 long, f2 long, sig binary"


def sketch(df: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, f1, f2, sig): set size, 128-bit fingerprint of the set, and the signature."""

    def run(batches):
        for b in batches:
            n, f1, f2, sig = [], [], [], []
            for t in b.column("t").to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16)
                x = np.frombuffer(d, "<i8")
                f1.append(int(x[0]))
                f2.append(int(x[1]))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "th", "n_shingles", "f1", "f2", "sig"])
        _hashes.clear()
        release()

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("t")).mapInArrow(run, SKETCH)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of pairs(a, b) whose full sets are similar; texts(node, text). Pairs go to their first end's
    task, cut into parts of MEMBERS_A_TASK where it has many; a task holds one set besides the streamed one."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    parts = counts.select("a", F.expr(f"cast((n + {MEMBERS_A_TASK - 1}) div {MEMBERS_A_TASK} as int)").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    member = dealt.join(texts, F.col("b") == F.col("node")).select("a", "part", "b", "text")
    hub = parts.join(texts, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("b"), "text")
    both = hub.unionByName(member)
    both = both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "part").sortWithinPartitions("a", "part", "b")

    def run(batches):
        now, own = None, None
        for x in batches:
            a_out, b_out = [], []
            for a, part, b, t in zip(*[x.column(k).to_pylist() for k in ("a", "part", "b", "text")]):
                if b < 0:
                    now, own = (a, part), shingles(t, size)
                elif now == (a, part) and similar(own, shingles(t, size), percent):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
        _hashes.clear()
        release()

    return both.mapInArrow(run, "a long, b long")


def _crossing(tile, comp, n, sig, k: int, i: int, j: int, percent: int):
    """(rows, partners, agreement) of the pairs between tiles i and j that are in different components, have the sizes of
    similar sets, and share band k but none before it (the pair meets in that band's bucket only), or any band if k < 0."""
    bands = np.ascontiguousarray(sig).view("<u8").reshape(len(sig), BANDS, -1)
    bands = bands[:, :k + 1] if k >= 0 else bands
    xi = np.flatnonzero(tile == i)
    yi = xi if i == j else np.flatnonzero(tile == j)
    a, b, m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in xi:
        y = yi[(comp[yi] != comp[x]) & (100 * np.minimum(n[yi], n[x]) >= percent * np.maximum(n[yi], n[x]))]
        if i == j:
            y = y[y > x]
        if len(y):
            equal = (bands[y] == bands[x]).all(axis=2)
            y = y[equal[:, k] & ~equal[:, :k].any(axis=1)] if k >= 0 else y[equal.any(axis=1)]
            a.append(np.full(len(y), x))
            b.append(y)
            m.append((sig[y] == sig[x]).sum(axis=1))
    return np.concatenate(a), np.concatenate(b), np.concatenate(m)


def _columns(t, *names):
    return [t.column(c).to_numpy() for c in names]


def _pairs(t, key, percent: int):
    """The pairs of a key (group, its band's place or -1, tile i, tile j)."""
    _, k, i, j = (x.as_py() for x in key)
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(t.num_rows, -1)
    return _crossing(*_columns(t, "tile", "comp", "n_shingles"), sig, k, i, j, percent)


def _involved(percent: int):
    """Of two tiles of a group: the rows that have a pair to confirm."""

    def run(key, t):
        a, b, _ = _pairs(t, key, percent)
        return t.take(pa.array(np.unique(np.concatenate([a, b]))))

    return run


def _joined(size: int, percent: int):
    """Of two tiles: links between components that are confirmed on the full sets. The pairs most alike come
    first, and a pair that links have joined by then is passed over, so what leaves is a forest."""

    def run(key, t):
        node, comp = _columns(t, "node", "comp")
        a, b, m = _pairs(t, key, percent)
        sets = [shingles(x, size) for x in t.column("text").to_pylist()]
        up: dict[int, int] = {}

        def find(c: int) -> int:
            while (above := up.get(c, c)) != c:
                up[c] = up.get(above, above)
                c = above
            return c

        one, two = [], []
        for k in np.argsort(-m, kind="stable"):
            x, y = a[k], b[k]
            p, q = find(int(comp[x])), find(int(comp[y]))
            if p != q and similar(sets[x], sets[y], percent):
                up[max(p, q)] = min(p, q)
                one.append(node[x])
                two.append(node[y])
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    return run


def classes(df: DataFrame, tables, size: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id (least doc_id reachable by links, itself
    included), kept (doc_id = component_id), and group (a number of the component, null without words) for every
    row of df.

    A-Z count as a-z; words are stretches without ASCII white space. Null and empty texts and texts without
    words have an empty set, link with nothing, and are their own component. Repeated rows and equal sets are
    linked; rows of one doc_id may have different texts. A null doc_id has its component's least id, and is not
    kept. Texts of any length; extra columns are not looked at; an empty table gives an empty result."""
    docs = tables.write(sketch(df, size, text_col))
    own = docs.where("n_shingles > 0").groupBy("f1", "f2").agg(
        F.min(F.struct(F.col("doc_id").alias("doc_id"), F.col("th").alias("th"), F.col("n_shingles").alias("n_shingles"), F.col("sig").alias("sig"))).alias("x"), F.min("doc_id").alias("low"))
    reps = tables.write(own.select("f1", "f2", "low", "x.*").withColumn("node", F.monotonically_increasing_id()))
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 4 * BAND * k + 1, 4 * BAND)) for k in range(BANDS)])
    rows = reps.select("node", F.posexplode(bands).alias("k", "band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = tables.write(rows.join(shared.select("band", "leader", "n"), "band"))
    # the texts of all candidates, once, so that later rounds leave the others alone
    wanted = reps.join(members.select("node").distinct(), "node").select("node", F.col("doc_id").alias("d"), F.col("th").alias("h"))
    text = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    texts = text.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("node", "text").dropDuplicates(["node"])
    texts = tables.write(texts)

    def fitting(pairs: DataFrame) -> DataFrame:
        """Pairs whose set sizes alone don't rule a link out."""
        n = reps.select(F.col("node"), F.col("n_shingles").alias("n"))
        j = pairs.join(n.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"node": "b", "n": "nb"}), "b")
        return j.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")

    star = members.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    star = star.groupBy("node").agg(F.max_by("leader", F.struct(F.col("n").alias("n"), (-F.col("leader")).alias("l"))).alias("leader"))
    star = fitting(star.select(F.col("leader").alias("a"), F.col("node").alias("b")))
    links = tables.write(confirm(star, texts, size, percent))
    groups = connected_components(links, tables)
    m = tables.write(members.join(groups, "node", "left").select("band", "k", "node", F.coalesce("component", "node").alias("comp")))
    mixed = m.groupBy("band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("node").alias("first")).where("c1 <> c2").select("band", "first")
    open_ = tables.write(m.join(mixed, "band"))
    family = connected_components(open_.select(F.col("node").alias("a"), F.col("first").alias("b")), tables).withColumnRenamed("component", "family")
    open_ = tables.write(open_.drop("first").join(family, "node"))
    # a family meets as a whole, or bucket by bucket where that takes fewer rows to tiles
    cost = F.expr(f"sum(n * ((n + {ROWS_A_TILE - 1}) div {ROWS_A_TILE}))")
    apart = open_.groupBy("family", "band").agg(F.count("*").alias("n")).groupBy("family").agg(cost.alias("apart"))
    whole = open_.select("family", "node", "comp").distinct()
    as_one = whole.groupBy("family").agg(F.count("*").alias("n")).groupBy("family").agg(cost.alias("as_one"))
    way = tables.write(apart.join(as_one, "family").select("family", (F.col("as_one") <= F.col("apart")).alias("one")))
    rows = whole.join(way.where("one"), "family").select(F.col("family").alias("grp"), F.lit(-1).alias("k"), "node", "comp")
    rows = rows.union(open_.join(way.where("not one"), "family").select("band", "k", "node", "comp")).join(reps.select("node", "sig", "n_shingles"), "node")
    # a component of many rows has tiles of its own, which need not meet one another; the others share tiles
    parts = lambda n, s: F.expr(f"cast(greatest(({n} + {ROWS_A_TILE - 1}) div {ROWS_A_TILE}, ({s} + {SHINGLES_A_TILE - 1}) div {SHINGLES_A_TILE}) as int)")
    key = ["grp", "k"]
    sizes = rows.groupBy(*key, "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).withColumn("large", F.expr(f"n >= {ROWS_A_TILE // 4} or s >= {SHINGLES_A_TILE // 4}"))
    sizes = tables.write(sizes.withColumn("own", F.when(F.col("large"), parts("n", "s"))))
    common = sizes.groupBy(*key).agg(F.sum(F.expr("if(large, 0, n)")).alias("n"), F.sum(F.expr("if(large, 0, s)")).alias("s"), F.coalesce(F.sum("own"), F.lit(0)).alias("owned"))
    common = common.select(*key, parts("n", "s").alias("common"), "owned")
    before = F.coalesce(F.sum("own").over(W.partitionBy(*key).orderBy("comp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = sizes.where("large").select(*key, "comp", "own", before.alias("before"))
    rows = rows.join(common, key).join(large, [*key, "comp"], "left").withColumn("low", F.col("common") + F.col("before"))
    rows = rows.withColumn("tile", F.expr("cast(if(own is null, pmod(xxhash64(node), common), low + pmod(xxhash64(node), own)) as int)"))
    others = F.expr("filter(sequence(0, cast(common + owned - 1 as int)), t -> own is null or t < low or t >= low + own)")
    meet = F.transform(others, lambda t: F.struct(F.least(F.col("tile"), t).alias("i"), F.greatest(F.col("tile"), t).alias("j")))
    rows = rows.select(*key, "node", "comp", "n_shingles", "sig", "tile", F.explode(meet).alias("p"))
    rows = rows.select(*key, "p.i", "p.j", "node", "comp", "n_shingles", "sig", "tile")
    some = tables.write(rows.groupBy(*key, "i", "j").applyInArrow(_involved(percent), rows.schema))
    more = some.join(texts, "node").groupBy(*key, "i", "j").applyInArrow(_joined(size, percent), "a long, b long")
    more = tables.write(more)
    groups = connected_components(links.unionByName(more), tables)
    tables.drop(members, texts, links, m, open_, way, sizes, some, more)  # what follows reads docs, reps and groups
    r = reps.select("f1", "f2", "low", "node").join(groups, "node", "left").withColumn("c", F.coalesce("component", "node"))
    low = r.groupBy("c").agg(F.min("low").alias("least"))
    r = r.join(low, "c").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "least", F.col("c").alias("group"))
    j = docs.drop("sig").join(r, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") > 0), "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return j.select("doc_id", "th", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"), "group")


def dedup(df: DataFrame, tables, size: int = 5, percent: int = 80) -> DataFrame:
    """df's rows, one of each group of near copies: the one with the least doc_id, repeated rows once; a group
    that has null doc_ids only keeps one row too. Rows without words are kept."""
    c = classes(df, tables, size, percent).where("kept or component_id is null")
    id_, th, h = unused(df, "__id", "__th", "__h")
    c = c.groupBy(F.col("doc_id").alias(id_), "group").agg(F.min("th").alias(th))
    src = df.withColumn(h, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    j = src.join(c, src["doc_id"].eqNullSafe(c[id_]) & (src[h] == c[th]), "left_semi")
    return j.dropDuplicates(["doc_id", h]).select(df.columns)
