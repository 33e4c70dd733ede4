"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, in a hashed order, form a stream of words that is cut into equal blocks, of B words at
most. Of T slots, slot t has the golden-ratio point t * G mod T, where G is the first number from T * 0.618... on that
shares no divisor with T, so that every point is one slot's, however many there are. Points are mapped through the
cumulative target weights, counted in each source's own blocks, to sources; the slot's rank within its source picks the
source's next block, starting anew when all are taken. Shares are integers, so reruns and other engines agree to the
last bit."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd, isqrt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.llm.common import unused

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: the golden ratio's fraction, in 10^19 parts.
GOLDEN = 6180339887498948482
#: Slots ranked together before the ranks of earlier chunks are added, at least; and points of a source in a row.
CHUNK, POINTS_A_ROW = 1 << 12, 1 << 18
#: Documents of a source's stream that are added up together, at most (on average).
DOCS_A_BUCKET = 1 << 20
#: The least number of blocks of a source that has as many words.
LEAST_BLOCKS = 64
#: Parts of a block that a source's share is counted in.
PARTS = 1 << 20


@dataclass(frozen=True)
class Mix:
    """weights: of sources by code point (null last), repeating. share_percent: of all words that the mix takes.
    most_times: of a source's words at most. block words: all words / blocks, between 1 and most_block."""

    weights: tuple[int, ...] = (5, 2, 1)
    share_percent: int = 150
    most_times: int = 2
    blocks: int = 1 << 17
    most_block: int = 256
    seed: str = "mix"


def sized(df: DataFrame, mix: Mix, text_col: str = "text") -> DataFrame:
    """doc_id, source, size in words (null text: 0), and h, the hashed place in the source's stream: of the doc_id, or of
    the text where that is null, so that no place is shared by many different rows."""
    return df.select(
        "doc_id", "source",
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))))).alias("h"),
    )


def targets(docs: DataFrame, mix: Mix) -> DataFrame:
    """A row per source: sid (its place), source, source_size, target (double). Sources fill in the order of cap to weight: those that the
    common level would lift above their cap get the cap, and the level is shared by the rest."""
    by = docs.groupBy("source").agg(F.sum("size").alias("size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = by.withColumn("sid", F.row_number().over(order))
    w = F.element_at(F.array(*[F.lit(x) for x in mix.weights]), F.pmod(F.col("sid") - 1, F.lit(len(mix.weights))) + 1)
    s = s.select("sid", "source", "size", w.cast("long").alias("w"), (mix.most_times * F.col("size")).alias("cap"))
    d38 = lambda c: F.col(c).cast("decimal(38,0)")
    fill = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("sid").asc())
    s = s.select(
        "*",
        F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("w").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("wrest"),
        F.sum("size").over(W.partitionBy()).alias("all_size"),
    )
    # all over the denominator 100 * wrest of the first source below its cap
    s = s.withColumn("left", mix.share_percent * F.col("all_size") - 100 * F.col("before"))
    s = s.withColumn("full", 100 * d38("cap") * d38("wrest") <= d38("w") * d38("left"))
    every = W.partitionBy()
    s = s.withColumn("k", F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("sid").alias("i"), F.col("left").alias("left"), F.col("wrest").alias("wrest")))
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.col("k"))).over(every))
    num, den = F.coalesce(F.col("level.left"), F.lit(0)), F.coalesce(100 * F.col("level.wrest"), F.lit(1))
    s = s.select("sid", "source", F.col("size").alias("source_size"), "w", "cap", "full", num.alias("num"), den.alias("den"))
    return s.select(
        "sid", "source", "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("num")).cast("double") / F.col("den").cast("double")).alias("target"),
    )


def step(slots: int) -> int:
    """G: how far the points of neighbouring slots are apart."""
    g = max(1, slots * GOLDEN // 10 ** 19)
    while gcd(g, slots) != 1:
        g += 1
    return g


def count_slots(shares: DataFrame) -> int:
    return (int(shares.agg(F.max("all_tn")).first()[0] or 0) + PARTS // 2) // PARTS


def ranges(shares: DataFrame, slots: int) -> DataFrame:
    """(sid, lo, hi): each source's points, of as many as there are slots. Sources without a whole point have none."""
    at = lambda c: F.expr(f"cast(({c}) * {max(1, slots)}BD div all_tn as bigint)")
    return shares.where("all_tn > 0").select("sid", at("upto - tn").alias("lo"), at("upto").alias("hi")).where("hi > lo")


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, rank): which source's block each slot takes. A source has a range of the points, and each of its points
    names its slot by the inverse step, so that nothing is joined or searched: rows are slots, whatever the number of
    sources, and a range of many points is dealt over tasks."""
    n, back = max(1, slots), pow(step(max(1, slots)), -1, max(1, slots))
    chunk, wide = max(CHUNK, isqrt(n)), POINTS_A_ROW
    rows = ranges(shares, slots).select("sid", "hi", F.explode(F.expr(f"sequence(lo, hi - 1, {wide}L)")).alias("lo"))
    rows = rows.repartition("sid", "lo").select("sid", F.explode(F.expr(f"sequence(lo, least(hi, lo + {wide}) - 1)")).alias("p"))
    slot = F.expr(f"cast(cast(p as decimal(19,0)) * {back}BD % {n}BD as bigint)")
    hit = rows.select(slot.alias("slot"), "sid").withColumn("chunk", F.expr(f"slot div {chunk}"))
    per = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    per = per.select("sid", "chunk", (F.sum("n").over(W.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("base"))
    ranked = hit.withColumn("r", F.row_number().over(W.partitionBy("chunk", "sid").orderBy("slot")) - 1)
    return ranked.join(per, ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("r")).alias("rank"))


def blocked(shares: DataFrame, block: int) -> DataFrame:
    """shares plus n_blocks, base and rem: a source's first rem blocks have base + 1 words, the others base; and tn, the
    target in parts of the source's blocks, with all_tn, the sum of all, and upto, that of the sources up to this."""
    s = shares.withColumn("n_blocks", F.expr(f"greatest(1, (source_size + {block - 1}) div {block}, least(source_size, {LEAST_BLOCKS}))"))
    s = s.withColumns({"base": F.expr("greatest(1, source_size div n_blocks)"), "rem": F.expr("source_size % n_blocks")})
    parts = F.floor(F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1)) * PARTS)
    s = s.withColumn("tn", parts.cast("decimal(38,0)"))
    total = lambda w: F.sum("tn").over(w).cast("decimal(38,0)")
    return s.withColumns({"all_tn": total(W.partitionBy()), "upto": total(W.orderBy("sid"))})


def places(docs: DataFrame, rows: int) -> DataFrame:
    """docs plus a: the words of its source's stream before it. Sums within hashed buckets, as many as the number of rows
    asks for, then over buckets."""
    digits = 3
    while 16 ** digits * DOCS_A_BUCKET < rows:
        digits += 1
    b = docs.withColumn("bucket", F.substring("h", 1, digits))
    per = b.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    per = per.select("sid", "bucket", (F.sum("n").over(W.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("base"))
    order = W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    b = b.withColumn("within", F.sum("size").over(order) - F.col("size"))
    return b.join(per, ["sid", "bucket"]).select(*docs.columns, (F.col("base") + F.col("within")).alias("a"))


def mix(df: DataFrame, tables, how: Mix = Mix(), text_col: str = "text") -> DataFrame:
    """A row per row of df: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Null and empty texts have size 0 and nothing taken; a null source is a source, the last. Repeated rows are
    rows of their own. An empty table gives an empty result. A slot beyond most_times passes takes nothing, so
    no document exceeds most_times its size; each source's slots are its target's blocks to within one, and a source of 64 words or more has 64 blocks at
    least."""
    docs = tables.write(sized(df, how, text_col))
    shares = tables.write(targets(docs, how))
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(how.most_block, total * how.share_percent // 100 // how.blocks))
    shares = tables.write(blocked(shares, block))
    slots = count_slots(shares)
    own = docs.join(shares, docs["source"].eqNullSafe(shares["source"])).select(
        "doc_id", docs["source"], "size", "h", "sid", "source_size", "target")
    plan = schedule(shares, slots).join(shares.select("sid", "n_blocks"), "sid")
    takes = plan.where(F.col("rank") < how.most_times * F.col("n_blocks")).groupBy(
        "sid", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("times"))
    placed = tables.write(places(own, docs.count()).withColumn("row", F.monotonically_increasing_id()))
    at = lambda w: f"if({w} < rem * (base + 1), ({w}) div (base + 1), rem + ({w} - rem * (base + 1)) div base)"
    begin = lambda b: b * F.col("base") + F.least(b, F.col("rem"))
    cut = placed.where("size > 0").join(shares.select("sid", "base", "rem"), "sid").select(
        "row", "sid", "a", "size", "base", "rem", F.explode(F.expr(f"sequence({at('a')}, {at('a + size - 1')})")).alias("block"))
    over = F.least(F.col("a") + F.col("size"), begin(F.col("block") + 1)) - F.greatest(F.col("a"), begin(F.col("block")))
    taken = cut.join(takes, ["sid", "block"]).groupBy("row").agg(F.sum(over * F.col("times")).alias("taken"))
    return placed.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def repeats(df: DataFrame, tables, how: Mix = Mix()) -> DataFrame:
    """df's rows as the mix takes them: each as often as its taken words fill it, to the nearest whole (0 to
    most_times). Only the document at a source's end is cut by a block, so a source keeps its words within one
    document. Rows of one doc_id share their mean."""
    m = mix(df.select("doc_id", "source", "text"), tables, how).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("n"))
    id_, times, k = unused(df, "__id", "__times", "__k")
    m = m.select(F.col("doc_id").alias(id_), F.round(F.try_divide("t", "n")).cast("int").alias(times)).where(F.col(times) > 0)
    j = df.join(m, df["doc_id"].eqNullSafe(m[id_]))
    return j.select(*[df[c] for c in df.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(k)).drop(k)
