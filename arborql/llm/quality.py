"""Quality rules with built-in functions only: base rules, and adaptive limits per language and source.

The limits come from mergeable quantile sketches: each metric is an integer, a value falls into a bucket that
keeps its leading bits, and a sketch is the counts of its buckets. Sketches merge by adding counts, so the counts of
(language, source) groups are pre-aggregated where the rows are, and a language's sketch is the sum of its sources'.
Unlike sampled sketches they give the same limits however the rows are dealt out.

Of the word length, which all texts have, fences around the quartiles are read. The other metrics are rates of events
that most texts have none of, so that their quartiles say nothing: of those the mean up to the 0.99 quantile is read,
the rate at which the group has such events without its worst documents, and a document may have as many as chance
brings at that rate: mu + SIGMAS * sqrt(mu) + SIGMAS^2 / 3 (Bernstein's bound) for the mu that its length lets expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.llm.common import WS_CHARS

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: metric -> (events, what they are counted in), per 1000.
METRICS = {
    "symbol_rate": ("n_symbols", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "shout_rate": ("n_shout", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}
#: The metric with fences, FENCE times the spread between the quartiles away from them; the others are rates.
FENCED, FENCE = "word_length", 3
RATES = [m for m in METRICS if m != FENCED]
#: How many standard deviations above what a group's rate lets expect a document's events may lie.
SIGMAS = 3
#: The leading bits that a bucket keeps: smaller values have buckets of their own.
BITS = 6
#: The documents that a language's limits weigh as in those of a source: a source of few documents leans on its
#: language, one of many stands for itself.
PRIOR = 8


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, first occurrences included.

    Windows are hashed (64 bits within one text) and sorted with their places; equal neighbours are repeats.
    A text whose windows all differ is done by the distinct count."""

    def hashed(h: Column) -> Column:
        n = F.size(h)
        at = F.sequence(F.lit(0), n - 3)
        wins = F.transform(at, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

        def counted(win: Column) -> Column:
            pairs = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

            def places(p: Column) -> Column:
                same = lambda q, x: F.coalesce(q["x"] == x, F.lit(False))
                hit = F.filter(p, lambda q, k: same(F.get(p, k - 1), q["x"]) | same(F.get(p, k + 1), q["x"]))
                at = F.sort_array(F.transform(hit, lambda q: q["i"]))
                start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
                step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
                return F.aggregate(at, start, step, lambda acc: acc["n"])

            return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(_let(pairs, places))

        return F.when(n < 4, F.lit(0)).otherwise(_let(wins, counted))

    return _let(F.transform(w, lambda x: F.xxhash64(x)), hashed).cast("long")


FIELDS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shout"]


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns plus __m, a struct of FIELDS. A null text counts as empty: all zero."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.char_length(F.btrim(x, F.lit(WS_CHARS))) > 0)
    fewer = lambda chars: (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")
    # __w and __l are columns of their own, so that each is computed once
    out = df.withColumns({"__w": words(text), "__l": lines})
    m = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.translate(text, WS_CHARS, "")).cast("long").alias("word_chars"),
        fewer(SYMBOLS).alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__w")).alias("n_repeat_words"),
        fewer("!?").alias("n_shout"),
    )
    return out.select(*df.columns, m.alias("__m"))


def width(name: str) -> Column:
    """The width of the bucket of column ``name`` (not negative): 2 to the number of its bits after the leading ones."""
    return F.expr(f"shiftleft(1L, greatest(0, length(bin({name})) - {BITS}))")


def bucket(name: str) -> Column:
    """The least value of the bucket of column ``name``."""
    return F.col(name) - F.col(name) % width(name)


def rate(metric: str) -> Column:
    a, b = METRICS[metric]
    return F.coalesce(F.try_divide(F.lit(1000) * F.col(f"__m.{a}"), F.col(f"__m.{b}")).cast("long"), F.lit(0)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, width, n): one mergeable sketch for each group and metric, of the documents that
    the base rules leave."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(k).alias("bucket"), width(k).alias("width")) for k in METRICS]))
    rated = measured.where(~base_fails()).select("lang", "source", *[rate(k).alias(k) for k in METRICS])
    return rated.select("lang", "source", rows.alias("r")).groupBy("lang", "source", "r.metric", "r.bucket", "r.width").agg(F.count("*").alias("n"))


def read(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, n, low, high, mean: what each group's sketch says. low and high are the fences; the quartiles are the
    outer edges of their buckets, so a group of equal values has the width of one as its spread. mean is that of the
    buckets' values, none above the 0.99 quantile's, in events a million."""
    w = W.partitionBy(*keys, "metric")
    c = sketch.groupBy(*keys, "metric", "bucket", "width").agg(F.sum("n").alias("n")).select(
        *keys, "metric", "bucket", "width", "n", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    c = c.withColumn("top", F.min(F.when(F.col("upto") * 100 >= F.col("total") * 99, F.col("bucket"))).over(w))
    q = c.groupBy(*keys, "metric").agg(
        F.max("total").alias("n"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket") + F.col("width"))).alias("q3"),
        F.sum(F.col("n") * F.least("bucket", "top")).alias("events"),
    )
    spread = FENCE * (F.col("q3") - F.col("q1"))
    return q.select(*keys, "metric", "n", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"), F.expr("1000 * events div n").alias("mean"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, low_<FENCED>, high_<FENCED>, mean_<RATES> ..): what the group's sketch says, and its language's at
    the weight of PRIOR documents."""
    own, lang = read(sketch, ["lang", "source"]), read(sketch, ["lang"])
    both = own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.metric") == F.col("l.metric")))
    blend = lambda c: F.expr(f"(o.n * o.{c} + {PRIOR} * l.{c}) div (o.n + {PRIOR})").alias(c)
    both = both.select("o.lang", "o.source", "o.metric", blend("low"), blend("high"), blend("mean"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}")
    return both.groupBy("lang", "source").agg(of(FENCED, "low"), of(FENCED, "high"), *[of(m, "mean") for m in RATES])


def excess(metric: str) -> Column:
    """Whether a row of measures has more events than its group's rate lets expect. Repeated words count as lines' worth
    of them (a mean line of the text), as they come a line at a time."""
    m = lambda f: F.col(f"__m.{f}").cast("double")
    a, b = METRICS[metric]
    events, of = (m(a) * m("n_lines") / m("n_words"), m("n_lines")) if metric == "repeat_rate" else (m(a), m(b))
    mu = F.col(f"mean_{metric}").cast("double") * of  # in millionths
    over = 1e6 * (events - SIGMAS * SIGMAS / 3) - mu
    return (over > 0) & (over * over > SIGMAS * SIGMAS * 1e6 * mu)


def within() -> Column:
    """Whether a row of measures meets its group's limits."""
    ok = rate(FENCED).between(F.col(f"low_{FENCED}"), F.col(f"high_{FENCED}"))
    for k in RATES:
        ok = ok & ~excess(k)
    return ok


def base_fails() -> Column:
    return (F.col("__m.n_words") < MIN_WORDS) | (100 * F.col("__m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__m.n_words"))


def _verdicts(m: DataFrame) -> DataFrame:
    """m (with __m, and lang and source as __a and __b) plus __kept, by the limits that all of m gives. The limits are a
    row a group, so the join leaves the order of rows to the planner."""
    most = limits(sketches(m.select("__m", F.col("__a").alias("lang"), F.col("__b").alias("source"))))
    most = most.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    j = m.join(most, F.col("__a").eqNullSafe(F.col("__lang")) & F.col("__b").eqNullSafe(F.col("__source")), "left")
    return j.select(*m.columns, (~base_fails() & F.coalesce(within(), F.lit(False))).alias("__kept"))


def judge(df: DataFrame, tables, text_col: str = "text") -> DataFrame:
    """A row per row of df: doc_id, lang, source, FIELDS, base_failed, and kept: base rules first, then every
    metric within the limits of the row's language and source (null is a language or source of its own).

    Empty and null texts fail the base rules. Repeated rows are judged alike. Extra columns are not looked at,
    whatever their names; an empty table gives an empty result."""
    src = df.select("doc_id", F.col("lang").alias("__a"), F.col("source").alias("__b"), F.col(text_col).alias("__text"))
    m = tables.write(measures(src, "__text").drop("__text"))
    return _verdicts(m).select("doc_id", F.col("__a").alias("lang"), F.col("__b").alias("source"), *[f"__m.{f}" for f in FIELDS],
                               base_fails().alias("base_failed"), F.col("__kept").alias("kept"))


def keep(df: DataFrame, tables, text_col: str = "text") -> DataFrame:
    """df's rows that ``judge`` keeps, with all columns, whatever their names: they travel in a struct."""
    row = F.struct(*df.columns).alias("__row")
    src = df.select(row, F.col("lang").alias("__a"), F.col("source").alias("__b"), F.col(text_col).alias("__text"))
    m = tables.write(measures(src, "__text").drop("__text"))
    return _verdicts(m).where("__kept").select("__row.*")


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
