"""Secret scans with built-in functions only: fixed patterns, and sliding-window Shannon entropy.

Spans are code points, end exclusive. Base kinds are fixed patterns whose leftmost non-overlapping matches
are kept if long enough. The method adds kind ``entropy``: stretches of token characters are cut where the
allow list names something, and in each piece left the windows of WINDOW characters that reach a class's
entropy are found, by adding the entering and removing the leaving character's count. The span runs from the
first such window of a piece to its last."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, least length, and the group whose length counts.
BASE = [
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"(AKIA[A-Z0-9]+)", 20, 1),
    ("hex", r"([0-9a-f]+)", 24, 1),
]
#: Hex and access runs shorter than the least length never start a longer match, so they may be left out at once.
FAST = {"access": r"(AKIA[A-Z0-9]{16,})", "hex": r"([0-9a-f]{24,})"}
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
WINDOW = 20
#: class name, its characters, least entropy in bits, and what a run of them must hold besides. ``mixed`` is tried on
#: whole pieces, the others on a piece's runs of those characters between others than letters and digits. The limits
#: of lower and upper letters with digits are passed by about 99 of 100 random windows.
CLASSES = [
    ("hex", "0123456789abcdef", 3.0, r"^(?=.*[0-9])(?=.*[a-f])"),
    ("upper_hex", "0123456789ABCDEF", 3.0, r"^(?=.*[0-9])(?=.*[A-F])"),
    ("lower_digit", "abcdefghijklmnopqrstuvwxyz0123456789", 3.4, r"^(?=.*[0-9])(?=.*[a-z])"),
    ("upper_digit", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.35, r"^(?=.*[0-9])(?=.*[A-Z])"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
]
#: A word as paths, slugs and identifiers have it: humps of letters and a short number, or either. Bounded and
#: possessive, so that no text makes the matcher go back or down far.
_PART = r"(?:(?:[A-Z]?[a-z]++){1,40}+[0-9]{0,4}|[A-Z]++[0-9]{0,4}|[0-9]{1,8})"
#: Windows that touch these do not count: UUIDs, alphabet and digit runs, stated placeholders, paths and slugs whose
#: parts are all such words, and identifiers of three humps or more.
ALLOW = "|".join([
    r"^(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$", r"(?i:0123456789abcdef|abcdefghijklmnopqrstuvwxyz|example|placeholder|xxxxxxxx)", r"(?i:(.)\1{9,})",
    rf"(?<![A-Za-z0-9+]){_PART}(?:[/_-]{{1,3}}{_PART}){{1,60}}(?![A-Za-z0-9+])",
    r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,4}(?=[A-Z][a-z])){3,40}+[0-9]{0,4}(?![A-Za-z0-9])",
])
SPAN = "struct<s:int,o:int,e:int,k:string,body:string>"
#: Counts of a window are held in so many bits, so many to a long.
COUNT_BITS, COUNTS = 5, 12


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(a: Column) -> Column:
    """The sums of an array of numbers up to each place, by doubling: after k rounds a place holds the sum of the last
    2^k, so n places take n log n steps."""
    rounds = F.when(F.size(a) > 1, F.sequence(F.lit(0), F.length(F.bin((F.size(a) - 1).cast("long"))) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, a, lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))


def _matches(text: Column, pattern: Column, body) -> Column:
    """body(ends, matches): the places after each match, from the gaps that split() leaves, and the matches themselves.
    One more end, the text's, stands after the last."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)

    def placed(m: Column) -> Column:
        steps = F.zip_with(gaps, m, lambda g, x: g + F.coalesce(F.char_length(x), F.lit(0)))
        return _let(running(steps), lambda ends: body(ends, m))

    return _let(found, placed)


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _spans(text: Column, pattern: str | Column, kind: str, order: int, least: int, group: int = 1) -> Column:
    """array<SPAN> of the matches whose group is long enough (1: the whole match)."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def rows(counted: Column, ends: Column, m: Column) -> Column:
        every = F.transform(m, lambda x, i: F.struct((F.get(ends, i) - F.char_length(x)).alias("s"), F.lit(order).alias("o"), F.get(ends, i).alias("e"),
                                                     F.lit(kind).alias("k"), F.get(counted, i).alias("body")))
        return F.filter(every, lambda r: F.char_length(r["body"]) >= least)

    def body(ends: Column, m: Column) -> Column:
        if group == 1:
            return rows(m, ends, m)
        return _let(F.regexp_extract_all(text, pattern, F.lit(group)), lambda c: rows(c, ends, m))

    return F.when(F.regexp_like(text, pattern), _matches(text, pattern, body)).otherwise(_none())


def high_windows(body: Column, alphabet: Column, bits: Column, window: int = WINDOW) -> Column:
    """struct<first, last, best>: the last places of the first and the last window of ``window`` characters that reach
    ``bits`` (null if none does), and the most bits of any, null for a shorter text.

    With S the sum of c*log2(c) over the counts, a window's entropy is log2(w) - S/w; a character's coming or going
    changes one count and one term. Counts stand twelve to a long; characters outside the alphabet share one."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    longs = -(-(max(len(c) for _, c, *_ in CLASSES) + 1) // COUNTS)
    ids = F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c))
    shift = lambda c: (c % COUNTS) * COUNT_BITS
    one = lambda k, c: F.when(k == F.floor(c / COUNTS), F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))).otherwise(0)
    count = lambda n, c: F.call_function("shiftright", F.get(n, F.floor(c / COUNTS).cast("int")), shift(c)).bitwiseAND((1 << COUNT_BITS) - 1).cast("int")
    more = lambda c: F.get(terms, c + 1) - F.get(terms, c)

    def run(ids: Column) -> Column:
        none = F.lit(None).cast("int")
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0.0).alias("sum"), none.alias("first"), none.alias("last"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("i"))

        def step(acc: Column, come: Column) -> Column:
            i, n = acc["i"], acc["n"]
            going = F.when(i >= window, F.get(ids, i - window))
            less = F.coalesce(more(count(n, going) - F.when(going == come, 0).otherwise(1)), F.lit(0.0))
            counts = F.transform(n, lambda v, k: v + one(k, come) - one(k, going))
            now = F.struct(i.alias("i"), (acc["sum"] + more(count(n, come)) - less).alias("sum"), counts.alias("n"))

            def out(x: Column) -> Column:
                level = F.when(x["i"] >= window - 1, F.lit(math.log2(window)) - x["sum"] / window)
                high = level >= bits
                return F.struct(x["n"].alias("n"), x["sum"].alias("sum"), F.coalesce(acc["first"], F.when(high, x["i"])).alias("first"), F.when(high, x["i"]).otherwise(acc["last"]).alias("last"),
                                F.greatest(acc["best"], level).alias("best"), (x["i"] + 1).alias("i"))

            return _let(now, out)

        return F.aggregate(ids, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"), acc["best"].alias("best")))

    return _let(ids, run)


def window_entropy(body: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The most bits of any window, null for a text shorter than one."""
    return F.when(F.char_length(body) >= window, high_windows(body, F.lit(alphabet), F.lit(0.0), window)["best"])


def _pieces(text: Column) -> Column:
    """array<struct<s, body>> of what the allow list leaves of the stretches of token characters, if a window fits in."""

    def of_stretch(r: Column) -> Column:
        gaps = F.split(r["body"], ALLOW, -1)
        starts = lambda ends, _: F.transform(gaps, lambda p, i: F.struct((r["s"] + F.coalesce(F.get(ends, i - 1), F.lit(0))).alias("s"), p.alias("body")))
        return _matches(r["body"], F.lit(ALLOW), starts)

    every = F.flatten(F.transform(_spans(text, CANDIDATE, "", 0, WINDOW), of_stretch))
    return F.filter(every, lambda p: F.char_length(p["body"]) >= WINDOW)


def _runs(p: Column) -> Column:
    """array<struct<s, body, chars, bits>> of a piece's runs of each class that hold what they must."""
    one = lambda name, chars, bits, must: F.struct(
        F.lit(None if name == "mixed" else rf"(?<![A-Za-z0-9])[{chars}]{{{WINDOW},}}(?![A-Za-z0-9])").cast("string").alias("runs"),
        F.lit(chars).alias("chars"), F.lit(bits).alias("bits"), F.lit(must).alias("must"))

    def of_class(c: Column) -> Column:
        runs = F.transform(_spans(p["body"], c["runs"], "", 0, WINDOW), lambda r: F.struct((p["s"] + r["s"]).alias("s"), r["body"].alias("body")))
        runs = F.filter(F.when(c["runs"].isNull(), F.array(p)).otherwise(runs), lambda r: F.regexp_like(r["body"], c["must"]))
        return F.transform(runs, lambda r: F.struct(r["s"].alias("s"), r["body"].alias("body"), c["chars"].alias("chars"), c["bits"].alias("bits")))

    return F.flatten(F.transform(F.array(*[one(*c) for c in CLASSES]), of_class))


def _entropy_spans(text: Column) -> Column:
    def places(runs: Column) -> Column:
        return F.transform(runs, lambda r: _let(high_windows(r["body"], r["chars"], r["bits"]), lambda w: F.struct(
            (r["s"] + w["first"] - WINDOW + 1).alias("s"), (r["s"] + w["last"] + 1).alias("e"))))

    def of_piece(p: Column) -> Column:
        s, e = lambda f: F.array_min(F.transform(f, lambda x: x["s"])), lambda f: F.array_max(F.transform(f, lambda x: x["e"]))
        body = lambda f: F.substring(p["body"], s(f) - p["s"] + 1, e(f) - s(f))
        return _let(places(_runs(p)), lambda f: F.struct(s(f).alias("s"), F.lit(len(BASE)).alias("o"), e(f).alias("e"), F.lit("entropy").alias("k"), body(f).alias("body")))

    return F.filter(F.transform(_pieces(text), of_piece), lambda x: x["s"].isNotNull())


def scan(df: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """All columns plus ``out_col``: array<struct<s,o,e,k,body>> of base and entropy spans by start, then
    kind, body being the span's counted characters. Work grows with the text, and with n log n in its matches. Null and empty texts have none; repeated rows give
    equal spans; an empty table gives an empty one; a clashing out_col is refused."""
    if out_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out_col} exists already; pass another out_col")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [_spans(text, FAST.get(k, p), k, i, least, g) for i, (k, p, least, g) in enumerate(BASE)]
    return df.withColumn(out_col, F.array_sort(F.concat(*base, _entropy_spans(text))))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The texts with every base pattern that is long enough replaced by ``mark``."""
    out = F.col(text_col)
    for k, p, least, g in BASE:
        p = FAST.get(k, p.replace("]+)", "]{%d,})" % least) if g == 2 else p)
        out = F.regexp_replace(out, p, mark)
    return df.withColumn(text_col, out)


def digests(df: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base kinds, SHA-256 of the base spans, and all spans as a string."""
    found = scan(df.select("doc_id", "text")).select("doc_id", "secrets")

    def of(kind: str):
        return lambda r: r["k"] == kind

    def said(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["k"], r["s"].cast("string"), r["e"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[F.size(F.filter("secrets", of(k))).cast("long").alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(said(F.filter("secrets", lambda r: r["o"] < len(BASE))), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
    )
