"""Audit of how filters interact: what each removes at every place of every order they can be applied in.

A filter's doing depends on the set of filters before it, not on their order. So the documents' failures are counted
once for each (already-applied subset, next filter) edge of the lattice of subsets, 80 for five filters, and an order is
a path of edges: its steps are joined with the counted edges."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborql.llm.common import WS_CLASS

#: The filters by letter; filter i's bit in a mask is 1 << i.
FILTERS = "ABCDE"

RESULT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters that a text fails by itself: A under 100 words, B under 80 distinct words in 100, C more than
    10 of 100 code points in A-Z, D any of #$%&*|."""
    n = F.size(words).cast("long")
    upper = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * upper.cast("long") > 10 * F.char_length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, quality, toxic, n): documents by language, failed filters and labels.

    E fails where a smaller doc_id has the same text anywhere in the table. Texts are told apart by SHA-256. Rows are
    combined by (text, language, labels, doc_id), then by all but doc_id, then by text; so a text that a third of all
    rows hold is some rows a task before it is shuffled by text, and no text is joined or shuffled.
    A null text is empty, a null lang the empty string. Rows of one doc_id and text are documents that all pass or all
    fail E; a null doc_id is no smaller than any and has none smaller. A doc_id of several label rows has a label if one
    of them says so."""
    seen = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    seen = seen.withColumn("words", F.array_remove(F.split("text", f"[{WS_CLASS}]+"), ""))
    seen = seen.select("id", "part", F.sha2("text", 256).alias("h"), text_mask(F.col("text"), F.col("words")).alias("mask"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # rows without a doc_id meet no label, so they are kept out of the join, where they would be one key
    with_id = seen.where("id is not null").join(said, "id", "left")
    every = with_id.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).unionByName(
        seen.where("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    kind = ["h", "part", "mask", "good", "toxic"]
    # of each text and kind: the rows, those without an id, the least id and its rows
    a_row = every.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    a_kind = a_row.groupBy(kind).agg(
        F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    each = a_kind.withColumn("least", F.min("first.id").over(Window.partitionBy("h")))
    passing = F.col("no_id") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    e = 1 << FILTERS.index("E")
    split = F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") + F.col("no_id") - passing).alias("n")))
    return each.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "good", "toxic", "s.*").where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(classes: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, subset, next) with counts: the lattice's edges, each with all documents of the part contributing. A part's
    documents come as classes, at most four times the subsets, so that an edge costs no more with more documents."""
    lattice = F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(1 << i).alias("next")) for s in range(1 << len(filters)) for i in range(len(filters)) if not s >> i & 1])
    on = classes.select("*", F.explode(lattice).alias("edge")).select("part", "mask", "good", "toxic", "n", "edge.*")
    arrives = F.col("mask").bitwiseAND(F.col("subset")) == 0
    fails = F.col("mask").bitwiseAND(F.col("next")) != 0

    def count(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0))

    return on.groupBy("part", "subset", "next").agg(
        count(arrives & ~fails).alias("kept"), count(arrives & fails).alias("removed"), count(~arrives & fails).alias("redundant"),
        count(F.col("mask") == F.col("next")).alias("unique_fails"), count(arrives & fails & F.col("good")).alias("good_lost"), count(arrives & fails & F.col("toxic")).alias("toxic_lost"))


def paths(filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, subset, next) of every step of every order: 600 rows for five filters."""
    out = []
    for order in permutations(range(len(filters))):
        subset = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(filters[k] for k in order), step, subset, 1 << i))
            subset |= 1 << i
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part, order and step (RESULT). shapley is the filter's removals over all orders of the part. What is
    broadcast is the fixed table of steps. An empty table has no parts, so no rows; extra columns are not looked at."""
    steps = docs.sparkSession.createDataFrame(paths(), "filter_order string, step int, subset int, next int")
    walked = edges(classes(docs, labels)).join(F.broadcast(steps), ["subset", "next"])
    return walked.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "next"))).select(RESULT)
