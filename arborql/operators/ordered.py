"""Order-preserving primitives. Every one takes explicit ordinals: Spark has no row order of its own.

First and last wins aggregate with min_by and max_by, which combine before the shuffle; windows are used only
where a row needs its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.tables import Tables


def first_wins(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``, with all columns."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(df.columns)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, keys, order, last=True)


def consume_once(matches: DataFrame, item: list[str], order: list[str]) -> DataFrame:
    """Each item goes to its first claimant by ``order`` (JN1, JN6, GRP2)."""
    return first_wins(matches, item, order)


def carry_forward(value: Column, partition: list[str], order: list[str]) -> Column:
    """WIN1: the latest value that is not null, this row's included."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def islands(df: DataFrame, value: list[str], partition: list[str], order: list[str], name: str = "island") -> DataFrame:
    """WIN5, WIN9: a number for each run of equal neighbours (nulls equal nulls), from 1 within a partition."""
    w = W.partitionBy(*partition).orderBy(*order)
    same = F.lit(True)
    for v in value:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    start = F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__start", start).withColumn(name, F.sum("__start").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__start")


def placed_in_order(df: DataFrame, order: list[str], tables=None) -> DataFrame:
    """df in ranges of ``order``, written, with __part and __at: the number of the range and the place within it. Order
    over a whole table needs no window over it: ranges are sorted on their own, and a row a range tells the rest."""
    tables = tables or Tables(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return tables.write(d.withColumns({"__part": F.expr("shiftright(__id, 33)"), "__at": F.expr("__id & 8589934591")}).drop("__id"))


def numbered(df: DataFrame, order: list[str], name: str, tables=None) -> DataFrame:
    """SNK7: ``name``, from 1, in order over the whole table."""
    d = placed_in_order(df, order, tables)
    per = d.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a range
    per = per.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__base"))
    return d.join(per, "__part").withColumn(name, F.col("__base") + F.col("__at") + 1).drop("__part", "__at", "__base")


def running_total(df: DataFrame, order: list[str], value: str, name: str, tables=None) -> DataFrame:
    """``name``: the sum of ``value`` over the rows up to this one in order over the whole table."""
    d = placed_in_order(df, order, tables)
    per = d.groupBy("__part").agg(F.sum(value).alias("__n"))  # a row a range
    per = per.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__base"))
    w = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return d.withColumn(name, F.sum(value).over(w)).join(per, "__part").withColumn(name, F.col(name) + F.col("__base")).drop("__part", "__at", "__base")


def neighbours(df: DataFrame, order: list[str], value: str, prev: str, next_: str, tables=None) -> DataFrame:
    """WIN3: ``value`` of the row before and after in order over the whole table."""
    d = placed_in_order(df, order, tables)
    ends = d.groupBy("__part").agg(F.min_by(value, "__at").alias("__first"), F.max_by(value, "__at").alias("__last"), F.max("__at").alias("__top"))
    across = W.orderBy("__part")  # over a row a range
    ends = ends.select("__part", "__top", F.lag("__last").over(across).alias("__before"), F.lead("__first").over(across).alias("__after"))
    w = W.partitionBy("__part").orderBy("__at")
    out = d.withColumns({prev: F.lag(value).over(w), next_: F.lead(value).over(w)}).join(ends, "__part")
    out = out.withColumns({prev: F.when(F.col("__at") == 0, F.col("__before")).otherwise(F.col(prev)), next_: F.when(F.col("__at") == F.col("__top"), F.col("__after")).otherwise(F.col(next_))})
    return out.drop("__part", "__at", "__top", "__before", "__after")


def values_in_order(df: DataFrame, keys: list[str], values: str, order: str, name: str) -> DataFrame:
    """AGG5: keys and the distinct values of the array column ``values`` over a key's rows, by first place. What is
    collected is a key's distinct values, not its rows."""
    one = df.select(*keys, F.col(order).alias("__o"), F.posexplode(values).alias("__p", "__v"))
    one = one.groupBy(*keys, "__v").agg(F.min(F.struct("__o", "__p")).alias("__at"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda r: r["__v"]).alias(name))


def unique_names(name: Column, scope: list[str], order: list[str]) -> Column:
    """WIN4: repeats of a name within a scope get 1, 2, ... appended. A natural name may still equal a made one."""
    n = F.row_number().over(W.partitionBy(*scope, name).orderBy(*order)) - 1
    return F.when(n == 0, name).otherwise(F.concat(name, n.cast("string")))


def stable_partition(df: DataFrame, flag: Column, order: list[str], name: str = "place") -> DataFrame:
    """OR8: rows where flag holds come last, each part in its order; ``name`` is a sort key."""
    return df.withColumn(name, F.struct(F.coalesce(flag, F.lit(False)).alias("late"), *order))


def ordered_union(*frames: DataFrame) -> DataFrame:
    """SET1: branch is the number of the frame that a row is of, the first sort key of the whole."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("branch", F.lit(k))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def uniqued(a: Column) -> Column:
    """AGG15: distinct and sorted."""
    return F.array_sort(F.array_distinct(a))


def first_duplicate(df: DataFrame, key: str, order: str) -> DataFrame:
    """AGG15: the key whose second use comes first."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    return df.withColumn("__n", n).where("__n = 2").orderBy(order).limit(1).select(key)


def multiset_minus(a: Column, b: Column) -> Column:
    """SET2: a without b's values; repeats and order stay."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def numbered_match(left: DataFrame, right: DataFrame, on: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """One-use on both sides by key: the i-th left row of a key takes the i-th right one. Rows are numbered first, so
    the join is one to one and no key's pairs are ever made."""
    l = left.withColumn("__n", F.row_number().over(W.partitionBy(*on).orderBy(*left_order)))
    r = right.withColumn("__n", F.row_number().over(W.partitionBy(*on).orderBy(*right_order)))
    return l.join(r, [*on, "__n"]).drop("__n")


def set_minus(a: Column, b: Column) -> Column:
    """SET3: what a has and b has not, each once."""
    return F.array_except(a, b)


def set_meets(a: Column, b: Column) -> Column:
    """SET3: whether both share a value."""
    return F.arrays_overlap(a, b)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """SET4"""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()
