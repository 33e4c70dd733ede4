"""Names by their shortest unique prefixes, over tables of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborql.functions.text import common_prefix
from arborql.operators.ordered import neighbours


def unique_prefixes(df: DataFrame, name: str, tables) -> DataFrame:
    """ST11: (name, prefix) of each distinct name: its shortest prefix that begins no other name, null for one that itself
    begins another. Names that share most are neighbours in order, so each is compared with two, over sorted ranges of the
    whole table."""
    d = df.select(F.col(name).alias("name")).where("name <> ''").distinct()
    d = neighbours(d, ["name"], "name", "__prev", "__next", tables)
    n = F.greatest(common_prefix(F.col("name"), F.col("__prev")), common_prefix(F.col("name"), F.col("__next"))) + 1
    return d.select("name", F.when(n <= F.char_length("name"), F.substring("name", F.lit(1), n)).alias("prefix"))


def matched_prefixes(asked: DataFrame, names: DataFrame, tables) -> DataFrame:
    """ST11: asked(prefix) with the one name that each begins, null if it begins none or several, or is empty. A prefix is
    long enough if it holds the name's shortest one: both are equal at that length, so it is an equi-join by length."""
    short = unique_prefixes(names, "name", tables).where("prefix is not null").select(F.col("name").alias("__name"), F.col("prefix").alias("__short"), F.char_length("prefix").alias("__n"))
    lengths = short.select("__n").distinct().agg(F.collect_set("__n")).first()[0]  # as many as names are long
    tries = asked.select("prefix").distinct().select("prefix", F.explode(F.array(*map(F.lit, sorted(lengths))) if lengths else F.array().cast("array<int>")).alias("__n"))
    tries = tries.withColumn("__short", F.substring("prefix", F.lit(1), F.col("__n"))).where(F.char_length("__short") == F.col("__n"))
    hit = tries.join(short, ["__n", "__short"]).where(F.startswith(F.col("__name"), F.col("prefix"))).select("prefix", F.col("__name").alias("name"))
    return asked.join(hit, "prefix", "left")
