"""Coverage, reports, and the badge's colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(documented: Column, undocumented: Column) -> Column:
    """AGG2: whole percent, rounded down; 0 of nothing."""
    both = documented + undocumented
    return F.when(both == 0, F.lit(0)).otherwise((F.lit(100) * documented - F.pmod(F.lit(100) * documented, F.greatest(both, F.lit(1)))) / F.greatest(both, F.lit(1))).cast("long")


def coverage_by(df: DataFrame, keys: list[str], documented: Column, with_rollup: bool = False) -> DataFrame:
    """AGG2 for groups; with_rollup (an addition) adds the totals of the leading keys."""
    g = df.rollup(*keys) if with_rollup else df.groupBy(*keys)
    out = g.agg(F.count_if(documented).alias("documented"), F.count_if(~documented).alias("undocumented"))
    return out.withColumn("coverage", coverage(F.col("documented"), F.col("undocumented")))


def coverage_report(counts: DataFrame) -> DataFrame:
    """AGG3: lines of the report from (counter, n); skipped-by-ACL and SPI lines only where there are any."""
    n = {k: F.coalesce(F.max(F.when(F.col("counter") == k, F.col("n"))), F.lit(0)) for k in ("documentedDef", "missingDocumentation", "filterMinAclExcluded", "filterSpi")}
    one = counts.agg(*[v.alias(k) for k, v in n.items()])
    total = coverage(F.col("documentedDef"), F.col("missingDocumentation"))
    lines = F.array(
        F.concat(total.cast("string"), F.lit("% documentation coverage with "), F.col("missingDocumentation").cast("string"), F.lit(" undocumented symbols")),
        F.when(F.col("filterMinAclExcluded") > 0, F.concat(F.col("filterMinAclExcluded").cast("string"), F.lit(" symbols skipped by access level"))),
        F.when(F.col("filterSpi") > 0, F.concat(F.col("filterSpi").cast("string"), F.lit(" SPI symbols skipped"))),
    )
    return one.select(F.posexplode(F.array_compact(lines)).alias("line_no", "line"))


def badge_colour(percent: Column) -> Column:
    """SNK13: steps at 10, 30, 60, 85, 90."""
    out = F.lit("brightgreen")
    for below, colour in ((90, "green"), (85, "yellowgreen"), (60, "yellow"), (30, "orange"), (10, "red")):
        out = F.when(percent < below, F.lit(colour)).otherwise(out)
    return out


def undocumented(df: DataFrame) -> DataFrame:
    """SNK9: by file and line; null files first, as ''."""
    return df.where("missing").orderBy(F.coalesce("file_pathname", F.lit("")), F.coalesce("first_line", F.lit(0)), "name")


def unresolved(df: DataFrame, order: str) -> DataFrame:
    """SNK10: a row per name with its last context, by name and context together."""
    return df.groupBy("name").agg(F.max_by("context", order).alias("context")).orderBy(F.concat("name", "context"))
