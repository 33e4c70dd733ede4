"""Filters as dispositions: an ordered chain of rejections gives each row one reason, so that counters are an
aggregate over a column and a retried task cannot count twice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborql.functions.text import glob_match
from arborql.model import ACLS, COUNTERS, rank


@dataclass(frozen=True)
class FilterConfig:
    include_globs: list[str] = field(default_factory=list)
    exclude_globs: list[str] = field(default_factory=list)
    exclude_names: list[str] = field(default_factory=list)
    min_acl: str = "public"
    include_spi: bool = False
    skip_undocumented: bool = False
    skip_undocumented_override: bool = False


def disposition(rules: list[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first rule that holds, in order; null conditions don't hold."""
    out = F.lit(kept)
    for name, cond in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def import_rules(excluded: Column) -> list[tuple[str, Column]]:
    """FLT1, FLT2: over typename, usr, name, declaration, diagnostic_stage."""
    return [
        ("importFailureNoRoot", F.col("diagnostic_stage").isNull()),
        ("importFailureNoType", F.col("typename").contains("<<error type>>")),
        ("importFailureNoUsr", F.col("usr").isNull()),
        ("importFailureIncomplete", F.col("name").isNull() | F.col("declaration").isNull()),
        ("importExcluded", excluded),
    ]


def filename_fails(path: Column, include: list[str], exclude: list[str]) -> Column:
    """FLT3: fails unless every include matches and no exclude does; a null name passes."""
    bad = F.lit(False)
    for g in include:
        bad = bad | ~glob_match(path, g)
    for g in exclude:
        bad = bad | glob_match(path, g)
    return F.coalesce(bad, F.lit(False))


def name_fails(name: Column, patterns: list[str]) -> Column:
    """FLT4: any pattern found anywhere."""
    bad = F.lit(False)
    for p in patterns:
        bad = bad | name.rlike(p)
    return bad


def marked_nodoc(abstract: Column, discussion: Column) -> Column:
    """FLT5"""
    return F.coalesce(F.contains(abstract, F.lit(":nodoc:")), F.lit(False)) | F.coalesce(F.contains(discussion, F.lit(":nodoc:")), F.lit(False))


def acl_fails(acl: Column, least: str, swift_extension: Column) -> Column:
    """FLT7: below the threshold, except extensions at internal."""
    return (rank(acl, ACLS, -1) < ACLS.index(least)) & ~(swift_extension & (acl == "internal"))


def filter_rules(c: FilterConfig) -> list[tuple[str, Column]]:
    """FLT3-7 in order, over file_pathname, name, abstract, discussion, is_spi, acl, is_swift_extension."""
    rules = [
        ("filterFilename", filename_fails(F.col("file_pathname"), c.include_globs, c.exclude_globs)),
        ("filterSymbolName", name_fails(F.col("name"), c.exclude_names)),
        ("filterNoDoc", marked_nodoc(F.col("abstract"), F.col("discussion"))),
    ]
    if not c.include_spi and ACLS.index(c.min_acl) >= ACLS.index("public"):
        rules.append(("filterSpi", F.col("is_spi")))
    return [*rules, ("filterMinAclExcluded", acl_fails(F.col("acl"), c.min_acl, F.col("is_swift_extension")))]


def documentation(c: FilterConfig) -> tuple[Column, Column]:
    """FLT9 over has_docs, is_override, is_swift_extension: (disposition, counter). Documented rows and
    extensions pass; others are reported, and dropped or given a placeholder."""
    fine = F.col("has_docs") | F.col("is_swift_extension")
    override = F.lit(c.skip_undocumented_override) & F.col("is_override") & ~F.col("has_docs")
    d = disposition([("filterSkipUndocOverride", override), ("documented", fine), ("filterSkipUndocumented", F.lit(c.skip_undocumented))], "placeholder")
    n = F.when(override, "filterSkipUndocOverride").when(fine, "documentedDef").otherwise("missingDocumentation")
    return d, n


def private_protocols(defs: DataFrame) -> DataFrame:
    """FLT8: names, bare and with their module, of top-level private protocols of the unfiltered input."""
    p = defs.where((F.size("path") == 1) & F.col("kind").endswith(".protocol") & F.col("acl").isin("private", "fileprivate"))
    return p.select(F.explode(F.array(F.col("name"), F.concat_ws(".", "module_name", "name"))).alias("name")).distinct()


def strip_inherited(defs: DataFrame, private: DataFrame, key: list[str], column: str = "inherited_types") -> DataFrame:
    """FLT8: inherited types without private protocols, order and repeats kept. An equi-join on the names, so
    the set is never gathered in one place."""
    e = defs.select(*key, F.posexplode_outer(column).alias("__pos", "__name"))
    e = e.join(private.select(F.col("name").alias("__name")), "__name", "left_anti")
    back = e.where("__name is not null").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__name"))), lambda x: x["__name"]).alias("__t"))
    return defs.join(back, key, "left").withColumn(column, F.coalesce("__t", F.array().cast("array<string>"))).drop("__t")


def counters(counted: DataFrame, column: str, names: list[str] | None = None) -> DataFrame:
    """AGG1: (counter, n) of every known counter, zero where nothing was counted."""
    names = COUNTERS if names is None else names
    known = counted.sparkSession.createDataFrame([(n,) for n in names], "counter string")
    got = counted.groupBy(F.col(column).alias("counter")).agg(F.count("*").alias("n"))
    return known.join(got, "counter", "left").select("counter", F.coalesce("n", F.lit(0)).alias("n"))


def toc_visible(show: Column, depth: Column) -> Column:
    """FLT13: yes, no, or at the top level only."""
    return F.when(show == "atTopLevel", depth < 2).otherwise(show == "yes")
