"""Grouping: by kind and module, by rules, and by directory; and the orders of what a group holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.functions.text import re_check, re_escape
from arborql.model import ITEM_KIND_NAMES, ITEM_KINDS, TOPICS, rank


def kind_groups(items: DataFrame, modules: DataFrame) -> DataFrame:
    """GRP1: items(meta_kind, module_name) with group_title and group_rank; modules(module_name, policy, named) has
    the policy global, separate or named. With one module, separate is global."""
    one = modules.count() < 2
    m = modules.select("module_name", F.when((F.col("policy") == "separate") & F.lit(one), "global").otherwise(F.col("policy")).alias("policy"), "named")
    j = items.join(m, "module_name")
    names = F.create_map(*[x for k, v in ITEM_KIND_NAMES.items() for x in (F.lit(k), F.lit(v))])
    title = names[F.col("meta_kind")]
    affix = F.when(F.col("policy") == "separate", F.col("module_name")).when(F.col("policy") == "named", F.col("named"))
    j = j.withColumn("group_title", F.when(affix.isNull(), title).otherwise(F.concat(affix, F.lit(" "), title)))
    order = W.orderBy(rank(F.col("meta_kind"), ITEM_KINDS, len(ITEM_KINDS)), F.col("is_all"), F.col("group_title"))
    g = j.select("meta_kind", "group_title", affix.isNull().alias("is_all")).distinct()
    return j.join(g.select("meta_kind", "group_title", F.dense_rank().over(order).alias("group_rank")), ["meta_kind", "group_title"])


@dataclass(frozen=True)
class Rule:
    """One line of a custom group: a name, ``Name [TocName]``, ``/regex/``, or ``filepath /regex/``."""

    group: str
    text: str

    def parts(self) -> tuple[str, str]:
        t = self.text.strip()
        if t.startswith("filepath ") and t.endswith("/"):
            return "file", t[len("filepath "):].strip()[1:-1]
        if len(t) > 1 and t.startswith("/") and t.endswith("/"):
            return "regex", t[1:-1]
        return "exact", t.split(" [")[0]


def parse_groups(config: list[dict]) -> list[Rule]:
    """GRP6: groups {name, children or topics [{name, children}]} as rules in document order, validated."""
    out = []

    def walk(g: dict, nested: bool) -> None:
        if not isinstance(g.get("name"), str) or not g["name"]:
            raise ValueError("a custom group needs a name")
        if g.get("children") and g.get("topics"):
            raise ValueError(f"group {g['name']}: children or topics, not both")
        if nested and g.get("topics"):
            raise ValueError(f"group {g['name']}: topics within topics")
        for c in g.get("children") or []:
            if isinstance(c, dict):
                walk(c, nested)
            else:
                r = Rule(g["name"], str(c))
                if r.parts()[0] != "exact":
                    re_check(r.parts()[1])
                out.append(r)
        for t in g.get("topics") or []:
            walk(t, True)

    for g in config:
        walk(g, False)
    return out


def rule_claims(items: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """GRP2: items(name, qualified_name, file_pathname) with rule_ord of the first rule that takes them, null for the
    remainder (GRP3). Rules are a bounded configuration, so they are one conditional column, not a join:
    an item is evaluated where it is. An exact name takes a qualified name before a bare one."""
    claim = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        kind, what = rules[k].parts()
        if kind == "exact":
            hit = (F.col("qualified_name") == what) | (F.col("name") == what)
        elif kind == "regex":
            hit = F.col("qualified_name").rlike(what) | F.col("name").rlike(what)
        else:
            hit = F.col("file_pathname").rlike(what)
        claim = F.when(F.coalesce(hit, F.lit(False)), F.lit(k)).otherwise(claim)
    groups = F.array(*[F.lit(r.group) for r in rules]) if rules else F.array().cast("array<string>")
    return items.withColumn("rule_ord", claim).withColumn("group_title", F.get(groups, F.col("rule_ord")))


def claim_order(rules: list[Rule]) -> list[Column]:
    """GRP2: within a group by rule; regex results by name, filepath results in source order."""
    by_name = F.col("rule_ord").isin([k for k, r in enumerate(rules) if r.parts()[0] == "regex"])
    return [F.col("rule_ord"), F.when(by_name, F.col("name")), F.col("path")]


def unused_rules(claims: DataFrame, rules: list[Rule]) -> DataFrame:
    """SET5: rules that took nothing."""
    d = claims.sparkSession.createDataFrame([(k, r.group, r.text) for k, r in enumerate(rules)], "rule_ord int, group string, rule string")
    return d.join(claims.select("rule_ord").distinct(), "rule_ord", "left_anti")


def unmatched(given: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """SET5: what the configuration gives (abstracts, titles, definitions) and nothing takes, by kind: (kind, n, names
    sorted). given(kind, name, ..) and taken hold ``keys``; a name given twice is one."""
    left = given.select("kind", "name", *keys).distinct().join(taken.select(*keys).distinct(), keys, "left_anti")
    return left.select("kind", "name").distinct().groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def missing_members(children: DataFrame, listed: DataFrame) -> DataFrame:
    """SET5: entries of custom definitions that name no child of their type, by name or by declaration."""
    own = children.select("type_name", F.explode(F.array("name", "declaration")).alias("entry")).where("entry is not null").distinct()
    return listed.select("type_name", "entry").distinct().join(own, ["type_name", "entry"], "left_anti")


def custom_members(children: DataFrame, listed: DataFrame, skip_unlisted: bool) -> DataFrame:
    """GRP4: a type's children with the place that its list gives them (by name, or by declaration), the first
    match of each entry; unlisted ones follow in order or go. listed(type_name, entry, topic, place)."""
    by_name = children.join(listed, (children["type_name"] == listed["type_name"]) & (children["name"] == listed["entry"])).drop(listed["type_name"])
    by_decl = children.join(listed, (children["type_name"] == listed["type_name"]) & (children["declaration"] == listed["entry"])).drop(listed["type_name"])
    hit = by_name.unionByName(by_decl).groupBy("type_name", "place").agg(F.min_by(F.struct("path", "topic"), "path").alias("x")).select("type_name", "place", "x.path", F.col("x.topic").alias("custom_topic"))
    hit = hit.groupBy("type_name", "path").agg(F.min("place").alias("place"), F.min_by("custom_topic", "place").alias("custom_topic"))
    out = children.join(hit, ["type_name", "path"], "inner" if skip_unlisted else "left")
    return out.withColumn("place", F.struct(F.col("place").isNull().alias("late"), F.col("place").alias("at"), F.col("path").alias("path")))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def nested_directories(paths: DataFrame, column: str = "dir") -> DataFrame:
    """GRP5, JN15: each directory with its parent: the longest other directory that is a path prefix. A directory
    asks for its own ancestors, so it is an equi-join; '/a/b' does not hold '/a/bc'."""
    d = paths.select(F.col(column).alias("dir")).distinct()
    n = F.size(F.split("dir", "/"))
    ups = d.select("dir", F.explode(F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))).alias("up"))
    best = ups.join(d.select(F.col("dir").alias("up")), "up").groupBy("dir").agg(F.max_by("up", F.length("up")).alias("parent_dir"))
    return d.join(best, "dir", "left").withColumn("title", F.when(F.col("parent_dir").isNull(), F.element_at(F.split("dir", "/"), -1)).otherwise(F.substring("dir", F.length("parent_dir") + 2, F.length("dir"))))


def string_prefix_parents(paths: DataFrame, column: str = "dir", max_depth: int = 64) -> DataFrame:
    """JN15 in its compatible form: the first shorter path that is a string prefix, whole components or not."""
    d = paths.select(F.col(column).alias("dir")).distinct()
    ups = d.select("dir", F.explode(F.when(F.length("dir") > 1, F.transform(F.sequence(F.lit(1), F.length("dir") - 1), lambda k: F.substring("dir", F.lit(1), k))).otherwise(F.array().cast("array<string>"))).alias("up"))
    best = ups.join(d.select(F.col("dir").alias("up")), "up").groupBy("dir").agg(F.max_by("up", F.length("up")).alias("parent_dir"))
    return d.join(best, "dir", "left")


def logical_order() -> list[Column]:
    """OR1: by topic, then name, but enum elements in source order."""
    return [rank(F.col("def_topic"), TOPICS, len(TOPICS)), F.when(F.col("def_topic") != "enumElement", F.col("name")), F.col("path")]


def conditional_order() -> list[Column]:
    """OR2"""
    return [F.col("extension_constraint"), rank(F.col("def_topic"), TOPICS, len(TOPICS)), F.col("name")]


def group_page_order() -> list[Column]:
    """OR3: groups within a group first, then by sortable name."""
    return [F.col("is_def"), F.col("sortable_name")]


def location_order() -> list[Column]:
    """OR6"""
    return [F.coalesce("file_pathname", F.lit("")), F.coalesce("first_line", F.lit(0))]


def source_topics(df: DataFrame, default: str = "") -> DataFrame:
    """WIN6: topics of siblings in source order: a null one is the one before; the first is ``default``."""
    w = W.partitionBy("parent").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("topic", F.coalesce(F.last("topic", ignorenulls=True).over(w), F.lit(default)))


def conditional_block(df: DataFrame) -> DataFrame:
    """WIN8: from the first constrained child on, children have the latest constraint."""
    w = W.partitionBy("parent").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("block_constraint", F.last("extension_constraint", ignorenulls=True).over(w))


def toc_order(source_order: Column, title: Column, in_custom_group: Column) -> list[Column]:
    """OR9: by title in source-order mode, except under custom groups; then by path."""
    return [F.when(source_order & ~in_custom_group, title), F.col("path")]


def exact_pattern(name: str) -> str:
    return "^" + re_escape(name) + "$"


def guide_titles(guides: DataFrame, titles: DataFrame) -> DataFrame:
    """JN7: guides(name) with the title that titles(name, title) gives them, else their name."""
    return guides.join(titles, "name", "left").withColumn("title", F.coalesce("title", "name"))


def unused_titles(guides: DataFrame, titles: DataFrame) -> DataFrame:
    """JN7, SET5"""
    return titles.join(guides, "name", "left_anti")


def listed_guides(claims: DataFrame, have_custom_groups: bool) -> DataFrame:
    """GRP7: with custom groups and their setting, guides that no rule takes are left out."""
    return claims.where(F.col("rule_ord").isNotNull() | (F.col("item_type") != "guide")) if have_custom_groups else claims


def with_modules(items: DataFrame, modules: DataFrame) -> DataFrame:
    """JN8: every item's module row; an item of an unknown module is an error that shows as a null policy."""
    return items.join(modules, "module_name", "left")


def by_depth(paths: DataFrame, column: str = "dir") -> DataFrame:
    """OR5, SET4: distinct directories, the least nested first."""
    return paths.select(column).distinct().orderBy(F.size(F.split(column, "/")), column)
