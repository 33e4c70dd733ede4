"""Hierarchies as flat rows with a materialized ordinal path: ORDER BY path is depth-first pre-order, and an
ancestor's path is a prefix. Paths make ancestor tests and pruning joins on equal prefixes, not recursion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.operators.ordered import neighbours, placed_in_order

CHILDREN = "key.substructure"


def flatten_variant(spark: SparkSession, view: str, child_key: str = CHILDREN, max_depth: int = 1000) -> DataFrame:
    """PRJ4: the rows of recursive JSON. The view has (root columns.., v VARIANT); the result has them plus
    path ARRAY<INT> and v, one row a node, by one recursive query without Python. Nodes below max_depth are an error."""
    cols = [c for c in spark.table(view).columns if c != "v"]
    keys = ", ".join(cols) + (", " if cols else "")
    kept = ", ".join(f"t.{c}" for c in cols) + (", " if cols else "")
    return spark.sql(f"""
        WITH RECURSIVE t({keys}path, v, depth) MAX RECURSION LEVEL {max_depth} AS (
          SELECT {keys}array(0), v, 0 FROM {view}
          UNION ALL
          SELECT {kept}array_append(t.path, c.pos), c.value, t.depth + 1
          FROM t, LATERAL variant_explode(try_variant_get(t.v, '$["{child_key}"]', 'variant')) c)
        SELECT {keys}path, v FROM t LIMIT ALL""")


def paths_from_parents(df: DataFrame, tables, id_col: str, parent_col: str, order: str, max_depth: int = 1000) -> DataFrame:
    """path ARRAY<STRUCT<ord,id>> of every row reachable from a root (null parent), one equi-join per level. Rows below
    max_depth levels, as repeated ids in a ring have, are an error."""
    step = F.struct(F.col(order).alias("ord"), F.col(id_col).alias("id"))
    level = tables.write(df.where(F.col(parent_col).isNull()).withColumn("path", F.array(step)))
    found = [level]
    for _ in range(max_depth):
        up = level.select(F.col(id_col).alias("__up"), F.col("path").alias("__path"))
        level = tables.write(df.join(up, F.col(parent_col) == F.col("__up")).withColumn("path", F.array_append("__path", step)).drop("__up", "__path"))
        if level.isEmpty():
            break
        found.append(level)
        if len(found) == 50:  # so that the plan of a deep tree stays small
            found = [tables.write(reduce(DataFrame.unionByName, found))]
    else:
        raise RuntimeError(f"rows below {max_depth} levels")
    return reduce(DataFrame.unionByName, found)


def is_ancestor(a: Column, b: Column) -> Column:
    """Whether path a is a proper prefix of path b."""
    return (F.size(a) < F.size(b)) & (F.slice(b, 1, F.size(a)) == a)


def ancestor_paths(path: Column) -> Column:
    """The paths of all proper ancestors, outermost first."""
    n = F.size(path)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.slice(path, F.lit(1), k))).otherwise(F.slice(F.array(path), 1, 0))


#: Levels for which the last row of each is carried along in one pass; deeper trees ask for their prefixes.
LEVELS = 32


def above(df: DataFrame, value: Column, name: str, root: list[str] | None = None, tables=None) -> DataFrame:
    """``name`` holds ``value`` of the ancestors that are rows and of the row itself, outermost first.

    In order of path the last row of a level so far is the ancestor on that level, if it is a prefix. So it is one pass
    over sorted ranges with the last row of each level carried along, and a row a range for what comes from before it."""
    root = root or []
    d = placed_in_order(df.withColumn("__v", value), [*root, "path"], tables)
    deep = d.agg(F.max(F.size("path"))).first()[0] or 0
    if deep > LEVELS or not deep:
        return _above_by_prefix(d.drop("__part", "__at"), name, root)
    depth = F.size("path")
    at = [F.when(depth == k, F.struct(*root, F.col("path").alias("__p"), F.col("__v").alias("__v"))) for k in range(1, deep + 1)]
    w = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    across = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # over a row a range
    ends = d.groupBy("__part").agg(*[F.max_by(x, F.when(x.isNotNull(), F.col("__at"))).alias(f"__e{k}") for k, x in enumerate(at)])
    ends = ends.select("__part", *[F.last(f"__e{k}", ignorenulls=True).over(across).alias(f"__c{k}") for k in range(deep)])
    d = d.select("*", *[F.last(x, ignorenulls=True).over(w).alias(f"__l{k}") for k, x in enumerate(at)]).join(ends, "__part")
    own = lambda x: [x[r].eqNullSafe(F.col(r)) for r in root]
    last = [F.coalesce(f"__l{k}", f"__c{k}") for k in range(deep)]
    fits = [reduce(lambda a, b: a & b, own(x), (depth > k) & (F.slice("path", 1, k + 1) == x["__p"])) for k, x in enumerate(last)]
    some = F.array(*[F.when(f, x) for f, x in zip(fits, last)]) if last else F.array()
    return d.withColumn(name, F.transform(F.filter(some, lambda x: x.isNotNull()), lambda x: x["__v"])).select(*df.columns, name)


def _above_by_prefix(d: DataFrame, name: str, root: list[str]) -> DataFrame:
    """The same for trees of any depth: a row asks for each of its prefixes."""
    ups = d.select(*root, F.col("path").alias("__of"), F.explode(F.array_append(ancestor_paths(F.col("path")), F.col("path"))).alias("__at"))
    vals = d.select(*root, F.col("path").alias("__at"), "__v")
    got = ups.join(vals, [*root, "__at"]).groupBy(*root, "__of").agg(F.array_sort(F.collect_list(F.struct(F.size("__at").alias("d"), F.col("__v").alias("v")))).alias("__vs"))
    return d.join(got.withColumnRenamed("__of", "path"), [*root, "path"]).withColumn(name, F.transform("__vs", lambda x: x["v"])).drop("__vs", "__v")


def with_ancestors(df: DataFrame, value: str, name: str, root: list[str] | None = None) -> DataFrame:
    """PRJ11, LNK12: ``name`` holds the values of the ancestors and the row itself, outermost first."""
    return above(df, F.col(value), name, root)


def prune(df: DataFrame, dropped: Column, root: list[str] | None = None) -> DataFrame:
    """FLT10: rows with neither a dropped ancestor nor dropped themselves."""
    d = above(df, F.coalesce(dropped, F.lit(False)), "__dropped", root)
    return d.where(~F.exists("__dropped", lambda x: x)).drop("__dropped")


def unevaluated(df: DataFrame, dropped: Column, root: list[str] | None = None) -> DataFrame:
    """FLT10: the rows below a dropped row, which are neither evaluated nor counted."""
    d = above(df, F.coalesce(dropped, F.lit(False)), "__dropped", root)
    return d.where(F.exists(F.slice("__dropped", F.lit(1), F.size("__dropped") - 1), lambda x: x)).drop("__dropped")


def prune_childless(df: DataFrame, needs_child: Column, tables, root: list[str] | None = None) -> DataFrame:
    """FLT11: rows where needs_child holds and no child is left go, from the leaves up."""
    root = root or []
    df = tables.write(df)
    while True:  # a round takes a row at least
        kids = df.select(*root, F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
        bare = df.where(needs_child).join(kids, [*root, "path"], "left_anti")
        if bare.isEmpty():
            return df
        df = tables.write(df.join(bare.select(*root, "path"), [*root, "path"], "left_anti"))


def unwrap(df: DataFrame, wrapper: Column, root: list[str] | None = None) -> DataFrame:
    """PRJ5: wrapper rows (enum cases) are replaced by their children, which take their place in order: the
    wrapper's ordinal stays in the path and the depth is told by ``depth``."""
    root = root or []
    w = df.where(wrapper).select(*root, F.col("path").alias("__w"))
    up = F.slice("path", F.lit(1), F.size("path") - 1)
    kids = df.withColumn("__w", up).join(w, [*root, "__w"], "left_semi").select(*root, "path").withColumn("__moved", F.lit(1))
    out = df.where(~wrapper).join(kids, [*root, "path"], "left")
    return out.withColumn("depth", F.size("path") - F.coalesce("__moved", F.lit(0))).drop("__moved")


def nest(df: DataFrame, fields: list[str], root: list[str], depth: int) -> DataFrame:
    """SNK2, SNK3: rows back to JSON trees, deepest level first; one JSON text per root row in order."""
    body = lambda kids: F.to_json(F.struct(*fields, *kids))
    level = None
    for d in range(depth, 0, -1):
        own = df.where(F.size("path") == d)
        if level is None:
            now = own.withColumn("json", body([]))
        else:
            now = own.join(level, [*root, "path"], "left")
            plain, full = body([]), F.concat(F.expr(f"left(to_json(struct({', '.join(fields)})), length(to_json(struct({', '.join(fields)}))) - 1)"), F.lit(',"children":['), F.array_join("kids", ","), F.lit("]}"))
            now = now.withColumn("json", F.when(F.col("kids").isNull(), plain).otherwise(full)).drop("kids")
        if d == 1:
            return now.select(*root, "path", "json")
        level = now.groupBy(*root, F.slice("path", 1, d - 1).alias("path")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("path", "json"))), lambda x: x["json"]).alias("kids"))
    return df.select(*root, "path").withColumn("json", F.lit(None).cast("string"))


def json_pieces(df: DataFrame, body: str, root: list[str], tables, child_key: str = "children") -> DataFrame:
    """SNK2, SNK3: trees of any depth as JSON, a piece a row: the pieces of a tree in the order of ``path``, put together,
    are its text. A row's piece depends on its own depth and that of the row after it, over sorted ranges of the whole
    table: no level is joined or gathered, and no tree needs to fit in a task.

    df(root.., path, body JSON object); a tree is a row with a path of one and all below it. Rows without their parent
    right before them in depth are an error. The result is root.., path, top (the tree's first ordinal) and piece."""
    at = F.struct(*root, F.col("path")[0].alias("__top"))
    d = df.select(*root, "path", F.col(body).alias("__body")).withColumn("__v", F.struct(at.alias("tree"), F.size("path").alias("depth")))
    d = neighbours(d, [*root, "path"], "__v", "__prev", "__next", tables)
    same = lambda v: F.coalesce(F.col(f"{v}.tree").eqNullSafe(F.col("__v.tree")), F.lit(False))
    depth, after, before = F.col("__v.depth"), F.when(same("__next"), F.col("__next.depth")).otherwise(1), F.when(same("__prev"), F.col("__prev.depth")).otherwise(0)
    opened = F.substring("__body", F.lit(1), F.length("__body") - 1)
    more = F.concat(opened, F.when(opened != "{", ",").otherwise(""), F.lit(f'"{child_key}":['))
    shut = F.concat(F.col("__body"), F.repeat(F.lit("]}"), depth - after), F.when(same("__next"), ",").otherwise(""))
    piece = F.when(depth - before > 1, F.raise_error(F.concat(F.lit("no parent: "), F.to_json("path")))).when(after > depth, more).otherwise(shut)
    return d.select(*root, "path", F.col("path")[0].alias("top"), piece.alias("piece"))


def json_trees(pieces: DataFrame, root: list[str]) -> DataFrame:
    """The whole texts: a row a tree (root.., top, json). For trees that fit in a row."""
    g = pieces.groupBy(*root, "top").agg(F.array_sort(F.collect_list(F.struct("path", "piece"))).alias("p"))
    return g.select(*root, "top", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("json"))
