"""Sources: symbol JSON in three dialects, markdown, string bundles, link indexes, configuration.

All are read by Spark, so any file system that Spark knows will do; nothing is opened on the driver but the
configuration. Order comes from the file name and place in it (file_ord), never from arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.functions.text import glob_pattern, re_escape, version_at_most
from arborql.model import SYMBOL_GRAPH
from arborql.operators.ordered import first_wins, islands, last_wins, neighbours, running_total
from arborql.tables import hadoop_path

_PATH = "_metadata.file_path"


def whole_files(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(file, text) of files, optionally those whose name fits a glob (SRC18)."""
    r = spark.read
    return (r.option("pathGlobFilter", pattern) if pattern else r).text(paths, wholetext=True).select(F.col(_PATH).alias("file"), F.col("value").alias("text"))


def glob_files(spark: SparkSession, patterns: str | list[str], name: str | None = None, contents: bool = True) -> DataFrame:
    """SRC18: (file, folder, name, size, and text with ``contents``) of files in all folders that the patterns name, by *, ?,
    [..] and {a,b}, in any file system; none is no rows. ``name`` is a shell pattern for the files' own names. It is a
    filter on metadata, so it prunes the listing before anything is opened, and sizes alone open nothing."""
    found = []
    for p in [patterns] if isinstance(patterns, str) else patterns:
        path, fs = hadoop_path(spark, p)
        found += [s.getPath().toString() for s in fs.globStatus(path) or []]
    schema = "file string, folder string, name string, size long" + (", text string" if contents else "")
    if not found:
        return spark.createDataFrame([], schema)
    r = spark.read.text(found, wholetext=True) if contents else spark.read.format("binaryFile").load(found)
    if name is not None:
        r = r.where(F.col("_metadata.file_name").rlike(glob_pattern(name)))
    file = F.col(_PATH)
    r = r.select(file.alias("file"), F.substring_index(F.regexp_replace(file, "/[^/]*$", ""), "/", -1).alias("folder"), F.col("_metadata.file_name").alias("name"),
                 F.col("_metadata.file_size").alias("size"), *([F.col("value").alias("text")] if contents else []))
    return r


def raw_symbols(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC1: (file, file_seq, pathname, v VARIANT) of arrays of one-key objects; what does not decode is a row with
    a null v and a warning."""
    f = whole_files(spark, paths).withColumn("doc", F.try_parse_json("text"))
    f.createOrReplaceTempView("__raw_files")
    return spark.sql("""
        SELECT f.file, e.pos AS file_seq, o.key AS pathname, o.value AS v, CAST(NULL AS STRING) AS warning
        FROM __raw_files f, LATERAL variant_explode(f.doc) e, LATERAL variant_explode(e.value) o WHERE f.doc IS NOT NULL
        UNION ALL SELECT file, 0, NULL, NULL, 'undecodable' FROM __raw_files WHERE doc IS NULL""")


def text_of(name: str, kind: str = "string") -> Column:
    """PRJ1: a typed key of the raw record, null where the type is another."""
    return F.try_variant_get("v", f'$["key.{name}"]', kind)


def project(rows: DataFrame) -> DataFrame:
    """PRJ1: the typed columns of flattened raw rows(.., path, v)."""
    keep = [c for c in rows.columns if c != "v"]
    return rows.select(
        *keep, text_of("name").alias("name"), text_of("kind").alias("kind"), text_of("usr").alias("usr"), text_of("typename").alias("typename"),
        text_of("accessibility").alias("accessibility"), text_of("doc.comment").alias("doc_comment"), text_of("parsed_declaration").alias("declaration"),
        text_of("annotated_decl").alias("annotated_decl"), text_of("modulename").alias("modulename"), text_of("offset", "bigint").alias("offset"),
        text_of("doc.line", "bigint").alias("doc_line"), text_of("parsed_scope.start", "bigint").alias("scope_start"), text_of("parsed_scope.end", "bigint").alias("scope_end"),
        text_of("filepath").alias("filepath"), text_of("diagnostic_stage").alias("diagnostic_stage"))


def reimported(spark: SparkSession, paths: str | list[str], this_version: str = "2.0") -> DataFrame:
    """SRC2: raw symbols with module_name, pass_index and pass_no: files of malformed or later versions go, and runs
    of neighbours with one module and pass are one pass (not a group-by: a module may come back)."""
    r = raw_symbols(spark, paths).where("v is not null")
    r = r.select("*", F.try_variant_get("v", '$["key.bb.version"]', "string").alias("version"), F.try_variant_get("v", '$["key.bb.module_name"]', "string").alias("module_name"),
                 F.try_variant_get("v", '$["key.bb.pass_index"]', "bigint").alias("pass_index"))
    r = r.where(F.col("version").isNotNull() & F.col("module_name").isNotNull() & F.col("pass_index").isNotNull()).where(version_at_most(F.col("version"), F.lit(this_version)))
    r = islands(r, ["module_name", "pass_index"], ["file"], ["file_seq"], "__run")
    # runs are numbered within files; a row a file tells how many came before it, and whether its first goes on a run
    ends = F.struct("module_name", "pass_index")
    f = r.groupBy("file").agg(F.min_by(ends, "file_seq").alias("first"), F.max_by(ends, "file_seq").alias("last"), F.max("__run").alias("n"))
    f = neighbours(f, ["file"], "last", "__prev", "__next").withColumn("__own", F.col("n") - F.when(F.col("first").eqNullSafe(F.col("__prev")), 1).otherwise(0))
    f = running_total(f, ["file"], "__own", "__upto").select("file", (F.col("__upto") - F.col("n")).alias("__base"))
    return r.join(f, "file").withColumn("pass_no", F.col("__base") + F.col("__run")).drop("__base", "__run")


def import_filter(df: DataFrame, module: str | None = None, pass_index: int | None = None) -> DataFrame:
    """SRC3: no module: all; else the module, and the pass if one is named."""
    if module is None:
        return df
    out = df.where(F.col("module_name") == module)
    return out if pass_index is None else out.where(F.col("pass_index") == pass_index)


def symbol_graphs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC4, SRC5: (file_ord, module_name, fixed schema). The module is the file's, an extension file 'A@B' is of A
    about B."""
    g = spark.read.schema(SYMBOL_GRAPH).option("multiLine", True).option("mode", "PERMISSIVE").json(paths).select("*", F.col(_PATH).alias("file_ord"))
    name = F.regexp_extract("file_ord", r"([^/]*)\.symbols\.json$", 1)
    return g.where("metadata is not null").select("file_ord", F.regexp_extract(name, r"^([^@]*)", 1).alias("module_name"), F.nullif(F.regexp_extract(name, r"@(.*)$", 1), F.lit("")).alias("about_module"), "symbols", "relationships")


def bridging_names(rows: DataFrame) -> DataFrame:
    """SRC9: usr -> swift name and declaration of flattened header rows; the last wins."""
    r = rows.select("path", "file", text_of("usr").alias("usr"), text_of("swift_name").alias("name"), text_of("swift_declaration").alias("declaration"))
    return last_wins(r.where("usr is not null"), ["usr"], ["file", "path"])


def localized_markdown(spark: SparkSession, paths: str | list[str], tags: list[str], main: str) -> DataFrame:
    """SRC10: (name, texts MAP): .md files of the paths, which may be patterns; the first of a base name wins;
    <tag>/<file> overrides it for a tag."""
    f = glob_files(spark, paths, "*.[mM][dD]").select("file", "text")
    parts = F.split("file", "/")
    f = f.select(F.element_at(parts, -1).alias("name"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -2).alias("last_dir"), "file", "text")
    base = first_wins(f.where(~F.col("last_dir").isin(tags)), ["name"], ["file"])
    out = base.withColumn("texts", F.create_map(F.lit(main), F.col("text")))
    for t in tags:
        o = f.where(F.col("last_dir") == t).select("name", F.regexp_replace("dir", f"/{re_escape(t)}$", "").alias("dir"), F.col("text").alias("__t"))
        out = out.join(o, ["name", "dir"], "left").withColumn("texts", F.map_concat(_without(F.col("texts"), t), F.create_map(F.lit(t), F.coalesce("__t", "text")))).drop("__t")
    return out.select("name", "file", "texts")


def _without(m: Column, tag: str) -> Column:
    return F.map_filter(m, lambda k, _: k != tag)


def media_files(spark: SparkSession, paths: str | list[str], name: str | None = None) -> DataFrame:
    """SRC11: (name, file, size) of files that the patterns name: the first of a name; contents are not read."""
    return first_wins(glob_files(spark, paths, name, contents=False).select("name", "file", "size"), ["name"], ["file"])


def builtin_links(spark: SparkSession, paths: str | list[str], base: str) -> DataFrame:
    """SRC12: (module_name, name, url): one field is a type with a derived url, more are names of the last."""
    t = spark.read.text(paths).select(F.element_at(F.split(_PATH, "/"), -1).alias("module_name"), F.split("value", r"\|").alias("f")).where("f[0] <> ''")
    one = t.where("size(f) = 1").select("module_name", F.col("f")[0].alias("name"), F.concat(F.lit(base), F.lower("module_name"), F.lit("/"), F.lower(F.col("f")[0])).alias("url"))
    many = t.where("size(f) > 1").select("module_name", F.explode(F.expr("slice(f, 1, size(f) - 1)")).alias("name"), F.element_at("f", -1).alias("url"))
    return one.unionByName(many)


def remote_search(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC13: (url, name, abstract, parent_name) of a remote search index."""
    m = F.from_json("text", "map<string,struct<name:string,abstract:string,parent_name:string>>")
    return whole_files(spark, paths).select("file", F.explode(m).alias("url", "e")).select("file", "url", "e.*")


def remote_docc(spark: SparkSession, paths: str | list[str], language: str = "swift") -> DataFrame:
    """SRC14: (module_name, symbol, suffix, path, title) of a DocC index, by one recursive query over its nodes;
    modules, symbol groups and nodes without a path are left out."""
    whole_files(spark, paths).withColumn("doc", F.try_parse_json("text")).createOrReplaceTempView("__docc")
    n = spark.sql(f"""
        WITH RECURSIVE t(file, ord, v) MAX RECURSION LEVEL 1000 AS (
          SELECT f.file, array(e.pos), e.value FROM __docc f, LATERAL variant_explode(try_variant_get(f.doc, '$.interfaceLanguages.{language}', 'variant')) e
          UNION ALL
          SELECT t.file, array_append(t.ord, c.pos), c.value FROM t, LATERAL variant_explode(try_variant_get(t.v, '$.children', 'variant')) c)
        SELECT file, ord, try_variant_get(v, '$.path', 'string') AS path, try_variant_get(v, '$.title', 'string') AS title, try_variant_get(v, '$.type', 'string') AS type FROM t LIMIT ALL""")
    p = r"^/documentation/([^/]+)/(.+?)(-[0-9a-z]{4,6})?$"
    n = n.where("path is not null and type is not null and type not in ('module', 'symbol')").where(F.col("path").rlike(p))
    return n.select("file", "ord", F.regexp_extract("path", p, 1).alias("module_name"), F.regexp_extract("path", p, 2).alias("symbol"), F.nullif(F.regexp_extract("path", p, 3), F.lit("")).alias("suffix"), "path", "title")


def site_record(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC15: (file, version, module_name)."""
    r = F.from_json("text", "version string, modules array<string>")
    return whole_files(spark, paths).select("file", r.alias("r")).select("file", "r.version", F.explode("r.modules").alias("module_name"))


def string_bundles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC19: (tag, key, value) of "key" = "value"; lines; the tag is the directory's."""
    row = r'(?s)"((?:[^"\\]|\\.)*)"\s*=\s*"((?:[^"\\]|\\.)*)"\s*;'
    f = whole_files(spark, paths).select("file", F.element_at(F.split("file", "/"), -2).alias("tag"), F.explode(F.arrays_zip(
        F.regexp_extract_all("text", F.lit(row), F.lit(1)).alias("key"), F.regexp_extract_all("text", F.lit(row), F.lit(2)).alias("value"))).alias("e"))
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1")
    return f.select("file", F.regexp_replace("tag", r"\.lproj$", "").alias("tag"), plain(F.col("e.key")).alias("key"), plain(F.col("e.value")).alias("value"))


def localized(keys: DataFrame, bundle: DataFrame, tags: list[str], main: str) -> DataFrame:
    """JN9: keys(key, ..) with texts MAP: each tag's string, else the main tag's, else absent."""
    m = bundle.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("tag", "value")))).alias("m"))
    j = keys.join(m, "key", "left")
    return j.withColumn("texts", F.map_filter(F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*[F.coalesce(F.try_element_at("m", F.lit(t)), F.try_element_at("m", F.lit(main))) for t in tags])), lambda k, v: v.isNotNull())).drop("m")


def with_shared_docs(rows: DataFrame) -> DataFrame:
    """WIN2: a row without docs at its previous sibling's offset, or after an enum element, has that one's docs;
    this goes on along a run. rows(parent, ord, offset, kind, docs)."""
    w = W.partitionBy("parent").orderBy("ord")
    joins = (F.col("offset") == F.lag("offset").over(w)) | F.lag("kind").over(w).endswith("enumelement") & F.col("kind").endswith("enumelement")
    r = rows.withColumn("__run", F.sum(F.when(F.coalesce(joins, F.lit(False)) & F.col("docs").isNull(), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return r.withColumn("docs", F.last("docs", ignorenulls=True).over(W.partitionBy("parent", "__run").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__run")
