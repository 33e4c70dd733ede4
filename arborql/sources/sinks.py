"""Products: JSON in its shapes, indexes, reports. Each is a frame; nothing runs until it is written, and what is not
asked for never runs (SNK1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Products, and those made unless others are asked for.
PRODUCTS = ["files-json", "decls-json", "docs-summary-json", "docs-json", "docs", "docset", "stats-json", "undocumented-json", "unresolved-json", "theme"]
DEFAULT = ["docs", "docset", "stats-json", "undocumented-json"]


def chosen(asked: list[str] | None = None) -> list[str]:
    """SNK1: products in order of making; unique prefixes will do; the theme stands alone."""
    asked = asked or DEFAULT
    out = []
    for a in asked:
        hits = [p for p in PRODUCTS if p == a] or [p for p in PRODUCTS if p.startswith(a)]
        if len(hits) != 1:
            raise ValueError(f"product {a}: {'ambiguous' if hits else 'unknown'}")
        out += hits
    if "theme" in out and len(set(out)) > 1:
        raise ValueError("theme goes with no other product")
    return [p for p in PRODUCTS if p in out]


def run_products(makers: dict[str, Callable[[], DataFrame]], asked: list[str] | None, write: Callable[[str, DataFrame], None]) -> list[str]:
    done = []
    for p in chosen(asked):
        if p in makers:
            write(p, makers[p]())
            done.append(p)
    return done


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")


def as_json(df: DataFrame, columns: list[str] | None = None, name: str = "json") -> DataFrame:
    """SNK3, JS1: rows as JSON with snake-case keys in order; nulls are left out, and so are empty arrays and maps."""
    columns = sorted(columns or df.columns, key=snake)
    kinds = dict(df.dtypes)
    fields = []
    for c in columns:
        v = F.col(c)
        if kinds[c].startswith(("array", "map")):
            v = F.when(F.size(v) > 0, v)
        fields.append(v.alias(snake(c)))
    return df.withColumn(name, F.to_json(F.struct(*fields)))


def stats_json(counters: DataFrame) -> DataFrame:
    """SNK8: all counters as one object, by name."""
    rows = F.array_sort(F.collect_list(F.struct("counter", "n")))
    return counters.agg(F.to_json(F.map_from_entries(rows)).alias("json"))


def search_json(entries: DataFrame) -> DataFrame:
    """SNK11: (language, url, name, abstract, parent_name) as a JSON line per url; a repeated url is an error."""
    twice = entries.groupBy("language", "url").agg(F.count("*").alias("n")).where("n > 1")
    bad = twice.first()
    if bad is not None:
        raise ValueError(f"url {bad['url']} names two search entries")
    return entries.select("language", "url", F.to_json(F.struct("abstract", "name", "parent_name")).alias("json"))


def site_json(modules: DataFrame, version: str) -> DataFrame:
    """SNK12"""
    return modules.agg(F.to_json(F.struct(F.array_sort(F.collect_set("module_name")).alias("modules"), F.lit(version).alias("version"))).alias("json"))


def write_text(df: DataFrame, path: str, column: str = "json") -> None:
    """Text files, in the order of the frame."""
    df.select(column).write.mode("overwrite").text(path)


#: Rows of an index file.
INDEX_ROWS = 100_000


def docset_files(index: DataFrame, module: str, bundle_prefix: str, version: str | None = None, deployment: str | None = None, playground: str | None = None) -> DataFrame:
    """SNK7: (path, ord, line) of a docset's files: the property list, the index (id, name, type, path; a tab between, in
    files of INDEX_ROWS by id, so that it is many tasks' work) and, where it is deployed and has a version, the feed.
    With ``tree_files`` they appear together or not at all."""
    spark, low = index.sparkSession, module.lower()
    key = lambda k, v: [f"<key>{k}</key>", f"<string>{_xml(v)}</string>"] if v else []
    plist = ['<?xml version="1.0" encoding="UTF-8"?>', '<plist version="1.0">', "<dict>", *key("CFBundleIdentifier", f"{bundle_prefix}.{low}"), *key("CFBundleName", module), *key("DocSetPlatformFamily", low),
             "<key>isDashDocset</key>", "<true/>", *key("dashIndexFilePath", "index.html"), "<key>isJavaScriptEnabled</key>", "<true/>", "<key>DashDocSetDefaultFTSEnabled</key>", "<true/>",
             *key("DashDocSetFamily", "dashtoc"), *key("DashDocSetPlayURL", playground), *key("DashDocSetFallbackURL", deployment), "</dict>", "</plist>"]
    feed = ["<entry>", f"<version>{_xml(version)}</version>", f"<url>{_xml(deployment.rstrip('/') + '/docsets/' + module + '.tgz')}</url>", "</entry>"] if version and deployment else []
    top = f"{module}.docset/Contents"
    fixed = [(f"{top}/Info.plist", k, x) for k, x in enumerate(plist)] + [(f"{module}.xml", k, x) for k, x in enumerate(feed)]
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\n\r]", " ")
    rows = index.select(F.concat(F.lit(f"{top}/Resources/searchIndex/"), F.lpad(F.expr(f"id div {INDEX_ROWS}").cast("string"), 8, "0"), F.lit(".tsv")).alias("path"),
                        F.col("id").cast("long").alias("ord"), F.concat_ws("\t", *map(clean, ("id", "name", "type", "path"))).alias("line"))
    return spark.createDataFrame(fixed, "path string, ord long, line string").unionByName(rows)


def _xml(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
