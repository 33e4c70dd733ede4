"""Pages: URLs, linear order, breadcrumbs, topics, tables of contents, languages."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.functions.text import slugged, url_path_encoded
from arborql.model import ITEM_KIND_NAMES
from arborql.operators.ordered import islands, neighbours, unique_names
from arborql.operators.filters import toc_visible
from arborql.operators.tree import with_ancestors


def embedded(style: str, has_children: Column, show_in_toc: Column) -> Column:
    """LNK10: whether an item has no page of its own."""
    if style == "nested":
        return ~has_children
    if style == "nested_separate_types":
        return ~has_children & (show_in_toc == "yes")
    return F.lit(False)


def urls(items: DataFrame, tables, style: str = "nested", multi_module: bool = False) -> DataFrame:
    """LNK10: url_path and url_hash of items(path, item_type, name, meta_kind, module_name, show_in_toc). A nested
    item's URL is made of its parent's, so levels are done in turn, each by one equi-join."""
    kids = items.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct().withColumn("has_children", F.lit(True))
    it = items.join(kids, "path", "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))
    slug = unique_names(slugged(F.col("name")), ["__scope"], ["path"])
    it = it.withColumn("__scope", F.slice("path", F.lit(1), F.size("path") - 1)).withColumn("slug", slug).drop("__scope")
    it = tables.write(it.withColumn("embed", (F.col("item_type") == "def") & embedded(style, F.col("has_children"), F.col("show_in_toc"))))
    kind_names = F.create_map(*[x for k, v in ITEM_KIND_NAMES.items() for x in (F.lit(k), slugged(F.lit(v)))])
    top = F.concat_ws("/", F.when(F.lit(multi_module), slugged(F.col("module_name"))), kind_names[F.col("meta_kind")], "slug")
    page = lambda stem: F.concat(url_path_encoded(stem), F.lit(".html"))
    done, level = None, None
    for d in count(1):
        own = it.where(F.size("path") == d)
        if level is None:
            stem = F.when(F.col("item_type") == "guide", F.concat(F.lit("guides/"), "slug")).when(F.col("item_type") == "readme", F.lit("index")).otherwise(F.col("slug"))
            now = own.withColumns({"stem": stem, "page_stem": stem, "url_hash": F.lit(None).cast("string")})
        else:
            up = level.select(F.col("path").alias("__up"), F.col("page_stem").alias("__stem"), F.col("item_type").alias("__type"))
            j = own.join(up, F.slice("path", 1, d - 1) == F.col("__up"))
            stem = F.when(F.col("item_type") == "group", F.col("slug")).when(F.col("__type") == "group", top).otherwise(F.concat_ws("/", "__stem", "slug"))
            now = j.withColumns({"stem": stem, "page_stem": F.when(F.col("embed"), F.col("__stem")).otherwise(stem), "url_hash": F.when(F.col("embed"), F.concat(F.lit("/"), F.col("slug")))}).drop("__up", "__stem", "__type")
        level = tables.write(now)
        if level.isEmpty():
            break
        done = level if done is None else done.unionByName(level)
        if d % 50 == 0:
            done = tables.write(done)
    return done.withColumn("url_path", page(F.col("page_stem"))).drop("stem")


def linear(pages: DataFrame, group: str | None = None, tables=None) -> DataFrame:
    """WIN3: prev_url and next_url over rows with render_as_page in path order; the readme closes the ring: its next
    is the first page and its previous the last. ``group`` bounds the order to one corpus, site or module; without
    it the order goes over ranges of the whole table, so that a window never holds everything."""
    base = pages.where("render_as_page")
    part = [group or "__all"]
    base = base if group else base.withColumn("__all", F.lit(0))
    body = base.where("item_type <> 'readme'")
    w = W.partitionBy(*part).orderBy("path")
    out = body.withColumns({"prev_url": F.lag("url_path").over(w), "next_url": F.lead("url_path").over(w)}) if group else neighbours(body, ["path"], "url_path", "prev_url", "next_url", tables)
    ends = body.groupBy(*part).agg(F.min_by("url_path", "path").alias("next_url"), F.max_by("url_path", "path").alias("prev_url"))
    readme = base.where("item_type = 'readme'")
    return out.unionByName(readme.join(ends, part, "left")).drop("__all")


def breadcrumbs(items: DataFrame, title: str = "name") -> DataFrame:
    """LNK12: titles from the root to the item itself."""
    return with_ancestors(items, title, "breadcrumbs")


def page_topics(items: DataFrame) -> DataFrame:
    """WIN5: runs of one topic among a page's items: (parent, island, topic_id, title, anchor, n)."""
    r = islands(items, ["topic_id"], ["parent"], ["ord"])
    g = r.groupBy("parent", "island").agg(F.min("topic_id").alias("topic_id"), F.min_by("topic_title", "ord").alias("title"), F.count("*").alias("n"))
    return g.withColumn("anchor", unique_names(F.concat(F.lit("tpc-"), slugged("title")), ["parent"], ["island"]))


def solo(value: Column) -> Column:
    """AGG13: the one value of a group; null if any is null or two differ."""
    return F.when((F.min(value) == F.max(value)) & (F.count("*") == F.count(value)), F.min(value))


def languages(items: DataFrame, default: str = "swift") -> DataFrame:
    """AGG12: the languages in use, by name; the default if there are none."""
    d = items.select(F.explode(F.array_compact(F.array("primary_language", "secondary_language"))).alias("language")).distinct()
    none = d.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(default).alias("language"))
    return d.unionByName(none).orderBy("language")


def page_languages(pages: DataFrame, tags: list[str]) -> DataFrame:
    """LNK15: every page in every language: an explode of a bounded list, not a join."""
    return pages.withColumn("language", F.explode(F.array(*map(F.lit, tags))))


def with_globals(pages: DataFrame, values: dict[str, str]) -> DataFrame:
    """SNK5: page values (a map) over global ones; the page's win."""
    own = F.coalesce("page_values", F.create_map().cast("map<string,string>"))
    common = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return pages.withColumn("page_values", F.map_concat(F.map_filter(common, lambda k, _: ~F.map_contains_key(own, k)), own))


def toc(items: DataFrame, language: str) -> DataFrame:
    """LNK13, FLT13: the visible rows of a language's contents: by show_in_toc and depth; groups only with a child."""
    shown = toc_visible(F.col("show_in_toc"), F.size("path") - 1)
    rows = items.where((F.col("item_type") == "group") | (shown & (F.col("primary_language").eqNullSafe(F.lit(language)) | F.col("secondary_language").eqNullSafe(F.lit(language)) | F.col("primary_language").isNull())))
    ups = rows.where("item_type <> 'group'").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("path")).distinct()
    return rows.join(ups, "path", "left_semi")


def code_host_url(prefix: Column, file: Column, source_dir: Column, first: Column, last: Column, style: str = "github") -> Column:
    """PRJ23: a file's place at a code host; null unless the file is under the source directory."""
    root = F.when(source_dir.endswith("/"), source_dir).otherwise(F.concat(source_dir, F.lit("/")))
    tail = url_path_encoded(F.substring(file, F.length(root) + 1, F.length(file)))
    n = lambda c: c.cast("string")
    one = {"github": F.concat(F.lit("#L"), n(first)), "gitlab": F.concat(F.lit("#L"), n(first)), "bitbucket": F.concat(F.lit("#lines-"), n(first))}[style]
    two = {"github": F.concat(F.lit("#L"), n(first), F.lit("-L"), n(last)), "gitlab": F.concat(F.lit("#L"), n(first), F.lit("-"), n(last)), "bitbucket": F.concat(F.lit("#lines-"), n(first), F.lit(":"), n(last))}[style]
    line = F.when(first.isNull(), F.lit("")).when(last.isNull() | (first == last), one).otherwise(two)
    return F.when(F.startswith(file, root), F.concat(prefix, F.lit("/"), tail, line))


def assemble(items: DataFrame, tables=None) -> DataFrame:
    """LNK14: a row per page of items(path, item_type, name, url_path, url_hash, topic_id, topic_title, abstract): title,
    breadcrumbs, previous and next page, and topics as array<struct<title, anchor, items>>. What a page shows is
    bounded by what its parent item holds."""
    kids = items.where(F.size("path") > 1).select(F.slice("path", F.lit(1), F.size("path") - 1).alias("parent"), F.element_at("path", -1).alias("ord"), "name", "url_path", "url_hash", "topic_id", "topic_title")
    runs = islands(kids, ["topic_id"], ["parent"], ["ord"])
    shown = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "url_path", "url_hash"))), lambda x: F.struct(x["name"].alias("name"), x["url_path"].alias("url_path"), x["url_hash"].alias("url_hash")))
    t = runs.groupBy("parent", "island").agg(F.min_by("topic_title", "ord").alias("title"), shown.alias("items"))
    t = t.withColumn("anchor", unique_names(F.concat(F.lit("tpc-"), slugged(F.coalesce("title", F.lit("")))), ["parent"], ["island"]))
    t = t.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("island", "title", "anchor", "items"))), lambda x: F.struct(x["title"].alias("title"), x["anchor"].alias("anchor"), x["items"].alias("items"))).alias("topics"))
    own = breadcrumbs(items).where("url_hash is null").withColumn("render_as_page", F.lit(True))
    p = linear(own, tables=tables).join(t.withColumnRenamed("parent", "path"), "path", "left")
    return p.select("path", "item_type", F.col("name").alias("title"), "url_path", "abstract", "breadcrumbs", "prev_url", "next_url", "topics")


def page_dictionaries(assembled: DataFrame, languages_: list[str], globals_: dict[str, str]) -> DataFrame:
    """SNK4, SNK5, LNK16: the values that a page template or docs-json gets, a JSON text per page and language: the
    page's over the global ones."""
    common = [F.lit(v).alias(k) for k, v in sorted(globals_.items()) if k not in assembled.columns and k != "language"]
    p = page_languages(assembled, languages_)
    return p.withColumn("json", F.to_json(F.struct(*common, "language", "title", "url_path", "abstract", "breadcrumbs", "prev_url", "next_url", "topics"))).select("path", "language", "url_path", "json")


def menu(groups: DataFrame) -> DataFrame:
    """LNK16: the legacy menu: a title and links per group, in order. groups(group_title, group_rank, name, url_path)."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("name", "url_path"))), lambda x: F.struct(x["name"].alias("name"), x["url_path"].alias("url")))
    return groups.groupBy("group_rank", "group_title").agg(rows.alias("children")).orderBy("group_rank")
