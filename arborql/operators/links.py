"""Names and links: indexes, ordered lookups, candidates in texts, URLs, search.

Resolution never walks scopes row by row: every candidate of a reference is a row with a priority, one equi-join
finds which exist, and the least priority wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborql.functions.text import html_escaped, link_name, objc_key, re_matches, slugged
from arborql.operators.ordered import first_wins, last_wins, numbered


def elided(name: Column) -> Column:
    """'f(a:b:)' and 'f()' as 'f(...)'; null for names without parentheses."""
    return F.when(F.contains(name, F.lit("(")), F.regexp_replace(name, r"\(.*\)", "(...)"))


def name_index(items: DataFrame, first: bool = False) -> DataFrame:
    """LNK1: (language, key, item_id) of items(item_id, path, language, full_name, module_name): a Swift item's full name,
    the same with its module, and both with arguments elided; an Objective-C item's full name. The last in pre-order wins
    (or the first)."""
    swift = F.array("full_name", F.concat_ws(".", "module_name", "full_name"), elided(F.col("full_name")), F.concat(F.col("module_name"), F.lit("."), elided(F.col("full_name"))))
    keys = F.when(F.col("language") == "objc", F.array("full_name")).otherwise(swift)
    e = items.select("language", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"), "item_id", "path")
    return first_wins(e, ["language", "key"], ["path"], last=not first).drop("path")


def scope_candidates(refs: DataFrame, languages: list[str]) -> DataFrame:
    """JN10: refs(ref_id, name, scopes, context) -> (ref_id, language, key, priority). scopes are the names of the items
    around the one that refers, outermost first (``scopes_<language>`` where names differ), context is its own name, null
    for items that are no definitions.

    The order is that of phases, then languages: the name under each enclosing prefix, from the longest, in every
    language; then the name alone, hierarchical; then the name under the context."""
    none = F.array().cast("array<string>")
    out = None
    for k, lang in enumerate(languages):
        scopes = F.col(f"scopes_{lang}" if f"scopes_{lang}" in refs.columns else "scopes")
        n = F.size(scopes)
        prefixes = F.when((n > 0) & F.col("context").isNotNull(), F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda d: F.concat_ws(".", F.array_join(F.slice(scopes, F.lit(1), d), "."), "name"))).otherwise(none)  # noqa: B023
        at = lambda phase, place: F.struct(F.lit(phase).alias("phase"), F.lit(k).alias("language"), place.alias("place"))  # noqa: E731, B023
        rows = F.concat(
            F.transform(prefixes, lambda x, i: F.struct(x.alias("key"), at(0, i).alias("priority"))),
            F.array(F.struct(objc_key(F.col("name")).alias("key"), at(1, F.lit(0)).alias("priority"))),
            F.array(F.struct(F.concat("context", F.lit("."), "name").alias("key"), at(2, F.lit(0)).alias("priority"))))
        one = refs.select("ref_id", F.lit(lang).alias("language"), F.explode(rows).alias("r")).select("ref_id", "language", "r.key", "r.priority").where("key is not null")
        out = one if out is None else out.unionByName(one)
    return out


def resolve_local(refs: DataFrame, index: DataFrame, languages: list[str]) -> DataFrame:
    """JN10: refs with item_id and language of what they mean, null if nothing, and the priority that it was found at;
    each distinct name and place is looked up once. Without a context column, the innermost scope is the context."""
    if "context" not in refs.columns:
        refs = refs.withColumn("context", F.try_element_at("scopes", F.lit(-1)))
    on = ["name", "context", *[c for c in refs.columns if c.startswith("scopes")]]
    # 128 bits of hash stand for a name and place; nulls leave no trace in a hash, so which are null is hashed too
    seen = [*on, *[F.col(c).isNull() for c in on]]
    key = F.struct(F.xxhash64(*seen).alias("k1"), F.xxhash64(F.lit("second"), *seen).alias("k2"))
    d = refs.select(*on).distinct().withColumn("ref_id", key)
    hit = scope_candidates(d, languages).join(index, ["language", "key"])
    hit = hit.groupBy("ref_id").agg(F.min_by(F.struct("item_id", "language"), "priority").alias("h"), F.min("priority").alias("priority"))
    found = d.join(hit, "ref_id").select("ref_id", "h.item_id", "h.language", "priority").withColumnRenamed("ref_id", "__k")
    return refs.withColumn("__k", key).join(found, "__k", "left").drop("__k")


#: Names that are never reported as unresolved.
COMMON_UNLINKED = ["true", "false", "nil", "self", "Self", "YES", "NO"]


def autolink(refs: DataFrame, index: DataFrame, remote: DataFrame, builtin: DataFrame, languages: list[str]) -> DataFrame:
    """LNK2: refs(ref_id, name, scopes, context, context_id, generic_params) with ``outcome`` and what it found: rejected,
    self, local (item_id, language), remote or builtin (url), or unresolved. Each step sees only what earlier ones left.
    ``report`` marks the unresolved names that are worth a report: not the context's own, nor common words."""
    r = refs.withColumns({"search": link_name(F.col("name")), "__no": rejected(F.col("name"), F.coalesce("generic_params", F.array().cast("array<string>")))})
    local = resolve_local(r.where(~F.col("__no")).select("ref_id", F.col("search").alias("name"), *[c for c in refs.columns if c.startswith("scopes")], "context"), index, languages)
    r = r.join(local.select("ref_id", "item_id", "language"), "ref_id", "left")
    rest = r.where(~F.col("__no") & F.col("item_id").isNull()).select("ref_id", F.col("search").alias("name"))
    far = resolve_remote(rest, remote).select("ref_id", F.col("url").alias("remote_url"))
    near = resolve_builtin(rest.join(far, "ref_id", "left_anti"), builtin).select("ref_id", F.col("url").alias("builtin_url"))
    r = r.join(far, "ref_id", "left").join(near, "ref_id", "left")
    own = F.col("item_id").eqNullSafe(F.col("context_id")) & F.col("item_id").isNotNull()
    outcome = (F.when(F.col("__no"), "rejected").when(own, "self").when(F.col("item_id").isNotNull(), "local").when(F.col("remote_url").isNotNull(), "remote")
               .when(F.col("builtin_url").isNotNull(), "builtin").otherwise("unresolved"))
    report = (outcome.isin("unresolved", "self")) & ~F.col("search").eqNullSafe(F.col("context")) & ~F.col("search").isin(COMMON_UNLINKED)
    return r.select("ref_id", "name", "search", outcome.alias("outcome"), F.when(~own, F.col("item_id")).alias("item_id"), F.when(~own, F.col("language")).alias("language"),
                    F.coalesce("remote_url", "builtin_url").alias("url"), report.alias("report"))


def rejected(name: Column, generic_params: Column) -> Column:
    """LNK2: names that are no references: generic parameters, implicit members, mathematics."""
    return F.array_contains(generic_params, name) | name.startswith(".") | name.rlike(r"^\$.*\$$")


def shadowed(refs: DataFrame, params: DataFrame) -> DataFrame:
    """JN17: refs(name, path) without those whose name is a generic parameter of their item or of one around it."""
    asks = refs.select("ref_id", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("at"))
    bad = asks.join(params.select(F.col("path").alias("at"), "name"), ["at", "name"], "left_semi").select("ref_id").distinct()
    return refs.join(bad, "ref_id", "left_anti")


def resolve_remote(refs: DataFrame, remote: DataFrame) -> DataFrame:
    """JN11: refs(ref_id, name): over sources in order, bare name first, then 'Module.rest'. remote(source_ord,
    module_name, key, url)."""
    at = lambda phase: F.struct(F.lit(phase).alias("phase"), F.col("source_ord").alias("ord")).alias("priority")
    bare = refs.join(remote, F.col("name") == F.col("key")).select("ref_id", "url", at(0))
    cut = refs.where(F.contains("name", F.lit("."))).select("ref_id", F.substring_index("name", ".", 1).alias("m"), F.expr("substring(name, instr(name, '.') + 1)").alias("rest"))
    full = cut.join(remote, (F.col("m") == F.col("module_name")) & (F.col("rest") == F.col("key"))).select("ref_id", "url", at(1))
    return bare.unionByName(full).groupBy("ref_id").agg(F.min_by("url", "priority").alias("url"))


def resolve_builtin(refs: DataFrame, db: DataFrame) -> DataFrame:
    """JN12: refs(ref_id, name) in db(module_name, name, url): not for a lower-case initial; with a module, only
    there; else Swift, ObjectiveC, then the rest by name."""
    r = refs.where(~F.col("name").rlike(r"(?U)^\p{Ll}"))
    d = db.withColumn("p", F.struct(F.when(F.col("module_name") == "Swift", 0).when(F.col("module_name") == "ObjectiveC", 1).otherwise(2).alias("k"), F.col("module_name").alias("m")))
    bare = r.join(d.withColumnRenamed("name", "key"), F.col("name") == F.col("key")).select("ref_id", "url", "p")
    cut = r.select("ref_id", F.substring_index("name", ".", 1).alias("module_name"), F.expr("substring(name, instr(name, '.') + 1)").alias("name"))
    full = cut.join(d, ["module_name", "name"]).select("ref_id", "url", F.struct(F.lit(-1).alias("k"), F.col("module_name").alias("m")).alias("p"))
    return bare.unionByName(full).groupBy("ref_id").agg(F.min_by("url", "p").alias("url"))


def search_parents(entries: DataFrame, tables) -> DataFrame:
    """JN13: search entries(url, name, parent_name) that find their parent, with parent_url (null for roots) and their
    place in the order of finding.

    Parents are found by short name. Entries are gone over by url, again and again; a name stands for the last root that
    has it, else for the first entry found. So an entry is found in the pass of its parent's name if that comes before it
    by url, else in the next, and places are the least solution of that rule: they only fall, until none changes."""
    e = tables.write(entries.where(~F.col("url").rlike(r"(?i)(^|/)extensions(/|$)")))
    place = lambda p, u: F.struct(p.cast("long").alias("pass"), u.alias("url"))
    roots = last_wins(e.where("parent_name is null").select("name", "url"), ["name"], ["url"])
    roots = roots.select("name", F.col("url").alias("at_url"), place(F.lit(1), F.lit("")).alias("place"))
    rest = tables.write(e.where("parent_name is not null").join(roots.select("name", F.lit(True).alias("is_root")), "name", "left"))
    names = tables.write(roots)

    def found(names: DataFrame) -> DataFrame:
        up = names.select(F.col("name").alias("parent_name"), F.col("at_url").alias("parent_url"), F.col("place").alias("__p"))
        behind = F.when(F.col("__p.url") < F.col("url"), 0).otherwise(1)
        return rest.join(up, "parent_name").select("url", "name", "parent_url", "is_root", place(F.col("__p.pass") + behind, F.col("url")).alias("place"))

    changed = names
    while True:  # only what fell in the last round can let others fall
        new = found(changed).where("is_root is null").groupBy("name").agg(F.min("place").alias("place")).select("name", F.col("place.url").alias("at_url"), "place")
        better = tables.write(new.join(names.select("name", F.col("place").alias("__old")), "name", "left").where("__old is null or place < __old").drop("__old"))
        if better.isEmpty():
            break
        names = tables.write(names.join(better.select("name"), "name", "left_anti").unionByName(better))
        changed = better
    first = roots.select(F.col("at_url").alias("url"), "name", F.lit(None).cast("string").alias("parent_url"), "place")
    return tables.write(first.unionByName(found(names).drop("is_root")))


def parent_fixpoint(entries: DataFrame, tables) -> DataFrame:
    """JN13: search entries(url, name, parent_name) to full names (full_name, url, name), one a level by one equi-join. Of
    a parent's children of one name the last found wins; callables go by an elided name too, in the same order."""
    e = search_parents(entries, tables)
    names = F.explode(F.array_distinct(F.array_compact(F.array("name", elided(F.col("name"))))))
    kids = e.where("parent_url is not null").select("parent_url", names.alias("name"), "url", "place")
    kids = tables.write(last_wins(kids, ["parent_url", "name"], ["place"]).drop("place"))
    level = tables.write(e.where("parent_url is null").select(F.col("name").alias("full_name"), "url", "name"))
    done = [level]
    while True:  # a child is found after its parent, so levels end
        up = level.select(F.col("url").alias("parent_url"), "full_name")
        level = tables.write(kids.join(up, "parent_url").select(F.concat_ws(".", "full_name", "name").alias("full_name"), "url", "name"))
        if level.isEmpty():
            break
        done.append(level)
        if len(done) == 50:
            done = [tables.write(reduce(DataFrame.unionByName, done))]
    return first_wins(reduce(DataFrame.unionByName, done), ["full_name"], ["url"])


def docc_key(name: Column) -> Column:
    """JN14: the folded key of a name in a remote DocC index."""
    return F.lower(F.replace(name, F.lit("."), F.lit("/")))


def link_targets(links: DataFrame, media: DataFrame, guides: DataFrame) -> DataFrame:
    """JN16: links(link_id, basename): a medium of the name, else a guide, else the readme, else null."""
    m = media.select("basename", F.col("url").alias("media_url"))
    g = guides.select("basename", F.col("url").alias("guide_url"))
    j = links.join(m, "basename", "left").join(g, "basename", "left")
    readme = F.when(F.lower("basename").isin("readme", "readme.md"), F.lit("index.html"))
    return j.withColumn("target", F.coalesce("media_url", "guide_url", readme)).drop("media_url", "guide_url")


def code_spans(markdown: Column) -> Column:
    """LNK4: the contents of code spans, as normalized names, in order."""
    return F.transform(re_matches(markdown, r"(?<!`)`([^`\n]+)`(?!`)", 1), link_name)


def type_names(declaration: Column) -> Column:
    """LNK5: capitalized identifiers of a declaration."""
    return re_matches(declaration, r"(?U)(?:\b|@)\p{Lu}[\w.]*")


def headings(markdown: Column, deepest: int = 2) -> Column:
    """LNK8: array<struct<level, title, anchor>> of headings above a level, in order."""
    h = re_matches(markdown, rf"(?m)^(#{{1,{deepest}}}\s+.*)$", 1)
    return F.transform(h, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#+)", 1)).alias("level"), F.regexp_extract(x, r"^#+\s+(.*?)\s*#*$", 1).alias("title"),
                                             slugged(F.regexp_extract(x, r"^#+\s+(.*?)\s*#*$", 1)).alias("anchor")))


def plain_text(markdown: Column) -> Column:
    """LNK9: markdown without its marks, as search results show it."""
    for p, r in ((r"(?s)```.*?```", " "), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`([^`]*)`", "$1"),
                 (r"(\*\*|__)(.+?)\1", "$2"), (r"(?<!\w)[*_](.+?)[*_](?!\w)", "$1"), (r"(?m)^\s{0,3}(?:#{1,6}|>|[-*+]|\d+\.)\s+", ""), (r"\s+", " ")):
        markdown = F.regexp_replace(markdown, p, r)
    return F.trim(markdown)


def paragraphs_to_list(markdown: Column) -> Column:
    """LNK17: several paragraphs as a bullet list; one stays."""
    p = F.filter(F.split(markdown, r"\n\s*\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(p) < 2, markdown).otherwise(F.array_join(F.transform(p, lambda x: F.concat(F.lit("- "), F.trim(x))), "\n"))


def rendered_link(text: Column, url: Column) -> Column:
    """LNK3"""
    return F.when(url.isNull(), F.concat(F.lit("<code>"), text, F.lit("</code>"))).otherwise(F.concat(F.lit('<a href="'), url, F.lit('"><code>'), html_escaped(text), F.lit("</code></a>")))


def dual_link(text: Column, language: Column, urls: Column, names: Column, full_names: Column) -> Column:
    """LNK3: the link to a definition that has two languages (maps from language to url, name and full name): one anchor
    a language, that of the other marked secondary. It shows the other's short name if the written one is short."""
    other = F.when(language == "swift", F.lit("objc")).otherwise(F.lit("swift"))
    shown = F.when(text == F.try_element_at(names, language), F.try_element_at(names, other)).otherwise(F.try_element_at(full_names, other))
    one = lambda lang, style, name: F.concat(F.lit('<a href="'), F.try_element_at(urls, lang), F.lit('" class="j2-'), lang, F.lit(style + '"><code>'), html_escaped(name), F.lit("</code></a>"))
    single = F.concat(F.lit('<a href="'), F.try_element_at(urls, language), F.lit('"><code>'), html_escaped(text), F.lit("</code></a>"))
    return F.when(F.try_element_at(urls, other).isNull(), single).otherwise(F.concat(one(language, "", text), one(other, " j2-secondary", shown)))


def fixed_up(html: Column, placeholder: str, path_to_root: Column) -> Column:
    """LNK6: placeholders of a page's links as its own way to the root."""
    return F.replace(html, F.lit(placeholder), path_to_root)


def path_to_root(url_path: Column) -> Column:
    """PRJ24: '../' for every directory that a page is in."""
    return F.repeat(F.lit("../"), F.length(url_path) - F.length(F.replace(url_path, F.lit("/"), F.lit(""))))


def search_entries(items: DataFrame) -> DataFrame:
    """LNK11: (url, name, abstract, parent_name) of items with swift_name, objc_name: one for each, if they differ."""
    e = items.select("url", "abstract", F.when(F.col("parent_is_def"), F.col("parent_name")).alias("parent_name"), F.explode(F.array_distinct(F.array_compact(F.array("swift_name", "objc_name")))).alias("name"))
    return e.select("url", "name", F.when(F.col("abstract") != "", F.col("abstract")).alias("abstract"), "parent_name")


def search(docs: DataFrame, terms: list[str], id_col: str, fields: list[str], top: int = 10) -> DataFrame:
    """OR10: the first ``top`` by score: 100 for each field holding a term as a word, 10 for each holding a word that
    begins with it. A top-k is the feature; it merges per-partition heaps."""
    score = F.lit(0)
    for f in fields:
        words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"(?U)[^\w]+"))
        for t in terms:
            score = score + F.when(F.array_contains(words, t), 100).otherwise(0) + F.when(F.exists(words, _starts(t)), 10).otherwise(0)
    return docs.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), id_col).limit(top)


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """OR10: (term, field, id) of every word, in ranges of terms: written, it is an index that searches read a few row groups
    of, by filters on term that reach the scan."""
    words = lambda f: F.array_distinct(F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"(?U)[^\w]+"))
    rows = F.explode(F.flatten(F.array(*[F.transform(words(f), lambda w: F.struct(w.alias("term"), F.lit(k).alias("field"))) for k, f in enumerate(fields)])))
    p = docs.select(F.col(id_col).alias("id"), rows.alias("r")).select("r.term", "r.field", "id").where("term <> ''")
    return p.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "term", "id").sortWithinPartitions("term", "id")


def search_postings(index: DataFrame, terms: list[str], top: int = 10) -> DataFrame:
    """OR10: the scores of ``search`` from an index: 100 for a field holding a term, 10 for one holding a word that begins
    with it, each counted once; the first ``top`` ids by score. What is read and shuffled is the terms' postings."""
    hits = None
    for k, t in enumerate(terms):
        one = index.where(F.startswith(F.col("term"), F.lit(t))).select("id", "field", F.lit(k).alias("k"), (F.col("term") == t).alias("whole"))
        hits = one if hits is None else hits.unionByName(one)
    score = hits.groupBy("id", "field", "k").agg(F.max(F.when(F.col("whole"), 100).otherwise(0)).alias("s")).groupBy("id").agg(F.sum(F.col("s") + 10).alias("score"))
    return score.orderBy(F.desc("score"), "id").limit(top)


def _starts(term: str):
    return lambda w: F.startswith(w, F.lit(term))


def docset_index(entries: DataFrame, tables=None) -> DataFrame:
    """SNK7: the first row of each (name, type, path), numbered in order."""
    return numbered(first_wins(entries, ["name", "type", "path"], ["ord"]), ["ord"], "id", tables)
