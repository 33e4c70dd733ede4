"""URL filters with built-in functions only: host and path rules, and decisions shared by redirect equivalence.

An address (host and path, whatever the scheme, query and fragment) has aliases: those that canonical links and refresh
redirects in the html name, seen from either end. Links are edges between addresses, and their connected components are
found in a distributed way. Spelling (www. or m. before the host, a slash or .html at the end) makes no alias unless it
is asked for. A component with an explicitly allowed member lets its unruled members pass; otherwise one
with a blocked member blocks them. A page's own rule always comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborql.llm.common import connected_components

#: Fixed values: (verdict, host, path); a rule holds for the host and its subdomains.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.get(F.split(url, "://", 2), F.lit(1)))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule; ties cannot be, as equal rules are one rule."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_key(host: Column, path: Column, spelling: bool = False) -> Column:
    """The key of an address, or with ``spelling`` one key for its spellings; null without a host."""
    if not spelling:
        return F.when(host != "", F.concat(host, F.lit("|"), path))
    h = F.regexp_replace(host, r"^(?:www\.|m\.)+(?=[^.]+\.)", "")
    p = F.regexp_replace(path, r"(?:/|\.html?|/index\.html?)$", "")
    return F.when(host != "", F.concat(h, F.lit("|"), p))


def without_dots(path: Column) -> Column:
    """A path from the root with its . and .. segments worked off."""
    parts = F.slice(F.split(path, "/", -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split(path, "/", -1)) - 1))
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(x == "..", up).when(x == ".", acc).otherwise(F.array_append(acc, x))

    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, none, step), ended), "/"))


def resolved(u: Column, url: Column) -> Column:
    """The absolute URL that u means on the page of ``url``; null for other schemes and on pages without a host.
    Queries and fragments of relative ones are left out, as addresses have none."""
    host, path = host_path(url)
    scheme = F.substring_index(url, "://", 1)
    ref = F.regexp_extract(u, r"^[^?#]*", 0)
    folder = F.when(path.startswith("/"), F.regexp_extract(path, r"(?s)^.*/", 0)).otherwise(F.lit("/"))
    there = F.when(ref == "", path).when(ref.startswith("/"), without_dots(ref)).otherwise(without_dots(F.concat(folder, ref)))
    local = F.when(host != "", F.concat(scheme, F.lit("://"), host, there))
    return (
        F.when(u.rlike(r"^[^/?#]*://"), u)
        .when(u.startswith("//"), F.when(host != "", F.concat(scheme, F.lit(":"), u)))
        .when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(local)
    )


#: Character references that URLs in attributes are written with; the ampersand's own comes last.
REFERENCES = {r"&(?:quot|#34|#x22);": '"', r"&(?:apos|#39|#x27);": "'", r"&(?:sol|#47|#x2f);": "/", r"&(?:colon|#58|#x3a);": ":", r"&(?:quest|#63|#x3f);": "?",
              r"&(?:num|#35|#x23);": "#", r"&(?:period|#46|#x2e);": ".", r"&(?:equals|#61|#x3d);": "=", r"&(?:amp|#38|#x26);": "&"}


def decoded(u: Column) -> Column:
    for p, c in REFERENCES.items():
        u = F.regexp_replace(u, f"(?i){p}", c)
    return u


#: Elements whose content is text, whatever it looks like.
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
#: One token of html after another: a comment (also the kinds that end at the first >), an element of text with its
#: content, or a tag (unclosed ones go to the end and name nothing). What is in comments, in text elements and in quoted values is so no tag of its own.
TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(?:[!?]|/[^a-z])[^>]*+>?"
    + rf"|<({RAW})(?=[\s/>])(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+>.*?(?:</\1(?=[\s/>])|\z)"
    + r"|<[a-z](?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+>?"
)
#: An attribute with a value: its name, and the value in double quotes, in single quotes, or bare.
ATTRIBUTE = r"(?s)(?<=[\s\"'/])([^\s=>\"'/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))"


def attributes(tag: Column) -> Column:
    """array of struct<name, value>, names in lower case, in order; the first of a name is the one that counts."""
    at = lambda k: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(k))
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y))
    return F.zip_with(at(1), both(both(at(2), at(3)), at(4)), lambda n, v: F.struct(F.lower(n).alias("name"), v.alias("value")))


def value_of(attrs: Column, name: str) -> Column:
    return F.coalesce(F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"], F.lit(""))


def named(attrs: Column) -> Column:
    """The address that a link or meta tag of these attributes names, or an empty string."""
    rel = F.split(F.lower(value_of(attrs, "rel")), r"\s+")
    refresh = F.lower(F.btrim(value_of(attrs, "http-equiv"))) == "refresh"
    to = F.regexp_extract(value_of(attrs, "content"), r"(?is)(?:^|[\s;,])url\s*=\s*[\"']?([^\"'\s]+)", 1)
    return F.when(F.array_contains(rel, "canonical"), F.btrim(value_of(attrs, "href"))).when(refresh, to).otherwise("")


def link_targets(html: Column, url: Column) -> Column:
    """array of absolute URLs that canonical links and refresh redirects of the page at ``url`` name."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(r"(?is)^<(?:link|meta)[\s/].*>\z"))
    urls = F.transform(F.transform(tags, attributes), named)
    to = F.transform(F.filter(urls, lambda u: u != ""), lambda u: resolved(decoded(u), url))
    return F.when(html.rlike(r"(?i)canonical|http-equiv"), F.filter(to, lambda u: u.isNotNull())).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, tables, rules=RULES, spelling: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict for every row. Every address of the graph is judged by the rules, whether or not
    it is a page's own: a link to a blocked address that is no row blocks as one to a row does. Null urls and urls
    without :// have empty host and path, no rule and pass. Null html has no links. Repeated rows are judged alike; an
    empty table gives an empty result; extra columns are not looked at."""
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    p = p.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"),
                 alias_key(F.col("host"), F.col("path"), spelling).alias("key"), F.coalesce(link_targets(F.col("html"), F.col("url")), F.array().cast("array<string>")).alias("to"))
    p = tables.write(p)
    th, tp = host_path(F.col("u"))
    links = p.where((F.size("to") > 0) & F.col("key").isNotNull()).select("key", "r", F.explode("to").alias("u")).select("key", "r", th.alias("h"), tp.alias("p"))
    links = links.select("key", F.col("r.verdict").alias("own"), alias_key(F.col("h"), F.col("p"), spelling).alias("other"), rule_of(F.col("h"), F.col("p"), rules)["verdict"].alias("there"))
    links = tables.write(links.where("other is not null").distinct())
    # an address of the graph, or with spelling several that share a key, and what the rules say of it
    said = links.select(F.explode(F.array(F.struct("key", F.col("own").alias("verdict")), F.struct(F.col("other").alias("key"), F.col("there").alias("verdict")))).alias("a"))
    if spelling:  # an address decides for its other spellings without a link, too
        said = said.unionByName(p.where("key is not null and r is not null").select(F.struct("key", F.col("r.verdict").alias("verdict")).alias("a")))
    names = said.groupBy("a.key").agg(F.bool_or(F.col("a.verdict") == "allow").alias("allowed"), F.bool_or(F.col("a.verdict") == "block").alias("blocked"))
    names = tables.write(names.withColumn("node", F.monotonically_increasing_id()))
    edges = links.where("key <> other").select("key", "other").distinct()
    ends = edges.join(names.select("key", F.col("node").alias("a")), "key").join(names.select(F.col("key").alias("other"), F.col("node").alias("b")), "other")
    found = connected_components(ends.select("a", "b"), tables)
    of = tables.write(names.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    votes = of.groupBy("component").agg(F.bool_or("allowed").alias("allowed"), F.bool_or("blocked").alias("blocked"))
    shared = of.select("key", "component").join(votes, "component").select("key", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("shared"))
    j = p.join(shared, "key", "left")
    return j.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.col("shared"), F.lit("allow")).alias("verdict"))
