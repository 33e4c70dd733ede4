"""Queries over the driver's tables, each an operator of the library at work, with the DuckDB SQL that gives the same
rows. Stand-ins: documents are definitions with copies, labels tell what is documented, region > nation > customer >
orders is a hierarchy, pages have links and paths, part names collide."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.functions import maps
from arborql.functions import text as X
from arborql.operators import filters, graph, group, links, merge, ordered, pages, stats, tree
from arborql.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all tasks by key. A table of some MB comes in one or a few splits; what costs much for each row would
    run in as few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4: the first document of each text. The text's hash pair is the key, so texts don't pass a shuffle."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    return d.groupBy("k1", "k2").agg(F.min_by(F.struct("doc_id", "lang", "source"), "doc_id").alias("r")).select("r.*")


_FIRST = "f AS (SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1)"


@query(f"""WITH {_FIRST}, c AS (
SELECT lang, count(*) FILTER (l.doc_id IS NOT NULL) AS documented, count(*) FILTER (l.doc_id IS NULL) AS undocumented FROM f LEFT JOIN labels l USING (doc_id) GROUP BY lang)
SELECT lang, documented, undocumented, (100 * documented) // (documented + undocumented) AS coverage FROM c""")
def q01_coverage(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has")).distinct()
    j = first_texts(spark, sf_dir).join(labels, "doc_id", "left")
    return stats.coverage_by(j, ["lang"], F.coalesce("has", F.lit(False)))


@query(f"""WITH {_FIRST}, c AS (
SELECT lang, source, count(*) FILTER (l.doc_id IS NOT NULL) AS documented, count(*) FILTER (l.doc_id IS NULL) AS undocumented FROM f LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (lang, source))
SELECT lang, source, documented, undocumented, (100 * documented) // (documented + undocumented) AS coverage FROM c""")
def q01_coverage_rollup(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has")).distinct()
    j = first_texts(spark, sf_dir).join(labels, "doc_id", "left")
    return stats.coverage_by(j, ["lang", "source"], F.coalesce("has", F.lit(False)), with_rollup=True)


@query("""WITH s AS (SELECT text, source, min(doc_id) AS fst FROM documents GROUP BY ALL), t AS (
SELECT text, string_agg(source, ',' ORDER BY fst) AS sources, min(fst) AS head FROM s GROUP BY text), n AS (SELECT text, count(*) AS copies FROM documents GROUP BY text)
SELECT head, copies, sources FROM t JOIN n USING (text)""")
def q02_merged_copies(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    s = d.groupBy("k1", "k2", "source").agg(F.min("doc_id").alias("at"), F.count("*").alias("n"))
    g = s.groupBy("k1", "k2").agg(F.min("at").alias("head"), F.sum("n").alias("copies"), F.array_sort(F.collect_list(F.struct("at", "source"))).alias("x"))
    return g.select("head", "copies", F.array_join(F.transform("x", lambda r: r["source"]), ",").alias("sources"))


@query("""WITH p AS (SELECT page_id, url FROM pages WHERE url LIKE '%example%' AND url LIKE 'http%' AND url NOT LIKE '%/de/%' AND NOT regexp_matches(url, 'casino|pills'))
SELECT page_id, url FROM p""")
def q03_globs(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    return p.where(~filters.filename_fails(F.col("url"), ["*example*", "http*"], ["*/de/*"]) & ~filters.name_fails(F.col("url"), ["casino|pills"]))


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE
CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE -1 END >= 3""")
def q03_ordered_enum(spark, sf_dir):
    from arborql.model import rank

    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return o.where(rank(F.col("o_orderpriority"), ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"], -1) >= 3)


@query(r"""WITH d AS (SELECT CASE WHEN source = 'src3' THEN 'filterFilename' WHEN regexp_matches(text, '%%%|\$\$\$') THEN 'filterSymbolName'
WHEN contains(text, '!!') THEN 'filterNoDoc' WHEN n_chars < 200 THEN 'filterMinAclExcluded' ELSE 'filterMinAclIncluded' END AS r FROM documents),
k AS (SELECT unnest(['filterFilename','filterSymbolName','filterNoDoc','filterSpi','filterMinAclExcluded','filterMinAclIncluded']) AS counter)
SELECT counter, count(r) AS n FROM k LEFT JOIN d ON r = counter GROUP BY counter""")
def q04_dispositions(spark, sf_dir):
    rules = [("filterFilename", F.col("source") == "src3"), ("filterSymbolName", F.col("text").rlike(r"%%%|\$\$\$")), ("filterNoDoc", F.contains("text", F.lit("!!"))), ("filterMinAclExcluded", F.col("n_chars") < 200)]
    d = read(spark, sf_dir, "documents").select(filters.disposition(rules, "filterMinAclIncluded").alias("r"))
    return filters.counters(d, "r", ["filterFilename", "filterSymbolName", "filterNoDoc", "filterSpi", "filterMinAclExcluded", "filterMinAclIncluded"])


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region > nation > customer > order as (path, name, level)."""
    r, n, c, o = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    i = lambda x: F.col(x).cast("long")
    nc = n.select("n_nationkey", "n_regionkey")
    co = c.select("c_custkey", "c_nationkey").join(nc, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = [
        r.select(F.array(i("r_regionkey")).alias("path"), F.col("r_name").alias("name")),
        n.select(F.array(i("n_regionkey"), i("n_nationkey")).alias("path"), F.col("n_name").alias("name")),
        c.join(nc, F.col("c_nationkey") == F.col("n_nationkey")).select(F.array(i("n_regionkey"), i("n_nationkey"), i("c_custkey")).alias("path"), F.col("c_name").alias("name")),
        o.join(co, F.col("o_custkey") == F.col("c_custkey")).select(F.array(i("n_regionkey"), i("n_nationkey"), i("c_custkey"), i("o_orderkey")).alias("path"), F.col("o_orderkey").cast("string").alias("name")),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


_TREE = """h AS (
SELECT [r_regionkey::BIGINT] AS p, r_name AS name, r_name AS q FROM region
UNION ALL SELECT [n_regionkey, n_nationkey], n_name, r_name || '.' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT [n_regionkey, n_nationkey, c_custkey], c_name, r_name || '.' || n_name || '.' || c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT [n_regionkey, n_nationkey, c_custkey, o_orderkey], o_orderkey::VARCHAR, r_name || '.' || n_name || '.' || c_name || '.' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


@query(f"WITH {_TREE} SELECT array_to_string(p, '/') AS path, len(p) AS depth, q AS qualified FROM h WHERE NOT (len(p) >= 2 AND p[2] IN (3, 7)) AND NOT p[1] = 4")
def q05_qualified_names(spark, sf_dir):
    h = hierarchy(spark, sf_dir)
    bad = ((F.size("path") == 2) & F.get("path", F.lit(1)).isin(3, 7)) | ((F.size("path") == 1) & (F.get("path", F.lit(0)) == 4))
    h = tree.with_ancestors(tree.prune(h, bad), "name", "names")
    return h.select(F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.size("path").cast("long").alias("depth"), F.array_join("names", ".").alias("qualified"))


@query("""WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 350000), c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (FROM o)),
n AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)), r AS (SELECT r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))
SELECT 1 AS depth, count(*) AS n FROM r UNION ALL SELECT 2, count(*) FROM n UNION ALL SELECT 3, count(*) FROM c UNION ALL SELECT 4, count(*) FROM orders WHERE o_totalprice > 350000""")
def q06_childless(spark, sf_dir):
    h = hierarchy(spark, sf_dir)
    dear = read(spark, sf_dir, "orders").where("o_totalprice > 350000").select(F.col("o_orderkey").cast("long").alias("k"))
    h = h.where(F.size("path") < 4).unionByName(h.where(F.size("path") == 4).join(dear, F.get("path", F.lit(3)) == F.col("k"), "left_semi"))
    left = tree.prune_childless(h, F.size("path") < 4, Tables(spark))
    return left.groupBy(F.size("path").alias("depth")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT p_name, min(p_partkey) AS claimant FROM part WHERE p_size <= 10 GROUP BY p_name), e AS (SELECT p_partkey, p_name FROM part WHERE p_size > 40)
SELECT p_partkey, e.p_name AS name, claimant, CASE WHEN claimant IS NULL THEN min(p_partkey) OVER (PARTITION BY e.p_name, claimant) END AS leftover_head FROM e LEFT JOIN t ON t.p_name = e.p_name""")
def q07_claims(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    types = p.where("p_size <= 10").select(F.col("p_name").alias("usr"), F.col("p_partkey").alias("path"), F.lit(False).alias("in_extension"))
    ext = p.where("p_size > 40").select(F.col("p_name").alias("type_usr"), F.col("p_partkey").alias("path"))
    return merge.claim_extensions(types, ext).select(F.col("path").alias("p_partkey"), F.col("type_usr").alias("name"), "claimant", "leftover_head")


_HOST, _LANG = "regexp_extract(url, '://([^/?#]*)', 1)", "regexp_extract(url, '://[^/]*/([a-z]+)/', 1)"


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, {_LANG} AS lang, lower(regexp_extract(html, '<h1>(\\S+)', 1)) AS key, html FROM pages),
r AS (SELECT DISTINCT page_id, host, lang, key, lower(unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1))) AS name FROM p),
k AS (SELECT name, max(page_id) AS target FROM (SELECT host || '.' || lang || '.' || key AS name, page_id FROM p UNION ALL SELECT host || '.' || key, page_id FROM p WHERE lang = 'en' UNION ALL SELECT key, page_id FROM p WHERE lang = 'de') GROUP BY name),
c AS (SELECT page_id, name, 0 AS scope, host || '.' || lang || '.' || name AS key FROM r UNION ALL SELECT page_id, name, 1, host || '.' || name FROM r UNION ALL SELECT page_id, name, 10, name FROM r UNION ALL SELECT page_id, name, 20, key || '.' || name FROM r)
SELECT page_id, c.name, arg_min(target, scope) AS target, min(scope) AS scope FROM c JOIN k ON c.key = k.name GROUP BY page_id, c.name""")
def q08_scopes(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    host, lang = F.regexp_extract("url", r"://([^/?#]*)", 1), F.regexp_extract("url", r"://[^/]*/([a-z]+)/", 1)
    p = p.select("page_id", host.alias("host"), lang.alias("lang"), F.lower(F.regexp_extract("html", r"<h1>(\S+)", 1)).alias("key"), "html")
    dotted = lambda *c: F.concat_ws(".", *c)
    names = F.array(dotted("host", "lang", "key"), F.when(F.col("lang") == "en", dotted("host", "key")), F.when(F.col("lang") == "de", F.col("key")))
    items = p.select(F.col("page_id").alias("item_id"), F.col("page_id").alias("path"), F.lit("swift").alias("language"), F.explode(F.array_compact(names)).alias("full_name"), F.lit(None).cast("string").alias("module_name"))
    refs = p.select("page_id", F.array("host", "lang").alias("scopes"), F.col("key").alias("context"), F.explode(X.re_matches(F.col("html"), r'href="/([^"]*)"', 1)).alias("name")).withColumn("name", F.lower("name")).distinct()
    r = links.resolve_local(refs, links.name_index(items), ["swift"]).where("item_id is not null")
    return r.select("page_id", "name", F.col("item_id").alias("target"), (F.col("priority.phase") * 10 + F.col("priority.place")).alias("scope"))


_DIRS = "d AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/[^/]*$', '') AS dir FROM pages UNION SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) FROM pages)"


@query(f"""WITH {_DIRS}, j AS (SELECT c.dir, p.dir AS up FROM d c LEFT JOIN d p ON starts_with(c.dir, p.dir || '/'))
SELECT dir, arg_max(up, length(up)) AS parent_dir FROM j GROUP BY dir""")
def q09_directories(spark, sf_dir):
    u = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("p"), F.regexp_extract("url", r"://([^/?#]*)", 1).alias("h"))
    d = u.select(F.explode(F.array(group.directory(F.col("p")), F.col("h"))).alias("dir"))
    return group.nested_directories(d).select("dir", "parent_dir")


@query(f"""WITH {_DIRS}, j AS (SELECT c.dir, p.dir AS up FROM d c LEFT JOIN d p ON starts_with(c.dir, p.dir) AND c.dir <> p.dir AND p.dir <> '')
SELECT dir, arg_max(up, length(up)) AS parent_dir FROM j GROUP BY dir""")
def q09_string_prefixes(spark, sf_dir):
    u = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("p"), F.regexp_extract("url", r"://([^/?#]*)", 1).alias("h"))
    d = u.select(F.explode(F.array(group.directory(F.col("p")), F.col("h"))).alias("dir"))
    return group.string_prefix_parents(d).select("dir", "parent_dir")


@query(f"""WITH RECURSIVE {_DIRS}, e AS (SELECT dir, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') END AS up FROM d),
t AS (SELECT dir, dir AS root, 0 AS depth FROM e WHERE up IS NULL UNION ALL SELECT e.dir, t.root, t.depth + 1 FROM e JOIN t ON e.up = t.dir) SELECT dir, root, depth FROM t""")
def q10_paths(spark, sf_dir):
    u = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("p"), F.regexp_extract("url", r"://([^/?#]*)", 1).alias("h"))
    d = u.select(F.explode(F.array(group.directory(F.col("p")), F.col("h"))).alias("dir")).distinct()
    e = d.withColumn("up", F.when(F.contains("dir", F.lit("/")), group.directory(F.col("dir"))))
    t = tree.paths_from_parents(e, Tables(spark), "dir", "up", "dir")
    return t.select("dir", F.get("path", F.lit(0))["id"].alias("root"), (F.size("path") - 1).alias("depth"))


@query(f"""WITH RECURSIVE {_DIRS}, e AS (SELECT dir, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') END AS up FROM d),
t AS (SELECT dir, dir AS full_name FROM e WHERE up IS NULL UNION ALL SELECT e.dir, t.full_name || '.' || e.dir FROM e JOIN t ON e.up = t.dir) SELECT dir, full_name FROM t""")
def q10_fixpoint(spark, sf_dir):
    u = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("p"), F.regexp_extract("url", r"://([^/?#]*)", 1).alias("h"))
    d = u.select(F.explode(F.array(group.directory(F.col("p")), F.col("h"))).alias("url")).distinct()
    e = d.select("url", F.col("url").alias("name"), F.when(F.contains("url", F.lit("/")), group.directory(F.col("url"))).alias("parent_name"))
    return links.parent_fixpoint(e, Tables(spark)).select(F.col("url").alias("dir"), "full_name")


@query("""WITH e AS (SELECT p_partkey AS k, p_brand AS brand, p_type AS type, p_size AS size FROM part), roots AS (SELECT brand AS full_name, max(k) AS k FROM e WHERE size <= 5 GROUP BY brand),
kids AS (SELECT brand, type, max(k) AS k FROM e WHERE size > 5 AND size <= 40 AND brand IN (SELECT full_name FROM roots) GROUP BY ALL),
firsts AS (SELECT type, min(k) AS k FROM e WHERE size > 5 AND size <= 40 AND brand IN (SELECT full_name FROM roots) GROUP BY type),
deep AS (SELECT kids.brand || '.' || kids.type || '.x' || e.size AS full_name, max(e.k) AS k FROM e JOIN firsts USING (type) JOIN kids ON kids.type = firsts.type AND kids.k = firsts.k WHERE e.size > 40 GROUP BY 1)
SELECT full_name, 'r' || lpad(k::VARCHAR, 12, '0') AS url FROM roots UNION ALL SELECT brand || '.' || type, 's' || lpad(k::VARCHAR, 12, '0') FROM kids UNION ALL SELECT full_name, 't' || lpad(k::VARCHAR, 12, '0') FROM deep""")
def j13_search_parents(spark, sf_dir):
    """Names collide: the last root of a name stands, the first of the others; of a parent's children the last."""
    p, size = read(spark, sf_dir, "part"), F.col("p_size")
    level = F.when(size <= 5, "r").when(size <= 40, "s").otherwise("t")
    name = F.when(size <= 5, F.col("p_brand")).when(size <= 40, F.col("p_type")).otherwise(F.concat(F.lit("x"), size.cast("string")))
    up = F.when(size <= 5, F.lit(None).cast("string")).when(size <= 40, F.col("p_brand")).otherwise(F.col("p_type"))
    e = p.select(F.concat(level, F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("url"), name.alias("name"), up.alias("parent_name"))
    return links.parent_fixpoint(e, Tables(spark)).select("full_name", "url")


RULES = [group.Rule("Greens", r"/^g.*/"), group.Rule("Blacks", r"/black|burlywood/"), group.Rule("Vowels", r"/^[aeiou]/")]


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^g.*') THEN 0 WHEN regexp_matches(p_name, 'black|burlywood') THEN 1 WHEN regexp_matches(p_name, '^[aeiou]') THEN 2 END AS rule_ord,
CASE WHEN regexp_matches(p_name, '^g.*') THEN 'Greens' WHEN regexp_matches(p_name, 'black|burlywood') THEN 'Blacks' WHEN regexp_matches(p_name, '^[aeiou]') THEN 'Vowels' END AS group_title FROM part""")
def q11_rules(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.lit("").alias("file_pathname"))
    return group.rule_claims(p, RULES, ["p_partkey"]).select("p_partkey", "rule_ord", "group_title")


@query("""WITH i AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'type' WHEN n_nationkey % 3 = 1 THEN 'function' ELSE 'variable' END AS k, r_name AS m, r_regionkey AS rk FROM nation JOIN region ON r_regionkey = n_regionkey),
t AS (SELECT *, CASE k WHEN 'type' THEN 'Types' WHEN 'function' THEN 'Functions' ELSE 'Variables' END AS n, CASE WHEN rk < 2 THEN NULL WHEN rk < 4 THEN m ELSE 'Rest' END AS a FROM i),
g AS (SELECT k, CASE WHEN a IS NULL THEN n ELSE a || ' ' || n END AS title, a IS NULL AS al, count(*) AS items FROM t GROUP BY ALL)
SELECT title AS group_title, dense_rank() OVER (ORDER BY CASE k WHEN 'type' THEN 1 WHEN 'variable' THEN 2 ELSE 3 END, al, title) AS group_rank, items FROM g""")
def q12_kind_groups(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.when(F.col("n_nationkey") % 3 == 0, "type").when(F.col("n_nationkey") % 3 == 1, "function").otherwise("variable")
    items = n.select(k.alias("meta_kind"), F.col("r_name").alias("module_name"))
    m = read(spark, sf_dir, "region").select(F.col("r_name").alias("module_name"), F.when(F.col("r_regionkey") < 2, "global").when(F.col("r_regionkey") < 4, "separate").otherwise("named").alias("policy"), F.lit("Rest").alias("named"))
    return group.kind_groups(items, m).groupBy("group_title", "group_rank").agg(F.count("*").alias("items")).select("group_title", F.col("group_rank").cast("long"), "items")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user FROM conversations""")
def q13_carry_forward(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ordered.carry_forward(F.when(F.col("role") == "user", F.char_length("text").cast("long")), ["conv_id"], ["turn"]).alias("last_user"))


@query("""WITH s AS (SELECT user_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS st FROM events),
i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island""")
def q14_islands(spark, sf_dir):
    e = ordered.islands(read(spark, sf_dir, "events").select("user_id", "event_type", "ts"), ["event_type"], ["user_id"], ["ts"])
    return e.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, url FROM pages)
SELECT page_id, lag(page_id) OVER w AS prev, lead(page_id) OVER w AS next FROM p WINDOW w AS (PARTITION BY host ORDER BY url, page_id)""")
def q15_linear(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), F.struct("url", "page_id").alias("path"), F.col("page_id").alias("url_path"), F.lit(True).alias("render_as_page"), F.lit("def").alias("item_type"))
    return pages.linear(p, "host").select(F.col("url_path").alias("page_id"), F.col("prev_url").alias("prev"), F.col("next_url").alias("next"))


@query(r"""WITH s AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '[^\w\s]', '', 'g'), '\s+', '-', 'g')) AS slug FROM part)
SELECT p_partkey, slug, CASE WHEN n = 0 THEN slug ELSE slug || n END AS unique_slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) - 1 AS n FROM s)""")
def q16_slugs(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", X.slugged(F.col("p_name")).alias("slug"))
    return p.select("p_partkey", "slug", ordered.unique_names(F.col("slug"), [], ["p_partkey"]).alias("unique_slug"))


@query("SELECT p_name AS name, max(p_partkey) AS last_key, min(p_partkey) AS first_key, arg_max(p_brand, p_partkey) AS last_brand FROM part GROUP BY p_name")
def q17_name_index(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey", "p_brand")
    last = ordered.last_wins(p, ["name"], ["p_partkey"]).select("name", F.col("p_partkey").alias("last_key"), F.col("p_brand").alias("last_brand"))
    return last.join(ordered.first_wins(p, ["name"], ["p_partkey"]).select("name", F.col("p_partkey").alias("first_key")), "name")


@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages), t AS (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS l FROM pages)
SELECT page_id, 'href' AS kind, unnest(range(len(l)))::INT AS pos, unnest(l) AS value FROM h UNION ALL SELECT page_id, 'heading', unnest(range(len(l)))::INT, unnest(l) FROM t""")
def q18_links(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    h = p.select("page_id", F.lit("href").alias("kind"), F.posexplode(X.re_matches(F.col("html"), 'href="([^"]*)"', 1)).alias("pos", "value"))
    return h.union(p.select("page_id", F.lit("heading").alias("kind"), F.posexplode(X.re_matches(F.col("html"), "<h1>([^<]*)</h1>", 1)).alias("pos", "value")))


@query(r"""WITH w AS (SELECT item_id, list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}_\p{M}]+')) AS ws FROM benchmark), s AS (
SELECT item_id, CASE WHEN list_contains(ws, 'the') THEN 100 ELSE 0 END + CASE WHEN len(list_filter(ws, lambda x: starts_with(x, 'the'))) > 0 THEN 10 ELSE 0 END
 + CASE WHEN list_contains(ws, 'er') THEN 100 ELSE 0 END + CASE WHEN len(list_filter(ws, lambda x: starts_with(x, 'er'))) > 0 THEN 10 ELSE 0 END AS score FROM w)
SELECT item_id, score FROM s WHERE score > 0 ORDER BY score DESC, item_id LIMIT 10""")
def q19_search(spark, sf_dir):
    return links.search(read(spark, sf_dir, "benchmark"), ["the", "er"], "item_id", ["text"]).select("item_id", "score")


@query("""WITH u AS (SELECT p_name AS name, 'part' AS type, 0 AS b, p_partkey AS k FROM part UNION ALL SELECT n_name, 'nation', 1, n_nationkey FROM nation UNION ALL SELECT s_name, 'supplier', 2, s_suppkey FROM supplier)
SELECT name, type, b AS branch, k AS first_key, row_number() OVER (ORDER BY b, k) AS id FROM (SELECT *, row_number() OVER (PARTITION BY name, type ORDER BY b, k) AS n FROM u) WHERE n = 1""")
def q20_docset(spark, sf_dir):
    pick = lambda t, n, k, kind: read(spark, sf_dir, t).select(F.col(n).alias("name"), F.lit(kind).alias("type"), F.lit("").alias("path"), F.col(k).cast("long").alias("k"))
    u = ordered.ordered_union(pick("part", "p_name", "p_partkey", "part"), pick("nation", "n_name", "n_nationkey", "nation"), pick("supplier", "s_name", "s_suppkey", "supplier"))
    d = links.docset_index(u.withColumn("ord", F.struct("branch", "k")), Tables(spark))
    return d.select("name", "type", "branch", F.col("k").alias("first_key"), "id")


@query("""WITH m AS (SELECT conv_id, role, string_agg(length(text)::VARCHAR, '+' ORDER BY turn) AS t FROM conversations WHERE role IN ('user', 'system') GROUP BY ALL),
n AS (SELECT conv_id, role, string_agg(turn::VARCHAR, '+' ORDER BY turn) AS t FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL), c AS (SELECT DISTINCT conv_id FROM conversations),
x AS (SELECT c.conv_id, u.t AS mu, s.t AS ms, nu.t AS nu, na.t AS na FROM c LEFT JOIN m u ON u.conv_id = c.conv_id AND u.role = 'user' LEFT JOIN m s ON s.conv_id = c.conv_id AND s.role = 'system'
 LEFT JOIN n nu ON nu.conv_id = c.conv_id AND nu.role = 'user' LEFT JOIN n na ON na.conv_id = c.conv_id AND na.role = 'assistant')
SELECT conv_id, coalesce(concat_ws('|', mu, nu), '') AS joined_user, coalesce(na, '') AS joined_assistant, CASE WHEN mu IS NULL THEN '' ELSE mu || coalesce(nu, '') END AS left_user, coalesce(ms, '') AS left_system FROM x""")
def q21_localized(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")

    def by_role(roles: list[str], value):
        r = c.where(F.col("role").isin(roles)).groupBy("conv_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", value.cast("string").alias("v")))), lambda x: x["v"]), "+").alias("t"))
        return r.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "t")))).alias("m"))

    none = F.create_map().cast("map<string,string>")
    a, b = by_role(["user", "system"], F.char_length("text")), by_role(["user", "assistant"], F.col("turn"))
    j = c.select("conv_id").distinct().join(a, "conv_id", "left").join(b.withColumnRenamed("m", "n"), "conv_id", "left")
    m, n = F.coalesce("m", none), F.coalesce("n", none)
    both, left = maps.joined(m, n, "|"), maps.concat(m, n)
    return j.select("conv_id", maps.get(both, "user").alias("joined_user"), maps.get(both, "assistant").alias("joined_assistant"), maps.get(left, "user").alias("left_user"), maps.get(left, "system").alias("left_system"))


@query("""WITH v AS (SELECT p_partkey, p_size FROM part WHERE p_size > 5), e AS (SELECT l.*, p_size, s_suppkey FROM lineitem l LEFT JOIN v ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey),
m AS (SELECT p_size % 2 = 0 AND l_suppkey % 3 = 0 AS ctx FROM e WHERE l_returnflag = 'R' AND p_size IS NOT NULL)
SELECT 'missing source' AS what, count(*) AS n FROM e WHERE p_size IS NULL UNION ALL SELECT 'into target', count(*) FROM m WHERE NOT ctx UNION ALL SELECT 'into extension', count(*) FROM m WHERE ctx
UNION ALL SELECT 'conforms', count(*) FROM e WHERE l_returnflag = 'A' AND p_size IS NOT NULL AND (l_linestatus = 'F' AND l_quantity > 25 OR l_suppkey % 4 <> 0)
UNION ALL SELECT 'override', count(DISTINCT l_partkey) FROM e WHERE l_returnflag = 'N' AND p_size IS NOT NULL AND l_quantity <= 25 UNION ALL SELECT 'subclass', count(DISTINCT l_partkey) FROM e WHERE l_returnflag = 'N' AND p_size IS NOT NULL AND l_quantity > 25""")
def q22_graph(spark, sf_dir):
    """Edges looked up at both ends, members placed, conformances and flags: parts are symbols, suppliers their targets."""
    key = lambda c, k: F.concat(F.lit(k), F.col(c).cast("string"))
    none, one = F.array().cast("array<string>"), lambda x: F.array(F.lit(x))
    p = read(spark, sf_dir, "part").where("p_size > 5").select(
        key("p_partkey", "p").alias("usr"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.lit("swift.method").alias("kind"), F.lit("M").alias("module_name"),
        F.when(F.col("p_size") % 2 == 0, one("T : P")).otherwise(none).alias("constraints"), none.alias("generic_params"), F.lit("struct P : S0").alias("declaration"))
    s = read(spark, sf_dir, "supplier").select(
        key("s_suppkey", "s").alias("usr"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("S"), (F.col("s_suppkey") % 4).cast("string")).alias("name"), F.lit("swift.struct").alias("kind"), F.lit("M").alias("module_name"),
        none.alias("constraints"), F.when(F.col("s_suppkey") % 3 == 0, one("T")).otherwise(none).alias("generic_params"), F.lit("struct S").alias("declaration"))
    flag, many = F.col("l_returnflag"), F.col("l_quantity") > 25
    kind = F.when(flag == "R", "memberOf").when(flag == "A", "conformsTo").when(many, "inheritsFrom").otherwise("overrides")
    e = read(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber").alias("ord"), kind.alias("kind"), key("l_partkey", "p").alias("source"), key("l_suppkey", "s").alias("target"), F.lit(None).cast("string").alias("fallback"),
        F.when((F.col("l_linestatus") == "F") & many, one("T : Q")).otherwise(none).alias("constraints"), F.lit(None).cast("string").alias("warning"))
    r = graph.resolved(e, graph.vertices(p.unionByName(s)))
    # a pass for each rule, two reports of one rule together
    rows = lambda d, **n: d.agg(*[F.count_if(c).alias(k) for k, c in n.items()]).select(F.explode(F.array(*[F.struct(F.lit(k.replace("_", " ")).alias("what"), F.col(k).alias("n")) for k in n])).alias("x")).select("x.*")
    into, override = F.col("into_target"), F.col("is_override")
    parts = [rows(r, missing_source=F.col("warning") == "missing source"), rows(graph.placed(r), into_target=into, into_extension=~into), rows(graph.conformances(r), conforms=F.lit(True)),
             rows(graph.flags(r), override=override, subclass=F.col("superclass").isNotNull())]
    return reduce(DataFrame.union, parts)


@query(f"SELECT {_HOST} AS host, CASE WHEN min({_LANG}) = max({_LANG}) THEN min({_LANG}) END AS solo, count(*) AS n FROM pages GROUP BY 1")
def q23_solo_language(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"://[^/]*/([a-z]+)/", 1).alias("lang"))
    return p.groupBy("host").agg(pages.solo(F.col("lang")).alias("solo"), F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props) AS kind FROM events")
def q24_json(spark, sf_dir):
    v = F.try_parse_json("props")
    kind = F.when(F.schema_of_variant(v).startswith("OBJECT"), "OBJECT").otherwise(F.upper(F.schema_of_variant(v)))
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), kind.alias("kind"))


@query(r"""SELECT page_id, replace(url, '&', '&amp;') AS escaped, len(string_split(regexp_extract(url, '://(.*)', 1), '/')) - 1 AS depth,
list_filter(string_split_regex(url, '[:/.?=#]+'), lambda x: x <> '')[2] AS second_piece, regexp_replace(url, '/([a-z]+)/(\d+)', '/\2/\1') AS swapped, coalesce(nullif(regexp_extract(url, '/([a-z]+)/\d+\.html', 1), ''), NULL) AS html_lang FROM pages""")
def s01_text_functions(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", X.html_escaped(u).alias("escaped"), X.nesting_depth(F.regexp_extract(u, "://(.*)", 1)).cast("long").alias("depth"), F.get(X.re_split(u, "[:/.?=#]+"), F.lit(1)).alias("second_piece"),
        X.re_sub(u, r"/([a-z]+)/(\d+)", "/$2/$1").alias("swapped"), X.re_match(u, r"/([a-z]+)/\d+\.html", 1).alias("html_lang"))


@query("""SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '<v>', 'g') AS marked, starts_with(p_name, 'a') OR p_name LIKE '%green%' AS hit FROM part""")
def s02_callback_and_glob(spark, sf_dir):
    n = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", X.re_sub_with(n, "[aeiou]", lambda m: F.lit("<v>")).alias("marked"), (X.glob_match(n, "a*") | X.glob_match(n, "*green*")).alias("hit"))


@query("""SELECT name, context FROM (SELECT p_name AS name, p_brand AS context, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1""")
def q25_unresolved(spark, sf_dir):
    return stats.unresolved(read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("context"), "p_partkey"), "p_partkey")


@query("""WITH a AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part), b AS (SELECT s_suppkey, s_name, (SELECT p_name FROM part WHERE p_partkey = s_suppkey) AS p_name FROM supplier),
c AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY s_suppkey) AS n FROM b) SELECT s_suppkey, p_partkey FROM c JOIN a USING (p_name, n)""")
def q26_consume_both(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    s = read(spark, sf_dir, "supplier").select("s_suppkey").join(p, F.col("s_suppkey") == F.col("p_partkey")).select("s_suppkey", "p_name")
    return ordered.numbered_match(s, p, ["p_name"], ["s_suppkey"], ["p_partkey"]).select("s_suppkey", "p_partkey")


@query("""WITH e AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_custkey FROM orders), t AS (SELECT o_orderkey, o_custkey, CASE WHEN n % 3 = 1 THEN 'topic' || (n // 3) END AS topic FROM e)
SELECT o_orderkey, coalesce(last_value(topic IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), '') AS topic FROM t""")
def q27_source_topics(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("ord"))
    n = F.row_number().over(W.partitionBy("parent").orderBy("ord"))
    o = o.withColumn("n", n).withColumn("topic", F.when(F.col("n") % 3 == 1, F.concat(F.lit("topic"), F.expr("n div 3").cast("string"))))
    return group.source_topics(o).select(F.col("ord").alias("o_orderkey"), "topic")


@query("""WITH c AS (SELECT p_name, p_type, p_size, p_partkey FROM part), g AS (SELECT p_name, min(p_partkey) AS head, arg_min(p_type, p_partkey) AS ht FROM c GROUP BY p_name),
j AS (SELECT c.*, head, ht FROM c JOIN g USING (p_name)), s AS (SELECT p_name, p_size, min(p_partkey) AS fst FROM j WHERE p_type = ht GROUP BY ALL)
SELECT p_name AS usr, (SELECT min(x.head) FROM j x WHERE x.p_name = s.p_name) AS head, (SELECT count(*) FROM j x WHERE x.p_name = s.p_name) AS copies, (SELECT count(*) FROM j x WHERE x.p_name = s.p_name AND x.p_type <> x.ht) AS mismatches, string_agg(p_size::VARCHAR, ',' ORDER BY fst) AS availability FROM s GROUP BY p_name""")
def q28_duplicate_merge(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_name").alias("usr"), F.col("p_partkey").alias("path"), F.col("p_type").alias("kind"), F.array(F.col("p_size").cast("string")).alias("availability"))
    d = merge.duplicates(p).where("is_head")
    return d.select("usr", "head", "copies", F.col("mismatches").cast("long").alias("mismatches"), F.array_join("availability", ",").alias("availability"))


@query("""WITH r AS (SELECT n_nationkey, n_regionkey FROM nation), m AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, count_if(c_acctbal < 0) AS neg, max(c_custkey) FILTER (c_acctbal >= 0) AS last_ok FROM customer GROUP BY ALL)
SELECT n_nationkey, s AS segment, coalesce(m.n - m.neg, 0) AS n_default, coalesce(m.neg, 0) AS n_conditional, last_ok FROM r CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer) LEFT JOIN m ON c_nationkey = n_nationkey AND c_mktsegment = s""")
def q29_default_implementations(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    segments = F.explode(F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))).alias("name")
    req = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("protocol"), segments, F.lit("f").alias("kind"), F.lit("m").alias("module_name"))
    mem = c.select(F.col("c_nationkey").alias("protocol"), F.col("c_mktsegment").alias("name"), F.lit("f").alias("kind"), (F.col("c_acctbal") < 0).alias("is_constrained"), F.col("c_custkey").cast("string").alias("docs"), F.lit("m").alias("module_name"), F.col("c_custkey").alias("path"))
    d = merge.default_implementations(req, mem)
    return d.select(F.col("protocol").alias("n_nationkey"), F.col("name").alias("segment"), F.coalesce("n_default", F.lit(0)).alias("n_default"), F.coalesce("n_conditional", F.lit(0)).alias("n_conditional"), F.col("default_docs").cast("long").alias("last_ok"))


@query(f"""WITH {_TREE}, bad AS (SELECT p FROM h WHERE len(p) = 3 AND p[3] % 7 = 0) SELECT len(h.p) AS depth, count(*) AS unevaluated FROM h WHERE EXISTS (SELECT 1 FROM bad WHERE len(h.p) > len(bad.p) AND h.p[1:3] = bad.p) GROUP BY 1""")
def q30_unevaluated(spark, sf_dir):
    h = hierarchy(spark, sf_dir)
    bad = (F.size("path") == 3) & (F.get("path", F.lit(2)) % 7 == 0)
    return tree.unevaluated(h, bad).groupBy(F.size("path").cast("long").alias("depth")).agg(F.count("*").alias("unevaluated"))


from arborql.plans import docs, files, more, symbols, wide  # noqa: E402, F401  (add to QUERIES)
