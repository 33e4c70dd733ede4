"""Documentation comments, availability, name pieces, dictionaries, rules and link lookups over the driver's tables, with
their DuckDB SQL. Comments, declarations and XML are written from parts, so that SQL can state what is in them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.functions import maps
from arborql.functions import text as X
from arborql.model import OBJC
from arborql.operators import decls, graph, group, links, ordered, pages, tree
from arborql.plans.catalogue import query, read, spread
from arborql.plans.wide import _NATIONS, by_region, files, nations, site
from arborql.sources import readers
from arborql.tables import Tables


def text(c: str):
    return F.col(c).cast("string")


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN '' ELSE 'Part ' || p_name || chr(10) || 'in one.' END AS abstract,
CASE WHEN p_size > 25 THEN '' ELSE 'Second.' || chr(10) || chr(10) END || '- note: stays ' || p_size AS discussion, p_type AS returns, CASE WHEN p_size <= 25 THEN 'E' || p_size END AS throws,
CASE WHEN p_size > 25 THEN 'x=of ' || p_brand ELSE 'x=of ' || p_brand || ',y=two' || chr(10) || 'lines' END AS params FROM part""")
def p20_doc_comments(spark, sf_dir):
    """PRJ20: abstract, discussion, parameters, returns and throws of comments; other list items stay."""
    first = F.concat(F.lit("Part "), "p_name", F.lit("\nin one.\n\nSecond.\n\n"))
    x = F.concat(F.lit("- parameter x: of "), "p_brand", F.lit("\n- Returns: "), "p_type", F.lit("\n- note: stays "), text("p_size"))
    more = F.concat(F.lit("\n- Parameter y: two\n  lines\n- throws: E"), text("p_size"))
    comment = F.when(F.col("p_size") > 25, x).otherwise(F.concat(first, x, more))
    d = spread(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", decls.doc_comment(comment).alias("d"))
    params = F.array_join(F.transform("d.parameters", lambda p: F.concat(p["name"], F.lit("="), p["description"])), ",")
    return d.select("p_partkey", "d.abstract", "d.discussion", "d.returns", "d.throws", params.alias("params"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'iOS ' || p_size || '+|macOS 11+' WHEN 1 THEN 'iOS ' || p_size || '+' ELSE '' END AS available,
CASE p_size % 4 WHEN 1 THEN 'iOS deprecated since ' || (p_size + 1) || ': use ' || p_name WHEN 2 THEN 'deprecated: Renamed: `' || p_brand || '`.' END AS deprecated, CASE WHEN p_size % 4 = 3 THEN 'unavailable.' END AS unavailable FROM part""")
def p15_availability(spark, sf_dir):
    """PRJ15: the three forms of an availability attribute."""
    n, k = text("p_size"), F.col("p_size") % 4
    a = (F.when(k == 0, F.concat(F.lit("@available(iOS "), n, F.lit(", macOS 11, *)")))
         .when(k == 1, F.concat(F.lit("@available(iOS, introduced: "), n, F.lit(", deprecated: "), (F.col("p_size") + 1).cast("string"), F.lit(', message: "use '), "p_name", F.lit('")')))
         .when(k == 2, F.concat(F.lit('@available(*, deprecated, renamed: "'), "p_brand", F.lit('")'))).otherwise("@available(*, unavailable)"))
    d = spread(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", decls.availability(a).alias("d"))
    return d.select("p_partkey", F.array_join("d.available", "|").alias("available"), "d.deprecated", "d.unavailable")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'm' || p_size || 'with' ELSE 'v' || p_size END AS sortable,
CASE WHEN p_size % 2 = 0 THEN 'func <b>m' || p_size || '</b>(<b>with</b> a: Int) -> Void' ELSE 'static var <b>v' || p_size || '</b>: Int' END AS wrapped,
CASE WHEN p_size % 2 = 0 THEN 'func m' || p_size || '(with a: Int) -> Void' ELSE 'static var v' || p_size || ': Int' END AS flat FROM part""")
def p16_name_pieces(spark, sf_dir):
    """PRJ16, ST14, OR7: declarations as pieces that are their name or not; the name alone sorts."""
    n = text("p_size")
    d = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("func m"), n, F.lit("(with a: Int) -> Void"))).otherwise(F.concat(F.lit("static var v"), n, F.lit(": Int")))
    p = spread(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", decls.pieces(d).alias("p"))
    return p.select("p_partkey", X.sortable_name(F.col("p")).alias("sortable"), X.pieces_wrapped(F.col("p"), "<b>", "</b>").alias("wrapped"), X.pieces_flat(F.col("p")).alias("flat"))


@query("""SELECT p_partkey, CASE WHEN p_size <> 13 THEN 'Part `' || p_brand || '`' END AS abstract, CASE WHEN p_size <> 13 THEN '*' || p_name || '*' || chr(10) || chr(10) || '- Note: two' END AS discussion,
CASE WHEN p_size <> 13 THEN p_type END AS returns, CASE WHEN p_size <> 13 THEN 'x=of ' || p_size END AS params FROM part""")
def p22_xml_docs(spark, sf_dir):
    """PRJ22: XML documentation comments as the same parts; what is not well-formed has none."""
    para = lambda *c: F.concat(F.lit("<Para>"), *c, F.lit("</Para>"))
    xml = F.concat(
        F.lit("<Function><Name>f</Name><CommentParts><Abstract>"), para(F.lit("Part <codeVoice>"), F.col("p_brand"), F.lit("</codeVoice>")), F.lit("</Abstract><Parameters><Parameter><Name>x</Name><Discussion>"),
        para(F.lit("of "), text("p_size")), F.lit("</Discussion></Parameter></Parameters><ResultDiscussion>"), para(F.col("p_type")), F.lit("</ResultDiscussion><Discussion>"),
        para(F.lit("<emphasis>"), F.col("p_name"), F.lit("</emphasis>")), F.lit("<Note><Para>two</Para></Note></Discussion></CommentParts></Function>"))
    d = spread(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", decls.xml_docs(F.when(F.col("p_size") == 13, "<Function>").otherwise(xml)).alias("d"))
    params = F.array_join(F.transform("d.parameters", lambda p: F.concat(p["name"], F.lit("="), p["description"])), ",")
    return d.select("p_partkey", "d.abstract", "d.discussion", "d.returns", params.alias("params"))


@query("""SELECT p_partkey, p_name AS default_abstract, p_type AS default_discussion, NULL AS abstract, 'T' || p_size AS name FROM part""")
def p25_moved_docs(spark, sf_dir):
    """PRJ25, PRJ3: a default implementation's docs move to the default fields; a category is its class's extension."""
    none = F.lit(None).cast("string")
    docs = F.struct(F.col("p_name").alias("abstract"), F.col("p_type").alias("discussion"), none.alias("default_abstract"), none.alias("default_discussion"))
    name = decls.repaired_name(F.concat(F.lit("T"), text("p_size"), F.lit("(Cat)")), F.lit(OBJC + "category"))
    d = read(spark, sf_dir, "part").select("p_partkey", decls.default_moved(docs).alias("d"), name.alias("name"))
    return d.select("p_partkey", "d.default_abstract", "d.default_discussion", "d.abstract", "name")


@query(f"""WITH {_NATIONS}, k AS (SELECT 'u' || (n_nationkey % 7) AS usr, n_name, r_regionkey, pos FROM n)
SELECT usr, arg_max(n_name, r_regionkey * 100 + pos) AS name, 'func ' || arg_max(n_name, r_regionkey * 100 + pos) || '()' AS declaration FROM k GROUP BY usr""")
def src9_bridging(spark, sf_dir):
    """SRC9: the bridging table of header files; a symbol that comes again has its last name."""
    name = F.col("n_name")
    row = F.to_json(F.struct(F.concat(F.lit("u"), (F.col("n_nationkey") % 7).cast("string")).alias("key.usr"), name.alias("key.swift_name"), F.concat(F.lit("func "), name, F.lit("()")).alias("key.swift_declaration")))
    value = by_region(nations(spark, sf_dir), row, '[{"/src/A.h":{"key.substructure":[', "]}}]")
    raw = readers.raw_symbols(spark, files(value, "r_regionkey", Tables(spark), "headers")).where("v is not null")
    raw.select("file", "v").createOrReplaceTempView("src9_rows")
    return readers.bridging_names(tree.flatten_variant(spark, "src9_rows")).select("usr", "name", "declaration")


@query("""WITH it AS (SELECT r_name AS title FROM region UNION ALL SELECT n_name FROM nation), l AS (SELECT unnest(['en', 'fr']) AS language)
SELECT title, language, '2.0' AS version, title || '/' || language AS own, 'common' AS other FROM it, l""")
def k05_dictionaries(spark, sf_dir):
    """SNK4, SNK5, LNK15, LNK16: what a template gets for each page and language, the page's values over global ones."""
    t = Tables(spark)
    u = pages.urls(site(spark, sf_dir), t, "separate").withColumns({"topic_id": F.lit("t"), "topic_title": F.lit("T"), "abstract": F.lit("a")})
    d = pages.page_dictionaries(pages.assemble(u, t), ["en", "fr"], {"version": "2.0", "title": "not this"})
    get = lambda k: F.get_json_object("json", f"$.{k}")
    own = F.create_map(F.lit("own"), F.concat(get("title"), F.lit("/"), get("language")))
    v = pages.with_globals(d.withColumn("page_values", own), {"own": "not this", "other": "common"})
    return v.select(get("title").alias("title"), get("language").alias("language"), get("version").alias("version"), F.col("page_values")["own"].alias("own"), F.col("page_values")["other"].alias("other"))


@query("""SELECT r_regionkey, r_name, count(*) AS n, string_agg(n_name || ' ' || n_nationkey, ',' ORDER BY n_name, n_nationkey) AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def l16_menu(spark, sf_dir):
    """LNK16: the menu of groups."""
    n = nations(spark, sf_dir).select(F.col("r_regionkey").alias("group_rank"), F.col("r_name").alias("group_title"), F.col("n_name").alias("name"), text("n_nationkey").alias("url_path"))
    rows = F.transform("children", lambda c: F.concat(c["name"], F.lit(" "), c["url"]))
    return pages.menu(n).select(F.col("group_rank").alias("r_regionkey"), F.col("group_title").alias("r_name"), F.size("children").cast("long").alias("n"), F.array_join(rows, ",").alias("children"))


@query("""SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN 'n' || c_nationkey END AS protocol FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 5 > 0""")
def j03_default_targets(spark, sf_dir):
    """JN3: default implementations with the protocol of the requirement that they implement, if it has one."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.lit("defaultImplementationOf").alias("kind"), F.concat(F.lit("c"), text("o_custkey")).alias("target"), F.when(F.col("o_orderkey") % 5 == 0, "missing source").alias("warning"))
    m = read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("c"), text("c_custkey")).alias("source"), F.concat(F.lit("n"), text("c_nationkey")).alias("target"))
    return graph.default_targets(o, m).select("o_orderkey", F.col("protocol_usr").alias("protocol"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN 's/' WHEN n_nationkey % 2 = 0 THEN 'o/' ELSE 'z/' END ELSE 's/' END || n_name AS url
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND n_nationkey % 3 = 0)""")
def j12_builtin_names(spark, sf_dir):
    """JN12: names in the built-in index: in the module named, else by the order of modules; none with a small initial."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    module = F.array_compact(F.array(F.lit("Zeta"), F.when(k % 2 == 0, "ObjectiveC"), F.when(k % 3 == 0, "Swift")))
    db = n.select(F.explode(module).alias("module_name"), F.col("n_name").alias("name")).withColumn("url", F.concat(F.lower(F.substring("module_name", 1, 1)), F.lit("/"), "name"))
    c = F.col("c_custkey")
    name = F.when(c % 3 == 0, F.col("n_name")).when(c % 3 == 1, F.concat(F.lit("Swift."), "n_name")).otherwise(F.lower("n_name"))
    refs = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == k).select(c.alias("ref_id"), name.alias("name"))
    return links.resolve_builtin(refs, db).select(F.col("ref_id").alias("c_custkey"), "url")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '<a href="s/' || p_partkey || '" class="j2-swift"><code>' || p_name || '</code></a><a href="o/' || p_partkey || '" class="j2-objc j2-secondary"><code>' || p_type || '</code></a>'
ELSE '<a href="s/' || p_partkey || '"><code>' || p_name || '</code></a>' END AS html FROM part""")
def l03_dual_links(spark, sf_dir):
    """LNK3: links to definitions of two languages, and of one."""
    one = lambda lang, c: F.create_map(F.lit(lang), c)
    url = lambda p: F.concat(F.lit(p), text("p_partkey"))
    two = lambda a, b: F.when(F.col("p_size") % 2 == 0, F.map_concat(one("swift", a), one("objc", b))).otherwise(one("swift", a))
    html = links.dual_link(F.col("p_name"), F.lit("swift"), two(url("s/"), url("o/")), two(F.col("p_name"), F.col("p_type")), two(F.concat(F.lit("M."), "p_name"), F.concat(F.lit("M."), "p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", html.alias("html"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = p_size % 2 THEN '../page.html' ELSE '../../k' || (p_size % 2) || '/page.html' END AS relative, replace(p_name, ' ', '%20') || '?;%23' AS fragment, p_name || ' +%/' AS decoded, p_type || '(a.b:)' AS tail FROM part""")
def s09_paths(spark, sf_dir):
    """ST9, ST12, ST15: relative paths, encoded fragments, decoding, and what is shown of a dotted name."""
    at = lambda k, end: F.concat(F.lit("root/k"), (F.col("p_size") % k).cast("string"), F.lit(end))
    return read(spark, sf_dir, "part").select(
        "p_partkey", X.relative_path(at(3, "/page"), at(2, "/page.html")).alias("relative"), X.url_fragment_encoded(F.concat("p_name", F.lit("?;#"))).alias("fragment"),
        X.url_decoded(X.url_path_encoded(F.concat("p_name", F.lit(" +%/")))).alias("decoded"), X.display_tail(F.concat(F.lit("M.A."), "p_type", F.lit("(a.b:)"))).alias("tail"))


@query("""SELECT p_partkey, p_brand AS fr_abstract, p_name AS en_abstract, CASE WHEN p_size > 25 THEN p_type ELSE 'x' END AS fr_param, CASE WHEN p_size % 2 = 0 THEN 'dans ' || p_name ELSE p_name || ' of ' || p_brand END AS said FROM part""")
def m07_localized(spark, sf_dir):
    """MP1, MP5, MP7: docs under every tag, a language's own set over them, and messages of its template."""
    tags = ["en", "fr"]
    docs = F.struct(maps.broadcast_tags(F.col("p_name"), tags).alias("abstract"), maps.broadcast_tags(F.lit("d"), tags).alias("discussion"),
                    F.array(F.struct(F.lit("x").alias("name"), maps.broadcast_tags(F.lit("x"), tags).alias("text"))).alias("params"))
    own = F.struct(F.col("p_brand").alias("abstract"), F.lit(None).cast("string").alias("discussion"),
                   F.array(F.struct(F.when(F.col("p_size") > 25, "x").otherwise("unknown").alias("name"), F.col("p_type").alias("text"))).alias("params"))
    bundle = F.create_map(F.lit("en"), F.lit("%1 of %2"), F.lit("fr"), F.lit("dans %1"))
    said = maps.message(maps.localized_message(bundle, F.when(F.col("p_size") % 2 == 0, "fr").otherwise("de"), "en"), F.col("p_name"), F.col("p_brand"))
    d = read(spark, sf_dir, "part").select("p_partkey", maps.merge_docs(docs, own, "fr").alias("d"), said.alias("said"))
    return d.select("p_partkey", maps.get(F.col("d.abstract"), "fr").alias("fr_abstract"), maps.get(F.col("d.abstract"), "en").alias("en_abstract"), maps.get(F.col("d.params")[0]["text"], "fr").alias("fr_param"), "said")


@query("""SELECT dir, len(string_split(dir, '/'))::BIGINT AS depth FROM (SELECT DISTINCT p_brand || CASE WHEN p_size > 25 THEN '/' || p_type ELSE '' END AS dir FROM part UNION SELECT DISTINCT p_type FROM part)""")
def t04_directories(spark, sf_dir):
    """OR5, SET4: distinct directories of several lists, the least nested first."""
    p = read(spark, sf_dir, "part")
    d = group.by_depth(p.select(F.concat("p_brand", F.when(F.col("p_size") > 25, F.concat(F.lit("/"), "p_type")).otherwise("")).alias("dir")))
    return ordered.union_distinct(d, p.select(F.col("p_type").alias("dir"))).withColumn("depth", F.size(F.split("dir", "/")).cast("long"))


@query("""SELECT arg_min(p_name, p_partkey) AS again FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 2""")
def a15_first_duplicate(spark, sf_dir):
    """AGG15: the first name to come again."""
    return ordered.first_duplicate(read(spark, sf_dir, "part"), "p_name", "p_partkey").select(F.col("p_name").alias("again"))


_CUSTOM = [{"name": "Rings", "children": ["/ring$/", "no such part"]}, {"name": "Blue", "topics": [{"name": "Blue ones", "children": ["/^blue/"]}]}, {"name": "None", "children": ["neither"]}]


@query("""WITH k AS (SELECT p_partkey, p_name, CASE WHEN p_name LIKE '%ring' THEN 'Rings' WHEN p_name LIKE 'blue%' THEN 'Blue ones' END AS title FROM part)
SELECT p_partkey, title, CASE WHEN title IS NOT NULL THEN row_number() OVER (PARTITION BY title ORDER BY p_name, p_partkey) END::BIGINT AS place FROM k WHERE title IS NOT NULL OR p_partkey % 2 = 1""")
def g07_listed_guides(spark, sf_dir):
    """GRP2, GRP6, GRP7: groups of a configuration; guides that no rule takes go."""
    rules = group.parse_groups(_CUSTOM)
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.lit("f").alias("file_pathname"), F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 2 == 1, "def").otherwise("guide").alias("item_type"))
    c = group.listed_guides(group.rule_claims(p, rules, ["p_partkey"]), True)
    at = F.row_number().over(W.partitionBy("group_title").orderBy(*group.claim_order(rules)))
    return c.select("p_partkey", F.col("group_title").alias("title"), F.when(F.col("group_title").isNotNull(), at).cast("long").alias("place"))


@query("""SELECT * FROM (VALUES ('Rings', 'no such part'), ('None', 'neither')) AS t(title, rule)""")
def g06_unused_rules(spark, sf_dir):
    """SET5: rules of the configuration that took nothing."""
    rules = group.parse_groups(_CUSTOM)
    p = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.lit("f").alias("file_pathname"))
    return group.unused_rules(group.rule_claims(p, rules, ["name"]), rules).select(F.col("group").alias("title"), "rule")
