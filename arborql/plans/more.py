"""More operators over the driver's tables, with their DuckDB SQL. Stand-ins as in ``catalogue``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborql.functions import maps
from arborql.functions import text as X
from arborql.model import NOTES, TOPICS
from arborql.operators import decls, filters, graph, group, links, merge, ordered, pages, stats, tree
from arborql.plans.catalogue import _TREE, hierarchy, query, read
from arborql.sources import readers
from arborql.tables import Tables


@query("""WITH p AS (SELECT DISTINCT p_name FROM part WHERE p_size < 3), s AS (SELECT s_suppkey, unnest([s_suppkey, s_suppkey + 1, s_suppkey, s_suppkey + 2]) AS k, unnest([0, 1, 2, 3]) AS pos FROM supplier)
SELECT s_suppkey, coalesce(string_agg(p_name, ',' ORDER BY pos) FILTER (p_name NOT IN (FROM p)), '') AS inherited FROM s JOIN part ON p_partkey = k GROUP BY s_suppkey""")
def f08_private_protocols(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.expr("array(s_suppkey, s_suppkey + 1, s_suppkey, s_suppkey + 2)")).alias("pos", "k"))
    lists = s.join(part, F.col("k") == F.col("p_partkey")).groupBy("s_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p_name"))), lambda r: r["p_name"]).alias("inherited_types"))
    hidden = part.where("p_size < 3").select(F.col("p_name").alias("name")).distinct()
    return filters.strip_inherited(lists, hidden, ["s_suppkey"]).select("s_suppkey", F.array_join("inherited_types", ",").alias("inherited"))


@query("""WITH d AS (SELECT doc_id, l.doc_id IS NOT NULL AS has_docs, d.doc_id % 11 = 0 AS is_override, source = 'src1' AS ext FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT CASE WHEN is_override AND NOT has_docs THEN 'filterSkipUndocOverride' WHEN has_docs OR ext THEN 'documented' ELSE 'placeholder' END AS disposition,
CASE WHEN is_override AND NOT has_docs THEN 'filterSkipUndocOverride' WHEN has_docs OR ext THEN 'documentedDef' ELSE 'missingDocumentation' END AS counter, count(*) AS n FROM d GROUP BY ALL""")
def f09_documentation(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l")).distinct()
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(lab, "doc_id", "left")
    d = d.select(F.coalesce("l", F.lit(False)).alias("has_docs"), (F.col("doc_id") % 11 == 0).alias("is_override"), (F.col("source") == "src1").alias("is_swift_extension"))
    disp, counter = filters.documentation(filters.FilterConfig(skip_undocumented_override=True))
    return d.groupBy(disp.alias("disposition"), counter.alias("counter")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT item_id, string_split(text, ' ')[1] AS name FROM benchmark), t AS (SELECT doc_id, string_split(text, ' ')[1] AS name FROM documents),
f AS (SELECT name, min(item_id) AS item_id FROM a GROUP BY name), h AS (SELECT name, min(doc_id) AS doc_id FROM t GROUP BY name)
SELECT f.name, item_id, doc_id FROM f LEFT JOIN h USING (name)""")
def j06_custom_abstracts(spark, sf_dir):
    word = F.split("text", " ")[0]
    a = ordered.first_wins(read(spark, sf_dir, "benchmark").select("item_id", word.alias("name")), ["name"], ["item_id"])
    t = ordered.consume_once(read(spark, sf_dir, "documents").select("doc_id", word.alias("name")), ["name"], ["doc_id"])
    return a.join(t, "name", "left")


@query("""WITH s AS (SELECT p_name AS key, CASE WHEN p_size % 3 = 0 THEN 'fr' WHEN p_size % 3 = 1 THEN 'en' ELSE 'de' END AS tag, max(p_brand) AS v FROM part GROUP BY ALL), k AS (SELECT DISTINCT p_name AS key FROM part)
SELECT key, coalesce(f.v, e.v) AS fr, coalesce(e.v, NULL) AS en FROM k LEFT JOIN (FROM s WHERE tag = 'fr') f USING (key) LEFT JOIN (FROM s WHERE tag = 'en') e USING (key)""")
def j09_localized_strings(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    tag = F.when(F.col("p_size") % 3 == 0, "fr").when(F.col("p_size") % 3 == 1, "en").otherwise("de")
    b = p.groupBy(F.col("p_name").alias("key"), tag.alias("tag")).agg(F.max("p_brand").alias("value"))
    out = readers.localized(p.select(F.col("p_name").alias("key")).distinct(), b, ["fr", "en"], "en")
    return out.select("key", F.try_element_at("texts", F.lit("fr")).alias("fr"), F.try_element_at("texts", F.lit("en")).alias("en"))


@query("""WITH r AS (SELECT p_partkey AS ref_id, p_name AS name FROM part WHERE p_size < 20), m AS (SELECT s_suppkey % 3 AS source_ord, p_name AS key, s_name AS url FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT ref_id, arg_min(url, source_ord * 1000000 + length(url)) AS url FROM r JOIN (SELECT key, source_ord, min(url) AS url FROM m GROUP BY ALL) ON name = key GROUP BY ref_id""")
def j11_remote_sources(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    refs = p.where("p_size < 20").select(F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("name"))
    m = read(spark, sf_dir, "supplier").join(p, F.col("s_suppkey") == F.col("p_partkey")).groupBy((F.col("s_suppkey") % 3).alias("source_ord"), F.col("p_name").alias("key")).agg(F.min("s_name").alias("url"))
    return links.resolve_remote(refs, m.withColumn("module_name", F.lit("none")))


@query("""WITH l AS (SELECT p_partkey AS link_id, p_name AS basename FROM part), m AS (SELECT p_name AS basename, min(p_brand) AS url FROM part WHERE p_size = 1 GROUP BY 1), g AS (SELECT p_name AS basename, min(p_type) AS url FROM part WHERE p_size < 4 GROUP BY 1)
SELECT link_id, coalesce(m.url, g.url) AS target FROM l LEFT JOIN m USING (basename) LEFT JOIN g USING (basename)""")
def j16_link_targets(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    m = p.where("p_size = 1").groupBy(F.col("p_name").alias("basename")).agg(F.min("p_brand").alias("url"))
    g = p.where("p_size < 4").groupBy(F.col("p_name").alias("basename")).agg(F.min("p_type").alias("url"))
    return links.link_targets(p.select(F.col("p_partkey").alias("link_id"), F.col("p_name").alias("basename")), m, g).select("link_id", "target")


@query(f"WITH {_TREE}, b AS (SELECT p FROM h WHERE len(p) = 3 AND p[3] % 10 = 1) SELECT len(h.p) AS depth, count(*) AS n FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE h.p[1:3] = b.p) GROUP BY 1")
def j17_shadowed_names(spark, sf_dir):
    h = hierarchy(spark, sf_dir).withColumn("ref_id", F.array_join(F.col("path").cast("array<string>"), "/")).withColumn("name", F.lit("T"))
    params = h.where((F.size("path") == 3) & (F.get("path", F.lit(2)) % 10 == 1)).select("path", "name")
    return links.shadowed(h, params).groupBy(F.size("path").cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE '' END AS docs FROM nation), e AS (SELECT c_nationkey, arg_min(c_name, c_custkey) AS d FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
SELECT n_nationkey, CASE WHEN docs = '' THEN d ELSE docs END AS docs FROM t LEFT JOIN e ON c_nationkey = n_nationkey""")
def a06_docs_backfill(spark, sf_dir):
    t = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "own").otherwise("").alias("docs"))
    e = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("claimant"), F.col("c_custkey").alias("path"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("docs"))
    return merge.backfill_docs(t, e).select(F.col("path").alias("n_nationkey"), "docs")


@query("""WITH o AS (SELECT c_nationkey AS parent, 0 AS k, c_custkey AS ord, c_acctbal < 0 AS con FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_nationkey, 1, c_custkey, c_acctbal < 0 FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_nationkey, 2, c_custkey, c_acctbal < 0 FROM customer WHERE c_custkey % 3 = 2)
SELECT ord AS c_custkey, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN con THEN 9 ELSE k END, ord) AS place FROM o""")
def a07_folded_members(spark, sf_dir):
    from pyspark.sql import Window as W

    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent_path"), F.lit(0).alias("ext_path"), F.col("c_custkey").alias("ord"), (F.col("c_acctbal") < 0).alias("is_constrained"))
    f = merge.folded_members(*[c.where(F.col("ord") % 3 == k) for k in range(3)])
    return f.select(F.col("ord").alias("c_custkey"), F.row_number().over(W.partitionBy("parent_path").orderBy("fold_order")).cast("long").alias("place"))


@query("""WITH d AS (SELECT p_name, arg_min(p_brand, p_partkey) AS base FROM part GROUP BY 1), o AS (SELECT DISTINCT p_name, p_brand FROM part JOIN d USING (p_name) WHERE p_brand <> base AND (p_size < 10 OR p_size > 45))
SELECT d.p_name AS name, base || coalesce(chr(10) || chr(10) || string_agg(p_brand, chr(10) || chr(10) ORDER BY p_brand), '') AS declaration FROM d LEFT JOIN o USING (p_name) GROUP BY d.p_name, base""")
def a08_declarations(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    g = p.groupBy(F.col("p_name").alias("name")).agg(F.min_by("p_brand", "p_partkey").alias("base"), F.collect_set(F.struct(F.col("p_brand").alias("decl"), (F.col("p_size") < 10).alias("conforms"), (F.col("p_size") > 45).alias("constrained"))).alias("others"))
    return g.select("name", merge.merged_declarations(F.col("base"), F.col("others")).alias("declaration"))


@query(f"WITH {_TREE}, e AS (SELECT p FROM h WHERE len(p) = 2 AND p[2] % 2 = 1) SELECT len(h.p) AS depth, count(*) FILTER (e.p IS NOT NULL) AS imported, count(*) AS n FROM h LEFT JOIN e ON len(h.p) >= 2 AND h.p[1:2] = e.p GROUP BY 1")
def a10_imported_notes(spark, sf_dir):
    h = hierarchy(spark, sf_dir).select("path")
    e = h.where(F.size("path") == 2).select("path", F.lit("A").alias("module_name"), F.when(F.get("path", F.lit(1)) % 2 == 1, "B").otherwise("A").alias("type_module_name"))
    return merge.imported_notes(e, h).groupBy(F.size("path").cast("long").alias("depth")).agg(F.count("imported_from").alias("imported"), F.count("*").alias("n"))


@query("SELECT DISTINCT lang AS language FROM documents")
def a12_languages(spark, sf_dir):
    return pages.languages(read(spark, sf_dir, "documents").select(F.col("lang").alias("primary_language"), F.lit(None).cast("string").alias("secondary_language")))


@query("""WITH n AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 ELSE 6 END AS r, CASE o_orderstatus WHEN 'F' THEN 'imported: F' WHEN 'O' THEN 'defaultImplementation' ELSE 'unavailable: P' END AS t FROM orders), d AS (SELECT DISTINCT o_custkey, r, t FROM n)
SELECT o_custkey, string_agg(t, '; ' ORDER BY r) AS notes FROM d GROUP BY 1""")
def a14_notes(spark, sf_dir):
    s = F.col("o_orderstatus")
    note = F.struct(F.when(s == "F", "imported").when(s == "O", "defaultImplementation").otherwise("unavailable").alias("tag"), F.when(s == "F", "F").when(s == "O", F.lit(None).cast("string")).otherwise("P").alias("arg"))
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(note).alias("n"))
    return g.select("o_custkey", merge.notes_joined(F.col("n"), NOTES).alias("notes"))


@query("SELECT p_brand AS module_name, max(p_partkey) AS pass_index, arg_max(p_name, p_partkey) AS version FROM part GROUP BY 1")
def a16_last_pass(spark, sf_dir):
    return merge.last_pass(read(spark, sf_dir, "part").select(F.col("p_brand").alias("module_name"), F.col("p_partkey").alias("pass_index"), F.col("p_name").alias("version")))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus AS name FROM orders), l AS (SELECT unnest(['P', 'F']) AS entry, unnest([0, 1]) AS place),
h AS (SELECT o_custkey, place, min(o_orderkey) AS o_orderkey FROM c JOIN l ON name = entry GROUP BY 1, 2)
SELECT c.o_orderkey, place FROM c LEFT JOIN h USING (o_custkey, o_orderkey)""")
def g04_custom_members(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("type_name"), F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("name"), F.lit("").alias("declaration"))
    entries = F.explode(F.array(F.struct(F.lit("P").alias("entry"), F.lit(0).alias("place")), F.struct(F.lit("F").alias("entry"), F.lit(1).alias("place")))).alias("e")
    listed = o.select("type_name").distinct().select("type_name", entries).select("type_name", "e.entry", F.lit("top").alias("topic"), "e.place")
    return group.custom_members(o, listed, False).select(F.col("path").alias("o_orderkey"), F.col("place.at").alias("place"))


@query("""WITH s AS (SELECT conv_id, turn, text, role, CASE WHEN role = 'assistant' THEN NULL ELSE length(text) END AS docs FROM conversations), f AS (SELECT *, CASE WHEN docs IS NULL AND lag(turn // 2) OVER w = turn // 2 THEN 0 ELSE 1 END AS st FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT conv_id, turn, last_value(docs IGNORE NULLS) OVER (PARTITION BY conv_id, run ORDER BY turn ROWS UNBOUNDED PRECEDING) AS docs FROM r""")
def w02_shared_docs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("parent"), F.col("turn").alias("ord"), F.expr("turn div 2").alias("offset"), F.lit("var").alias("kind"), F.when(F.col("role") != "assistant", F.char_length("text").cast("long")).alias("docs"))
    return readers.with_shared_docs(c).select(F.col("parent").alias("conv_id"), F.col("ord").alias("turn"), "docs")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_orderpriority END AS c FROM orders)
SELECT o_orderkey, last_value(c IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS block FROM o""")
def w08_conditional_block(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")).alias("extension_constraint"))
    return group.conditional_block(o).select(F.col("ord").alias("o_orderkey"), F.col("block_constraint").alias("block"))


@query("""WITH i AS (SELECT conv_id, turn, role, sum(CASE WHEN role = lagr THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lagr FROM conversations)),
g AS (SELECT conv_id, island, min(role) AS title, count(*) AS n FROM i GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, title ORDER BY island) - 1 AS k FROM g)
SELECT conv_id, island::BIGINT AS island, n, 'tpc-' || title || CASE WHEN k = 0 THEN '' ELSE k::VARCHAR END AS anchor FROM u""")
def w05_page_topics(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("parent"), F.col("turn").alias("ord"), F.col("role").alias("topic_id"), F.col("role").alias("topic_title"))
    return pages.page_topics(c).select(F.col("parent").alias("conv_id"), F.col("island").cast("long").alias("island"), "n", "anchor")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 4 ELSE 5 END, CASE WHEN p_size < 10 OR p_size >= 30 THEN p_name END NULLS FIRST, p_partkey) AS place FROM part""")
def o01_logical_order(spark, sf_dir):
    from pyspark.sql import Window as W

    topic = F.when(F.col("p_size") < 10, "type").when(F.col("p_size") < 30, "enumElement").otherwise("method")
    p = read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("path"), F.col("p_name").alias("name"), topic.alias("def_topic"))
    assert TOPICS.index("type") < TOPICS.index("enumElement") < TOPICS.index("method")
    return p.select(F.col("path").alias("p_partkey"), F.row_number().over(W.partitionBy("p_brand").orderBy(*group.logical_order())).cast("long").alias("place"))


@query("""SELECT page_id, url, repeat('../', length(p) - length(replace(p, '/', ''))) AS root FROM (SELECT page_id, url, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS p FROM pages)""")
def p24_path_to_root(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url", links.path_to_root(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1)).alias("root"))


@query("""SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'func f<T>() where T: P' ELSE 'func f()' END AS declaration, CASE WHEN p_type LIKE 'PROMO%' THEN 'T: P' END AS requirements,
'c:objc(cs)T' || p_size AS type_usr FROM part""")
def p12_declaration_columns(spark, sf_dir):
    d = F.when(F.col("p_type").startswith("PROMO"), F.lit("func f<T>() where T: P")).otherwise(F.lit("func f()"))
    usr = F.concat(F.lit("c:objc(cy)T"), F.col("p_size").cast("string"), F.lit("@Cat"))
    return read(spark, sf_dir, "part").select("p_partkey", d.alias("declaration"), decls.generic_requirements(d).alias("requirements"), decls.type_usr(usr).alias("type_usr"))


@query(r"""WITH c AS (SELECT doc_id, 'Parameter ' || source || ': ' || lang AS a, upper(lang) || ': ' || source AS b FROM documents)
SELECT doc_id, regexp_extract(a, '^Parameter ([^:]*): (.*)$', 1) AS title, regexp_extract(a, '^Parameter ([^:]*): (.*)$', 2) AS body, 'parameter' AS kind, CASE WHEN lower(regexp_extract(b, '^(\w+):', 1)) IN ('note', 'see') THEN 'term' END AS other FROM c""")
def p21_callouts(spark, sf_dir):
    a = decls.callout(F.concat(F.lit("Parameter "), F.col("source"), F.lit(": "), F.col("lang")))
    b = decls.callout(F.concat(F.upper("lang"), F.lit(": "), F.col("source")))
    return read(spark, sf_dir, "documents").select("doc_id", a["title"].alias("title"), a["body"].alias("body"), a["kind"].alias("kind"), b["kind"].alias("other"))


@query("""WITH i AS (SELECT p_partkey, p_name || '.' || p_brand AS f, 'M' || (p_size % 2) AS m FROM part), k AS (SELECT p_partkey, unnest(list_distinct([f, m || '.' || f])) AS key FROM i)
SELECT key, max(p_partkey) AS item_id FROM k GROUP BY key""")
def l01_name_index(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("path"), F.lit("swift").alias("language"), F.concat_ws(".", "p_name", "p_brand").alias("full_name"), F.concat(F.lit("M"), (F.col("p_size") % 2).cast("string")).alias("module_name"))
    return links.name_index(p).select("key", "item_id")


@query("""WITH e AS (SELECT p_partkey, unnest(list_distinct([p_name, p_brand])) AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS parent_name, nullif(CASE WHEN p_size > 25 THEN p_type ELSE '' END, '') AS abstract FROM part)
SELECT p_partkey AS url, name, abstract, parent_name FROM e""")
def l11_search_entries(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("abstract"), F.col("p_type").alias("parent_name"), (F.col("p_size") % 2 == 0).alias("parent_is_def"), F.col("p_name").alias("swift_name"), F.col("p_brand").alias("objc_name"))
    return links.search_entries(p)


@query(f"WITH {_TREE} SELECT array_to_string(p, '/') AS path, len(p) AS crumbs, q AS trail FROM h")
def l12_breadcrumbs(spark, sf_dir):
    h = hierarchy(spark, sf_dir)
    b = pages.breadcrumbs(h)
    return b.select(F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.size("breadcrumbs").cast("long").alias("crumbs"), F.array_join("breadcrumbs", ".").alias("trail"))


@query(f"WITH {_TREE}, v AS (SELECT p FROM h JOIN orders ON len(p) = 4 AND p[4] = o_orderkey AND o_totalprice > 300000), a AS (SELECT DISTINCT unnest([p[1:1], p[1:2], p[1:3], p]) AS p FROM v) SELECT len(p) AS depth, count(*) AS n FROM a GROUP BY 1")
def l13_toc(spark, sf_dir):
    dear = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").cast("long").alias("k"))
    h = hierarchy(spark, sf_dir).withColumn("at", F.get("path", F.lit(3))).join(dear, F.col("at") == F.col("k"), "left")
    h = h.select("path", F.when(F.size("path") < 4, "group").otherwise("def").alias("item_type"), F.when(F.col("k").isNotNull(), "yes").otherwise("no").alias("show_in_toc"), F.lit("swift").alias("primary_language"), F.lit(None).cast("string").alias("secondary_language"))
    return pages.toc(h, "swift").groupBy(F.size("path").cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, lang FROM (SELECT page_id FROM pages) CROSS JOIN (SELECT unnest(['en', 'fr']) AS lang)""")
def l15_page_languages(spark, sf_dir):
    return pages.page_languages(read(spark, sf_dir, "pages").select("page_id"), ["en", "fr"]).select("page_id", F.col("language").alias("lang"))


@query("""WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) SELECT doc_id, CASE WHEN len(l) < 2 THEN 'one' ELSE sha256(array_to_string(list_transform(l, lambda x: '- ' || trim(x)), chr(10))) END AS list FROM p""")
def l17_paragraph_list(spark, sf_dir):
    m = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    p = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.size(p) < 2, "one").otherwise(F.sha2(links.paragraphs_to_list(m), 256)).alias("list"))


@query("""WITH o AS (SELECT l_orderkey, l_suppkey, l_partkey % 7 AS k FROM lineitem), c AS (SELECT DISTINCT l_suppkey, k, l_orderkey % 5 AS m FROM o)
SELECT l_suppkey AS type_usr, k::VARCHAR AS constraint_key, count(DISTINCT m) AS members, string_agg(m::VARCHAR, ',' ORDER BY m) AS conforms FROM c GROUP BY ALL""")
def r11_extension_map(spark, sf_dir):
    o = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("s"), (F.col("l_partkey") % 7).cast("string").alias("k"), (F.col("l_orderkey") % 5).cast("string").alias("m")).distinct()
    members = o.select(F.lit(False).alias("into_target"), F.col("s").alias("target"), F.col("k").alias("constraint_key"), F.col("m").alias("ord"), F.col("m").alias("source"))
    conforms = o.select(F.col("s").alias("source"), F.array("k").alias("constraints"), F.col("m").alias("target_name"))
    e = graph.extension_map(members, conforms)
    return e.select(F.col("type_usr").cast("long").alias("type_usr"), "constraint_key", F.size("members").cast("long").alias("members"), F.array_join("conforms_to", ",").alias("conforms"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 20 THEN p_partkey // 3 END AS up FROM part), t AS (SELECT id, id AS root, 0 AS depth FROM e WHERE up IS NULL UNION ALL SELECT e.id, t.root, t.depth + 1 FROM e JOIN t ON e.up = t.id) SELECT id, root, depth FROM t""")
def r05_forest(spark, sf_dir):
    v = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("usr"))
    m = v.where("usr > 20").select(F.lit(True).alias("into_target"), F.col("usr").alias("source"), F.expr("usr div 3").alias("target"), F.lit(0).alias("ord"))
    return graph.rebuild(v, m, Tables(spark)).select(F.col("usr").alias("id"), F.col("root_usr").alias("root"), "depth")


@query("SELECT CASE WHEN p < 10 THEN 'red' WHEN p < 30 THEN 'orange' WHEN p < 60 THEN 'yellow' WHEN p < 85 THEN 'yellowgreen' WHEN p < 90 THEN 'green' ELSE 'brightgreen' END AS colour, count(*) AS n FROM (SELECT c_custkey % 101 AS p FROM customer) GROUP BY 1")
def k13_badge(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy(stats.badge_colour(F.col("c_custkey") % 101).alias("colour")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_name AS en, CASE WHEN p_size > 25 THEN p_brand ELSE p_name END AS fr, replace('%1 of %2', '%1', p_name) AS m FROM part""".replace("replace('%1 of %2', '%1', p_name)", "p_name || ' of ' || p_brand"))
def m01_filled_maps(spark, sf_dir):
    m = F.when(F.col("p_size") > 25, F.create_map(F.lit("en"), "p_name", F.lit("fr"), "p_brand")).otherwise(F.create_map(F.lit("en"), "p_name"))
    f = maps.filled(m, ["en", "fr"], "en")
    return read(spark, sf_dir, "part").select("p_partkey", maps.get(f, "en").alias("en"), maps.get(f, "fr").alias("fr"), maps.message(F.lit("%1 of %2"), F.col("p_name"), F.col("p_brand")).alias("m"))


@query("""SELECT page_id, url, replace(replace(replace(url, '%', '%25'), '?', '%3F'), '#', '%23') AS coded FROM pages""")
def t09_url_encoding(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", X.url_path_encoded(F.col("url")).alias("coded"))


@query("""WITH r AS (SELECT r_regionkey, n_nationkey FROM region LEFT JOIN nation ON n_regionkey = r_regionkey) SELECT r_regionkey, count(n_nationkey) AS kids, '{"n":' || count(n_nationkey) || ',"r":' || r_regionkey || '}' AS json FROM r GROUP BY 1""")
def k03_json(spark, sf_dir):
    from arborql.sources import sinks

    n = read(spark, sf_dir, "nation")
    g = read(spark, sf_dir, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_regionkey").agg(F.count("n_nationkey").alias("kids"))
    return sinks.as_json(g.withColumns({"n": F.col("kids"), "r": F.col("r_regionkey"), "none": F.lit(None).cast("string")}), ["r", "n", "none"]).select("r_regionkey", "kids", "json")


@query("""SELECT c_custkey, c_name AS name, count(o_orderkey) AS kids, min(o_orderkey)::VARCHAR AS first_kid FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def k02_nesting(spark, sf_dir):
    """A JSON tree a customer, of all orders."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root"), F.array(F.col("c_custkey").cast("long")).alias("path"), F.col("c_name").alias("name"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), F.array(F.col("o_custkey").cast("long"), F.col("o_orderkey").cast("long")).alias("path"), F.col("o_orderkey").cast("string").alias("name"))
    j = tree.nest(c.unionByName(o), ["name"], ["root"], 2).select("root", F.from_json("json", "name string, children array<struct<name:string>>").alias("j"))
    kids = F.coalesce("j.children", F.array().cast("array<struct<name:string>>"))
    return j.select(F.col("root").alias("c_custkey"), "j.name", F.size(kids).cast("long").alias("kids"), F.get(kids, F.lit(0))["name"].alias("first_kid"))
