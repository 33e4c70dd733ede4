"""Queries for symbol trees: forests with rings, the second pass over default implementations, and extensions folded into
their types, with their DuckDB SQL. Stand-ins as in ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborql.model import OBJC, SWIFT
from arborql.operators import decls, graph, group, links, merge
from arborql.plans.catalogue import query, read
from arborql.tables import Tables


def text(c: str):
    return F.col(c).cast("string")


@query("""WITH RECURSIVE v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 1000 < 3 THEN o_orderkey // 1000 * 1000 + (o_orderkey + 1) % 3 WHEN o_orderkey % 1000 = 999 THEN -1 WHEN o_orderkey % 1000 = 500 THEN NULL
  WHEN o_orderkey % 1000 > 500 THEN o_orderkey // 1000 * 1000 + 500 + (o_orderkey % 1000 - 500) // 2 ELSE o_orderkey // 1000 * 1000 + o_orderkey % 1000 // 2 END AS up, o_orderkey % 11 = 0 AS bad FROM orders),
t AS (SELECT v.id, v.up, v.id AS root, 0 AS depth, CASE WHEN v.up IS NOT NULL THEN 'orphan' WHEN v.bad THEN 'bad' ELSE 'root' END AS state FROM v LEFT JOIN v p ON p.id = v.up WHERE p.id IS NULL
  UNION ALL SELECT v.id, v.up, t.root, t.depth + 1, 'placed' FROM v JOIN t ON v.up = t.id),
o AS (SELECT id, up FROM v WHERE id NOT IN (SELECT id FROM t)), w AS (SELECT id, up AS seen FROM o UNION SELECT w.id, o.up FROM w JOIN o ON o.id = w.seen),
ring AS (SELECT id FROM w WHERE seen = id), ends AS (SELECT w.id, min(seen) AS low FROM w JOIN ring ON ring.id = w.seen GROUP BY w.id)
SELECT id, root, depth, state FROM t UNION ALL SELECT ends.id, low, NULL, CASE WHEN ring.id IS NULL THEN 'below ring' ELSE 'ring' END FROM ends LEFT JOIN ring USING (id)""")
def r05_rings(spark, sf_dir):
    """GR5: of every thousand orders three make a ring, what halves down to them lies below it, one heads a tree and one
    has a parent that is no order."""
    v = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("usr"))
    at, base = F.col("usr") % 1000, F.col("usr") - F.col("usr") % 1000
    up = F.when(at < 3, base + (F.col("usr") + 1) % 3).when(at == 999, F.lit(-1)).when(at == 500, F.lit(None)).when(at > 500, base + 500 + F.expr("(usr % 1000 - 500) div 2")).otherwise(base + F.expr("usr % 1000 div 2"))
    members = v.select(F.lit(True).alias("into_target"), F.col("usr").alias("source"), up.cast("long").alias("target"), F.lit(0).alias("ord")).where("target is not null")
    out = graph.rebuild(v, members, Tables(spark), bad=v.where("usr % 11 = 0"))
    return out.select(F.col("usr").alias("id"), F.col("root_usr").alias("root"), "depth", "state")


@query("""WITH m AS (SELECT c_custkey, c_nationkey, c_acctbal >= 0 AS req FROM customer), e AS (SELECT o_orderkey, o_custkey, o_totalprice > 150000 AS wide, o_orderkey % 13 = 0 AS lost, o_orderkey % 2 = 0 AS own FROM orders),
d AS (SELECT e.*, CASE WHEN req THEN c_nationkey END AS p FROM e LEFT JOIN m ON c_custkey = o_custkey)
SELECT o_orderkey, 'n' || p AS protocol, CASE WHEN NOT lost AND p IS NOT NULL THEN CASE WHEN wide THEN 'Self.Element : Ordered' ELSE '' END || CASE WHEN NOT own AND p % 2 = 0 THEN CASE WHEN wide THEN ', ' ELSE '' END || 'Item == Int' ELSE '' END END AS constraints,
CASE WHEN lost THEN 'missing source' WHEN p IS NULL THEN 'default implementation of an unplaced requirement' END AS warning, NOT lost AND p IS NULL AS bad FROM d""")
def j03_second_pass(spark, sf_dir):
    """JN3: orders implement what customers require; customers with debts are members of extensions, so what implements
    those is bad. Nations are the protocols, every second one with a constraint of its own."""
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), text("n_nationkey")).alias("usr"), F.when(F.col("n_nationkey") % 2 == 0, strings("Self : Base")).otherwise(strings("Self : Base", "Item == Int")).alias("constraints"), strings().alias("generic_params"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), text("c_custkey")).alias("usr"), strings("Self : Base").alias("constraints"), strings().alias("generic_params"), "c_nationkey", "c_acctbal")
    o = read(spark, sf_dir, "orders")
    wide, own = F.col("o_totalprice") > 150000, F.col("o_orderkey") % 2 == 0
    some = F.concat(strings("Self : Base"), F.when(wide, strings("Self.Element : Ordered")).otherwise(strings()), strings("Item == Int"))
    impl = o.where("o_orderkey % 13 <> 0").select(F.concat(F.lit("o"), text("o_orderkey")).alias("usr"), some.alias("constraints"), F.when(own, strings("Item")).otherwise(strings()).alias("generic_params"))
    first = c.select(F.col("usr").alias("source"), F.concat(F.lit("n"), text("c_nationkey")).alias("target"), F.lit(0).alias("ord"), (F.col("c_acctbal") >= 0).alias("into_target"))
    e = o.select(F.col("o_orderkey").alias("ord"), F.lit("defaultImplementationOf").alias("kind"), F.concat(F.lit("o"), text("o_orderkey")).alias("source"), F.concat(F.lit("c"), text("o_custkey")).alias("target"))
    out = graph.second_pass(e, n.unionByName(c.drop("c_nationkey", "c_acctbal")).unionByName(impl), first)
    return out.select(F.col("ord").alias("o_orderkey"), F.when(F.col("source").isNotNull(), F.col("target")).alias("protocol"), F.col("constraint_key").alias("constraints"), "warning", "bad")


@query("""WITH x AS (SELECT s_suppkey, s_nationkey AS t, s_acctbal < 0 AS con, 'm' || s_suppkey % 3 AS m, 'm' || s_nationkey % 2 AS tm FROM supplier),
k AS (SELECT c_custkey, x.*, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'own' || c_custkey END AS name FROM customer JOIN x ON s_suppkey = c_custkey % 10 + 1),
w AS (SELECT *, CASE WHEN starts_with(name, 'own') THEN 'only' WHEN con THEN 'conditional' ELSE 'default' END AS what FROM k),
base AS (SELECT greatest((SELECT max(o_orderkey) FROM orders JOIN k ON c_custkey = o_custkey), (SELECT max(1000000 + s_suppkey) FROM supplier), (SELECT max(c_custkey) FROM k)) AS v),
p AS (SELECT c_custkey, t || '/' || (v + row_number() OVER (ORDER BY t, con, s_suppkey, c_custkey)) AS path, name, what, con, m, tm FROM w, base WHERE what <> 'default'),
req AS (SELECT n_nationkey AS t, s AS name, 'm' || n_nationkey % 2 AS tm FROM nation, unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) u(s)),
given AS (SELECT t, name, list_sort(list(DISTINCT CASE WHEN what = 'conditional' THEN 'conditionalDefaultImplementationExists' WHEN m <> tm THEN 'importedDefaultImplementation:' || m ELSE 'defaultImplementation' END)) AS notes,
  arg_max(c_custkey, [s_suppkey, c_custkey]) FILTER (what = 'default') AS docs FROM w WHERE what <> 'only' GROUP BY ALL)
SELECT n_nationkey::VARCHAR AS path, n_name AS name, '' AS notes, NULL::VARCHAR AS docs, NULL::VARCHAR AS default_docs FROM nation
UNION ALL SELECT t || '/' || ascii(name), req.name, coalesce(array_to_string(notes, ','), ''), NULL, docs::VARCHAR FROM req LEFT JOIN given USING (t, name)
UNION ALL SELECT path, name, concat_ws(',', CASE WHEN what = 'conditional' THEN 'conditionalDefaultImplementation' END, CASE WHEN m <> tm THEN 'imported:' || m END, CASE WHEN what = 'only' THEN 'protocolExtensionMember' END),
  CASE WHEN what = 'only' THEN c_custkey::VARCHAR END, CASE WHEN what = 'conditional' THEN c_custkey::VARCHAR END FROM p
UNION ALL SELECT path || '/' || o_orderkey, o_orderkey::VARCHAR, CASE WHEN m <> tm THEN 'imported:' || m ELSE '' END, o_orderkey::VARCHAR, NULL FROM p JOIN orders ON o_custkey = c_custkey""")
def a09_folded_protocols(spark, sf_dir):
    """JN4, AGG7, AGG9: nations are protocols that require a function for each market segment, suppliers extend them (those
    in debt under constraints), customers are the extensions' members, and orders lie below."""
    n, s, c, o = (read(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "orders"))
    i = lambda x: F.col(x).cast("long")
    ext = F.lit(1_000_000) + i("s_suppkey")
    module = lambda x, k: F.concat(F.lit("m"), (F.col(x) % k).cast("string"))
    null = F.lit(None).cast("string")
    row = lambda d, path, name, kind, mod, docs: d.select(F.array(*path).alias("path"), name.alias("name"), F.lit(kind).alias("kind"), mod.alias("module_name"), docs.alias("docs"))
    of = c.join(s.select("s_suppkey"), F.col("c_custkey") % 10 + 1 == F.col("s_suppkey"))
    name = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("own"), text("c_custkey")))
    segments = n.withColumn("c_mktsegment", F.explode(F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))))
    rows = [
        row(n, [i("n_nationkey")], F.col("n_name"), "swift.protocol", module("n_nationkey", 2), null), row(segments, [i("n_nationkey"), F.ascii("c_mktsegment").cast("long")], F.col("c_mktsegment"), "f", module("n_nationkey", 2), null),
        row(s, [ext], F.col("s_name"), "swift.extension", module("s_suppkey", 3), null), row(of, [ext, i("c_custkey")], name, "f", module("s_suppkey", 3), text("c_custkey")),
        row(of.join(o, F.col("o_custkey") == F.col("c_custkey")), [ext, i("c_custkey"), i("o_orderkey")], text("o_orderkey"), "p", module("s_suppkey", 3), text("o_orderkey")),
    ]
    every = rows[0].union(rows[1]).union(rows[2]).union(rows[3]).union(rows[4])
    claims = s.select(F.array(ext).alias("ext_path"), F.array(i("s_nationkey")).alias("type_path"), (F.col("s_acctbal") < 0).alias("is_constrained"))
    out = merge.folded_extensions(every, claims, Tables(spark))
    notes = F.array_join(F.transform("notes", lambda x: F.concat_ws(":", x["tag"], x["arg"])), ",")
    return out.select(F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "name", notes.alias("notes"), "docs", "default_docs")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '+[' || p_brand || ' ' || p_name || ':]' WHEN 1 THEN '-[' || p_brand || ' ' || p_name || ':]' WHEN 2 THEN p_mfgr || '.' || p_brand || '.' || p_name || ':' ELSE p_name || ':' END AS qualified
FROM (SELECT *, p_type AS p_mfgr FROM part)""")
def p11_objc_names(spark, sf_dir):
    """PRJ11: full names of Objective-C methods, with their class in brackets, and of others, dotted."""
    f = F.col("p_partkey") % 4
    kind = F.when(f == 0, OBJC + "method.class").when(f == 1, OBJC + "method.instance").when(f == 2, OBJC + "property").otherwise(OBJC + "method.instance")
    ups = F.when(f == 3, F.array().cast("array<string>")).otherwise(F.array("p_type", "p_brand"))
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", decls.qualified_name(ups, F.concat("p_name", F.lit(":")), kind, F.lit("")).alias("qualified"))


@query("""WITH w AS (SELECT item_id, lower(unnest(string_split_regex(text, '[^\\p{L}\\p{N}_\\p{M}]+'))) AS t FROM benchmark), s AS (
SELECT item_id, max(CASE WHEN t = 'on' THEN 100 ELSE 0 END) + max(CASE WHEN starts_with(t, 'on') THEN 10 ELSE 0 END) + max(CASE WHEN t = 'th' THEN 100 ELSE 0 END) + max(CASE WHEN starts_with(t, 'th') THEN 10 ELSE 0 END) AS score FROM w GROUP BY 1)
SELECT item_id, score::BIGINT AS score FROM s WHERE score > 0 ORDER BY score DESC, item_id LIMIT 25""")
def or10_postings(spark, sf_dir):
    """OR10: a search that reads the postings of its terms only, from an index that is written once."""
    index = Tables(spark).write(links.postings(read(spark, sf_dir, "benchmark"), "item_id", ["text"]))
    return links.search_postings(index, ["on", "th"], 25).select(F.col("id").alias("item_id"), "score")


@query("""WITH g AS (SELECT 'abstract' AS kind, p_name AS name FROM part UNION SELECT 'title', p_brand FROM part), t AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 20 UNION SELECT p_brand FROM part WHERE p_size = 1),
l AS (SELECT kind, name FROM g WHERE name NOT IN (SELECT name FROM t)) SELECT kind, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM l GROUP BY kind
UNION ALL SELECT 'member', count(*), string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey::VARCHAR) FROM (SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 30))""")
def set5_unmatched(spark, sf_dir):
    """SET5: abstracts and titles that no item takes, and listed members that no type has."""
    p, s = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    given = p.select(F.lit("abstract").alias("kind"), F.col("p_name").alias("name")).union(p.select(F.lit("title"), F.col("p_brand")))
    taken = p.where("p_size < 20").select(F.col("p_name").alias("name")).union(p.where("p_size = 1").select("p_brand"))
    children = p.where("p_size > 30").select(F.lit("T").alias("type_name"), F.concat(F.lit("n"), text("p_partkey")).alias("name"), text("p_partkey").alias("declaration"))
    lost = group.missing_members(children, s.select(F.lit("T").alias("type_name"), text("s_suppkey").alias("entry")))
    members = lost.groupBy(F.lit("member").alias("kind")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("entry")).alias("names"))
    return group.unmatched(given, taken, ["name"]).unionByName(members).select("kind", "n", F.array_join("names", ",").alias("names"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '<h2 id="' || lower(replace(p_name, ' ', '-')) || '-code-' || p_size || '">' || p_name || ' <code>code &lt;' || p_size || '</code></h2>' || chr(10) || '<p>Made by <em>' || p_brand || '</em> &amp; sold. As ' || p_type || '.</p>'
WHEN 1 THEN '<ul><li>' || p_name || ' goes on</li><li><strong>' || p_brand || '</strong> at <a href="http://x.dev/' || p_partkey || '?a=1&b=2">here</a></li></ul>'
WHEN 2 THEN '<pre><code class="language-swift">let x = &quot;' || p_name || '&quot;' || chr(10) || chr(10) || '# ' || p_size || '</code></pre>' || chr(10) || '<blockquote><p>' || p_type || '</p></blockquote>'
ELSE '<p><img src="i/' || p_partkey || '.png" alt="' || p_name || '" style="width: ' || p_size || '%"/> a_b_c</p>' END AS html FROM part""")
def lnk7_html(spark, sf_dir):
    """LNK7: headings with anchors, paragraphs, lists, code, quotes, links, images, emphasis."""
    n, f, size = F.col("p_name"), F.col("p_size") % 4, text("p_size")
    lit = F.lit
    md = F.when(f == 0, F.concat(lit("## "), n, lit(" `code <"), size, lit("` ##\nMade by *"), "p_brand", lit("* & sold.\nAs "), "p_type", lit(".\n"))).when(
        f == 1, F.concat(lit("- "), n, lit("\n  goes on\n* **"), "p_brand", lit("** at [here](http://x.dev/"), text("p_partkey"), lit("?a=1&b=2)"))).when(
        f == 2, F.concat(lit('```\nlet x = "'), n, lit('"\n\n# '), size, lit("\n```\n> "), "p_type")).otherwise(F.concat(lit("!["), n, lit("|"), size, lit("%](i/"), text("p_partkey"), lit(".png) a_b_c")))
    return read(spark, sf_dir, "part").select("p_partkey", decls.to_html(md).alias("html"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 < 2 THEN '@objc' || chr(10) ELSE '' END || CASE p_size % 4 WHEN 0 THEN 'func f' || p_size || '(of: Inner) -> T<Int>' WHEN 1 THEN 'extension Inner : P' || p_size WHEN 2 THEN 'func g' || p_size || '(a: Int,' || chr(10) || '     b: Int)' ELSE 'var v' || p_size || ': Inner' END AS declaration,
CASE WHEN p_size % 4 IN (1, 2) THEN 'parsed' ELSE 'compiler' END AS name_source, CASE WHEN p_size % 5 = 3 THEN 'iOS ' || p_size || '+' ELSE '' END AS available, CASE WHEN p_size % 5 = 4 THEN 'deprecated: ' || p_name END AS deprecated FROM part""")
def p14_assembled(spark, sf_dir):
    """PRJ14: declarations out of the compiler's and the parser's texts, with attributes and availability."""
    f, n = F.col("p_size") % 4, text("p_size")
    lit = F.lit
    d = lambda *x: F.concat(lit("<Declaration><syntaxtype.attribute.builtin>@objc</syntaxtype.attribute.builtin> "), *x, lit("</Declaration>"))
    annotated = F.when(f == 0, d(lit("func f"), n, lit("(of: <Type>Outer&lt;Int&gt;.Inner</Type>) -&gt; T&lt;Int&gt;"))).when(f == 1, d(lit("struct Inner"))).when(f == 2, d(lit("func g"), n, lit("(a: Int, b: Int)"))).otherwise(d(lit("var v"), n, lit(": Outer.Inner {\n  get\n  }")))
    parsed = F.when(f == 1, F.concat(lit("extension Inner : P"), n)).when(f == 2, F.concat(lit("@objc func g"), n, lit("(a: Int,\n           b: Int)"))).when(f == 3, lit("var v: Inner {\n  1\n}"))
    kind = F.when(f == 0, SWIFT + "function.method.instance").when(f == 1, SWIFT + "extension").when(f == 2, SWIFT + "function.free").otherwise(SWIFT + "var.instance")
    k = F.col("p_size") % 5
    attrs = F.when(k < 2, F.array(lit("@objc"))).when(k == 3, F.array(F.concat(lit("@available(iOS "), n, lit(", *)")))).when(k == 4, F.array(F.concat(lit('@available(*, deprecated, message: "'), "p_name", lit('")'))))
    p = read(spark, sf_dir, "part").select("p_partkey", decls.assembled_declaration(annotated, parsed, attrs, F.array(lit("Outer"), lit("Inner")), kind).alias("d"))
    return p.select("p_partkey", "d.declaration", "d.name_source", F.array_join("d.available", ",").alias("available"), "d.deprecated")
