"""Sources, projections, filters, orders and text functions over the driver's tables, with their DuckDB SQL. Sources are
written from the tables in the form that a reader takes, in the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.functions import maps
from arborql.functions import text as X
from arborql.model import ACCESS, OBJC, SWIFT, acl_of, kind_predicates
from arborql.operators import decls, filters, graph, group, links, merge, ordered, pages, stats, tree
from arborql.plans.catalogue import query, read
from arborql.sources import readers, sinks
from arborql.tables import Tables


def files(df: DataFrame, key: str, tables: Tables, name: str) -> str:
    """A text file for each row of (key, value): folders in the order of the key."""
    path = tables.folder(name)
    df.select(key, "value").write.partitionBy(key).text(path)
    return path


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return read(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "n_nationkey", "n_name")


def by_region(n: DataFrame, row, start: str, end: str) -> DataFrame:
    """(r_regionkey, value): the JSON array of a region's rows in order, between two texts."""
    g = n.groupBy("r_regionkey", "r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("j")))), lambda x: x["j"]), ",").alias("js"))
    return g.select("r_regionkey", F.concat(F.lit(start), F.col("js"), F.lit(end)).alias("value"))


_NATIONS = "n AS (SELECT r_regionkey, r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS pos FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {_NATIONS} SELECT r_regionkey AS region, '0' AS path, NULL AS name, NULL AS usr, NULL AS doc_line, 'parse' AS stage FROM region
UNION ALL SELECT r_regionkey, '0/' || pos, n_name, 'n' || n_nationkey, n_nationkey, NULL FROM n""")
def src1_symbols(spark, sf_dir):
    """SRC1, PRJ1, PRJ4: symbol JSON read, flattened, projected."""
    row = F.to_json(F.struct(F.col("n_name").alias("key.name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key.usr"), F.col("n_nationkey").alias("key.doc.line")))
    value = by_region(nations(spark, sf_dir), row, '[{"/src/A.swift":{"key.diagnostic_stage":"parse","key.substructure":[', "]}}]")
    raw = readers.raw_symbols(spark, files(value, "r_regionkey", Tables(spark), "symbols")).where("v is not null")
    raw.select(F.regexp_extract("file", r"r_regionkey=(\d+)", 1).alias("region"), "v").createOrReplaceTempView("src1_rows")
    d = readers.project(tree.flatten_variant(spark, "src1_rows"))
    return d.select(F.col("region").cast("long").alias("region"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "name", "usr", "doc_line", F.col("diagnostic_stage").alias("stage"))


@query(f"""WITH {_NATIONS}, k AS (SELECT r_regionkey, pos, 'M' || (n_nationkey // 3 % 2) AS m, n_nationkey // 6 % 2 AS p FROM n WHERE n_nationkey <> 7),
s AS (SELECT *, CASE WHEN m = lag(m) OVER w AND p = lag(p) OVER w THEN 0 ELSE 1 END AS st FROM k WINDOW w AS (ORDER BY r_regionkey, pos)), i AS (SELECT *, sum(st) OVER (ORDER BY r_regionkey, pos) AS pass_no FROM s)
SELECT r_regionkey AS region, pos AS seq, m AS module_name, p AS pass_index, pass_no::BIGINT AS pass_no FROM i WHERE m = 'M1'""")
def src2_reimport(spark, sf_dir):
    """SRC2, SRC3, WIN9: passes of re-imported files; a later version goes."""
    k = F.col("n_nationkey")
    row = F.to_json(F.struct(F.struct(F.when(k == 7, "9.0").otherwise("1.9.0").alias("key.bb.version"), F.concat(F.lit("M"), F.expr("n_nationkey div 3 % 2").cast("string")).alias("key.bb.module_name"), F.expr("n_nationkey div 6 % 2").alias("key.bb.pass_index")).alias("/f")))
    path = files(by_region(nations(spark, sf_dir), row, "[", "]"), "r_regionkey", Tables(spark), "passes")
    r = readers.import_filter(readers.reimported(spark, path), "M1")
    return r.select(F.regexp_extract("file", r"r_regionkey=(\d+)", 1).cast("long").alias("region"), F.col("file_seq").alias("seq"), "module_name", "pass_index", F.col("pass_no").cast("long").alias("pass_no"))


@query(f"""WITH {_NATIONS} SELECT 'n' || n_nationkey AS usr, n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'source.lang.swift.decl.class' WHEN 1 THEN 'source.lang.swift.decl.struct' END AS kind,
CASE WHEN n_nationkey % 5 > 0 THEN 'public' END AS acl, n_name || chr(10) || 'more' AS docs, 'T : P,T == X' AS constraints,
CASE WHEN n_nationkey % 3 = 2 THEN 'unknown kind' WHEN n_nationkey % 5 = 0 THEN 'unknown access level' END AS warning,
row_number() OVER (PARTITION BY r_regionkey ORDER BY CASE WHEN n_nationkey % 4 > 0 THEN 'f' || (n_nationkey % 4) END NULLS LAST, CASE WHEN n_nationkey % 4 > 0 THEN -n_nationkey END NULLS LAST, n_name) AS place FROM n""")
def src4_symbol_graphs(spark, sf_dir):
    """SRC4, GR6, OR4: symbol graphs decoded and normalized; unknown kinds and access levels are rows with a warning."""
    k = F.col("n_nationkey")
    s = lambda **f: F.struct(*[v.alias(n) for n, v in f.items()])
    lit, one = F.lit, lambda kind, lhs, rhs: F.struct(F.lit(kind).alias("kind"), F.lit(lhs).alias("lhs"), rhs.alias("rhs"))
    row = F.to_json(s(
        kind=s(identifier=F.when(k % 3 == 0, "swift.class").when(k % 3 == 1, "swift.struct").otherwise("swift.odd")), identifier=s(precise=F.concat(lit("n"), k.cast("string"))), pathComponents=F.array("n_name"),
        docComment=s(lines=F.array(s(text=F.col("n_name")), s(text=lit("more")))), accessLevel=F.when(k % 5 > 0, "public").otherwise("odd"),
        swiftGenerics=s(constraints=F.array(one("sameType", "T", lit("X")), one("conformance", "T", lit("P")), one("conformance", "Self", F.col("n_name")), one("odd", "T", lit("P")))),
        swiftExtension=s(constraints=F.array(one("conformance", "T", lit("P")))),
        location=F.when(k % 4 > 0, s(uri=F.concat(lit("f"), (k % 4).cast("string")), position=s(line=-k, character=lit(0))))))
    path = files(by_region(nations(spark, sf_dir), row, '{"metadata":{"generator":"g"},"relationships":[],"symbols":[', "]}"), "r_regionkey", Tables(spark), "graphs")
    v = graph.symbols(readers.symbol_graphs(spark, path)).withColumn("place", F.row_number().over(W.partitionBy("ord.file_ord").orderBy(*graph.symbol_order())).cast("long"))
    return v.select("usr", "name", "kind", "acl", "docs", F.array_join("constraints", ",").alias("constraints"), "warning", "place")


@query("""SELECT 'k' || n_nationkey AS key, n_name AS en, CASE WHEN n_regionkey < 3 THEN 'le "' || n_name || '"' ELSE n_name END AS fr FROM nation""")
def src19_strings(spark, sf_dir):
    """SRC19, JN9: string bundles by language, the main one where a language has none."""
    n, at = nations(spark, sf_dir), Tables(spark).folder("strings")
    line = lambda v: F.concat(F.lit('"k'), F.col("n_nationkey").cast("string"), F.lit('" = "'), v, F.lit('";'))
    n.select(line(F.col("n_name"))).write.text(f"{at}/en.lproj")
    n.where("r_regionkey < 3").select(line(F.concat(F.lit('le \\"'), "n_name", F.lit('\\"')))).write.text(f"{at}/fr.lproj")
    b = readers.string_bundles(spark, [f"{at}/en.lproj", f"{at}/fr.lproj"])
    t = readers.localized(b.select("key").distinct(), b, ["en", "fr"], "en")
    return t.select("key", F.try_element_at("texts", F.lit("en")).alias("en"), F.try_element_at("texts", F.lit("fr")).alias("fr"))


@query("SELECT unnest([n_name, 'alias ' || n_name]) AS name, 'u' || n_nationkey AS url FROM nation")
def src12_builtin(spark, sf_dir):
    at = Tables(spark).folder("builtin")
    nations(spark, sf_dir).select(F.concat("n_name", F.lit("|alias "), "n_name", F.lit("|u"), F.col("n_nationkey").cast("string"))).write.text(at)
    return readers.builtin_links(spark, at, "base/").select("name", "url")


@query(f"WITH {_NATIONS} SELECT 'p' || n_nationkey AS url, n_name AS name, CASE WHEN n_nationkey > 9 THEN 'about' END AS abstract, CASE WHEN pos > 0 THEN r_name END AS parent_name FROM n")
def src13_search(spark, sf_dir):
    n = nations(spark, sf_dir).withColumn("pos", F.row_number().over(W.partitionBy("r_regionkey").orderBy("n_nationkey")) - 1)
    e = F.struct(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") > 9, "about").alias("abstract"), F.when(F.col("pos") > 0, F.col("r_name")).alias("parent_name"))
    m = n.groupBy("r_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("k"), e.alias("v"))))).alias("value"))
    return readers.remote_search(spark, files(m, "r_regionkey", Tables(spark), "search")).select("url", "name", "abstract", "parent_name")


@query(f"WITH {_NATIONS} SELECT 'r' || r_regionkey AS module_name, 'n' || n_nationkey AS symbol, CASE WHEN n_nationkey % 2 = 0 THEN '-1a2b3' END AS suffix, n_name AS title, 'r' || r_regionkey || '/n' || n_nationkey AS key FROM n")
def src14_docc(spark, sf_dir):
    """SRC14, JN14: a nested index; groups and modules go."""
    k = F.col("n_nationkey").cast("string")
    at = F.concat(F.lit("/documentation/r"), F.col("r_regionkey").cast("string"), F.lit("/n"), k, F.when(F.col("n_nationkey") % 2 == 0, "-1a2b3").otherwise(""))
    row = F.to_json(F.struct(F.col("n_name").alias("title"), F.lit("struct").alias("type"), at.alias("path")))
    value = by_region(nations(spark, sf_dir), row, '{"interfaceLanguages":{"swift":[{"title":"M","type":"module","path":"/documentation/m","children":[{"title":"g","type":"groupMarker"},', "]}]}}")
    d = readers.remote_docc(spark, files(value, "r_regionkey", Tables(spark), "docc"))
    return d.select("module_name", "symbol", "suffix", "title", links.docc_key(F.concat_ws(".", "module_name", "symbol")).alias("key"))


@query("SELECT n_name AS module_name, '1.' || n_regionkey AS version FROM nation")
def src15_site(spark, sf_dir):
    v = nations(spark, sf_dir).groupBy("r_regionkey").agg(F.collect_list("n_name").alias("m"))
    v = v.select("r_regionkey", F.to_json(F.struct(F.concat(F.lit("1."), F.col("r_regionkey").cast("string")).alias("version"), F.col("m").alias("modules"))).alias("value"))
    return readers.site_record(spark, files(v, "r_regionkey", Tables(spark), "site")).select("module_name", "version")


@query(f"""WITH p AS (SELECT *, p_size % 6 AS c FROM part) SELECT p_partkey, CASE c WHEN 0 THEN '{SWIFT}function.constructor' WHEN 1 THEN '{SWIFT}function.destructor' WHEN 2 THEN '{SWIFT}function.operator' WHEN 3 THEN '{SWIFT}actor' WHEN 4 THEN '{OBJC}property.class' ELSE '{SWIFT}function.method.instance' END AS kind,
CASE c WHEN 2 THEN '+(Int:T' || p_size || ':)' WHEN 0 THEN 'init(x:)' WHEN 1 THEN 'deinit' ELSE p_name END AS name, CASE WHEN c = 5 THEN 'Cls' || p_size ELSE 'other' END AS category, CASE c WHEN 1 THEN 'internal' WHEN 0 THEN 'public' ELSE 'internal' END AS acl, c > 1 AS guessed FROM p""")
def p02_kinds(spark, sf_dir):
    """PRJ2, PRJ3, PRJ10, ST18: kinds made exact by name and declaration, operators' names, access levels."""
    c, n = F.col("c"), F.col("p_size").cast("string")
    p = read(spark, sf_dir, "part").withColumn("c", F.col("p_size") % 6)
    kind = F.when(c == 3, SWIFT + "class").when(c == 4, OBJC + "property").otherwise(SWIFT + "function.method.instance")
    name = F.when(c == 0, "init(x:)").when(c == 1, "deinit").when(c == 2, "+(_:_:)").otherwise(F.col("p_name"))
    decl = F.when(c == 2, F.concat(F.lit("static func + (a: Int, b: T"), n, F.lit(")"))).when(c == 3, "public actor A").when(c == 4, "@property (class, readonly) int x").otherwise("func x()")
    acl = acl_of(name, F.when(c == 0, ACCESS + "public"), F.lit(False))
    cat = X.category_name(F.when(c == 5, F.concat(F.lit("Cls"), n, F.lit("(Cat)"))).otherwise("plain"))
    p = p.select("p_partkey", decls.adjusted_kind(kind, name, decl, F.lit(None)).alias("kind"), decls.operator_name(name, decl).alias("name"), cat.alias("cat"), acl.alias("a"))
    return p.select("p_partkey", "kind", "name", F.coalesce("cat.class", F.lit("other")).alias("category"), "a.acl", "a.guessed")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'open' ELSE 'public' END AS acl, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS primary_name, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS other_name,
'src/' || p_size AS file, CASE WHEN p_size > 20 THEN p_size ELSE p_partkey END AS first_line, 'https://h/a%20b.swift#L' || p_size || CASE WHEN p_size < p_partkey THEN '-L' || p_partkey WHEN p_size > p_partkey THEN '-L' || p_partkey ELSE '' END AS url,
CASE WHEN p_size % 2 = 1 THEN p_name WHEN p_size % 3 <> 0 THEN p_name END AS shown FROM part""")
def p06_personality(spark, sf_dir):
    """PRJ6, PRJ7, PRJ8, PRJ23: languages of a row, with one hidden, its place, and its URL at a code host."""
    objc, both = F.col("p_size") % 2 == 0, F.col("p_size") % 3 != 0
    decl = F.when(both, "d")
    p = decls.language_personality(F.col("p_name"), F.when(objc, decl).otherwise("d"), F.col("p_brand"), F.when(objc, F.lit("d")).otherwise(decl), objc, F.lit("public"))
    at = decls.location(F.lit(None).cast("string"), F.concat(F.lit("src/"), F.col("p_size").cast("string")), F.when(F.col("p_size") > 20, F.col("p_size").cast("long")), F.lit(None).cast("long"), F.col("p_partkey").cast("long"))
    d = read(spark, sf_dir, "part").select("p_partkey", "p_size", p.alias("p"), at.alias("at"))
    side = lambda s, objc_side: F.when(s.isNotNull(), F.struct(F.when(objc_side, "objc").otherwise("swift").alias("language"), s["name"].alias("name")))
    is_objc = F.col("p_size") % 2 == 0
    shown = decls.shown_language(side(F.col("p.primary"), is_objc), side(F.col("p.secondary"), ~is_objc), "objc")
    url = pages.code_host_url(F.lit("https://h"), F.lit("/root/a b.swift"), F.lit("/root"), F.col("p_size"), F.col("p_partkey"))
    return d.select("p_partkey", "p.acl", F.col("p.primary.name").alias("primary_name"), F.col("p.secondary.name").alias("other_name"), F.col("at.file_pathname").alias("file"), "at.first_line", url.alias("url"), shown["primary"]["name"].alias("shown"))


@query("""WITH d AS (SELECT *, doc_id % 7 AS c FROM documents) SELECT CASE c WHEN 0 THEN 'importFailureNoRoot' WHEN 1 THEN 'importFailureNoType' WHEN 2 THEN 'importFailureNoUsr' WHEN 3 THEN 'importFailureIncomplete' ELSE CASE WHEN lang = 'de' THEN 'importExcluded' ELSE 'kept' END END AS disposition, count(*) AS n FROM d GROUP BY 1""")
def f01_import_rules(spark, sf_dir):
    """FLT1, FLT2: the first rule that holds."""
    c = F.col("doc_id") % 7
    d = read(spark, sf_dir, "documents").select("lang", F.when(c != 0, "parse").alias("diagnostic_stage"), F.when(c == 1, "<<error type>>").otherwise("T").alias("typename"), F.when(c != 2, "u").alias("usr"), F.lit("n").alias("name"), F.when(c != 3, "d").alias("declaration"))
    return d.groupBy(filters.disposition(filters.import_rules(F.col("lang") == "de")).alias("disposition")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT source, lang, n_chars, text FROM documents) SELECT CASE WHEN source NOT LIKE 'src1%' THEN 'filterFilename' WHEN regexp_matches(lang, 'e[ns]') THEN 'filterSymbolName' WHEN contains(text, '!') THEN 'filterNoDoc' WHEN n_chars % 3 = 0 THEN 'filterSpi'
WHEN n_chars % 2 = 0 AND n_chars <= 1000 THEN 'filterMinAclExcluded' ELSE 'kept' END AS disposition, count(*) AS n FROM d GROUP BY 1""")
def f05_filter_rules(spark, sf_dir):
    """FLT3 to FLT7 as one chain: names, :nodoc:, SPI, and access levels with extensions exempt."""
    n = F.col("n_chars")
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("file_pathname"), F.col("lang").alias("name"), F.when(F.contains("text", F.lit("!")), "a :nodoc: b").otherwise("a").alias("abstract"), F.lit(None).cast("string").alias("discussion"),
                                                (n % 3 == 0).alias("is_spi"), F.when(n % 2 == 0, "internal").otherwise("public").alias("acl"), (n > 1000).alias("is_swift_extension"))
    rules = filters.filter_rules(filters.FilterConfig(include_globs=["src1*"], exclude_names=["e[ns]"]))
    return d.groupBy(filters.disposition(rules).alias("disposition")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT CASE p_size % 6 WHEN 0 THEN '{SWIFT}class' WHEN 1 THEN '{SWIFT}extension.struct' WHEN 2 THEN '{OBJC}category' WHEN 3 THEN '{SWIFT}function.method.static' WHEN 4 THEN '{OBJC}enumcase' ELSE '{SWIFT}protocol' END AS kind FROM part)
SELECT kind, starts_with(kind, '{SWIFT}') AS is_swift, kind LIKE '%extension%' OR kind LIKE '%category' AS is_extension, kind LIKE '%.method%' AS is_method, kind LIKE '%enumcase' AS is_enum_element, kind LIKE '%protocol' AS is_protocol, count(*) AS n FROM k GROUP BY kind""")
def f12_predicates(spark, sf_dir):
    c = F.col("p_size") % 6
    kind = F.when(c == 0, SWIFT + "class").when(c == 1, SWIFT + "extension.struct").when(c == 2, OBJC + "category").when(c == 3, SWIFT + "function.method.static").when(c == 4, OBJC + "enumcase").otherwise(SWIFT + "protocol")
    p = kind_predicates(F.col("kind"))
    g = read(spark, sf_dir, "part").select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return g.select("kind", *[p[x].alias(x) for x in ("is_swift", "is_extension", "is_method", "is_enum_element", "is_protocol")], "n")


@query("""SELECT p_partkey, p_brand || '.' || p_size AS key, 'Class.' || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || 'm' || p_size || ':' AS objc, '*' || p_name AS first_piece, p_size <= 12 AS old_enough, regexp_matches(p_name, 'red') AS hit, 'Part ' || p_size AS mark, p_name AS sortable FROM part""")
def s04_names(spark, sf_dir):
    """ST4, ST14 to ST18, OR7: link names, Objective-C keys, version gate, marks, pieces."""
    n = F.col("p_size").cast("string")
    written = F.concat(F.lit("<doc:@"), "p_brand", F.lit("/"), n, F.lit("-1a2b3>"))
    pieces = F.array(F.struct(F.lit(False).alias("is_name"), F.lit("func ").alias("text")), F.struct(F.lit(True).alias("is_name"), F.col("p_name").alias("text")))
    objc = F.concat(F.when(F.col("p_size") % 2 == 0, "+").otherwise("-"), F.lit("[Class(Cat) m"), n, F.lit(":]"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", X.link_name(written).alias("key"), X.objc_key(objc).alias("objc"), F.concat(F.lit("*"), X.sortable_name(pieces)).alias("first_piece"), X.version_at_most(F.concat(F.lit("1."), n), F.lit("1.12.0")).alias("old_enough"),
        X.re_is_match(F.col("p_name"), "red").alias("hit"), X.mark_text(F.concat(F.lit("// MARK: - Part "), n)).alias("mark"), X.sortable_name(pieces).alias("sortable"))


@query("""WITH r AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'T' WHEN 1 THEN '.x' WHEN 2 THEN p_name WHEN 3 THEN p_brand WHEN 4 THEN 'String' ELSE 'Nowhere' END AS name FROM part), i AS (SELECT p_name, max(p_partkey) AS item_id FROM part WHERE p_size < 25 GROUP BY 1), b AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 48)
SELECT p_partkey, CASE WHEN name IN ('T', '.x') THEN 'rejected' WHEN item_id = p_partkey THEN 'self' WHEN item_id IS NOT NULL THEN 'local' WHEN p_brand IS NOT NULL THEN 'remote' WHEN name = 'String' THEN 'builtin' ELSE 'unresolved' END AS outcome,
CASE WHEN item_id <> p_partkey THEN item_id END AS item_id, CASE WHEN p_brand IS NOT NULL THEN 'u ' || p_brand WHEN name = 'String' THEN 'str' END AS url FROM r LEFT JOIN i ON i.p_name = r.name LEFT JOIN b ON b.p_brand = r.name""")
def l02_autolink(spark, sf_dir):
    """LNK2, JN10 to JN12: the chain of rejection, local names, remote sources, built-in names."""
    p, c = read(spark, sf_dir, "part"), F.col("p_size") % 6
    name = F.when(c == 0, "T").when(c == 1, ".x").when(c == 2, F.col("p_name")).when(c == 3, F.col("p_brand")).when(c == 4, "String").otherwise("Nowhere")
    refs = p.select(F.col("p_partkey").alias("ref_id"), name.alias("name"), F.array().cast("array<string>").alias("scopes"), F.lit(None).cast("string").alias("context"), F.col("p_partkey").alias("context_id"), F.array(F.lit("T")).alias("generic_params"))
    items = p.where("p_size < 25").select(F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("path"), F.lit("swift").alias("language"), F.col("p_name").alias("full_name"), F.lit(None).cast("string").alias("module_name"))
    brands = p.where("p_size > 48").select("p_brand").distinct()
    remote = brands.select(F.lit(0).alias("source_ord"), F.lit("M").alias("module_name"), F.col("p_brand").alias("key"), F.concat(F.lit("u "), "p_brand").alias("url"))
    db = read(spark, sf_dir, "region").select(F.lit("Swift").alias("module_name"), F.lit("String").alias("name"), F.lit("str").alias("url")).distinct()
    r = links.autolink(refs, links.name_index(items), remote, db, ["swift", "objc"])
    return r.select(F.col("ref_id").alias("p_partkey"), "outcome", "item_id", "url")


@query("""SELECT p_partkey, p_name AS code, 'Type' || p_size AS type_name, 'title-' || p_size AS anchor, 'bold ' || p_name || ' x' AS plain, '<a href="../u"><code>' || p_name || '</code></a>' AS link FROM part""")
def l04_markdown(spark, sf_dir):
    """LNK3 to LNK6, LNK8, LNK9: what a text names, its headings, its plain form, links with their way to the root."""
    n = F.col("p_size").cast("string")
    md = F.concat(F.lit("# Title "), n, F.lit("\n**bold** "), "p_name", F.lit(" [x](y)"))
    code = F.concat(F.lit("see `"), "p_name", F.lit("` there"))
    plain = F.concat(F.lit("**bold** "), "p_name", F.lit(" [x](y)"))
    link = links.fixed_up(links.rendered_link(F.col("p_name"), F.lit("@@u")), "@@", F.lit("../"))
    return read(spark, sf_dir, "part").select("p_partkey", links.code_spans(code)[0].alias("code"), links.type_names(F.concat(F.lit("func f(a: Type"), n, F.lit(")")))[0].alias("type_name"),
                                              links.headings(md)[0]["anchor"].alias("anchor"), links.plain_text(plain).alias("plain"), link.alias("link"))


_ITEMS = """it AS (SELECT r_regionkey, r_name, NULL AS n_nationkey, NULL AS n_name FROM region UNION ALL SELECT r_regionkey, r_name, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by region, a page each, and nations below them."""
    n = nations(spark, sf_dir)
    kids = n.select(F.array("r_regionkey", "n_nationkey").alias("path"), F.lit("def").alias("item_type"), F.col("n_name").alias("name"))
    tops = read(spark, sf_dir, "region").select(F.array("r_regionkey").alias("path"), F.lit("group").alias("item_type"), F.col("r_name").alias("name"))
    return kids.unionByName(tops).withColumns({"meta_kind": F.lit("type"), "module_name": F.lit("M"), "show_in_toc": F.lit("yes")})


@query(f"""WITH {_ITEMS}, u AS (SELECT *, lower(replace(CASE WHEN n_name IS NULL THEN r_name ELSE 'types/' || n_name END, ' ', '-')) || '.html' AS url FROM it)
SELECT coalesce(n_name, r_name) AS title, url, lag(url) OVER w AS prev_url, lead(url) OVER w AS next_url, (SELECT count(*) FROM it k WHERE u.n_name IS NULL AND k.r_regionkey = u.r_regionkey AND k.n_name IS NOT NULL) AS kids FROM u WINDOW w AS (ORDER BY r_regionkey, n_nationkey NULLS FIRST)""")
def l10_pages(spark, sf_dir):
    """LNK10, LNK14, WIN3: URLs, and pages assembled in one order over ranges."""
    t = Tables(spark)
    u = pages.urls(site(spark, sf_dir), t, "separate").withColumns({"topic_id": F.lit("t"), "topic_title": F.lit("T"), "abstract": F.lit("a")})
    kids = F.coalesce(F.size(F.get("topics", F.lit(0))["items"]), F.lit(0))
    return pages.assemble(u, t).select("title", F.col("url_path").alias("url"), "prev_url", "next_url", F.when(kids > 0, kids).otherwise(0).cast("long").alias("kids"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, CASE p_size % 2 WHEN 0 THEN 1 ELSE 5 END, p_name, p_partkey) AS conditional, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 25, p_name, p_partkey) AS grouped,
row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 9 THEN 'f' ELSE '' END, CASE WHEN p_size > 20 THEN p_size ELSE 0 END, p_partkey) AS located, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS in_toc, row_number() OVER (PARTITION BY p_brand ORDER BY p_size = 5, p_partkey) AS late FROM part""")
def o02_orders(spark, sf_dir):
    """OR2, OR3, OR6, OR8, OR9."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_partkey").alias("path"), F.col("p_name").alias("name"), (F.col("p_size") % 3).cast("string").alias("extension_constraint"), F.when(F.col("p_size") % 2 == 0, "type").otherwise("method").alias("def_topic"),
                                           (F.col("p_size") > 25).alias("is_def"), F.col("p_name").alias("sortable_name"), F.when(F.col("p_size") > 9, "f").alias("file_pathname"), F.when(F.col("p_size") > 20, F.col("p_size")).alias("first_line"), "p_size")
    p = ordered.stable_partition(p, F.col("p_size") == 5, ["p_partkey"])
    at = lambda *by: F.row_number().over(W.partitionBy("p_brand").orderBy(*by)).cast("long")
    return p.select("p_partkey", at(*group.conditional_order(), "p_partkey").alias("conditional"), at(*group.group_page_order(), "p_partkey").alias("grouped"), at(*group.location_order(), "p_partkey").alias("located"),
                    at(*group.toc_order(F.lit(True), F.col("name"), F.lit(False))).alias("in_toc"), at("place").alias("late"))


@query("""WITH g AS (SELECT DISTINCT p_brand AS name FROM part), t AS (SELECT 'Brand#' || (n_nationkey + 10) AS name, n_name AS title FROM nation)
SELECT g.name, coalesce(title, g.name) AS title, 'used' AS what FROM g LEFT JOIN t USING (name) UNION ALL SELECT name, title, 'unused' FROM t WHERE name NOT IN (FROM g)""")
def j07_guide_titles(spark, sf_dir):
    """JN7, SET5: titles by name, and those that no guide has."""
    g = read(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    t = read(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 10).cast("string")).alias("name"), F.col("n_name").alias("title"))
    return group.guide_titles(g, t).select("name", "title", F.lit("used").alias("what")).unionByName(group.unused_titles(g, t).select("name", "title", F.lit("unused").alias("what")))


@query("""WITH s AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier), i AS (SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_name END AS name FROM nation) SELECT s_suppkey, name AS other, n_name AS policy FROM s LEFT JOIN i ON i.n_nationkey = s_nationkey LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 4) m ON m.n_nationkey = s_nationkey""")
def j05_other_language(spark, sf_dir):
    """JN5, JN8: the other language's names by usr, and the module's row."""
    n = read(spark, sf_dir, "nation")
    d = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("usr"), F.col("s_nationkey").alias("module_name"))
    o = merge.with_other_language(d, n.select(F.col("n_nationkey").alias("usr"), F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("name"), F.lit("d").alias("declaration")))
    m = group.with_modules(o, n.where("n_regionkey < 4").select(F.col("n_nationkey").alias("module_name"), F.col("n_name").alias("policy")))
    return m.select("s_suppkey", F.col("other.name").alias("other"), "policy")


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sorted, count(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'F') AS without, bool_or(o_orderstatus = 'P') AS meets FROM orders GROUP BY 1""")
def t02_sets(spark, sf_dir):
    """AGG15, SET2, SET3."""
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    f, p = F.array(F.lit("F")), F.array(F.lit("P"))
    same = F.size(ordered.multiset_minus(F.col("s"), f)) == F.size(ordered.set_minus(F.col("s"), f))
    return g.select("o_custkey", F.array_join(ordered.uniqued(F.col("p")), ",").alias("sorted"), F.when(same, F.size(ordered.set_minus(F.col("s"), f))).cast("long").alias("without"), ordered.set_meets(F.col("s"), p).alias("meets"))


@query("""WITH c AS (SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS d, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS m, count(*) FILTER (n_chars < 200) AS a FROM documents)
SELECT 0 AS line_no, (100 * d // (d + m)) || '% documentation coverage with ' || m || ' undocumented symbols' AS line FROM c UNION ALL SELECT 1, a || ' symbols skipped by access level' FROM c WHERE a > 0
UNION ALL SELECT 2, '{"documentedDef":' || d || ',"filterMinAclExcluded":' || a || ',"missingDocumentation":' || m || '}' FROM c""")
def k03_reports(spark, sf_dir):
    """AGG3, SNK8: report lines, and the counters as JSON."""
    lab = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l")).distinct()
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(lab, "doc_id", "left")
    one = d.select(F.explode(F.array_compact(F.array(F.when(F.col("l"), "documentedDef").otherwise("missingDocumentation"), F.when(F.col("n_chars") < 200, "filterMinAclExcluded")))).alias("c"))
    n = filters.counters(one, "c", ["documentedDef", "missingDocumentation", "filterMinAclExcluded"])
    return stats.coverage_report(n).unionByName(sinks.stats_json(n).select(F.lit(2).alias("line_no"), F.col("json").alias("line")))


@query("""SELECT 'p' || p_partkey AS key, '{"abstract":"' || p_brand || '","name":"' || p_name || '"' || CASE WHEN p_size > 9 THEN ',"parent_name":"' || p_type || '"' ELSE '' END || '}' AS json FROM part
UNION ALL SELECT 'site', '{"modules":["' || (SELECT string_agg(r_name, '","' ORDER BY r_name) FROM region) || '"],"version":"2"}'""")
def k11_search_json(spark, sf_dir):
    """SNK11, SNK12."""
    e = read(spark, sf_dir, "part").select(F.lit("swift").alias("language"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_name").alias("name"), F.col("p_brand").alias("abstract"), F.when(F.col("p_size") > 9, F.col("p_type")).alias("parent_name"))
    s = sinks.site_json(read(spark, sf_dir, "region").select(F.col("r_name").alias("module_name")), "2")
    return sinks.search_json(e).select(F.col("url").alias("key"), "json").unionByName(s.select(F.lit("site").alias("key"), "json"))


@query("""SELECT p_partkey, p_name AS name, row_number() OVER (ORDER BY CASE WHEN p_size > 9 THEN p_brand ELSE '' END, CASE WHEN p_size > 20 THEN p_size ELSE 0 END, p_name, p_partkey) AS place FROM part WHERE p_size % 5 = 0""")
def k09_undocumented(spark, sf_dir):
    """SNK9: undocumented rows in the order of their places, numbered over ranges."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") > 9, F.col("p_brand")).alias("file_pathname"), F.when(F.col("p_size") > 20, F.col("p_size")).alias("first_line"), (F.col("p_size") % 5 == 0).alias("missing"))
    u = stats.undocumented(p).withColumn("at", F.struct(F.coalesce("file_pathname", F.lit("")), F.coalesce("first_line", F.lit(0)), "name", "p_partkey"))
    return ordered.numbered(u, ["at"], "place", Tables(spark)).select("p_partkey", "name", "place")


@query("""WITH d AS (SELECT p_name AS usr, p_brand AS kid, min(p_partkey) AS head, count(*) AS copies FROM part GROUP BY ALL), t AS (SELECT p_name AS usr, min(p_partkey) AS head, count(*) AS copies FROM part GROUP BY 1)
SELECT usr, NULL AS kid, head, copies FROM t UNION ALL SELECT usr, kid, head, copies FROM d""")
def a05_merged_forest(spark, sf_dir):
    """AGG4, AGG5 below the top: copies of a name merge, and then their children."""
    p = read(spark, sf_dir, "part")
    top = p.select(F.array("p_partkey").alias("path"), F.col("p_name").alias("usr"), F.lit(None).cast("string").alias("kid"))
    kid = p.select(F.array("p_partkey", F.lit(0).cast(p.schema["p_partkey"].dataType)).alias("path"), F.col("p_brand").alias("usr"), F.col("p_brand").alias("kid"))
    m = merge.merged_forest(top.unionByName(kid).withColumns({"kind": F.lit("k"), "availability": F.array().cast("array<string>")}), Tables(spark))
    up = m.where("kid is null").select(F.col("path").alias("head_parent"), F.col("usr").alias("up"))
    kids = m.where("kid is not null").join(up, "head_parent").select(F.col("up").alias("usr"), "kid", F.get("path", F.lit(0)).alias("head"), "copies")
    return kids.unionByName(m.where("kid is null").select("usr", "kid", F.get("path", F.lit(0)).alias("head"), "copies"))


@query("""WITH k AS (SELECT c_custkey, c_nationkey, c_acctbal < 0 AS par, c_name FROM customer), p AS (SELECT c_nationkey, string_agg(c_name, ',' ORDER BY c_name) AS ps FROM k WHERE par GROUP BY 1)
SELECT 'n' || n_nationkey AS key, coalesce(ps, '') AS params FROM nation LEFT JOIN p ON c_nationkey = n_nationkey UNION ALL SELECT 'c' || c_custkey, '' FROM k WHERE NOT par""")
def p09_generic_params(spark, sf_dir):
    """PRJ9: generic parameters leave the children for a set on their parent."""
    i = lambda c: F.col(c).cast("long")
    n = read(spark, sf_dir, "nation").select(F.array(i("n_nationkey")).alias("path"), F.lit(None).cast("array<bigint>").alias("parent_path"), F.lit(SWIFT + "class").alias("kind"), F.lit(None).cast("string").alias("parent_kind"), F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"))
    c = read(spark, sf_dir, "customer").select(F.array(i("c_nationkey"), i("c_custkey")).alias("path"), F.array(i("c_nationkey")).alias("parent_path"), F.when(F.col("c_acctbal") < 0, SWIFT + "generic_type_param").otherwise(SWIFT + "var.instance").alias("kind"), F.lit(SWIFT + "class").alias("parent_kind"), F.col("c_name").alias("name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"))
    return merge.generic_parameters(n.unionByName(c)).select("key", F.array_join("generic_params", ",").alias("params"))


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN coalesce(CASE WHEN o_custkey % 3 = 0 THEN 'cat' END, CASE WHEN o_custkey % 2 = 0 THEN 'T: P' END, 'own') ELSE o_orderpriority END AS topic FROM orders""")
def w07_topic_cascade(spark, sf_dir):
    """WIN7: an extension's first child has its category, else its constraint, else its own topic."""
    c = F.col("o_custkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", c.alias("ext_path"), F.col("o_orderkey").alias("ord"), F.when(c % 3 == 0, "cat").alias("category_name"), F.when(c % 2 == 0, "T: P").alias("constraint"), F.lit("own").alias("ext_topic"), F.col("o_orderpriority").alias("topic"))
    return merge.topic_cascade(o).select("o_orderkey", "topic")


@query("""SELECT o_orderkey, 3 - (c_acctbal < 0)::INT AS depth FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT -c_custkey, 2 FROM customer WHERE c_acctbal >= 0""")
def p05_unwrapped(spark, sf_dir):
    """PRJ5: wrapper rows go, and their children move up by one."""
    i = lambda c: F.col(c).cast("long")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    top = c.select(F.array(i("c_nationkey"), i("c_custkey")).alias("path"), (F.col("c_acctbal") < 0).alias("wraps"), (-i("c_custkey")).alias("key"))
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.array(i("c_nationkey"), i("c_custkey"), i("o_orderkey")).alias("path"), F.lit(False).alias("wraps"), i("o_orderkey").alias("key"))
    return tree.unwrap(top.unionByName(o), F.col("wraps")).select(F.col("key").alias("o_orderkey"), F.col("depth").cast("int").alias("depth"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' since 1' END AS deprecated, 'iOS ' || p_size || '+' AS available, '- (void)m' || p_size || ';' AS objc, 'func f(a: T' || p_size || ')' AS swift FROM part""")
def p14_declarations(spark, sf_dir):
    """PRJ14, PRJ17: Swift and Objective-C declarations without attributes and macros; deprecation messages stay."""
    n = F.col("p_size").cast("string")
    gone = F.when(F.col("p_size") > 25, F.concat(F.lit(' __attribute__((deprecated("'), "p_name", F.lit(' since 1")))'))).otherwise("")
    o = decls.objc_declaration(F.concat(F.lit("- (void)m"), n, gone, F.lit(";")))
    s = decls.swift_declaration(F.lit("").cast("string"), F.concat(F.lit("@objc func f(a: M.T"), n, F.lit(")")), F.lit(None).cast("array<string>"), F.lit("M"))
    return read(spark, sf_dir, "part").select("p_partkey", o["deprecated"].alias("deprecated"), F.concat(F.lit("iOS "), n, F.lit("+")).alias("available"), o["text"].alias("objc"), s.alias("swift"))


@query("""SELECT p_partkey, p_name AS en, 'only ' || p_brand AS fr FROM part""")
def m05_docs(spark, sf_dir):
    """MP6: entries reduced by key into a map."""
    e = F.array(F.struct(F.lit("en").alias("key"), F.col("p_name").alias("value")), F.struct(F.lit("fr").alias("key"), F.lit("only ").alias("value")), F.struct(F.lit("fr").alias("key"), F.col("p_brand").alias("value")))
    m = maps.reduce_by_key(e, lambda a, b: F.concat(a, b))
    return read(spark, sf_dir, "part").select("p_partkey", maps.get(m, "en").alias("en"), maps.get(m, "fr").alias("fr"))
