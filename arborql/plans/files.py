"""Queries over files by name (written from the tables, all together or not at all), whole definitions there and back,
trees as JSON, prefixes, and declarations in two languages, with their DuckDB SQL. Stand-ins as in ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborql.model import OBJC, SWIFT
from arborql.operators import decls, links, ordered, prefixes, tree
from arborql.plans.catalogue import _TREE, hierarchy, query, read, spread
from arborql.plans.wide import nations
from arborql.sources import definitions, readers, remote, sinks, tree_files
from arborql.tables import Tables, hadoop_path


def text(c: str):
    return F.col(c).cast("string")


def written(df, tables: Tables, name: str) -> str:
    """df(path, ord, line) as files; their folder."""
    top = tables.folder(name)
    tree_files.write_tree(df, top)
    return top


@query("""SELECT n_name || '.md' AS name, n_name || ' of ' || r_name AS en, CASE WHEN n_nationkey % 3 = 0 THEN 'fr ' || n_name ELSE n_name || ' of ' || r_name END AS fr FROM nation JOIN region ON r_regionkey = n_regionkey""")
def src10_markdown(spark, sf_dir):
    """SRC10: guides in a folder a region, some with a French one below."""
    n = nations(spark, sf_dir)
    base = n.select(F.concat_ws("/", text("r_regionkey"), F.concat("n_name", F.lit(".md"))).alias("path"), F.lit(0).alias("ord"), F.concat("n_name", F.lit(" of "), "r_name").alias("line"))
    fr = n.where("n_nationkey % 3 = 0").select(F.concat_ws("/", text("r_regionkey"), F.lit("fr"), F.concat("n_name", F.lit(".md"))).alias("path"), F.lit(0).alias("ord"), F.concat(F.lit("fr "), "n_name").alias("line"))
    other = n.select(F.concat_ws("/", text("r_regionkey"), F.concat("n_name", F.lit(".txt"))).alias("path"), F.lit(0).alias("ord"), F.lit("no guide").alias("line"))
    top = written(base.union(fr).union(other), Tables(spark), "guides")
    m = readers.localized_markdown(spark, [f"{top}/*", f"{top}/[0-9]/f?"], ["fr"], "en")
    at = lambda t: F.rtrim(F.regexp_replace(F.try_element_at("texts", F.lit(t)), "\n", ""))
    return m.select("name", at("en").alias("en"), at("fr").alias("fr"))


@query("""WITH m AS (SELECT s_nationkey % 3 AS d, s_suppkey % 20 AS k, count(*) AS n FROM supplier GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS r FROM m)
SELECT 'pic' || k || '.png' AS name, 'd' || d AS folder, 5 * n AS size FROM w WHERE r = 1""")
def src11_media(spark, sf_dir):
    """SRC11: pictures in several folders; the first of a name counts, and none is opened."""
    s = read(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 3).alias("d"), (F.col("s_suppkey") % 20).alias("k"), F.col("s_suppkey").alias("ord"))
    one = s.select(F.concat(F.lit("d"), text("d"), F.lit("/pic"), text("k"), F.lit(".png")).alias("path"), "ord", F.lit("line").alias("line"))
    other = s.select(F.concat(F.lit("d"), text("d"), F.lit("/pic"), text("k"), F.lit(".txt")).alias("path"), "ord", F.lit("line").alias("line"))
    m = readers.media_files(spark, f"{written(one.union(other), Tables(spark), 'media')}/d?", "*.png")
    return m.select("name", F.element_at(F.split("file", "/"), -2).alias("folder"), "size")


@query("""SELECT 'd' || c_nationkey % 7 AS folder, lower(c_mktsegment) || '.txt' AS name, count(*) AS lines, min(c_custkey) AS first_line FROM customer
WHERE c_nationkey % 7 IN (1, 2, 3, 6) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY ALL""")
def src18_globs(spark, sf_dir):
    """SRC18: files of several folders by patterns for the folders and for the names."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("d"), (F.col("c_nationkey") % 7).cast("string"), F.lit("/"), F.lower("c_mktsegment"), F.lit(".txt")).alias("path"), F.col("c_custkey").alias("ord"), text("c_custkey").alias("line"))
    top = written(c, Tables(spark), "globs")
    f = readers.glob_files(spark, [f"{top}/d[1-3]", f"{top}/?6", f"{top}/none*"], "[!bm]*.t?t")
    lines = F.split(F.rtrim(F.regexp_replace("text", "\n$", "")), "\n")
    return f.select("folder", "name", F.size(lines).cast("long").alias("lines"), lines[0].cast("long").alias("first_line"))


@query("""SELECT n_nationkey, CASE WHEN n_regionkey <> 2 THEN r_name END AS text, n_regionkey = 2 AS failed FROM nation JOIN region ON r_regionkey = n_regionkey""")
def src16_fetch(spark, sf_dir):
    """SRC16: a document a region, asked for by all of its nations; one is not there."""
    n = nations(spark, sf_dir)
    docs = n.where("r_regionkey <> 2").select(F.concat(text("r_regionkey"), F.lit(".txt")).alias("path"), F.lit(0).alias("ord"), F.col("r_name").alias("line")).distinct()
    path, fs = hadoop_path(spark, written(docs, Tables(spark), "remote"))
    top = fs.makeQualified(path).toString()
    urls = n.select("n_nationkey", F.concat(F.lit(top + "/"), text("r_regionkey"), F.lit(".txt")).alias("url"))
    got = remote.fetched(urls, tries=2, pause=0.01)
    return got.select("n_nationkey", F.regexp_replace("text", "\n$", "").alias("text"), F.col("error").isNotNull().alias("failed"))


@query("""WITH f AS (SELECT p_name AS name, min(p_partkey) AS k FROM part GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY k) AS id FROM f)
SELECT 'index' AS file, id || chr(9) || name || chr(9) || 'Part' || chr(9) || 'p' || k || '.html' AS line FROM i
UNION ALL SELECT 'feed', unnest(['<entry>', '<version>1.0</version>', '<url>http://x.dev/a&amp;b/docsets/Parts.tgz</url>', '</entry>'])
UNION ALL SELECT 'name', '<string>Parts</string>'""")
def snk7_docset(spark, sf_dir):
    """SNK7: a docset's property list, index and feed, written together and read back."""
    p = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    t = Tables(spark)
    index = links.docset_index(p.select("name", F.lit("Part").alias("type"), F.concat(F.lit("p"), text("k"), F.lit(".html")).alias("path"), F.col("k").alias("ord")), t)
    top = written(sinks.docset_files(index, "Parts", "org.example", "1.0", "http://x.dev/a&b"), t, "docset")
    r = spark.read.option("recursiveFileLookup", True).text(top).select("value", F.col("_metadata.file_path").alias("file"))
    kind = F.when(F.col("file").endswith(".tsv"), "index").when(F.col("file").endswith("/Parts.xml"), "feed").when(F.col("value") == "<string>Parts</string>", "name")
    return r.select(kind.alias("file"), F.col("value").alias("line")).where("file is not null")


@query("""WITH n AS (SELECT distinct p_name AS name FROM part), x AS (SELECT name, unnest(range(1, length(name) + 1)) AS k FROM n), c AS (SELECT left(name, k) AS prefix, count(*) AS n FROM x GROUP BY 1),
s AS (SELECT name, min(k) AS k FROM x JOIN c ON prefix = left(name, k) AND c.n = 1 GROUP BY 1) SELECT n.name, CASE WHEN s.k IS NOT NULL THEN left(n.name, s.k) END AS prefix FROM n LEFT JOIN s USING (name)""")
def st11_prefixes(spark, sf_dir):
    """ST11: shortest unique prefixes of the names of parts, some of which begin others."""
    return prefixes.unique_prefixes(read(spark, sf_dir, "part"), "p_name", Tables(spark))


@query("""WITH n AS (SELECT distinct p_name AS name FROM part), x AS (SELECT name, unnest(range(1, length(name) + 1)) AS k FROM n), c AS (SELECT left(name, k) AS prefix, count(*) AS n, any_value(name) AS name FROM x GROUP BY 1)
SELECT p_partkey, left(p_name, 1 + p_partkey % 14) AS prefix, c.name FROM part LEFT JOIN c ON c.prefix = left(p_name, 1 + p_partkey % 14) AND c.n = 1""")
def st11_matches(spark, sf_dir):
    """ST11: prefixes of all lengths, and the one name that each begins."""
    p = read(spark, sf_dir, "part")
    asked = p.select("p_partkey", F.expr("left(p_name, 1 + p_partkey % 14)").alias("prefix"))
    return prefixes.matched_prefixes(asked, p.select(F.col("p_name").alias("name")), Tables(spark)).select("p_partkey", "prefix", "name")


@query(f"""WITH {_TREE}, o AS (SELECT p[1:3] AS up, string_agg('{{"name":"' || name || '"}}', ',' ORDER BY p) AS js FROM h WHERE len(p) = 4 GROUP BY 1),
c AS (SELECT p[1:2] AS up, string_agg('{{"name":"' || name || '"' || coalesce(',"children":[' || js || ']', '') || '}}', ',' ORDER BY p) AS js FROM h LEFT JOIN o ON up = p WHERE len(p) = 3 GROUP BY 1),
n AS (SELECT p[1:1] AS up, string_agg('{{"name":"' || name || '"' || coalesce(',"children":[' || js || ']', '') || '}}', ',' ORDER BY p) AS js FROM h LEFT JOIN c ON up = p WHERE len(p) = 2 GROUP BY 1)
SELECT p[1] AS region, sha256('{{"name":"' || name || '"' || coalesce(',"children":[' || js || ']', '') || '}}') AS json_sha256 FROM h LEFT JOIN n ON up = p WHERE len(p) = 1""")
def k02_trees(spark, sf_dir):
    """SNK2, SNK3: whole uneven trees as JSON, customers without orders among them."""
    h = hierarchy(spark, sf_dir).withColumn("body", F.to_json(F.struct("name")))
    t = tree.json_trees(tree.json_pieces(h, "body", [], Tables(spark)), [])
    return t.select(F.col("top").alias("region"), F.sha2("json", 256).alias("json_sha256"))


def _definitions(spark, sf_dir):
    """Regions, nations and customers as whole definitions: every kind of key, unknown ones, and some of another type."""
    n = nations(spark, sf_dir)
    c = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    i = lambda x: F.col(x).cast("long")
    null = lambda d: F.lit(None).cast(d)
    kinds = {f: kind for f, _, kind in definitions.FIELDS}

    def rows(df, path, extra, **given):
        cols = [(given[f] if f in given else null(kind)).cast(kind).alias(f) for f, kind in kinds.items()]
        return df.select(F.col("r_regionkey").alias("region"), F.array(*path).alias("path"), *cols, extra.alias("rest"))

    k = F.col("n_nationkey")
    names = lambda m, prefix, key: F.transform(F.when(k % m > 0, F.sequence(F.lit(1), k % m)), lambda x: F.struct(F.concat(F.lit(prefix), x.cast("string")).alias(key)))
    no_rest = null("map<string,variant>")
    nation = rows(
        n, [F.lit(0).cast("long"), i("n_nationkey")], F.create_map(F.lit("key.extra"), F.parse_json(F.concat(F.lit('{"n":'), text("n_nationkey"), F.lit(',"list":[1,null,"x"]}')))),
        name=F.col("n_name"), kind=F.lit(SWIFT + "class"), offset=k, always_deprecated=k % 2 == 0, inherited=names(4, "I", "key.name"), overrides=names(2, "o", "key.usr"),
        attributes=F.transform(F.when(k % 3 > 0, F.sequence(F.lit(1), k % 3)), lambda x: F.struct(F.lit("public").alias("key.attribute"), x.cast("long").alias("key.offset"), F.lit(6).cast("long").alias("key.length"))),
        docs=F.when(k % 2 == 1, F.struct(F.create_map(F.lit("en"), F.col("n_name"), F.lit("fr"), F.lit('q"uote')), null("map<string,string>"), null("map<string,string>"), null("map<string,string>"),
                                         F.array(F.struct(F.lit("p").alias("a"), F.create_map(F.lit("en"), F.lit("d")).alias("b"))), F.lit("docComment"))),
        swift_pieces=F.array(F.struct(F.lit(False).alias("a"), F.lit("class ").alias("b")), F.struct(F.lit(True).alias("a"), F.col("n_name").alias("b"))), is_spi=k == 5)
    odd = F.when(F.col("c_custkey") % 10 == 0, F.create_map(F.lit("key.doc.line"), F.parse_json(F.lit('"ten"'))))
    customer = rows(c, [F.lit(0).cast("long"), i("n_nationkey"), i("c_custkey")], F.coalesce(odd, no_rest), name=F.col("c_name"), doc_line=F.when(F.col("c_custkey") % 10 > 0, i("c_custkey")))
    region = rows(n.select("r_regionkey", "r_name").distinct(), [F.lit(0).cast("long")], no_rest, diagnostic_stage=F.lit("parse"))
    return region.unionByName(nation).unionByName(customer)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos FROM nation), c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS cpos FROM customer),
i AS (SELECT n_nationkey AS k, string_agg('I' || x, ',' ORDER BY x) AS inherited FROM (SELECT n_nationkey, unnest(range(1, n_nationkey % 4 + 1)) AS x FROM nation) GROUP BY 1)
SELECT r_regionkey AS region, '0' AS path, NULL AS name, 0 AS attributes, NULL AS inherited, NULL AS abstract, NULL::BIGINT AS line, NULL AS rest, true AS same FROM region
UNION ALL SELECT n_regionkey, '0/' || pos, n_name, n_nationkey % 3, inherited, CASE WHEN n_nationkey % 2 = 1 THEN n_name || '|q"uote' END, NULL, '{"key.extra":{"list":[1,null,"x"],"n":' || n_nationkey || '}}', true FROM n LEFT JOIN i ON k = n_nationkey
UNION ALL SELECT n_regionkey, '0/' || pos || '/' || cpos, c_name, 0, NULL, NULL, CASE WHEN c_custkey % 10 > 0 THEN c_custkey END, CASE WHEN c_custkey % 10 = 0 THEN '{"key.doc.line":"ten"}' END, true FROM c JOIN n ON n_nationkey = c_nationkey""")
def js2_roundtrip(spark, sf_dir):
    """PRJ1, JS2, SNK2: definitions written as trees of JSON, read, written and read again: both readings are equal."""
    t = Tables(spark)

    def trees(d):
        return tree.json_trees(tree.json_pieces(definitions.as_json(d), "json", ["region"], t, tree.CHILDREN), ["region"])

    def rows(d, view):
        d.createOrReplaceTempView(view)
        return definitions.definitions(tree.flatten_variant(spark, view))

    folder = t.folder("definitions")
    trees(_definitions(spark, sf_dir)).select("region", F.concat(F.lit('[{"/src/A.swift":'), "json", F.lit("}]")).alias("value")).write.partitionBy("region").text(folder)
    raw = readers.raw_symbols(spark, folder).where("v is not null")
    once = t.write(rows(raw.select(F.regexp_extract("file", r"region=(\d+)", 1).cast("long").alias("region"), "v"), "js2_once").withColumn("rest", F.to_json("rest")))
    again = rows(trees(once.withColumn("rest", F.try_variant_get(F.parse_json("rest"), "$", "map<string,variant>"))).select("region", F.parse_json("json").alias("v")), "js2_again").withColumn("rest", F.to_json("rest"))
    whole = lambda d, name: d.select("region", "path", F.to_json(F.struct(*[c for c in d.columns if c not in ("region", "path")])).alias(name))
    both = whole(once, "a").join(whole(again, "b"), ["region", "path"], "full").select("region", "path", F.col("a").eqNullSafe(F.col("b")).alias("same"))
    d = once.join(both, ["region", "path"], "full")
    abstract = F.col("docs")["key.bb.abstract"]
    return d.select("region", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "name", F.coalesce(F.size("attributes"), F.lit(0)).alias("attributes"),
                    F.array_join(F.transform("inherited", lambda x: x["key.name"]), ",").alias("inherited"), F.concat_ws("|", abstract["en"], abstract["fr"]).alias("abstract_"), F.col("doc_line").alias("line"), F.nullif("rest", F.lit("{}")).alias("rest"), "same").withColumn("abstract", F.nullif("abstract_", F.lit(""))).drop("abstract_")


@query(f"""WITH w AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, coalesce(string_split(p_name, ' ')[2], 'x') AS b, p_partkey % 7 AS f FROM part)
SELECT k, CASE f WHEN 0 THEN '- (void)[' || a || ']:(NSDictionary<NSString *, NSArray<id<P>> *> *)x [' || b || ']:(void (^)(NSString *s, int i))y' WHEN 1 THEN '+ (instancetype)[' || a || ']'
WHEN 2 THEN 'NSString * [' || a || ']' WHEN 3 THEN 'void (^[' || a || ']' WHEN 4 THEN 'extern int [' || a || '](int (*g)(char), ...)' WHEN 5 THEN '@interface [' || a || ']'
ELSE '- (int)[' || a || ']:(struct {{int q : 3;}} *)s [and]:(int)i [' || b || ']:(id)z' END AS pieces,
CASE f WHEN 2 THEN '@property (copy) NSString *_Nonnull ' || a WHEN 3 THEN '@property void (^' || a || ')(NSString *, int)' WHEN 5 THEN '@interface ' || a || ' : NSObject' END AS neat FROM w""")
def p17_objc_pieces(spark, sf_dir):
    """PRJ17: Objective-C declarations of seven forms, neat and in pieces."""
    p = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select(F.col("p_partkey").alias("k"), F.split("p_name", " ")[0].alias("a"), F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit("x")).alias("b"), (F.col("p_partkey") % 7).alias("f"))
    a, b, f = F.col("a"), F.col("b"), F.col("f")
    forms = [
        ("method.instance", F.concat(F.lit("- (void)"), a, F.lit(":(NSDictionary<NSString *, NSArray<id<P>> *> *)x\n    "), b, F.lit(":(nullable void (^)(NSString *s, int i))y;"))), ("method.class", F.concat(F.lit("+ (nonnull instancetype)"), a, F.lit(";"))),
        ("property", F.concat(F.lit("@property (atomic, copy, readwrite) NSString *_Nonnull "), a, F.lit(";"))), ("property", F.concat(F.lit("@property (assign) void (^"), a, F.lit(")(NSString *, int);"))),
        ("function", F.concat(F.lit("extern int "), a, F.lit("(int (*g)(char), ...);"))), ("class", F.concat(F.lit("@interface "), a, F.lit(" : NSObject {\n  int i;\n}"))),
        ("method.instance", F.concat(F.lit("- (int)"), a, F.lit(":(struct {int q : 3;} *)s and:(int)i "), b, F.lit(":(id)z OBJC_DESIGNATED_INITIALIZER"))),
    ]
    kind, decl = F.lit(OBJC + forms[-1][0]), forms[-1][1]
    for k, (kd, d) in enumerate(forms[:-1]):
        kind, decl = F.when(f == k, OBJC + kd).otherwise(kind), F.when(f == k, d).otherwise(decl)
    d = p.select("k", "a", "f", kind.alias("kind"), decl.alias("decl")).withColumn("neat", decls.objc_neat(F.col("decl"), F.col("kind")))
    return d.select("k", decls.piece_text(decls.objc_pieces(F.col("neat"), a, F.col("kind"))).alias("pieces"), F.when(f.isin(2, 3, 5), F.col("neat")).alias("neat"))


@query(f"""SELECT p_partkey AS k, CASE WHEN p_size % 4 < 2 AND s_suppkey IS NOT NULL THEN '{OBJC}' || CASE p_size % 4 WHEN 0 THEN 'method.instance' ELSE 'property' END END AS kind,
CASE WHEN p_size % 4 < 2 AND s_suppkey IS NOT NULL THEN CASE p_size % 4 WHEN 0 THEN '- (void)[set]:(int)a [to]:(id)' || 's' || s_suppkey ELSE 'int [s' || s_suppkey || ']' END END AS pieces FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def p18_languages(spark, sf_dir):
    """PRJ18: Swift definitions with the Objective-C declaration of their usr: methods and properties have one, extensions
    and deinitializers have none."""
    size = F.col("p_size") % 4
    kind = F.when(size == 0, SWIFT + "function.method.instance").when(size == 1, SWIFT + "var.instance").when(size == 2, SWIFT + "extension").otherwise(SWIFT + "function.destructor")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text("p_partkey").alias("usr"), kind.alias("kind"), size.alias("f"))
    s = read(spark, sf_dir, "supplier").join(p.select("k", "f"), F.col("s_suppkey") == F.col("k"))
    v = F.concat(F.lit("s"), text("s_suppkey"))
    info = s.select(text("s_suppkey").alias("usr"), F.when(F.col("f") == 1, v).otherwise("set:to:").alias("name"), F.when(F.col("f") == 1, F.concat(F.lit("@property (assign) int "), v, F.lit(";"))).otherwise(F.concat(F.lit("- (void)set:(int)a to:(id)"), v, F.lit(";"))).alias("declaration"))
    d = decls.with_objc_declaration(p, info)
    return d.select("k", F.col("objc.kind").alias("kind"), decls.piece_text(F.col("objc.pieces")).alias("pieces"))
