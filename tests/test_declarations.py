"""Objective-C declarations in columns: neat texts, name pieces, and both languages."""

import os
import re

import pytest
from pyspark.sql import functions as F
from sqlcheck import SF_DIR

from arborql.model import OBJC, SWIFT
from arborql.operators import decls
from arborql.plans.catalogue import QUERIES

CASES = [
    ("method.instance", "setA:b:", "- (void)setA:(int)a b:(NSString *_Nonnull)b;", "- (void)[setA]:(int)a [b]:(NSString *)b"),
    ("method.class", "shared", "+ (instancetype)shared", "+ (instancetype)[shared]"),
    ("initializer", "initWithX:", "- (nonnull instancetype)initWithX:(NSDictionary<NSString *, NSArray<id<P>> *> *)x OBJC_DESIGNATED_INITIALIZER;", "- (instancetype)[initWithX]:(NSDictionary<NSString *, NSArray<id<P>> *> *)x"),
    ("method.instance", "run:then:", "- (void)run:(void (^)(NSString *a, int b))block\n    then:(nullable void (^)(BOOL (^)(int x)))next;", "- (void)[run]:(void (^)(NSString *a, int b))block [then]:(void (^)(BOOL (^)(int x)))next"),
    ("method.instance", "pick:", "- (int)pick:(struct {int a : 3;} *)s", "- (int)[pick]:(struct {int a : 3;} *)s"),
    ("method.instance", "é:", "- (id)é:(id)x NS_SWIFT_NAME(e(x:))", "- (id)[é]:(id)x"),
    ("property", "name", "@property (atomic, copy, nonnull, readwrite) NSString *name;", "NSString *[name]"),
    ("property", "handler", "@property (nonatomic, assign, unsafe_unretained) void (^handler)(NSString *);", "void (^[handler]"),
    ("property", "plain", "@property (atomic, assign)\n   NSInteger plain;", "NSInteger [plain]"),
    ("constant", "kName", "extern NSString *const kName;", "NSString *const [kName]"),
    ("function", "f", "int f(int (*g)(f_t), char c)", "int f(int (*g)([f]_t), char c)"),
    ("function", "sum", "extern double sum(double a, double b);", "extern double [sum](double a, double b)"),
    ("class", "Clazz", "@interface Clazz : NSObject <P> {\n  int ivar;\n}", "@interface [Clazz]"),
    ("typedef", "E", "typedef NS_ENUM(NSInteger, E", "typedef [E]"),
    ("category", "Clazz(Cat)", "@interface Clazz (Cat)\n- (void)x;", "@interface [Clazz(Cat)]"),
    ("constant", "gone", "extern int other;", "[extern int other]"), ("method.instance", "odd", "- ()", "[- ()]"), ("unexposed", "u", "something odd;", "[something odd]"), ("property", None, "@property int x;", "[@property int x]"),
]


def test_objc_pieces(spark):
    df = spark.createDataFrame([(k, OBJC + kind, n, d) for k, (kind, n, d, _) in enumerate(CASES)], "id int, kind string, name string, decl string")
    df = df.withColumn("neat", decls.objc_neat(F.col("decl"), F.col("kind")))
    out = {r.id: (r.neat, r.p) for r in df.select("id", "neat", decls.piece_text(decls.objc_pieces(F.col("neat"), F.col("name"), F.col("kind"))).alias("p")).collect()}
    for k, (*_, want) in enumerate(CASES):
        assert out[k][1] == want, (CASES[k], out[k])
    neat = [v[0] for v in out.values()]
    assert neat[6] == "@property (copy, nonnull) NSString *name" and neat[7] == "@property (nonatomic) void (^handler)(NSString *)" and neat[8] == "@property NSInteger plain"
    assert neat[12] == "@interface Clazz : NSObject <P>" and neat[13] == "typedef NS_ENUM(NSInteger, E)" and neat[14] == "@interface Clazz (Cat)"
    texts = spark.createDataFrame([(None, None, None)], "kind string, name string, decl string")
    assert texts.select(decls.objc_pieces(decls.objc_neat(F.col("decl"), F.col("kind")), F.col("name"), F.col("kind")).alias("p")).count() == 1


def test_pieces_are_the_whole_method(spark):
    """Pieces put together are the declaration, whatever it is."""
    texts = [d for k, _, d, _ in CASES if k.startswith("method")] + ["- (a<b<c>>)x:(d)e y : (f)g", "+ (void) z", ": : :", "((((", "x:"]
    df = spark.createDataFrame([(t,) for t in texts], "d string").withColumn("neat", decls.objc_neat(F.col("d"), F.lit(OBJC + "method.instance")))
    for r in df.select("neat", decls.objc_pieces(F.col("neat"), F.lit("n"), F.lit(OBJC + "method.instance")).alias("p")).collect():
        want = re.sub(r"\s+", " ", re.sub(r"(?i)\s*(_?_Nullable|_?_Nonnull)\b", "", re.sub(r"\b(nullable|nonnull)\s+", "", re.sub(r"\s+", " ", r.neat))))
        assert "".join(x.text for x in r.p) == want


def test_both_languages(spark):
    defs = spark.createDataFrame([("u1", SWIFT + "function.method.instance"), ("u2", SWIFT + "extension"), ("u3", SWIFT + "function.destructor"), ("u4", SWIFT + "var.instance"), ("u5", SWIFT + "class")], "usr string, kind string")
    info = spark.createDataFrame([("u1", "go:with:", "- (void)go:(int)a with:(int)b;"), ("u2", "E", "@interface E"), ("u3", "dealloc", "- (void)dealloc"), ("u4", "size", "@property (assign) int size;"), ("u5", None, "x")], "usr string, name string, declaration string")
    out = {r.usr: r.objc for r in decls.with_objc_declaration(defs, info).collect()}
    assert out["u1"].kind == OBJC + "method.instance" and [(p.is_name, p.text) for p in out["u1"].pieces] == [(False, "- (void)"), (True, "go"), (False, ":(int)a "), (True, "with"), (False, ":(int)b")]
    assert out["u4"].declaration == "@property int size" and out["u2"] is out["u3"] is out["u5"] is None
    o = spark.createDataFrame([(OBJC + "enum", "E", "struct E : RawRepresentable"), (OBJC + "enum", "F", "enum F"), (OBJC + "class", "G", None)], "kind string, name string, decl string")
    got = [r.s for r in o.select(decls.swift_of_objc(F.col("kind"), F.col("name"), F.col("decl")).alias("s")).collect()]
    assert [(x.kind, x.name) if x else None for x in got] == [(SWIFT + "struct", "E"), (SWIFT + "enum", "F"), None]


def test_assembled_declarations(spark):
    builtin = lambda a: f"<syntaxtype.attribute.builtin><syntaxtype.attribute.name>{a}</syntaxtype.attribute.name></syntaxtype.attribute.builtin> "
    rows = [
        ("<Declaration>" + builtin("@objc") + "func f(x: <Type>Outer&lt;T&gt;.Inner</Type>) -&gt; Int</Declaration>", "func f(x: Inner) -> Int", ["@objc(f:)", "@discardableResult"], ["Outer", "Inner"], "function.method.instance", True),
        ("<Declaration>var x: Int {\n  get\n  }</Declaration>", "var x: Int {\n    1\n}", [], ["x"], "var.instance", False),
        ("<Declaration>func g(a: Int, b: Int)</Declaration>", "@objc func g(a: Int,\n             b: Int)", ["@objc", "@available(iOS 13, *)", "@available(macOS, deprecated: 11, message: \"use h\")", "@available(*, unavailable)"], ["g"], "function.free", False),
        ("<Declaration>class Foo</Declaration>", "extension Foo : P", ["@_spi(Private)"], ["Foo"], "extension", False),
        (None, "func z()", [], ["z"], "function.free", False), ("<Declaration>mutating  mutating func m()</Declaration>", None, None, ["A.B", "m"], "function.method.instance", False),
    ]
    df = spark.createDataFrame([(k, *r[:4], SWIFT + r[4], r[5]) for k, r in enumerate(rows)], "k int, a string, p string, attrs array<string>, names array<string>, kind string, strip boolean")
    out = {r.k: r.d for r in df.select("k", decls.assembled_declaration(F.col("a"), F.col("p"), F.col("attrs"), F.col("names"), F.col("kind"), F.col("strip")).alias("d")).collect()}
    assert out[0].declaration == "@discardableResult\nfunc f(x: Inner) -> Int" and out[0].name_source == "compiler"
    assert out[1].declaration == "var x: Int" and out[4] is None and out[5].declaration == "mutating func m()"
    assert (out[2].declaration, out[2].name_source) == ("@objc\nfunc g(a: Int,\n       b: Int)", "parsed")
    assert (out[2].available, out[2].deprecated, out[2].unavailable) == (["iOS 13+"], "macOS deprecated since 11: use h", "unavailable.")
    assert out[3].declaration == "@_spi(Private)\nextension Foo : P" and out[3].is_spi and not out[2].is_spi
    text = "é @objc @available(iOS 9, *) func f()"
    src = spark.createDataFrame([([(4, 5), (3, 5), (9, 20), (9, 20), (None, 1), (30, 4)], text, "<d>@objc func f(x: <t>@escaping</t> A)</d>", "@available(*, deprecated, message: \"a (b) \\\"c\") func f()")], "r array<struct<offset:bigint,length:bigint>>, s string, a string, d string")
    r = src.select(decls.source_attributes(F.col("r"), F.col("s")).alias("x"), decls.written_attributes(F.col("a"), F.col("d")).alias("y")).first()
    assert r.x == ["@objc", "@available(iOS 9, *)"] and r.y == ["@objc", "@escaping", '@available(*, deprecated, message: "a (b) \\"c")']


def test_xml_tokens_are_read_once(spark):
    """What the fold over XML tokens needs is evaluated once a token, not where it is mentioned."""
    plan = spark.createDataFrame([("<a/>",)], "x string").select(decls.xml_docs("x").alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(decls.XML_OPEN[:24]) == plan.count(decls.XML_CLOSE[:20]) == 1


def test_objc_texts_are_made_once(spark):
    """A neat text and a text without notes are evaluated once a declaration, not where they are mentioned."""
    df = spark.createDataFrame([("- x", "x", "k")], "d string, n string, k string")
    plan = lambda c: df.select(c.alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(decls.objc_neat(F.col("d"), F.col("k"))).count("NS_SWIFT_NAME") == 1
    assert plan(decls.objc_pieces(F.col("d"), F.col("n"), F.col("k"))).count("_?_Null_unspecified") == 1


def test_long_method(spark):
    """A declaration of many words, with colons within brackets, is read in one pass."""
    n = 3000
    text = "- (void)" + " ".join(f"a{i}:(void (^)(id b:c))d" for i in range(n))
    p = spark.createDataFrame([(text,)], "d string").select(decls.objc_pieces(F.col("d"), F.lit("n"), F.lit(OBJC + "method.instance")).alias("p")).first().p
    assert "".join(x.text for x in p) == text and [x.text for x in p if x.is_name] == [f"a{i}" for i in range(n)]


def test_xml_blocks(spark):
    """Lists in lists, code, callouts, elements alone, and texts outside of the root."""
    item = lambda *x: "<Item>" + "".join(f"<Para>{i}</Para>" for i in x) + "</Item>"
    lists = f"<List-Number>{item('a', 'b')}<Item><List-Bullet>{item('c')}{item('d')}</List-Bullet></Item></List-Number>"
    code = "<CodeListing language='c'><zCodeLineNumbered>x <![CDATA[<]]> y</zCodeLineNumbered><zCodeLineNumbered/></CodeListing>"
    xml = f"<?xml?><F><CommentParts><Abstract/><Discussion>{lists}{code}<Note><Para> n </Para><Para><Link href='u'><bold>l</bold></Link></Para></Note></Discussion></CommentParts></F>\n"
    got = [r.d for r in spark.createDataFrame([(xml,), (xml + "t",), (xml + "<a/>",)], "x string").select(decls.xml_docs("x").alias("d")).collect()]
    assert got[0].abstract == "" and got[0].discussion == "1. a\nb\n2. - c\n- d\n\n```c\nx < y\n\n```\n\n- Note: n [**l**](u)" and got[1:] == [None, None]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
@pytest.mark.parametrize("name", ["p15_availability", "p16_name_pieces", "p17_objc_pieces", "p20_doc_comments", "p22_xml_docs"])
def test_declarations_are_spread(spark, name):
    """A small table in one split is no single task."""
    assert QUERIES[name](spark, SF_DIR).select(F.spark_partition_id().alias("p")).distinct().count() > 1
