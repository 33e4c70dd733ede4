"""Exact values of scalar functions and ordered primitives."""

import pytest
from pyspark.sql import functions as F

from arborql import config
from arborql.functions import maps
from arborql.functions import text as X
from arborql.model import COUNTERS, KINDS, acl_of, dim_kind, rank
from arborql.operators import ordered


def one(spark, column, **values):
    """The value of an expression over one row of string columns."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, slug", [("aA a", "aa-a"), ("Beginner's guide", "beginners-guide"), ("名词说明", "名词说明"), ("😀", "😀"), ("!", "e"), ("", "")])
def test_slug(spark, given, slug):
    assert one(spark, X.slugged(F.col("s")), s=given) == slug


def test_unique_names(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(["aaa", "aaa", "aaa", "bbb"])], "ord int, name string")
    rows = df.select("ord", ordered.unique_names(F.col("name"), [], ["ord"]).alias("u")).orderBy("ord").collect()
    assert [r["u"] for r in rows] == ["aaa", "aaa1", "aaa2", "bbb"]


@pytest.mark.parametrize("given, coded", [("a a", "a%20a"), ("a/a", "a/a"), ("a+b?c", "a+b%3Fc"), ("é", "%C3%A9")])
def test_url_path(spark, given, coded):
    assert one(spark, X.url_path_encoded(F.col("s")), s=given) == coded
    assert one(spark, X.url_decoded(F.col("s")), s=coded) == given


def test_regex(spark):
    s = F.col("s")
    assert one(spark, X.re_split(s, ","), s=",1,2,") == ["1", "2"]
    assert one(spark, X.re_split(s, ","), s=",,") == []
    assert one(spark, X.re_match(s, "(a)|(b)", 2), s="a") == ""
    assert one(spark, X.re_match(s, "(a)|(b)", 2), s="c") is None
    assert one(spark, X.re_sub_with(s, "[0-9]+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))), s="a1b22") == "a<1>b<22>"
    assert one(spark, X.re_is_match(s, "^" + X.re_escape("a.b(c)") + "$"), s="a.b(c)")
    with pytest.raises(ValueError):
        X.re_check("(")


@pytest.mark.parametrize("pattern, name, fits", [("/*c", "/a/b/c", True), ("/a/*", "", False), ("a?c", "abc", True), (r"a\?c", "a?c", True), (r"a\?c", "abc", False), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a.c", "abc", False)])
def test_glob(spark, pattern, name, fits):
    assert one(spark, X.glob_match(F.col("s"), pattern), s=name) is fits


def test_prefix_matcher():
    m = config.PrefixMatcher(["coverage", "products", "profile", "fo", "foo"])
    assert m.match("cov") == "coverage" and m.match("pro") is None and m.match("fo") is None and m.match("foo") == "foo" and m.match("x") is None and m.match("") is None


@pytest.mark.parametrize("comment, title", [("MARK: - mark -", "mark"), ("MARK: one", "one"), ("FIXME: no", None), ("// MARK: - two", "two"), ("#pragma mark three", "three")])
def test_mark(spark, comment, title):
    assert one(spark, X.mark_text(F.col("s")), s=comment) == title


def test_names(spark):
    s = F.col("s")
    assert one(spark, X.link_name(s), s="<doc:A/b-1a2b3>") == "A.b"
    assert one(spark, X.objc_key(s), s="-[Class(Cat) meth:od:]") == "Class.-meth:od:"
    assert one(spark, X.objc_key(s), s="+[Class m]") == "Class.+m" and one(spark, X.objc_key(s), s="f(x:)") == "f(x:)"
    assert one(spark, X.display_tail(s), s="A.B.f(a:b:)") == "f(a:b:)"
    assert one(spark, X.category_name(s), s="NSFoo(Bar)").asDict() == {"class": "NSFoo", "category": "Bar"}
    assert one(spark, X.relative_path(F.col("a"), F.col("b")), a="x/y/z", b="x/w") == "../../w"
    assert one(spark, X.nesting_depth(s), s="a/b/c") == 2
    assert one(spark, X.html_escaped(s), s="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, X.version_at_most(F.col("a"), F.col("b")), a="1.9.0", b="1.12.0") is True
    assert one(spark, X.version_at_most(F.col("a"), F.col("b")), a="2", b="1.12.0") is False


def test_config():
    assert X.split_commas(r"a\,b,c") == ["a,b", "c"]
    c = config.parse("min_acl: internal\nmodules:\n - module: A\n   passes: [{min_acl: open}, {}]\n - module: B", {"skip_undocumented": True})
    assert [(x.module, x.pass_index, x.min_acl, x.skip_undocumented) for x in c.cascade()] == [("A", 0, "open", True), ("A", 1, "internal", True), ("B", None, "internal", True)]
    assert config.parse('{"no_include_spi": false, "min": "open"}').include_spi is True
    assert config.parse("min_acl: ${LEVEL}", env={"LEVEL": "open"}).min_acl == "open"
    with pytest.raises(ValueError):
        config.parse("exclude_names: ['(']")
    with pytest.raises(ValueError):
        config.parse("skip: true")


def test_localized(spark):
    df = spark.createDataFrame([({"en": "a", "fr": "b"}, {"fr": "c", "de": "d"})], "m map<string,string>, n map<string,string>")
    m, n = F.col("m"), F.col("n")
    r = df.select(maps.concat(m, n).alias("c"), maps.joined(m, n, "-").alias("j"), maps.filled(m, ["en", "es"], "en").alias("f"), maps.get(m, "xx").alias("g"), maps.broadcast_tags(F.lit("q"), ["en", "fr"]).alias("b")).first()
    assert r["c"] == {"en": "a", "fr": "bc"} and r["j"] == {"en": "a", "fr": "b-c", "de": "d"}
    assert r["f"] == {"en": "a", "es": "a"} and r["g"] == "" and r["b"] == {"en": "q", "fr": "q"}
    assert one(spark, maps.message(F.col("t"), F.lit("x"), F.lit("y")), t="%1 of %2 and %1") == "x of y and x"


def test_model(spark):
    assert len(KINDS) == 65 and len(COUNTERS) == 59 and len(set(COUNTERS)) == 59
    assert one(spark, rank(F.col("s"), ["private", "open"], -1), s="open") == 1 and one(spark, rank(F.col("s"), ["private"], -1), s="x") == -1
    a = acl_of(F.col("n"), F.col("a"), F.lit(False))
    assert one(spark, a, n="deinit", a="source.lang.swift.accessibility.public").acl == "internal"
    r = one(spark, a, n="f", a=None)
    assert r.acl == "internal" and r.guessed
    d = dim_kind(spark)
    assert d.where("is_swift_extension").count() == 5 and d.where("is_objc").count() == 19


def test_ordered(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, None, 1), (1, "b", 2), (2, None, 1)], "k int, v string, o int")
    assert {(r.k, r.o) for r in ordered.first_wins(df, ["k"], ["o"]).collect()} == {(1, 1), (2, 1)}
    assert {(r.k, r.v) for r in ordered.last_wins(df, ["k"], ["o"]).collect()} == {(1, "a"), (2, None)}
    assert [r.x for r in df.select("k", "o", ordered.carry_forward(F.col("v"), ["k"], ["o"]).alias("x")).orderBy("k", "o").collect()] == [None, "b", "a", None]
    runs = spark.createDataFrame([(i, v) for i, v in enumerate(["x", "x", None, None, "x"])], "o int, v string")
    assert [r.island for r in ordered.islands(runs, ["v"], [], ["o"]).orderBy("o").collect()] == [1, 1, 2, 2, 3]
    assert ordered.first_duplicate(runs.where("v is not null"), "v", "o").first().v == "x"
