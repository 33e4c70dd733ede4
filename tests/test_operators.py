"""Operators over hand-built definitions: merging, filtering, grouping, links, graphs, pages."""

import json

import pytest
from pyspark.sql import functions as F

from arborql.functions.text import slugged
from arborql.model import NOTES, SYMBOL_GRAPH
from arborql.operators import decls, filters, graph, group, links, merge, ordered, pages, stats, tree


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_availability_union_and_collision(spark):
    d = frame(spark, [("C", 1, "class", ["macOS"]), ("C", 2, "class", ["Linux", "macOS"]), ("D", 3, "class", []), ("D", 4, "struct", ["x"])], "usr string, path int, kind string, availability array<string>")
    r = {x.usr: x for x in merge.duplicates(d).where("is_head").collect()}
    assert r["C"].availability == ["macOS", "Linux"] and r["C"].copies == 2 and r["C"].mismatches == 0
    assert r["D"].path == 3 and r["D"].mismatches == 1 and r["D"].availability == []


def test_extension_folding(spark):
    types = frame(spark, [("T", 1, False), ("U", 9, True), ("U", 2, False)], "usr string, path int, in_extension boolean")
    ext = frame(spark, [("T", 5), ("X", 6), ("X", 7), ("U", 8)], "type_usr string, path int")
    r = {x.path: x for x in merge.claim_extensions(types, ext).collect()}
    assert r[5].claimant == 1 and r[8].claimant == 9 and r[6].claimant is None and r[6].leftover_head == r[7].leftover_head == 6
    own = frame(spark, [(1, 0, 0, False)], "parent_path int, ext_path int, ord int, is_constrained boolean")
    e = frame(spark, [(1, 5, 0, True), (1, 6, 0, False), (1, 6, 1, False)], "parent_path int, ext_path int, ord int, is_constrained boolean")
    f = merge.folded_members(own, own.limit(0), e).orderBy("fold_order").collect()
    assert [(x.ext_path, x.ord) for x in f] == [(0, 0), (6, 0), (6, 1), (5, 0)]
    t = frame(spark, [(1, ""), (2, "own")], "path int, docs string")
    c = frame(spark, [(1, 7, "second"), (1, 6, "first"), (2, 5, "no")], "claimant int, path int, docs string")
    assert {x.path: x.docs for x in merge.backfill_docs(t, c).collect()} == {1: "first", 2: "own"}


def test_declarations_and_notes(spark):
    d = frame(spark, [("base", [("b", True, False), ("a", True, False), ("base", True, True), ("a", True, True), ("n", False, False)], [("unavailable", "no"), ("imported", "M"), ("imported", "M")])],
              "base string, others array<struct<decl:string,conforms:boolean,constrained:boolean>>, notes array<struct<tag:string,arg:string>>")
    r = d.select(merge.merged_declarations(F.col("base"), F.col("others")).alias("m"), merge.notes_joined(F.col("notes"), NOTES).alias("n")).first()
    assert r.m == "base\n\na\n\nb" and r.n == "imported: M; unavailable: no"


def test_default_implementations(spark):
    req = frame(spark, [("P", "f", "m", "A"), ("P", "g", "m", "A"), ("P", "h", "m", "A")], "protocol string, name string, kind string, module_name string")
    mem = frame(spark, [("P", "f", "m", False, "one", "A", 1), ("P", "f", "m", False, "two", "B", 2), ("P", "g", "m", True, "c", "A", 3), ("P", "z", "m", False, "z", "A", 4)], "protocol string, name string, kind string, is_constrained boolean, docs string, module_name string, path int")
    r = {x.name: x for x in merge.default_implementations(req, mem).collect()}
    assert r["f"].default_docs == "two" and r["f"].note == "importedDefaultImplementation" and r["g"].note is None and r["g"].conditional_note and r["h"].n_default is None
    assert [x.name for x in merge.extension_only(req, mem).collect()] == ["z"]


def test_imported_notes_and_cascade(spark):
    rows = frame(spark, [([1],), ([1, 0],), ([2],)], "path array<int>")
    ext = frame(spark, [([1], "A", "B"), ([2], "A", "A")], "path array<int>, module_name string, type_module_name string")
    assert {tuple(x.path): x.imported_from for x in merge.imported_notes(ext, rows).collect()} == {(1,): "A", (1, 0): "A", (2,): None}
    kids = frame(spark, [(1, 0, "Cat", None, "E", None), (1, 1, "Cat", None, "E", "t")], "ext_path int, ord int, category_name string, constraint string, ext_topic string, topic string")
    assert [x.topic for x in merge.topic_cascade(kids).orderBy("ord").collect()] == ["Cat", "t"]


def test_dispositions(spark):
    c = filters.FilterConfig(include_globs=["*/a/*"], exclude_names=["^_"], min_acl="public")
    d = frame(spark, [("x/a/f", "N", "", "", False, "public", False), (None, "N", "", ":nodoc:", False, "public", False), ("x/b", "N", "", "", False, "public", False), (None, "_n", "", "", False, "open", False), (None, "n", None, None, True, "open", False), (None, "n", "", "", False, "internal", False), (None, "n", "", "", False, "internal", True)],
              "file_pathname string, name string, abstract string, discussion string, is_spi boolean, acl string, is_swift_extension boolean")
    d = d.coalesce(1)
    r = {(x.file_pathname, x.name, x.acl, x.discussion, x.is_swift_extension): x.d for x in d.withColumn("d", filters.disposition(filters.filter_rules(c))).collect()}
    assert sorted(r.values()) == sorted(["kept", "filterNoDoc", "filterFilename", "filterSymbolName", "filterSpi", "filterMinAclExcluded", "kept"])
    spi = filters.disposition(filters.filter_rules(filters.FilterConfig(min_acl="internal")))
    assert d.where("is_spi").select(spi.alias("d")).first().d == "kept"
    doc, counter = filters.documentation(filters.FilterConfig(skip_undocumented=True, skip_undocumented_override=True))
    u = frame(spark, [(False, True, False), (True, True, False), (False, False, False), (False, False, True)], "has_docs boolean, is_override boolean, is_swift_extension boolean")
    assert sorted((x.d, x.c) for x in u.select(doc.alias("d"), counter.alias("c")).collect()) == sorted([("filterSkipUndocOverride",) * 2, ("documented", "documentedDef"), ("filterSkipUndocumented", "missingDocumentation"), ("documented", "documentedDef")])
    n = {x.counter: x.n for x in filters.counters(u.select(counter.alias("c")), "c").collect()}
    assert len(n) == 59 and n["documentedDef"] == 2 and n["filterSpi"] == 0


def test_private_protocols(spark):
    d = frame(spark, [([0], "P", "x.protocol", "private", "M", ["Q", "P", "M.P", "Q"]), ([1], "Q", "x.protocol", "public", "M", [])], "path array<int>, name string, kind string, acl string, module_name string, inherited_types array<string>")
    assert {x.name: x.inherited_types for x in filters.strip_inherited(d, filters.private_protocols(d), ["path"]).collect()} == {"P": ["Q", "Q"], "Q": []}


def test_tree(spark, tables):
    t = frame(spark, [(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 3, 0), (5, None, 1)], "id int, parent int, ord int")
    p = tree.paths_from_parents(t, tables, "id", "parent", "ord")
    assert [r.id for r in p.orderBy("path").collect()] == [1, 3, 4, 2, 5]
    x = p.select("id", F.transform("path", lambda s: s["ord"]).alias("path"), F.col("id").cast("string").alias("name"))
    assert {r.id for r in tree.prune(x, F.col("id") == 3).collect()} == {1, 2, 5} and {r.id for r in tree.unevaluated(x, F.col("id") == 3).collect()} == {4}
    assert {r.id: r.names for r in tree.with_ancestors(x, "name", "names").collect()}[4] == ["1", "3", "4"]
    assert {r.id for r in tree.prune_childless(x.where("id <> 4"), F.col("id").isin(1, 3), tables).collect()} == {1, 2, 5}
    assert {r.id: r.depth for r in tree.unwrap(x, F.col("id") == 3).collect()} == {1: 1, 4: 2, 2: 2, 5: 1}
    j = tree.nest(x.withColumn("r", F.lit("f")), ["id"], ["r"], 3).orderBy("path").collect()
    assert [json.loads(r.json) for r in j] == [{"id": 1, "children": [{"id": 3, "children": [{"id": 4}]}, {"id": 2}]}, {"id": 5}]


@pytest.mark.parametrize("levels", [32, 0])
def test_above(spark, tables, monkeypatch, levels):
    """Ancestors over sorted ranges and by prefixes: missing ancestors are left out, roots are apart, order of rows is nothing."""
    import random

    monkeypatch.setattr(tree, "LEVELS", levels)
    r = random.Random(6)
    paths = {(f, *p[:k]) for f in "ab" for p in [[r.randrange(3) for _ in range(5)] for _ in range(40)] for k in range(1, 6)}
    paths = sorted(p for p in paths if r.random() < 0.8)
    rows = [(p[0], list(p[1:]), None if k % 7 == 0 else f"v{k}") for k, p in enumerate(paths)]
    given = {(f, *p): v for f, p, v in rows}
    df = spark.createDataFrame(r.sample(rows, len(rows)), "f string, path array<int>, v string").repartition(5)
    got = {(x.f, *x.path): x.vs for x in tree.above(df, F.col("v"), "vs", ["f"]).collect()}
    assert got == {p: [given[p[:k]] for k in range(2, len(p) + 1) if p[:k] in given] for p in given}
    gone = lambda p: any(given.get(p[:k]) in ("v3", "v20", "v41") for k in range(2, len(p) + 1))
    assert {(x.f, *x.path) for x in tree.prune(df, F.col("v").isin("v3", "v20", "v41"), ["f"]).collect()} == {p for p in given if not gone(p)}
    assert {(x.f, *x.path) for x in tree.unevaluated(df, F.col("v").isin("v3", "v20", "v41"), ["f"]).collect()} == {p for p in given if gone(p[:-1])}
    assert tree.above(df.limit(0), F.col("v"), "vs", ["f"]).count() == 0


def test_deep_trees(spark, tables):
    """Below 64 levels (100 of JSON) nothing is lost, and a guard that is reached is an error."""
    n = 67
    t = frame(spark, [(k, k - 1 if k else None, 0) for k in range(n)], "id int, parent int, ord int").coalesce(1).cache()
    p = tree.paths_from_parents(t, tables, "id", "parent", "ord")
    assert {r.id: len(r.path) for r in p.collect()} == {k: k + 1 for k in range(n)}
    x = tables.write(p.select("id", F.transform("path", lambda s: s["ord"]).alias("path")).coalesce(1))
    assert [r.id for r in tree.prune_childless(x, F.col("id") > 0, tables).collect()] == [0]
    with pytest.raises(RuntimeError):
        tree.paths_from_parents(t, tables, "id", "parent", "ord", max_depth=3)
    m = t.where("id > 0").select(F.lit(True).alias("into_target"), F.col("id").alias("source"), F.col("parent").alias("target"), "ord")
    assert {r.usr: r.depth for r in graph.rebuild(t.select(F.col("id").alias("usr")), m, tables).collect()} == {k: k for k in range(n)}
    e = frame(spark, [(f"A{k:02}.html", f"n{k}", f"n{k - 1}" if k else None) for k in range(12)], "url string, name string, parent_name string")
    assert links.parent_fixpoint(e, tables).count() == 12


def test_forest_with_rings_and_orphans(spark, tables):
    """Every vertex is in the result, whatever its parent leads to."""
    up = {"a": "b", "b": "c", "c": "a", "t1": "a", "t2": "t1", "self": "self", "o": "nowhere", "o1": "o", "x": "r", "y": "x", "e1": "e", **{f"d{k}": f"d{k - 1}" if k else "c" for k in range(20)}}
    usrs = [*up, "r", "e", "w", "w"]
    members = [(s, t, 1, True) for s, t in up.items()] + [("e", "ext", 1, False), ("x", "y", 5, True), ("y", "ext", 0, False)]
    v = frame(spark, [(u, u.upper()) for u in usrs], "usr string, name string")
    out = graph.rebuild(v, frame(spark, members, "source string, target string, ord int, into_target boolean"), tables, bad=frame(spark, [("w",), ("x",)], "usr string")).collect()
    assert len(out) == len(usrs)
    got = {r.usr: (r.state, r.root_usr, r.depth) for r in out}
    ring = {k: ("ring", "a", None) for k in "abc"}
    below = {k: ("below ring", "a", None) for k in ("t1", "t2", *(f"d{k}" for k in range(20)))}
    rest = {"self": ("ring", "self", None), "o": ("orphan", "o", 0), "o1": ("placed", "o", 1), "r": ("root", "r", 0), "x": ("placed", "r", 1), "y": ("placed", "r", 2), "e": ("extension", "e", 0), "e1": ("placed", "e", 1), "w": ("bad", "w", 0)}
    assert got == ring | below | rest
    assert {r.usr: r.parent_usr for r in out}["o"] == "nowhere"


def test_forest_of_a_long_chain(spark, tables):
    """A chain of 10,000 and a ring of 1,000 take rounds by the logarithm of their length."""
    n, k = 10_000, 1_000
    v = spark.range(n + k).select(F.col("id").alias("usr"))
    m = v.where(f"usr > 0").select(F.col("usr").alias("source"), F.when(F.col("usr") == n, n + k - 1).otherwise(F.col("usr") - 1).alias("target"), F.lit(0).alias("ord"), F.lit(True).alias("into_target"))
    before = tables.n
    out = graph.rebuild(v, m, tables)
    assert out.where(f"usr < {n} and state <> 'ring' and depth = usr and root_usr = 0").count() == n
    assert out.where(f"usr >= {n} and state = 'ring' and depth is null and root_usr = {n}").count() == k
    assert tables.n - before < 25


def test_second_pass(spark, tables):
    """Default implementations go to extensions of the protocol that placed what they implement."""
    v = frame(spark, [("P", [], []), ("f", ["Self : P"], []), ("d1", ["Self : P"], []), ("d2", ["Self : P", "Self.Element : Equatable"], []), ("d3", ["Self : P", "T : Hashable"], ["T"]), ("d4", [], []), ("loose", [], [])],
              "usr string, constraints array<string>, generic_params array<string>")
    first = frame(spark, [("f", "P", 1, True), ("loose", "P", 2, False)], "source string, target string, ord int, into_target boolean")
    kind = "defaultImplementationOf"
    e = frame(spark, [(1, kind, "d1", "f"), (2, kind, "d2", "f"), (3, kind, "d3", "f"), (4, kind, "d4", "loose"), (5, kind, "gone", "f"), (6, kind, "d4", "unknown"), (7, "memberOf", "f", "P")], "ord int, kind string, source string, target string")
    out = {r.ord: r for r in graph.second_pass(e, v, first).collect()}
    assert {k: (r.target, r.constraint_key, r.warning is None, r.bad) for k, r in out.items()} == {
        1: ("P", "Self : P", True, False), 2: ("P", "Self : P, Self.Element : Equatable", True, False), 3: ("P", "Self : P", True, False), 4: (None, None, False, True), 5: ("P", None, False, False), 6: (None, None, False, True)}
    members = first.withColumn("constraint_key", F.lit("")).unionByName(graph.second_pass(e, v, first).where("warning is null").select("source", "target", "ord", "into_target", "constraint_key"))
    none = frame(spark, [], "source string, constraints array<string>, target_name string")
    ext = {r.constraint_key: r.members for r in graph.extension_map(members, none).collect()}
    assert ext == {"": ["loose"], "Self : P": ["d1", "d3"], "Self : P, Self.Element : Equatable": ["d2"]}
    bad = graph.second_pass(e, v, first).where("bad").select(F.col("source").alias("usr"))
    f = {r.usr: r.state for r in graph.rebuild(v, members, tables, bad).collect()}
    assert f == {"P": "root", "f": "placed", "d1": "extension", "d2": "extension", "d3": "extension", "d4": "bad", "loose": "extension"}


ROWS = "path array<int>, name string, kind string, module_name string, docs string"


def test_folded_protocol_extensions(spark, tables):
    rows = [
        ([0], "Proto", "swift.protocol", "Base", None), ([0, 0], "m1", "method", "Base", "own"), ([0, 1], "m2", "method", "Base", None), ([0, 2], "m1", "property", "Base", None), ([0, 3], "m1", "method", "Base", None),
        ([1], "Proto", "extension", "Other", None), ([1, 0], "m1", "method", "Other", "from other"), ([1, 0, 0], "inner", "parameter", "Other", None), ([1, 1], "m9", "method", "Other", "extra"), ([1, 1, 0], "deep", "parameter", "Other", None),
        ([2], "Proto", "extension", "Base", None), ([2, 0], "m2", "method", "Base", "conditional docs"), ([2, 0, 0], "deep2", "parameter", "Base", None),
        ([3], "Proto", "extension", "Base", None), ([3, 5], "m1", "method", "Base", "from base"), ([4], "Free", "extension", "Base", None), ([4, 0], "m1", "method", "Base", "free"),
    ]
    claims = frame(spark, [([1], [0], False), ([2], [0], True), ([3], [0], False), ([9], [0], False), ([4], [77], False)], "ext_path array<int>, type_path array<int>, is_constrained boolean")
    out = merge.folded_extensions(frame(spark, rows, ROWS), claims, tables).orderBy("path").collect()
    got = [(r.path[:1], r.name, r.docs, r.default_docs, [(n.tag, n.arg) for n in r.notes]) for r in out]
    assert got == [
        ([0], "Proto", None, None, []), ([0], "m1", "own", "from base", [("defaultImplementation", None), ("importedDefaultImplementation", "Other")]), ([0], "m2", None, None, [("conditionalDefaultImplementationExists", None)]),
        ([0], "m1", None, None, []), ([0], "m1", None, None, []), ([0], "m9", "extra", None, [("imported", "Other"), ("protocolExtensionMember", None)]), ([0], "deep", None, None, [("imported", "Other")]),
        ([0], "m2", None, "conditional docs", [("conditionalDefaultImplementation", None)]), ([0], "deep2", None, None, []), ([4], "Free", None, None, []), ([4], "m1", "free", None, [])]
    sizes = {r.name: len(r.path) for r in out}
    assert (sizes["m9"], sizes["deep"], sizes["deep2"]) == (2, 3, 3)


def test_folded_extensions_of_types_in_extensions(spark, tables):
    """An extension of a type that another extension holds goes along with it."""
    rows = [([0], "Clazz", "class", "M", None), ([1], "Clazz", "extension", "M", None), ([1, 0], "NStruct", "struct", "M", None), ([1, 0, 0], "own", "method", "M", None),
            ([2], "NStruct", "extension", "M", None), ([2, 0], "eMethod", "method", "M", None), ([3], "NStruct", "extension", "M", None), ([3, 0], "eMethod2", "method", "M", None), ([3, 0, 0], "leaf", "parameter", "M", None)]
    claims = frame(spark, [([1], [0], False), ([2], [1, 0], False), ([3], [1, 0], False)], "ext_path array<int>, type_path array<int>, is_constrained boolean")
    out = merge.folded_extensions(frame(spark, rows, ROWS), claims, tables).orderBy("path").collect()
    assert [(r.name, len(r.path)) for r in out] == [("Clazz", 1), ("NStruct", 2), ("own", 3), ("eMethod", 3), ("eMethod2", 3), ("leaf", 4)]
    assert all(b.path[:len(a.path)] == a.path for a, b in [(out[0], out[1]), (out[1], out[2]), (out[1], out[3]), (out[4], out[5])])
    with pytest.raises(ValueError):
        merge.folded_extensions(frame(spark, rows, ROWS), frame(spark, [([1], [1, 0], False)], "ext_path array<int>, type_path array<int>, is_constrained boolean"), tables)
    assert merge.folded_extensions(frame(spark, rows, ROWS), claims.limit(0), tables).count() == len(rows)


def test_deep_urls(spark, tables):
    n = 66
    items = frame(spark, [([0] * (k + 1), "def" if k else "group", f"x{k}", "type", "M", "yes", "swift", None) for k in range(n)],
                  "path array<int>, item_type string, name string, meta_kind string, module_name string, show_in_toc string, primary_language string, secondary_language string").coalesce(1)
    assert pages.urls(items, tables, "separate").count() == n


def test_deep_variant(spark):
    doc = {"key.name": "x"}
    for _ in range(109):
        doc = {"key.substructure": [doc]}
    spark.createDataFrame([("f", json.dumps(doc))], "file string, j string").select("file", F.parse_json("j").alias("v")).createOrReplaceTempView("deep")
    assert tree.flatten_variant(spark, "deep").count() == 110
    with pytest.raises(Exception, match="RECURSION"):
        tree.flatten_variant(spark, "deep", max_depth=20).count()


def test_variant_flatten(spark):
    doc = {"key.name": "A", "key.substructure": [{"key.name": "B", "key.substructure": [{"key.name": "C"}]}, {"key.name": 5}]}
    spark.createDataFrame([("f", json.dumps(doc))], "file string, j string").select("file", F.parse_json("j").alias("v")).createOrReplaceTempView("vv")
    rows = tree.flatten_variant(spark, "vv").select("path", F.try_variant_get("v", '$["key.name"]', "string").alias("n")).orderBy("path").collect()
    assert [(r.path, r.n) for r in rows] == [([0], "A"), ([0, 0], "B"), ([0, 0, 0], "C"), ([0, 1], "5")]


@pytest.mark.parametrize("policies, titles", [(["global", "global"], ["Types"]), (["separate", "separate"], ["A Types", "B Types"]), (["named", "global"], ["Rest Types", "Types"])])
def test_kind_groups(spark, policies, titles):
    items = frame(spark, [("type", "A"), ("type", "B")], "meta_kind string, module_name string")
    m = frame(spark, [(n, p, "Rest") for n, p in zip("AB", policies)], "module_name string, policy string, named string")
    g = group.kind_groups(items, m).select("group_title", "group_rank").distinct().orderBy("group_rank").collect()
    assert [x.group_title for x in g] == titles
    assert group.kind_groups(items.where("module_name = 'A'"), m.where("module_name = 'A'")).first().group_title in ("Types", "Rest Types")


def test_custom_groups(spark):
    rules = group.parse_groups([{"name": "G", "children": ["M.A", "/Class$/"]}, {"name": "H", "topics": [{"name": "T", "children": ["filepath /src/", "None"]}]}])
    items = frame(spark, [([0], "A", "M.A", "x"), ([1], "BClass", "M.BClass", "src/x"), ([2], "AClass", "M.AClass", "x"), ([3], "Z", "M.Z", "src/y"), ([4], "Y", "M.Y", "z")], "path array<int>, name string, qualified_name string, file_pathname string")
    c = group.rule_claims(items, rules, ["path"])
    assert [r.name for r in c.where("group_title = 'G'").orderBy(*group.claim_order(rules)).collect()] == ["A", "AClass", "BClass"]
    assert [r.name for r in c.where("rule_ord is null").collect()] == ["Y"] and [r.rule for r in group.unused_rules(c, rules).collect()] == ["None"]
    for bad in ({"children": []}, {"name": "x", "children": ["a"], "topics": [{"name": "t"}]}, {"name": "x", "children": ["/(/"]}):
        with pytest.raises(ValueError):
            group.parse_groups([bad])
    kids = frame(spark, [("T", [0], "a", "func a"), ("T", [1], "b", "func b"), ("T", [2], "c", "func c")], "type_name string, path array<int>, name string, declaration string")
    listed = frame(spark, [("T", "func c", "top", 0), ("T", "a", "top", 1)], "type_name string, entry string, topic string, place int")
    assert [r.name for r in group.custom_members(kids, listed, False).orderBy("place").collect()] == ["c", "a", "b"]
    assert [r.name for r in group.custom_members(kids, listed, True).orderBy("place").collect()] == ["c", "a"]


def test_directories(spark):
    d = frame(spark, [("/a",), ("/a/b",), ("/a/bc",), ("/a/b/c/d",)], "dir string")
    assert {r.dir: (r.parent_dir, r.title) for r in group.nested_directories(d).collect()} == {"/a": (None, "a"), "/a/b": ("/a", "b"), "/a/bc": ("/a", "bc"), "/a/b/c/d": ("/a/b", "c/d")}
    assert {r.dir: r.parent_dir for r in group.string_prefix_parents(d).collect()}["/a/bc"] == "/a/b"


def test_topics(spark):
    d = frame(spark, [(1, 0, None, None, "method", "b"), (1, 1, "x", "T: P", "type", "z"), (1, 2, None, None, "enumElement", "q"), (1, 3, None, "U: P", "enumElement", "a")], "parent int, ord int, topic string, extension_constraint string, def_topic string, name string")
    assert [r.topic for r in group.source_topics(d, "Other").orderBy("ord").collect()] == ["Other", "x", "x", "x"]
    assert [r.block_constraint for r in group.conditional_block(d).orderBy("ord").collect()] == [None, "T: P", "T: P", "U: P"]
    assert [r.name for r in d.withColumn("path", F.col("ord")).orderBy(*group.logical_order()).collect()] == ["z", "q", "a", "b"]


def test_scope_resolution(spark):
    items = frame(spark, [(k, [k], "swift", n, "M") for k, n in enumerate(["Outer", "Outer.Inner1", "Outer.Inner2", "Outer.Inner2.method(a:)", "Inner1"])], "item_id int, path array<int>, language string, full_name string, module_name string")
    index = links.name_index(items)
    refs = frame(spark, [(1, "Inner1", ["Outer", "Inner2"]), (2, "Inner1", []), (3, "M.Outer", []), (4, "method(...)", ["Outer", "Inner2"]), (5, "nothing", ["Outer"])], "id int, name string, scopes array<string>")
    r = {x.id: x.item_id for x in links.resolve_local(refs, index, ["swift", "objc"]).collect()}
    assert r == {1: 1, 2: 4, 3: 0, 4: 3, 5: None}


def test_scopes_go_before_languages(spark):
    """All enclosing prefixes in all languages come before any global name, those before names under the context."""
    items = frame(spark, [(1, [1], "swift", "B", "M"), (2, [2], "objc", "A.B", "M"), (3, [3], "objc", "Class.-meth:od:", "M"), (4, [4], "swift", "C.inner()", "M"), (5, [5], "swift", "C.last", "M"), (6, [6], "objc", "last", "M")], "item_id int, path array<int>, language string, full_name string, module_name string")
    index = links.name_index(items)
    refs = frame(spark, [(1, "B", ["A"], "C"), (2, "-[Class(Cat) meth:od:]", [], None), (3, "inner(...)", ["A"], "C"), (4, "last", ["A"], "C"), (5, "M.B", ["A"], "C"), (6, "M.last", [], "C")], "id int, name string, scopes array<string>, context string")
    r = {x.id: (x.item_id, x.language) for x in links.resolve_local(refs, index, ["swift", "objc"]).collect()}
    assert r == {1: (2, "objc"), 2: (3, "objc"), 3: (4, "swift"), 4: (6, "objc"), 5: (1, "swift"), 6: (None, None)}
    assert {x.key for x in index.where("item_id = 4").collect()} == {"C.inner()", "M.C.inner()", "C.inner(...)", "M.C.inner(...)"}


def test_autolink_chain(spark):
    items = frame(spark, [(1, [1], "swift", "A", "M"), (2, [2], "swift", "A.b", "M")], "item_id int, path array<int>, language string, full_name string, module_name string")
    remote = frame(spark, [(0, "Mod", "R", "r")], "source_ord int, module_name string, key string, url string")
    db = frame(spark, [("Swift", "String", "s"), ("Swift", "R", "never")], "module_name string, name string, url string")
    names = ["b", "A", "T", ".x", "$a$", "R", "String", "nothing", "true", "<doc:M/A>", "A-1a2b3"]
    refs = frame(spark, [(k, n, ["A"], "c", 9, ["T"]) for k, n in enumerate(names)] + [(20, "A", [], "A", 1, None)], "ref_id int, name string, scopes array<string>, context string, context_id int, generic_params array<string>")
    r = {x.ref_id: (x.outcome, x.item_id, x.url, x.report) for x in links.autolink(refs, links.name_index(items), remote, db, ["swift", "objc"]).collect()}
    rej, no = ("rejected", None, None, False), ("unresolved", None, None, True)
    assert [r[k] for k in range(11)] == [("local", 2, None, False), ("local", 1, None, False), rej, rej, rej, ("remote", None, "r", False), ("builtin", None, "s", False), no, ("unresolved", None, None, False), ("local", 1, None, False), ("local", 1, None, False)]
    assert r[20] == ("self", None, None, False)


def test_dual_links(spark):
    d = frame(spark, [("f", {"swift": "s.html", "objc": "o.html"}, {"swift": "f", "objc": "g"}, {"swift": "A.f", "objc": "A.g"}), ("A.f", {"swift": "s.html", "objc": "o.html"}, {"swift": "f", "objc": "g"}, {"swift": "A.f", "objc": "A.g"}), ("f<T>", {"swift": "s.html"}, {}, {})], "t string, u map<string,string>, n map<string,string>, f map<string,string>")
    got = [r.h for r in d.select(links.dual_link(F.col("t"), F.lit("swift"), F.col("u"), F.col("n"), F.col("f")).alias("h")).orderBy(F.desc("t")).collect()]
    a = '<a href="s.html" class="j2-swift"><code>{}</code></a><a href="o.html" class="j2-objc j2-secondary"><code>{}</code></a>'
    assert got == ['<a href="s.html"><code>f&lt;T&gt;</code></a>', a.format("f", "g"), a.format("A.f", "A.g")]


def test_remote_and_builtin(spark):
    refs = frame(spark, [(1, "A"), (2, "Mod.B"), (3, "lower"), (4, "Swift.String"), (5, "Nope")], "ref_id int, name string")
    remote = frame(spark, [(1, "Mod", "B", "u2"), (0, "X", "A", "u1"), (1, "Mod", "A", "u0")], "source_ord int, module_name string, key string, url string")
    assert {x.ref_id: x.url for x in links.resolve_remote(refs, remote).collect()} == {1: "u1", 2: "u2"}
    db = frame(spark, [("Foundation", "A", "f"), ("Swift", "A", "s"), ("Swift", "String", "str"), ("Swift", "lower", "l")], "module_name string, name string, url string")
    assert {x.ref_id: x.url for x in links.resolve_builtin(refs, db).collect()} == {1: "s", 4: "str"}


def test_search_index_fixpoint(spark, tables):
    e = frame(spark, [("Classes/A.html", "A", None), ("Classes/A.html#/m", "m(a:)", "A"), ("Classes/A/In.html", "In", "A"), ("Classes/A/In.html#/x", "x", "In"), ("Extensions/A.html", "A", None)], "url string, name string, parent_name string")
    got = {r.full_name: r.url for r in links.parent_fixpoint(e, tables).collect()}
    assert got == {"A": "Classes/A.html", "A.m(a:)": "Classes/A.html#/m", "A.m(...)": "Classes/A.html#/m", "A.In": "Classes/A/In.html", "A.In.x": "Classes/A/In.html#/x"}


def plain_search_parents(entries):
    """The search index as a loop over sorted entries fills it."""
    left, index, flat = [], {}, {}
    for e in sorted(entries):
        if "extensions" in e[0].lower().split("/"):
            continue
        if e[2] is None:
            index[e[1]] = (e[0], {}, True)
        else:
            left.append(e)
    while True:
        rest = []
        for url, name, parent in left:
            if parent not in index:
                rest.append((url, name, parent))
                continue
            entry = (url, {}, False)
            index[parent][1][name] = entry
            if "(" in name:
                index[parent][1][name[:name.index("(")] + "(...)" + name[name.rindex(")") + 1:]] = entry
            index.setdefault(name, entry)
        if len(rest) == len(left):
            break
        left = rest

    def walk(entry, path):
        flat[path] = entry[0]
        for n, kid in entry[1].items():
            walk(kid, f"{path}.{n}")

    for name, entry in index.items():
        if entry[2]:
            walk(entry, name)
    return flat


def test_search_index_like_the_loop(spark, tables):
    import random

    r = random.Random(5)
    for _ in range(3):
        urls = r.sample(range(1000), 60)
        e = [(f"{'extensions/' if r.random() < 0.1 else ''}p{u:03}.html", r.choice("ABCDEFGH") + r.choice(["", "", "(x:)", "(y:)"]), r.choice([None, *"ABCDEFGHXY"]) if r.random() < 0.9 else None) for u in urls]
        e += [("p998.html#/1", "m", "A"), ("p998.html#/2", "m", "A"), ("other/In.html", "In", "A")]
        got = {x.full_name: x.url for x in links.parent_fixpoint(frame(spark, e, "url string, name string, parent_name string"), tables).collect()}
        assert got == plain_search_parents(e)


def test_order_over_ranges(spark, tables):
    import random

    v = random.Random(1).sample(range(10_000), 500)
    d = frame(spark, [(x, f"n{x}") for x in v], "ord int, name string").repartition(4)
    s = sorted(v)
    assert {r.ord: r.id for r in ordered.numbered(d, ["ord"], "id", tables).collect()} == {x: k + 1 for k, x in enumerate(s)}
    got = {r.ord: (r.p, r.n) for r in ordered.neighbours(d, ["ord"], "name", "p", "n", tables).collect()}
    assert got == {x: (f"n{s[k - 1]}" if k else None, f"n{s[k + 1]}" if k + 1 < len(s) else None) for k, x in enumerate(s)}
    assert ordered.numbered(d.limit(0), ["ord"], "id", tables).count() == 0


def test_merged_forest(spark, tables):
    rows = [([0], "a", "k", ["x"]), ([0, 0], "m", "k", []), ([1], "a", "k", ["y", "x"]), ([1, 0], "m", "k", ["z"]), ([1, 0, 0], "p", "k", []), ([1, 1], "n", "k", []), ([2], "b", "k", []), ([2, 0], "m", "k", []), ([3], "a", "other", ["w"])]
    out = merge.merged_forest(frame(spark, rows, "path array<int>, usr string, kind string, availability array<string>"), tables)
    got = {tuple(r.path): (r.usr, r.head_parent, r.availability, r.copies, r.mismatches) for r in out.collect()}
    assert got == {(0,): ("a", None, ["x", "y"], 3, 1), (0, 0): ("m", [0], ["z"], 2, 0), (1, 0, 0): ("p", [0, 0], [], 1, 0), (1, 1): ("n", [0], [], 1, 0), (2,): ("b", None, [], 1, 0), (2, 0): ("m", [2], [], 1, 0)}


def test_text_candidates(spark):
    d = spark.createDataFrame([("# One\ntext `A/b` and `c`\n\n## Two! ##\n### Three\n* **bold** [x](y)", "func f(_ a: Mod.Type) -> @Foo Bar", "p one\n\np two")], "m string, d string, p string")
    r = d.select(links.code_spans(F.col("m")).alias("c"), links.headings(F.col("m")).alias("h"), links.type_names(F.col("d")).alias("t"), links.paragraphs_to_list(F.col("p")).alias("p"), links.plain_text(F.col("m")).alias("x")).first()
    assert r.c == ["A.b", "c"] and [(h.level, h.title, h.anchor) for h in r.h] == [(1, "One", "one"), (2, "Two!", "two")]
    assert r.t == ["Mod.Type", "@Foo", "Bar"] or r.t == ["Mod.Type", "Foo", "Bar"]
    assert r.p == "- p one\n- p two" and "bold x" in r.x


def test_search_top(spark):
    d = frame(spark, [(1, "apple pie", ""), (2, "apples", ""), (3, "pear", "an apple"), (4, "plum", "")], "id int, name string, abstract string")
    assert [(r.id, r.score) for r in links.search(d, ["apple"], "id", ["name", "abstract"]).collect()] == [(1, 110), (3, 110), (2, 10)]


def graph_of(symbols, relationships):
    return json.dumps({"metadata": {"generator": "g"}, "symbols": symbols, "relationships": relationships})


def symbol(usr, name, kind="swift.struct", acl="public", **more):
    return {"kind": {"identifier": kind}, "identifier": {"precise": usr}, "pathComponents": [name], "accessLevel": acl, "declarationFragments": [{"spelling": f"struct {name}", "kind": "text"}], **more}


def test_symbol_graph(spark, tables, tmp_path):
    where = [{"kind": "conformance", "lhs": "T", "rhs": "P"}]
    g = graph_of(
        [symbol("s:S", "S", swiftGenerics={"parameters": [{"name": "T", "depth": 0}], "constraints": []}), symbol("s:m", "m", "swift.method"), symbol("s:n", "n", "swift.method", swiftExtension={"extendedModule": "M", "constraints": where}), symbol("s:P", "P", "swift.protocol"), symbol("s:bad", "B", "swift.nonsense")],
        [{"kind": "memberOf", "source": "s:m", "target": "s:S"}, {"kind": "memberOf", "source": "s:n", "target": "s:S"}, {"kind": "conformsTo", "source": "s:S", "target": "s:P"}, {"kind": "conformsTo", "source": "s:S", "target": "s:X", "targetFallback": "Other", "swiftConstraints": where}, {"kind": "memberOf", "source": "s:gone", "target": "s:S"}, {"kind": "odd", "source": "s:m", "target": "s:S"}, {"kind": "overrides", "source": "s:m", "target": "s:n"}])
    (tmp_path / "M.symbols.json").write_text(g)
    from arborql.sources.readers import symbol_graphs

    files = symbol_graphs(spark, str(tmp_path))
    assert files.first().module_name == "M" and files.select("symbols").schema["symbols"].dataType == spark.createDataFrame([], SYMBOL_GRAPH).schema["symbols"].dataType
    s = graph.symbols(files)
    assert s.where("warning is not null").count() == 1
    v = graph.vertices(s.where("warning is null"))
    e = graph.resolved(graph.edges(files), v)
    assert sorted(x.warning for x in e.where("warning is not null").collect()) == ["missing source", "unknown relationship"]
    p = graph.placed(e)
    assert {x.source: x.into_target for x in p.collect()} == {"s:m": True, "s:n": False}
    ext = graph.extension_map(p, graph.conformances(e)).collect()
    assert sorted((x.constraint_key, x.members, x.conforms_to) for x in ext) == [("", [], ["P"]), ("T : P", ["s:n"], ["Other"])]
    assert {x.usr: (x.depth, x.root_usr) for x in graph.rebuild(v, p, tables).collect()}["s:m"] == (1, "s:S")
    assert {x.usr: x.is_override for x in graph.flags(e).collect()}["s:m"]


def test_urls_and_pages(spark, tables):
    items = frame(spark, [([0], "group", "Types", "group", "M", "yes", "swift", None), ([0, 0], "def", "Big One", "type", "M", "yes", "swift", "objc"), ([0, 0, 0], "def", "leaf", "other", "M", "no", "swift", None), ([1], "guide", "Guide", "guide", "M", "yes", None, None), ([2], "group", "Empty", "group", "M", "yes", None, None)],
                  "path array<int>, item_type string, name string, meta_kind string, module_name string, show_in_toc string, primary_language string, secondary_language string")
    u = {tuple(r.path): (r.url_path, r.url_hash) for r in pages.urls(items, tables).collect()}
    assert u == {(0,): ("types.html", None), (0, 0): ("types/big-one.html", None), (0, 0, 0): ("types/big-one.html", "/leaf"), (1,): ("guides/guide.html", None), (2,): ("empty.html", None)}
    assert {tuple(r.path): r.url_path for r in pages.urls(items, tables, "separate", True).collect()}[(0, 0, 0)] == "m/types/big-one/leaf.html"
    assert {tuple(r.path) for r in pages.toc(items, "swift").collect()} == {(0,), (0, 0), (1,)}
    assert [r.language for r in pages.languages(items).collect()] == ["objc", "swift"] and pages.languages(items.limit(0)).first().language == "swift"
    lin = frame(spark, [([0], "a", True, "def"), ([1], "x", False, "def"), ([2], "b", True, "def"), ([9], "r", True, "readme")], "path array<int>, url_path string, render_as_page boolean, item_type string")
    assert {r.url_path: (r.prev_url, r.next_url) for r in pages.linear(lin).collect()} == {"a": (None, "b"), "b": ("a", None), "r": ("b", "a")}
    t = frame(spark, [(1, 0, "t1", "One"), (1, 1, "t1", "One"), (1, 2, "t2", "One"), (1, 3, "t1", "One")], "parent int, ord int, topic_id string, topic_title string")
    assert [(r.n, r.anchor) for r in pages.page_topics(t).orderBy("island").collect()] == [(2, "tpc-one"), (1, "tpc-one1"), (1, "tpc-one2")]
    c = lambda x: F.lit(x)
    r = spark.range(1).select(pages.code_host_url(c("http://h"), c("/s/a b.swift"), c("/s"), c(3), c(5)).alias("g"), pages.code_host_url(c("http://h"), c("/t/a"), c("/s"), c(3), c(5)).alias("n"), pages.code_host_url(c("h"), c("/s/a"), c("/s/"), c(3), c(5), "bitbucket").alias("b")).first()
    assert (r.g, r.n, r.b) == ("http://h/a%20b.swift#L3-L5", None, "h/a#lines-3:5")
    g = pages.with_globals(spark.createDataFrame([({"a": "page"},)], "page_values map<string,string>"), {"a": "all", "b": "all"}).first()
    assert g.page_values == {"a": "page", "b": "all"}


def test_reports(spark):
    r = frame(spark, [(1, "n", "c1"), (2, "n", "c2"), (3, "a", "z")], "ord int, name string, context string")
    assert [(x.name, x.context) for x in stats.unresolved(r, "ord").collect()] == [("a", "z"), ("n", "c2")]
    c = frame(spark, [("documentedDef", 47), ("missingDocumentation", 50), ("filterSpi", 0), ("filterMinAclExcluded", 2)], "counter string, n long")
    assert [x.line for x in stats.coverage_report(c).orderBy("line_no").collect()] == ["48% documentation coverage with 50 undocumented symbols", "2 symbols skipped by access level"]
    assert [x.c for x in frame(spark, [(i, n) for i, n in enumerate([5, 10, 29, 60, 85, 90])], "i int, n int").select("i", stats.badge_colour(F.col("n")).alias("c")).orderBy("i").collect()] == ["red", "orange", "orange", "yellowgreen", "green", "brightgreen"]
    assert ordered.ordered_union(r, r).count() == 6


def parsed(spark, f, *texts):
    """What a parser of columns makes of each text, as Python values."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = {r.k: r.v for r in df.select("k", f(F.col("t")).alias("v")).collect()}
    plain = lambda v: v.asDict(True) if hasattr(v, "asDict") else [plain(x) for x in v] if isinstance(v, list) else v
    return [plain(rows[k]) for k in range(len(texts))]


def test_doc_comments(spark):
    d, listed, empty, none = parsed(
        spark, decls.doc_comment, "First paragraph\ngoes on.\n\nMore text.\n\n- parameter a: the a\n  goes on\n- returns: it\n- note: stays\n- Throws: bad\n- localizationKey: k",
        "- parameters:\n  - x: one\n  - y: two", "", None)
    assert d["abstract"] == "First paragraph\ngoes on." and d["discussion"] == "More text.\n\n- note: stays"
    assert d["parameters"] == [{"name": "a", "description": "the a\ngoes on"}] and (d["returns"], d["throws"], d["localization_key"]) == ("it", "bad", "k")
    assert listed["parameters"] == [{"name": "x", "description": "one"}, {"name": "y", "description": "two"}]
    assert empty["abstract"] == "" and none is None
    x, broken = parsed(spark, decls.xml_docs, "<Function><CommentParts><Abstract><Para>Do <codeVoice>it</codeVoice></Para></Abstract><Parameters><Parameter><Name>a</Name><Discussion><Para>the a</Para></Discussion></Parameter></Parameters><ResultDiscussion><Para>r</Para></ResultDiscussion><Discussion><Para>one</Para><List-Bullet><Item><Para>i</Para></Item></List-Bullet></Discussion></CommentParts></Function>", "<broken")
    assert x["abstract"] == "Do `it`" and x["discussion"] == "one\n\n- i" and x["parameters"] == [{"name": "a", "description": "the a"}] and x["returns"] == "r"
    assert broken is None


def test_xml_docs_of_odd_shapes(spark):
    bad = ["<a><b></a></b>", "<a/><b/>", "text", "<a>&bad;</a>", "<a x=1/>", "<a>", "</a>", "", None, "<a/> tail"]
    full = ('<?xml version="1.0"?><!-- c --><F><CommentParts><Abstract><Para>A &lt;b&gt; <emphasis>e <bold>f</bold></emphasis> <Link href="http://x?a=1">l</Link></Para></Abstract><Discussion><Para> one </Para>\n<Note><Para>two</Para><Para>three</Para></Note>'
            '<List-Number><Item><Para>i</Para><Para>j</Para></Item><Item><Para>k</Para></Item></List-Number><CodeListing language="swift"><zCodeLineNumbered><![CDATA[let x = 1 < 2]]></zCodeLineNumbered><zCodeLineNumbered>y</zCodeLineNumbered></CodeListing></Discussion>'
            '<Parameters><Parameter><Name>x</Name><Direction isExplicit="0">in</Direction><Discussion><Para>p</Para><Para>q</Para></Discussion></Parameter><Parameter><Name>y</Name></Parameter></Parameters><ThrowsDiscussion><Para>t</Para></ThrowsDiscussion></CommentParts></F>')
    *none, got, empty = parsed(spark, decls.xml_docs, *bad, full, " <a> </a> ")
    assert none == [None] * len(bad)
    assert got == {"abstract": "A <b> *e **f*** [l](http://x?a=1)", "discussion": "one\n\n- Note: two three\n\n1. i\nj\n2. k\n\n```swift\nlet x = 1 < 2\ny\n```", "returns": None, "throws": "t", "localization_key": None,
                   "parameters": [{"name": "x", "description": "p\n\nq"}, {"name": "y", "description": ""}]}
    assert empty == {"abstract": "", "discussion": "", "returns": None, "throws": None, "localization_key": None, "parameters": []}
    assert parsed(spark, lambda c: decls.xml_docs(c, brief=True), full)[0]["discussion"] == ""


def test_doc_comments_of_odd_shapes(spark):
    fenced, heading, quote, nested, twice, stray = parsed(
        spark, decls.doc_comment, "```\ncode\n\nmore - returns: x\n```\n\n- Returns: y", "# Heading\n\ntext", "> quote\n\nafter", "* Parameter a : b\n+ parameter c:d\n- Parameters:\n  stray line\n  - q: w\n    more", "- item one\n- returns: a\n\n- returns: b", "- parameters:\n  stray")
    assert (fenced["abstract"], fenced["discussion"], fenced["returns"]) == ("", "```\ncode\n\nmore - returns: x\n```", "y")
    assert (heading["abstract"], heading["discussion"]) == ("", "# Heading\n\ntext") and (quote["abstract"], quote["discussion"]) == ("", "> quote\n\nafter")
    assert nested["parameters"] == [{"name": "a", "description": "b"}, {"name": "c", "description": "d\nstray line"}, {"name": "q", "description": "w\nmore"}]
    assert twice["returns"] == "b" and twice["discussion"] == "- item one" and stray["parameters"] == []


def test_availability(spark):
    a, b, c, d, none = parsed(spark, decls.availability, "@available(macOS 10.15, iOS 13, *)", "@available(iOS, introduced: 9, obsoleted: 11, message: \"no, never\")", "@available(macOS, obsoleted: 11)", "@available(*, deprecated, renamed: \"g\")", "@objc")
    assert a["available"] == ["macOS 10.15+", "iOS 13+"]
    assert b == {"available": ["iOS 9-11"], "deprecated": None, "unavailable": "iOS unavailable since 11: no, never"}
    assert c["available"] == ["macOS ?-11"]
    assert d["deprecated"] == "deprecated: Renamed: `g`."
    assert none is None
    e, f = parsed(spark, decls.availability, "@available(iOS, deprecated: 11, message: \"use a, b (c): d\", renamed: \"foo(a:b:)\")", "@available(swift 5.1)")
    assert e["deprecated"] == "iOS deprecated since 11: use a, b (c): d Renamed: `foo(a:b:)`." and e["available"] == [] and f["available"] == ["swift 5.1+"]


def test_name_pieces(spark):
    full = "public func f(a b: Int, _ c: [String: Int], d: (Int) -> Void) -> Int"
    texts = [full, "var x: Int", "class Foo<T>: Bar", None, "init(x: Int, y z: (a: Int) -> B)", "static func == (lhs: A, rhs: A) -> Bool", "func g<T>(with t: T, then: @escaping (Int, b: Int) -> Void = { x in y(z: 1) })", "something odd"]
    got = parsed(spark, decls.pieces, *texts)
    name = lambda p: "".join(x["text"] for x in p if x["is_name"])
    assert "".join(p["text"] for p in got[0]) == full and name(got[0]).startswith("fa") and "Int" not in name(got[0])
    assert name(got[1]) == "x" and name(got[2]) == "Foo" and got[3] == []
    assert name(got[4]) == "initxy" and name(got[5]) == "==lhsrhs" and name(got[6]) == "gwiththen" and name(got[7]) == "something odd"
    assert all("".join(p["text"] for p in g) == t for g, t in zip(got, texts) if t)
    df = spark.createDataFrame([("/// x", "@available(iOS 9, *)", full)], "c string, a string, d string")
    r = df.select(decls.doc_comment("c").alias("c"), decls.availability("a").alias("a"), decls.pieces("d").alias("p"), decls.to_html("c").alias("h")).first()
    assert r.a.available == ["iOS 9+"] and r.p[1].is_name and r.h == "<p>/// x</p>"


def test_declaration_columns(spark):
    d = spark.createDataFrame([("x",)], "x string")
    c = lambda s: F.lit(s)
    from arborql.model import OBJC, SWIFT

    r = d.select(
        decls.adjusted_kind(c(SWIFT + "function.method.instance"), c("init(a:)"), c("init(a: Int)"), c("")).alias("k"), decls.adjusted_kind(c(SWIFT + "class"), c("A"), c("actor A"), c("")).alias("a"),
        decls.operator_name(c("+(_:_:)"), c("static func + (a: Int, b: String) -> Int")).alias("o"), decls.type_usr(c("c:objc(cy)T@C")).alias("u"), decls.generic_requirements(c("func f<T>() where T:\n  P")).alias("g"),
        decls.callout(c("Parameter x: the x")).alias("p"), decls.callout(c("Note: hi")).alias("n"), decls.callout(c("plain: no")).alias("z"), decls.callout(c("Callout(My Title): t")).alias("t"),
        decls.qualified_name(F.array(c("A")), c("m:"), c(OBJC + "method.class"), c("")).alias("q"), decls.objc_declaration(c('- (void) m  __attribute__((deprecated("use n")));')).alias("oc"), slugged(c("A b")).alias("s"),
        decls.swift_declaration(c("<d>func f(x: <t>M.Int</t>) -&gt; Int</d>"), c(""), F.array(c("@objc")), c("M")).alias("sd")).first()
    assert r.k == SWIFT + "function.constructor" and r.a == SWIFT + "actor" and r.o == "+(Int:String:)" and r.u == "c:objc(cs)T" and r.g == "T: P"
    assert (r.p.kind, r.p.title, r.p.body) == ("parameter", "x", "the x") and r.n.kind == "term" and r.z is None and r.t.title == "My Title"
    assert r.q == "+[A m:]" and r.oc.text == "- (void) m;" and r.oc.deprecated == "use n" and r.sd == "@objc\nfunc f(x: Int) -> Int"


def test_markdown(spark):
    h, spans, blocks, opened, none, empty = parsed(
        spark, decls.to_html, "# Title `x`\n\nA *b* <c>\n- one\n- two\n\n```\ncode <\n```\n![i|50%](p.png)", "`a < b` and [l\"k](http://x?a=1&b) _em_ a_b_c **x** [`code`](u) $x_1 * y$",
        "para one\nstill\n\n> quote **b**\n\n- a\n  more\n* c & d\n\n## H2 ##\n### !!!\n```js\nx = 'y'\n```", "```\nopen", None, "")
    assert spans == '<p><code>a &lt; b</code> and <a href="http://x?a=1&b">l&quot;k</a> <em>em</em> a_b_c <strong>x</strong> <a href="u"><code>code</code></a> $x_1 * y$</p>'
    assert blocks == '<p>para one still</p>\n<blockquote><p>quote <strong>b</strong></p></blockquote>\n<ul><li>a more</li><li>c &amp; d</li></ul>\n<h2 id="h2">H2</h2>\n<h3 id="e">!!!</h3>\n<pre><code class="language-js">x = &#x27;y&#x27;</code></pre>'
    assert opened == '<pre><code class="language-swift">open</code></pre>' and none is None and empty == ""
    assert '<h1 id="title-x">Title <code>x</code></h1>' in h and "<p>A <em>b</em> &lt;c&gt;</p>" in h and "<ul><li>one</li><li>two</li></ul>" in h and 'class="language-swift">code &lt;' in h and "width: 50%" in h


def test_page_assembly(spark):
    items = frame(spark, [([0], "group", "Types", "types.html", None, None, None, None), ([0, 0], "def", "A", "types/a.html", None, "t1", "One", "about"), ([0, 0, 0], "def", "x", "types/a.html", "/x", "t1", "One", None), ([0, 0, 1], "def", "y", "types/a.html", "/y", "t2", "One", None)],
                  "path array<int>, item_type string, name string, url_path string, url_hash string, topic_id string, topic_title string, abstract string")
    r = {x.title: x for x in pages.assemble(items).collect()}
    assert set(r) == {"Types", "A"} and r["A"].breadcrumbs == ["Types", "A"] and (r["A"].prev_url, r["Types"].next_url) == ("types.html", "types/a.html")
    assert [(t.title, t.anchor, [i.name for i in t["items"]]) for t in r["A"].topics] == [("One", "tpc-one", ["x"]), ("One", "tpc-one1", ["y"])]
    d = pages.page_dictionaries(pages.assemble(items), ["en", "fr"], {"copyright": "c", "title": "never"}).collect()
    assert len(d) == 4 and json.loads(d[0].json)["copyright"] == "c" and {json.loads(x.json)["title"] for x in d} == {"Types", "A"}
    m = pages.menu(frame(spark, [("G", 1, "b", "u2"), ("G", 1, "a", "u1"), ("H", 0, "c", "u3")], "group_title string, group_rank int, name string, url_path string")).collect()
    assert [(x.group_title, [c.name for c in x.children]) for x in m] == [("H", ["c"]), ("G", ["a", "b"])]


def test_small_joins_and_sets(spark):
    g = frame(spark, [("One",), ("Two",)], "name string")
    t = frame(spark, [("One", "First"), ("No", "x")], "name string, title string")
    assert {r.name: r.title for r in group.guide_titles(g, t).collect()} == {"One": "First", "Two": "Two"} and [r.name for r in group.unused_titles(g, t).collect()] == ["No"]
    c = frame(spark, [("a", "guide", None), ("b", "guide", 1), ("c", "def", None)], "name string, item_type string, rule_ord int")
    assert {r.name for r in group.listed_guides(c, True).collect()} == {"b", "c"} and group.listed_guides(c, False).count() == 3
    assert [r.dir for r in group.by_depth(frame(spark, [("a/b",), ("c",), ("a/b",)], "dir string")).collect()] == ["c", "a/b"]
    s = spark.createDataFrame([(["a", "b", "a"], ["b"])], "a array<string>, b array<string>").select(ordered.set_minus(F.col("a"), F.col("b")).alias("m"), ordered.set_meets(F.col("a"), F.col("b")).alias("o"), ordered.multiset_minus(F.col("a"), F.col("b")).alias("x")).first()
    assert s.m == ["a"] and s.o and s.x == ["a", "a"] and ordered.union_distinct(g, g).count() == 2
    o = merge.with_other_language(frame(spark, [("u",), ("v",)], "usr string"), frame(spark, [("u", "n", "d"), ("v", None, "d")], "usr string, name string, declaration string"))
    assert {r.usr: r.other and r.other.name for r in o.collect()} == {"u": "n", "v": None}
    p = frame(spark, [([0], None, "x.class", None, "C"), ([0, 0], [0], "x.generic_type_param", "x.class", "T"), ([0, 1], [0], "x.method", "x.class", "m"), ([1, 0], [1], "x.field", "sourcekitten.source.lang.objc.decl.typedef", "f")], "path array<int>, parent_path array<int>, kind string, parent_kind string, name string")
    assert {r.name: r.generic_params for r in merge.generic_parameters(p).collect()} == {"C": ["T"], "m": []}
