"""Files by name, patterns, fetching, prefixes, JSON trees and whole definitions."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from arborql.functions.text import common_prefix
from arborql.operators import prefixes, tree
from arborql.sources import definitions, readers, remote, sinks, tree_files


def names(spark, n):
    return spark.createDataFrame([(x,) for x in n], "name string").repartition(3)


def test_prefixes(spark, tables):
    r = random.Random(3)
    given = ["foo", "fob", "fo", "foom", "foop", "bar", "coverage", "profiling", "prolix", "é", "éa", "日本", "日本語", "", None, "foo"] + ["".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(60)]
    every = sorted({x for x in given if x})
    want = {x: next((x[:k] for k in range(1, len(x) + 1) if sum(y.startswith(x[:k]) for y in every) == 1), None) for x in every}
    assert {x.name: x.prefix for x in prefixes.unique_prefixes(names(spark, given), "name", tables).collect()} == want
    assert want["foo"] is None and want["fo"] is None and want["prolix"] == "prol"
    asked = sorted({x[:k] for x in every for k in range(len(x) + 1)} | {"zen", "prolapse", "foomp"})
    got = {x.prefix: x.name for x in prefixes.matched_prefixes(spark.createDataFrame([(x,) for x in asked], "prefix string"), names(spark, given), tables).collect()}
    assert got == {a: (hits[0] if len(hits := [y for y in every if y.startswith(a)]) == 1 and a else None) for a in asked}
    none = names(spark, []).limit(0)
    assert prefixes.unique_prefixes(none, "name", tables).count() == 0 and prefixes.matched_prefixes(spark.createDataFrame([("a",)], "prefix string"), none, tables).first().name is None
    assert names(spark, ["abc"]).select(common_prefix(F.col("name"), F.lit(None).cast("string")).alias("n")).first().n == 0


def test_json_trees(spark, tables):
    """Trees of any shape, a chain of 300 among them, against Python's own."""
    r = random.Random(8)
    rows = [("f", [0], "root"), ("g", [0], "alone"), ("g", [3], 'q"uote')]
    rows += [("f", [0, *p], f"n{k}") for k, p in enumerate([[0], [0, 0], [0, 1], [0, 1, 0], [2], [2, 5, ], [9]])]
    rows += [("deep", [0] * k, f"d{k}") for k in range(1, 301)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, path array<int>, name string").repartition(4).withColumn("body", F.to_json(F.struct("name")))

    def plain(file, path):
        kids = sorted(p for f, p, _ in rows if f == file and len(p) == len(path) + 1 and p[:len(path)] == path)
        name = next(n for f, p, n in rows if f == file and p == path)
        return {"name": name} | ({"children": [plain(file, k) for k in kids]} if kids else {})

    got = {(x.file, x.top): x.json for x in tree.json_trees(tree.json_pieces(df, "body", ["file"], tables), ["file"]).collect()}
    assert set(got) == {("f", 0), ("g", 0), ("g", 3), ("deep", 0)}
    for (f, top), j in got.items():
        if f == "deep":
            assert j.count("{") == 300 and j.startswith('{"name":"d1","children":[{"name":"d2"') and j.endswith("]}" * 299)
        else:
            assert json.loads(j) == plain(f, [top])
    empty = df.where("file = 'g'").withColumn("body", F.lit("{}"))
    assert [x.json for x in tree.json_trees(tree.json_pieces(empty, "body", ["file"], tables), ["file"]).collect()] == ["{}", "{}"]
    with pytest.raises(Exception, match="no parent"):
        tree.json_pieces(spark.createDataFrame([([0], "{}"), ([0, 1, 2], "{}")], "path array<int>, body string"), "body", [], tables).collect()


def test_definitions_there_and_back(spark):
    given = [
        {"key.name": "x", "key.offset": 5, "key.inheritedtypes": [{"key.name": "A"}], "key.bb.documentation": {"key.bb.abstract": {"en": "e\n\"q\"", "fr": "f"}, "key.bb.parameters": [{"key.bb.param_name": "p", "key.bb.param_desc": {"en": "d"}}]}, "key.substructure": [{"key.name": "kid"}]},
        {"key.offset": "not a number", "key.attributes": "no array", "key.other": {"a": [1, 2.5, None, "q", {"b": True}]}, "key.bb.is_spi": True}, {}, {"key.name": None, "x": None},
    ]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(given)], "id int, j string").select("id", F.parse_json("j").alias("v"))
    d = definitions.definitions(df)
    assert d.columns == ["id", *[f for f, *_ in definitions.FIELDS], "rest"]
    assert d.select([f for f, *_ in definitions.FIELDS]).schema.simpleString() == definitions.row_type().simpleString()
    back = {r.id: json.loads(r.json) for r in definitions.as_json(d).collect()}
    want = [{k: v for k, v in x.items() if k != "key.substructure"} for x in given]
    want[3] = {"x": None, "key.name": None}
    assert [back[k] for k in range(len(given))] == want
    row = d.where("id = 0").first()
    assert row.offset == 5 and row.inherited[0]["key.name"] == "A" and row.docs["key.bb.abstract"]["fr"] == "f" and not row.rest
    assert definitions.as_json(d.select("id", "name", "attributes")).where("id = 2").first().json == "{}"


def test_tree_files(spark, tmp_path):
    rows = [(f"a/f{k % 3}.txt", k, f"line {k}") for k in range(30)] + [("top.txt", 0, "é")]
    df = spark.createDataFrame(rows, "path string, ord int, line string").repartition(5)
    top = f"{tmp_path}/out"
    tree_files.write_tree(df, top)
    assert sorted(os.listdir(tmp_path)) == ["out"] and open(f"{top}/top.txt", encoding="utf-8").read() == "é\n"
    assert open(f"{top}/a/f1.txt").read() == "".join(f"line {k}\n" for k in range(1, 30, 3))
    # all or nothing: a task that fails half-way, a target that is there, rows of a file in two tasks, paths that lead out
    bad = F.when(F.col("ord") == 17, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("line"))
    for broken in (df.withColumn("line", bad), df.withColumn("path", F.lit("../x"))):
        with pytest.raises(Exception):
            tree_files.write_tree(broken, f"{tmp_path}/other")
    with pytest.raises(Exception, match="exists"):
        tree_files.write_tree(df, top)
    spark.dataSource.register(tree_files.TreeFiles)
    with pytest.raises(Exception, match="two tasks"):
        spark.range(8).repartition(4).select(F.lit("same").alias("path"), F.lit("x").alias("line")).write.format("tree_files").mode("append").save(f"{tmp_path}/other")
    assert sorted(os.listdir(tmp_path)) == ["out"] and len(os.listdir(f"{top}/a")) == 3


def test_docset_files(spark, tmp_path):
    index = spark.createDataFrame([(2, "b\tc", "Type", "b.html"), (1, "a", "Class", None)], "id int, name string, type string, path string")
    full = sinks.docset_files(index, "Mod", "org.example", "2.0", "http://x.dev/", "http://play")
    tree_files.write_tree(full, f"{tmp_path}/d")
    plist = open(f"{tmp_path}/d/Mod.docset/Contents/Info.plist").read()
    assert "<string>org.example.mod</string>" in plist and "<string>http://play</string>" in plist and plist.endswith("</plist>\n")
    assert open(f"{tmp_path}/d/Mod.docset/Contents/Resources/searchIndex/00000000.tsv").read() == "1\ta\tClass\t\n2\tb c\tType\tb.html\n"
    assert open(f"{tmp_path}/d/Mod.xml").read() == "<entry>\n<version>2.0</version>\n<url>http://x.dev/docsets/Mod.tgz</url>\n</entry>\n"
    assert sinks.docset_files(index, "Mod", "org.example").where("path = 'Mod.xml'").count() == 0


def test_patterns(spark, tmp_path):
    for f in ("a/x.md", "a/fr/x.md", "b/x.md", "b/y.MD", "b/z.txt", "c1/w.md", "c2/w.md"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{f}"), exist_ok=True)
        with open(f"{tmp_path}/{f}", "w") as o:
            o.write(f"text of {f}\nin two lines")
    g = lambda p, n=None, **k: sorted("/".join(r.file.split("/")[-2:]) for r in readers.glob_files(spark, p, n, **k).collect())
    assert g(f"{tmp_path}/[ab]", "*.md") == ["a/x.md", "b/x.md"] and g([f"{tmp_path}/c?", f"{tmp_path}/none"]) == ["c1/w.md", "c2/w.md"] and g(f"{tmp_path}/none*") == []
    assert g(f"{tmp_path}/b", "?.[!m]*", contents=False) == ["b/y.MD", "b/z.txt"]
    one = readers.glob_files(spark, f"{tmp_path}/a", "x*").first()
    assert (one.folder, one.name, one.text, one["size"]) == ("a", "x.md", "text of a/x.md\nin two lines", 27)
    plan = readers.glob_files(spark, f"{tmp_path}/*", "w*", contents=False)._jdf.queryExecution().executedPlan()
    assert "RLIKE" in plan.toString().split("PushedFilters")[0].split("DataFilters")[1] and "content" not in plan.toString().split("ReadSchema")[1]
    m = {r.name: (r.texts, r.file.split("/")[-2]) for r in readers.localized_markdown(spark, [f"{tmp_path}/*", f"{tmp_path}/*/fr"], ["fr"], "en").collect()}
    assert m["x.md"] == ({"en": "text of a/x.md\nin two lines", "fr": "text of a/fr/x.md\nin two lines"}, "a") and m["w.md"][1] == "c1" and set(m) == {"x.md", "y.MD", "w.md"}


def test_whole_files_of_many_lines(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"/a.swift": {"key.name": "x"}}], indent=2))
    assert [r.pathname for r in readers.raw_symbols(spark, str(tmp_path)).collect()] == ["/a.swift"]


def test_fetching(spark, tmp_path):
    (tmp_path / "a").write_text("text\nof a")
    rows = [(1, f"file://{tmp_path}/a"), (2, f"file://{tmp_path}/a"), (3, f"file://{tmp_path}/none"), (4, None), (5, "ftp://x/y"), (6, "no url")]
    out = {r.k: r for r in remote.fetched(spark.createDataFrame(rows, "k int, url string"), tries=2, pause=0.0).collect()}
    assert len(out) == 6 and out[1].text == out[2].text == "text\nof a" and out[1].tries == 1
    assert all(out[k].error and out[k].text is None for k in (3, 4, 5, 6))
    calls = []
    assert remote.fetch_one("http://127.0.0.1:9/x", 0.2, 3, 0.0)[2] == 3 and not calls


def test_running_total(spark, tables):
    from arborql.operators.ordered import running_total

    r = random.Random(5)
    rows = [(k, r.randrange(-3, 9)) for k in range(200)]
    df = spark.createDataFrame(r.sample(rows, 200), "k int, v int").repartition(6)
    got = {x.k: x.s for x in running_total(df, ["k"], "v", "s", tables).collect()}
    assert got == {k: sum(v for _, v in rows[:k + 1]) for k, _ in rows} and running_total(df.limit(0), ["k"], "v", "s", tables).count() == 0
