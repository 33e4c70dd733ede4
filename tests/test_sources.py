"""Sources, sinks, and streaming over small files."""

import json

import pytest
from pyspark.sql import functions as F

from arborql.operators import ordered, tree
from arborql.sources import readers, remote, sinks
from arborql.streaming import reingest


def test_raw_symbols(spark, tmp_path):
    root = {"key.diagnostic_stage": "parse", "key.substructure": [{"key.name": "A", "key.kind": "source.lang.swift.decl.class", "key.usr": "a", "key.doc.line": 3, "key.substructure": [{"key.name": "m", "key.usr": "m", "key.offset": "not a number"}]}]}
    (tmp_path / "x.json").write_text(json.dumps([{"/src/A.swift": root}, {"/src/B.swift": {"key.name": 1}}]))
    (tmp_path / "y.json").write_text("{broken")
    raw = readers.raw_symbols(spark, str(tmp_path))
    assert raw.where("warning = 'undecodable'").count() == 1
    raw.where("v is not null").select("file_seq", "pathname", "v").createOrReplaceTempView("raw_rows")
    d = readers.project(tree.flatten_variant(spark, "raw_rows")).orderBy("file_seq", "path").collect()
    assert [(r.pathname, r.path, r.name, r.usr, r.doc_line, r.offset) for r in d] == [("/src/A.swift", [0], None, None, None, None), ("/src/A.swift", [0, 0], "A", "a", 3, None), ("/src/A.swift", [0, 0, 0], "m", "m", None, None), ("/src/B.swift", [0], "1", None, None, None)]
    assert d[0].diagnostic_stage == "parse"


def test_reimport_runs(spark, tmp_path):
    entry = lambda m, p, v="1.9.0": {"k": {"key.bb.version": v, "key.bb.module_name": m, "key.bb.pass_index": p}}
    (tmp_path / "x.json").write_text(json.dumps([entry("A", 0), entry("A", 0), entry("B", 0), entry("A", 0), entry("A", 1), {"k": {}}, entry("A", 1, "9.0")]))
    r = readers.reimported(spark, str(tmp_path), "1.12.0").orderBy("file_seq").collect()
    assert [(x.module_name, x.pass_index, x.pass_no) for x in r] == [("A", 0, 1), ("A", 0, 1), ("B", 0, 2), ("A", 0, 3), ("A", 1, 4)]
    f = readers.import_filter(readers.reimported(spark, str(tmp_path), "1.12.0"), "A", 0)
    assert f.count() == 3
    # the last run of a file goes on in the next one's first
    (tmp_path / "y.json").write_text(json.dumps([entry("A", 1), entry("C", 0)]))
    (tmp_path / "z.json").write_text(json.dumps([entry("D", 0)]))
    r = readers.reimported(spark, str(tmp_path), "1.12.0").orderBy("file", "file_seq").collect()
    assert [x.pass_no for x in r] == [1, 1, 2, 3, 4, 4, 5, 6]


def test_markdown_and_strings(spark, tmp_path):
    for name, text in (("g/One.md", "one"), ("g/fr/One.md", "un"), ("h/One.md", "late"), ("h/Two.MD", "two"), ("h/no.txt", "x")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r.name: r.texts for r in readers.localized_markdown(spark, [str(tmp_path / "g"), str(tmp_path / "g/fr"), str(tmp_path / "h")], ["fr"], "en").collect()}
    assert got == {"One.md": {"en": "one", "fr": "un"}, "Two.MD": {"en": "two", "fr": "two"}}
    assert sorted(r.name for r in readers.media_files(spark, str(tmp_path / "h")).collect()) == ["One.md", "Two.MD", "no.txt"]
    (tmp_path / "fr.lproj").mkdir()
    (tmp_path / "fr.lproj" / "S.strings").write_text('/* c */ "k1" = "a \\"b\\"";\n"k2"="x\\ny";')
    b = readers.string_bundles(spark, str(tmp_path / "fr.lproj"))
    assert sorted((r.tag, r.key, r.value) for r in b.collect()) == [("fr", "k1", 'a "b"'), ("fr", "k2", "x\ny")]
    keys = spark.createDataFrame([("k1",), ("none",)], "key string")
    assert {r.key: r.texts for r in readers.localized(keys, b, ["en", "fr"], "fr").collect()} == {"k1": {"en": 'a "b"', "fr": 'a "b"'}, "none": {}}


def test_link_indexes(spark, tmp_path):
    (tmp_path / "Swift").write_text("String\nArray|append|https://a/array\n\n")
    got = sorted((r.module_name, r.name, r.url) for r in readers.builtin_links(spark, str(tmp_path / "Swift"), "https://d/").collect())
    assert got == [("Swift", "Array", "https://a/array"), ("Swift", "String", "https://d/swift/string"), ("Swift", "append", "https://a/array")]
    (tmp_path / "search.json").write_text(json.dumps({"A.html": {"name": "A"}, "A.html#m": {"name": "m", "parent_name": "A", "abstract": "x"}}))
    assert sorted((r.url, r.name, r.parent_name) for r in readers.remote_search(spark, str(tmp_path / "search.json")).collect()) == [("A.html", "A", None), ("A.html#m", "m", "A")]
    node = {"title": "S", "type": "struct", "path": "/documentation/m/s", "children": [{"title": "group", "type": "groupMarker"}, {"title": "f", "type": "method", "path": "/documentation/m/s/f(_:)-1a2b3"}]}
    (tmp_path / "index.json").write_text(json.dumps({"interfaceLanguages": {"swift": [{"title": "M", "type": "module", "path": "/documentation/m", "children": [node]}]}}))
    assert [(r.module_name, r.symbol, r.suffix) for r in readers.remote_docc(spark, str(tmp_path / "index.json")).orderBy("ord").collect()] == [("m", "s", None), ("m", "s/f(_:)", "-1a2b3")]
    (tmp_path / "site.json").write_text('{"version": "1", "modules": ["A", "B"]}')
    assert readers.site_record(spark, str(tmp_path / "site.json")).count() == 2


def test_shared_docs(spark):
    d = spark.createDataFrame([(1, 0, 5, "x.enumelement", "doc"), (1, 1, 6, "x.enumelement", None), (1, 2, 6, "x.enumelement", None), (1, 3, 9, "var", None), (1, 4, 9, "var", None)], "parent int, ord int, offset int, kind string, docs string")
    assert [r.docs for r in readers.with_shared_docs(d).orderBy("ord").collect()] == ["doc", "doc", "doc", None, None]


def test_fetch(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    spark.dataSource.register(remote.Fetch)
    rows = spark.read.format("fetch").option("urls", f"file://{tmp_path}/a.txt file://{tmp_path}/none ftp://x/y").load().collect()
    assert [r.text for r in rows] == ["hello", None, None] and rows[1].error and rows[2].error


def test_products(spark):
    assert sinks.chosen() == ["docs", "docset", "stats-json", "undocumented-json"] and sinks.chosen(["sta", "decls"]) == ["decls-json", "stats-json"]
    for bad in (["nothing"], ["docs-"], ["theme", "docset"]):
        with pytest.raises(ValueError):
            sinks.chosen(bad)
    done = {}
    sinks.run_products({"stats-json": lambda: "made", "docs": lambda: 1 / 0}, ["stats-json"], done.__setitem__)
    assert done == {"stats-json": "made"}
    d = spark.createDataFrame([("n", None, [], ["x"])], "usrName string, b string, c array<string>, aList array<string>")
    assert sinks.as_json(d).first().json == '{"a_list":["x"],"usr_name":"n"}'
    c = spark.createDataFrame([("b", 2), ("a", 1)], "counter string, n long")
    assert sinks.stats_json(c).first().json == '{"a":1,"b":2}'
    e = spark.createDataFrame([("en", "u", "n", None, "p")], "language string, url string, name string, abstract string, parent_name string")
    assert json.loads(sinks.search_json(e).first().json) == {"name": "n", "parent_name": "p"}
    with pytest.raises(ValueError):
        sinks.search_json(e.union(e))
    assert sinks.site_json(spark.createDataFrame([("B",), ("A",)], "module_name string"), "1").first().json == '{"modules":["A","B"],"version":"1"}'


def test_reingest(spark, tmp_path):
    schema = "usr string, ord long, name string, kind string, availability array<string>"
    src = tmp_path / "in"
    spark.createDataFrame([("a", 5, "late", "k", ["x"]), ("b", 1, "b", "k", [])], schema).write.json(str(src))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema(schema).json(str(src))
    reingest.reingest(spark, stream(), out, check).awaitTermination()
    spark.createDataFrame([("a", 2, "early", "k", ["y", "x"])], schema).write.mode("append").json(str(src))
    reingest.reingest(spark, stream(), out, check).awaitTermination()
    got = {r.usr: (r.name, r.availability) for r in spark.read.parquet(f"{out}/v=1").collect()}
    assert got == {"a": ("early", ["y", "x"]), "b": ("b", [])}
    # a fresh checkpoint goes on from what is stored
    more = tmp_path / "more"
    spark.createDataFrame([("c", 1, "c", "k", ["q"])], schema).write.json(str(more))
    reingest.reingest(spark, spark.readStream.schema(schema).json(str(more)), out, str(tmp_path / "check2")).awaitTermination()
    assert {r.usr for r in spark.read.parquet(f"{out}/v=2").collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, partitions):
    """The same rows in another order and another number of partitions give the same results."""
    rows = [(k % 5, (k * 37) % 101, "abc"[k % 3] if k % 4 else None) for k in range(101)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        d = spark.createDataFrame(rows, "k int, o int, v string").repartition(partitions)
        runs = ordered.islands(d, ["v"], ["k"], ["o"]).groupBy("k").agg(F.max("island").alias("n")).orderBy("k").collect()
        last = ordered.last_wins(d, ["k"], ["o"]).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = []
    for k in range(5):
        own = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]
        want.append(1 + sum(a != b for a, b in zip(own, own[1:])))
    assert [r.n for r in runs] == want and [r.o for r in last] == [max(r[1] for r in rows if r[0] == k) for k in range(5)]
