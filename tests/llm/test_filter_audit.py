"""The audit against filters that are applied one after the other to whole tables."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from arborql.llm import filter_audit


def brute(docs, labels):
    """Filters really applied, order by order. docs: (doc_id, text, lang)."""
    rows = [(i, t or "", p or "") for i, t, p in docs]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)

    def fails(f, i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }[f]

    verdicts = [{f: fails(f, i, t) for f in "ABCDE"} for i, t, _ in rows]
    good, toxic = ({i for i, *xy in labels if i is not None and xy[k] == 1} for k in (0, 1))
    out = {}
    for part in {p for _, _, p in rows}:
        own = [k for k, r in enumerate(rows) if r[2] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if verdicts[k][f]]
                before = set(own) - set(left)
                left = [k for k in left if not verdicts[k][f]]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(verdicts[k][f] for k in before), sum(verdicts[k][f] and sum(verdicts[k].values()) == 1 for k in own),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels):
    d = spark.createDataFrame([(i, t, p, 7, "clash") for i, t, p in docs], "doc_id long, text string, lang string, mask int, part string").repartition(3)
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(docs, labels)
    assert len(got) == len(want) and {(r[0], r[1], r[2]): list(r[3:]) for r in got} == want
    return got


def words(n, k=1000):
    return " ".join(f"w{i % k}" for i in range(n))


def test_audit(spark):
    docs = [
        (1, words(120), "en"), (2, words(120), "de"), (3, words(120), "en"), (4, words(99), "en"), (5, words(100), "en"), (6, words(100, 80), "en"), (7, words(100, 79), "en"),
        (8, words(150) + " ABCDEFGHIJ" * 9, "de"), (9, words(150) + " |", "de"), (10, None, None), (11, "", "en"), (12, "ABC # abc", ""), (13, " \n\t\x0b", "en"), (14, "É" * 50, "fr"),
        (15, words(300, 3) + " #", "en"), (15, words(300, 3) + " #", "en"), (16, words(300, 3) + " #", "fr"), (15, words(120), "en"), (None, words(120), "en"), (None, words(120), None), (None, "once", "fr"),
        (17, words(40_000, 30_000), "en"), (18, words(40_000, 33_000), "en"), (-5, "A" * 9 + "b" * 81, "en"), (-6, "A" * 9 + "b" * 80, "en"), (20, "a\x85b c", "en"), (21, "once", "fr"), (22, "once", "fr"),
    ]
    docs += [(100 + i, "copy of many", ["en", "de", None][i % 3]) for i in range(60)]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (7, 1, 0), (7, 0, 1), (8, None, 1), (9, 1, None), (15, 1, 1), (16, 2, 1), (None, 1, 1), (999, 1, 1), (100, 1, 0), (101, 1, 0), (102, 0, 1), (103, 0, 1)]
    rows = check(spark, docs, labels)
    assert len(rows) == 600 * 4  # en, de, fr and the empty string
    one = [r for r in rows if r["part"] == "en" and r["filter_order"] == "ABCDE"]
    assert [r["step"] for r in sorted(one, key=lambda r: r["step"])] == [1, 2, 3, 4, 5]


def test_empty_tables_and_unlabelled(spark):
    check(spark, [(1, "a b", "en"), (2, "a b", "en")], [])
    assert check(spark, [], [(1, 1, 1)]) == []


def test_lattice():
    steps = filter_audit.paths()
    assert len(steps) == 600 and len({(s, n) for _, _, s, n in steps}) == 80 and len({o for o, *_ in steps}) == 120


def test_kinds_are_few_before_texts_meet(spark):
    """A text that most rows hold is some rows a task before the window over it."""
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the very same text").alias("text"), F.lit("en").alias("lang"))
    c = filter_audit.classes(d, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r["mask"] >> 4, r["good"], r["n"]) for r in c) == [(0, False, 1), (1, False, 19_998), (1, True, 1)]
