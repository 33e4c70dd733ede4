"""The pipeline against its stages done in plain Python."""

import brute
import pytest
from test_llm_operators import DOCS, corpus

import corpus_pipeline
from arborql.llm import mixing, quality


def test_pipeline(spark, tmp_path, tables):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = corpus() + [(500 + k, t, l, s, n) for k, (i, t, l, s, n) in enumerate(corpus()) if i % 4 == 0]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs, tables).where("kept").collect()}
    left = [r for r in rows if r[0] in kept]
    assert left and all(not brute.quality(r[1])[-1] for r in left)
    lines = brute.lines([r[:2] for r in left])
    left = [(r[0], lines[r[0]][2], *r[2:]) for r in left]
    near = brute.near_copies([r[:2] for r in left], 5)
    left = [r for r in left if near[r[0]][2]]
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(spark.createDataFrame(left, DOCS), tables).collect()}
    t = Tokenizer.from_file(corpus_pipeline.default_vocab())
    want = []
    for r in left:
        n, size = taken[r[0]]
        ids = t.encode(r[1], add_special_tokens=False).ids
        want += [(r[0], len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False)))] * (int(n / size + 0.5) if size else 0)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == sorted(want)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns and stage.dtypes == docs.dtypes
        stage = tables.write(stage)
