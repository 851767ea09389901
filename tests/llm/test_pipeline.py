"""The pipeline against its operators in plain code, on the smallest tables."""

import corpus_pipeline
from scorelake.llm import exact_dedup, ngram_join, packing, quality

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    # the first three stages, one after another
    good = quality.accepted(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    by_text = {}
    for r in good:
        by_text[r.text] = max(by_text.get(r.text, r.doc_id), r.doc_id)
    texts = {d: t for t, d in by_text.items()}
    sets = {d: set(ngram_join.shingle_set(t, 5).tolist()) for d, t in texts.items()}
    root = {d: d for d in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert sorted(r.doc_id for r in rows) == sorted({top(d) for d in texts})
    assert all(r.text == texts[r.doc_id] and r.n_tokens == len(r.text.split()) <= r.bucket_length for r in rows)
    assert out.columns[: len(docs.columns)] == docs.columns


def test_stages_are_named_functions():
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
    assert exact_dedup and packing
