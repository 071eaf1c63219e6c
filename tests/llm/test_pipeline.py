"""Each stage of the pipeline on its own input."""

from __future__ import annotations

from cases import frame, hard_rows, kept_ids, repeated_bytes

import corpus_pipeline
from pressloom.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = frame(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, SF))
        kept[name] = before.collect(), docs.collect()
        if name != "bpe":
            assert docs.columns == before.columns
    _, first = kept["language_id"]
    assert {r["doc_id"] for r in hard_rows_with_letters()} >= {r["doc_id"] for r in first} and all(r["text"] for r in first)
    before, after = kept["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before]
    assert sorted((r["doc_id"] for r in after), key=lambda x: (x is None, x)) == kept_ids(rows)
    before, after = kept["suffix_array_dedup"]
    left = {(r["doc_id"], len((r["text"]).encode())) for r in after if r["doc_id"] not in (None, 13)}
    assert left == {(d, n - gone) for d, n, gone, _, _ in repeated_bytes([(r["doc_id"], r["text"]) for r in before]) if d not in (None, 13)}
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = kept["bpe"]
    assert sorted(r["text"] for r in before) == sorted(r["text"] for r in after) and all(len(r["tokens"]) == r["n_tokens"] for r in after)


def hard_rows_with_letters():
    return [{"doc_id": r[0]} for r in hard_rows() if r[1] and any(map(str.isalpha, r[1]))]


def test_whole_run_is_clean(spark):
    out = corpus_pipeline.run(spark, SF)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [r["text"] for r in out.collect()]
    assert len(texts) > 100 and not any(i in t for i in items for t in texts)
