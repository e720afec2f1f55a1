"""The pipeline's stages, one after the other, against plain versions of what each must do."""

import re

import corpus_pipeline
from clearwake.llm import secret_scan
from test_operators import plain_components


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    first, single, clean, safe, pieces = kept.values()
    groups = plain_components([(r["doc_id"], r["text"]) for r in first])
    assert {r["doc_id"] for r in single} == {c for _, c in groups.values()}
    windows = set()
    for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", row["text"].lower())
        windows |= {" ".join(words[i : i + 10]) for i in range(len(words) - 9)}
    for row in clean:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", row["text"].lower())
        assert not any(" ".join(words[i : i + 10]) in windows for i in range(len(words) - 9))
        assert row["n_chars"] == len(row["text"])
    assert len(clean) >= 0.95 * len(single) and len(safe) == len(clean)
    assert not any(secret_scan.find_spans(r["text"]) for r in safe)
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in safe}
