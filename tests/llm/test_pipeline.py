"""The pipeline keeps clean documents, drops junk and near copies, hides personal data and ends in ids."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from lexitide.llm import stages


def _clean(seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(80))


def test_stages(spark, tmp_path):
    rows = [(i, _clean(i), "en", f"s{i % 2}", 0) for i in range(20)]
    rows += [(100, _clean(3), "en", "s0", 0), (101, "||| *** " * 50, "en", "s0", 0), (102, None, None, None, None), (103, "", "en", "s1", 0)]
    rows += [(104, _clean(99) + " write to jo@mail.example.com", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    kept = stages.quality_rules(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {*range(20), 100, 104} and kept.columns == docs.columns
    lone = stages.simhash_near_dedup(spark, kept, "")
    assert {r["doc_id"] for r in lone.collect()} == {*range(20), 104} and lone.columns == docs.columns
    hidden = {r["doc_id"]: r["text"] for r in stages.pii(spark, lone, "").collect()}
    assert hidden[104].endswith("write to [EMAIL]") and hidden[4] == _clean(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {*range(20), 104} and len(ids) >= 8
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "source_mixing", "word_bpe"]
