"""Every pipeline stage on awkward tables: nulls, repeated rows, a very long text, no rows, dotted names and the operators' own names."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide.llm import simhash, stages, token_store

NAMES = [
    "quality", "kept", "n_words", "votes", "measures", "base_failed", "fp", "root", "component_id", "row_key", "whole", "found", "more", "clean_text",
    "text_key", "topic", "tokens", "weight", "probability", "sampled", "value", "factor", "gap", "row", "a.b", "n.words", "STAGE", "chunk", "docs", "words",
]


def _clean(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(n))


def _docs(spark):
    rows = [(i, _clean(i), "en", f"s{i % 2}") for i in range(12)]
    rows += [(3, _clean(3), "en", "s1")] * 2 + [(50, _clean(3), None, None), (None, _clean(60), "fr", "s0"), (None, None, None, None), (77, "", "en", "s0")]
    rows += [(70, _clean(70, 30_000), "en", "s0"), (71, _clean(71) + " write to jo@mail.example.com", "de", "s1")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING")
    return docs.select("*", *[F.concat_ws("|", F.lit(n), "doc_id").alias(n) for n in NAMES], F.lit(None).cast("int").alias("n_chars"))


def _bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("stage", ["quality_rules", "simhash_near_dedup", "pii", "source_mixing"])
def test_rows_come_back_whole(spark, stage):
    docs = _docs(spark)
    out = getattr(stages, stage)(spark, docs, "")
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    rest = [f"`{c}`" for c in docs.columns if stage != "pii" or c != "text"]
    had, has = _bag(docs.select(*rest)), _bag(out.select(*rest))
    assert has and not has - had
    if stage == "pii":
        assert has == had and out.where("text LIKE '%[EMAIL]%'").count() == 1
    empty = getattr(stages, stage)(spark, docs.limit(0), "")
    assert empty.columns == docs.columns and empty.count() == 0


def test_last_stage(spark):
    docs = _docs(spark)
    out = stages.word_bpe(spark, docs, "")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()
    assert stages.word_bpe(spark, docs.limit(0), "").count() == 0


def test_near_dedup_calls_the_operator(spark):
    docs = _docs(spark)
    kept = stages.simhash_near_dedup(spark, docs, "")
    groups = simhash.near_duplicates(docs.select("doc_id", "text")).select("component_id").distinct().count()
    assert kept.count() == groups
    assert kept.where("doc_id = 50 OR doc_id = 3").select("doc_id").collect() == [(3,)]


def test_unfolding_is_spread(spark):
    """The exchange before the unfolding stays: as many tasks as shuffle partitions, however few the bytes."""
    fps = spark.range(200).select(F.xxhash64("id").alias("fp")).distinct()
    cells = simhash.unfolded(fps)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    tasks = cells.select(F.spark_partition_id().alias("task")).distinct().count()
    assert "REPARTITION_BY_NUM" in plan and tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_equal_keys_are_hashed_anew():
    """Two documents whose first keys collide: the bucket takes the next salt; equal in both keys is an error, not a loop."""
    import pyarrow as pa

    assert token_store.perfect_hash(np.array([5, 9, 9, 77], np.uint64)) is None

    def table(other):
        n = len(other)
        numbers = {"bucket": [0] * n, "key": [5, 9, 9, 77], "other": other, "shard": list(range(n)), "offset": [10 * k for k in range(n)], "size": [1] * n}
        return pa.table({c: pa.array(v, pa.int32() if c == "shard" else pa.int64()) for c, v in numbers.items()})

    rows = table([1, 2, 3, 4])
    index = token_store._build_bucket(rows)
    assert index.column("salt")[0].as_py() == 1
    asked = pa.table({"doc_id": pa.array([0, 1, 2, 3]), "copy": pa.array([0] * 4, pa.int32()), "key": rows.column("key"), "other": rows.column("other")})
    found = token_store._find(asked, index).to_pydict()
    assert found["doc_id"] == [0, 1, 2, 3] and found["shard"] == [0, 1, 2, 3] and found["offset"] == [0, 10, 20, 30]
    with pytest.raises(ValueError, match="both of their keys"):
        token_store._build_bucket(table([1, 2, 2, 4]))
