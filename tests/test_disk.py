"""What iterative jobs leave on disk."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide.operators import descent, drift, lexical, mlp, vocab
from lexitide.session import cut_lineage, drop_checkpoint, ensure_checkpoint_dir


@pytest.fixture
def kept(spark):
    """How many frames in the checkpoint folder are new since the test began."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")

    def names():
        return {f"{at}/{d}" for at, folders, _ in os.walk(folder) for d in folders if d.startswith(("rdd-", "table-"))}

    before = names()
    return lambda: len(names() - before)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_shuffles_behind_a_checkpoint_are_deleted(spark, kept):
    before = _shuffle_files(spark)
    made = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    for _ in range(100):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert made.agg(F.sum("s")).first()[0] == 999 * 500 and kept() == 1
    drop_checkpoint(made)
    assert kept() == 0


def test_repeated_ids_are_one_document(docs):
    """Words of rows of one id are in order of position, then of the word, and each meets the `span` words behind it."""
    d = docs(("1", 1950, "a q b"), ("1", 1950, "c b"), ("2", 1950, "q q")).withColumn("decade", F.lit(1950))
    v = vocab.build_vocab(docs(("0", None, "a b c")), 3, 1)
    got = {(r["term"], r["context"]): r["n"] for r in lexical.cooccurrence(d, v, 3, span=1).collect()}
    # a0 c0 b1 b2
    assert got == {("a", "c"): 1, ("c", "a"): 1, ("c", "b"): 1, ("b", "c"): 1, ("b", "b"): 2}


def test_word_embeddings_keep_three_frames(spark, kept):
    rng = np.random.default_rng(1)
    x = np.abs(rng.standard_normal((30, 30)))
    rows = [(1950 + 10 * d, f"w{i}", f"w{j}", float(x[min(i, j), max(i, j)])) for d in range(2) for i in range(30) for j in range(30)]
    made = drift.word_embeddings(spark.createDataFrame(rows, "decade INT, term STRING, context STRING, w DOUBLE"), dims=4)
    assert made.count() == 60
    assert kept() <= 3


def test_mlp_keeps_one_set_of_weights(spark, kept):
    from pyspark.ml.linalg import SparseVector

    rows = [(SparseVector(6, {i % 6: 1.0}), float(i % 2)) for i in range(64)]
    model = mlp.fit_mlp(spark.createDataFrame(rows, ["features", "label_id"]), 6, 2, hidden=4, epochs=4, workers=2, tol=-1.0)
    assert len(model.losses) == 4 and model.weights.count() == 2
    assert kept() == 1


def test_neighbor_graph_in_slices(spark, kept, monkeypatch):
    x = np.random.default_rng(3).standard_normal((300, 4)).round(3)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "doc_id LONG, embedding ARRAY<DOUBLE>")

    def found():
        return sorted((r["doc_id"], r["nbr"], r["dist"], r["rank"]) for r in descent.neighbor_graph(rows, k=3, leaf=32).collect())

    whole = found()
    assert kept() == 1
    calls = []
    answered = descent._answered
    monkeypatch.setattr(descent, "_answered", lambda *a: calls.append(1) or answered(*a))
    monkeypatch.setattr(descent, "SLICE_BYTES", 300 * 4 * 9 * 8 * 8 // 3)
    assert found() == whole and len(calls) >= 3
