"""Every stage once, from gzip batches to its outputs, on the smallest supplied corpus."""

import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from lexitide.operators.vectors import HashingEncoder, embed_rows
from lexitide.plans import flows
from lexitide.schemas import NoLabelledRows
from lexitide.sources import stores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("flows")
    (base / "batches").mkdir()
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    for b in range(4):
        with gzip.open(base / "batches" / f"batch_{b:02d}.jsonl.gz", "wt", encoding="utf-8") as f:
            for r in rows[b::4]:
                words = re.findall(r"\w{2,}", r["text"].lower())
                year = None if r["doc_id"] % 17 == 0 else 1990 + r["doc_id"] % 30
                f.write(json.dumps({"doc_id": str(r["doc_id"]), "rights_year": year, "domain": r["lang"], "full_text": words}) + "\n")
    return base


def csv(spark, path):
    return spark.read.option("header", True).csv(str(path))


@pytest.fixture(scope="module")
def embedded(spark, work):
    counts = flows.embed_batches(spark, str(work / "batches"), str(work / "emb"), HashingEncoder(16), 64, 50)
    return counts.where("batch IS NULL").first()["processed"]


def test_embedding_limit_counts_kept_documents_per_file(spark, work, embedded):
    assert spark.read.parquet(str(work / "emb" / "vectors")).count() == embedded == 200
    counts = flows.embed_batches(spark, str(work / "batches"), str(work / "emb2"), HashingEncoder(8), max_docs=3, start_batch=1, end_batch=2)
    assert {r["batch"]: r["processed"] for r in counts.collect()} == {"batch_01": 3, "batch_02": 3, None: 6}
    got = spark.read.parquet(str(work / "emb2" / "vectors")).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in got} == {"batch_01": 3, "batch_02": 3}


def test_rows_that_share_an_id_keep_their_own_vectors(spark):
    rows = [("x", 1900, "a", 0, ["red", "blue"]), ("x", 1901, "b", 0, ["green"]), ("x", 1901, "b", 1, ["blue"])]
    docs = spark.createDataFrame(rows, "doc_id STRING, rights_year INT, batch STRING, line_no BIGINT, full_text ARRAY<STRING>")
    got = {(r["batch"], r["line_no"]): r["embedding"] for r in embed_rows(docs, HashingEncoder(16)).collect()}
    for row in rows:
        alone = spark.createDataFrame([row], docs.schema)
        assert got[row[2], row[3]] == embed_rows(alone, HashingEncoder(16)).first()["embedding"]
    assert len(got) == 3 and got["b", 0] != got["b", 1]


def test_unsound_vector_store_is_refused(spark):
    schema = "doc_id STRING, embedding ARRAY<FLOAT>"
    sound = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 1.0])], schema)
    assert stores.require_sound(sound).count() == 2
    for row in (("c", [1.0]), ("c", None), (None, [1.0, 1.0])):
        with pytest.raises(ValueError):
            stores.require_sound(sound.union(spark.createDataFrame([row], schema)))


def test_kmeans_and_report(spark, work, embedded):
    scored = flows.cluster_vectors(spark, str(work / "emb"), str(work / "km"), [2, 3, 4], max_iter=20, n_init=1)
    assert scored.count() == 3 and len(scored.first()["sources"]) >= 4
    rec = flows.report_k(spark, str(work / "km")).first()
    assert rec["n_candidates"] == 3 and rec["k_elbow"] in (2, 3, 4)
    assert csv(spark, work / "km" / "kmeans_k2_labels").count() == 200
    assert csv(spark, work / "km" / "kmeans_summary").count() == 3


def test_lda_and_gloss(spark, work):
    run = flows.lda_topics(spark, str(work / "batches"), str(work / "lda"), n_topics=4, vocab_size=300, min_freq=2, n_top_words=6)
    assert run.first()["n_docs"] == 200 and run.first()["vocab"] == 300
    gloss = flows.lda_gloss(spark, str(work / "lda" / "topics"), str(work / "lda" / "timelines"), str(work / "lda" / "gloss"), 5)
    rows = gloss.collect()
    assert [r["topic_id"] for r in rows] == [0, 1, 2, 3] and all(len(r["top_words"].split(", ")) == 5 for r in rows)
    assert all(r["first_year"] == 1990 and r["last_year"] == 2019 for r in rows)


@pytest.mark.parametrize("prob", [False, True])
def test_density_topics_and_gloss(spark, work, embedded, prob):
    out = work / f"den{prob}"
    info = flows.density_topics(spark, str(work / "emb"), str(work / "batches"), str(out), min_cluster_size=5, min_samples=2, n_components=3, nr_topics=3, calc_prob=prob)
    assert info.agg(F.sum("doc_count")).first()[0] == 200
    gloss = flows.density_gloss(spark, str(out / "topics"), str(out / "timelines"), str(out / "gloss"), 4).collect()
    assert {r["topic_id"] for r in gloss} == {r["topic"] for r in info.collect()}
    assert all(r["peak_year"] is not None for r in gloss if r["topic_id"] >= 0)


def test_datasets_and_classifiers(spark, work, embedded):
    time = flows.prepare_time_dataset(spark, str(work / "batches"), str(work / "time"), min_docs_per_class=5).first()
    assert time["labels"] == "1990s,2000s,2010s" and time["n_train"] + time["n_valid"] == time["n_docs"] < 200
    flows.prepare_domain_dataset(spark, str(work / "batches"), str(work / "dom"), min_docs_per_class=5)
    with pytest.raises(NoLabelledRows):
        flows.prepare_time_dataset(spark, str(work / "batches"), str(work / "none"), min_docs_per_class=5000)
    (work / "labels.csv").write_text("doc_id,label\n" + "".join(f"{i},{'x' if i % 2 else 'y'}\n" for i in range(1, 150)))
    ext = flows.prepare_domain_dataset(spark, str(work / "batches"), str(work / "ext"), str(work / "labels.csv"), 5).first()
    assert ext["labels"] == "x,y"
    base = flows.train_baselines(spark, str(work / "dom"), str(work / "base"), max_features=300, max_iter=30, hidden=8, mlp_features=100)
    scores = {r["tag"]: r["accuracy"] for r in base.collect()}
    assert scores["lr"] > 0.8 and set(scores) == {"lr", "mlp"}
    head = flows.train_vector_head(spark, str(work / "dom"), str(work / "emb"), str(work / "head"), (0.001, 0.1)).first()
    assert head["tag"] == "head" and 0 <= head["accuracy"] <= 1
    assert csv(spark, work / "base" / "confusion_matrix").count() >= 4
