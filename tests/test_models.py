import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide.functions.vectors import argmax
from lexitide.operators import classify, clustering, graph, metrics, neighbors, splits, timelines, topics, vocab
from lexitide.operators import blocks as B
from lexitide.operators import vectors as V
from lexitide.operators.documents import token_windows
from lexitide.schemas import MissingColumns, NoLabelledRows


def vec(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "doc_id INT, embedding ARRAY<DOUBLE>")


# --- topics and timelines --------------------------------------------------------------------------


def test_class_tfidf_golden(docs):
    d = docs(("0", None, "aa aa bb"), ("1", None, "aa cc")).withColumn("c", F.col("doc_id").cast("int"))
    got = {(r["c"], r["term"]): round(r["weight"], 6) for r in topics.class_term_weights(d, "c").collect()}
    assert got == {(0, "aa"): 0.404091, (0, "bb"): 0.417588, (1, "aa"): 0.303068, (1, "cc"): 0.626381}
    assert [(r["c"], r["term"]) for r in topics.class_tfidf(d, "c", 1).orderBy("c").collect()] == [(0, "bb"), (1, "cc")]


def test_hard_timeline_golden(spark):
    rows = [(2000, 0), (2000, 0), (2000, 1), (2000, -1), (2001, 1), (None, 0)]
    got = timelines.timeline_hard(spark.createDataFrame(rows, "rights_year INT, topic INT"))
    assert {(r["rights_year"], r["topic"]): r["prevalence"] for r in got.collect()} == {
        (2000, 0): 0.5, (2000, 1): 0.25, (2001, 0): 0.0, (2001, 1): 1.0,
    }


def test_soft_timeline(spark):
    df = spark.createDataFrame([(2000, [0.2, 0.8]), (2000, [0.4, 0.6]), (None, [1.0, 0.0])], "rights_year INT, dist ARRAY<DOUBLE>")
    got = {r["topic"]: round(r["prevalence"], 9) for r in timelines.timeline_soft(df).collect()}
    assert got == {0: 0.3, 1: 0.7}


def test_timeline_stats_golden(spark):
    rows = [(1999, 0, 0.2), (2000, 0, 0.5), (2001, 0, 0.5)]
    schema = "rights_year INT, topic INT, prevalence DOUBLE"

    def stats(extra):
        r = timelines.timeline_stats(spark.createDataFrame(rows + extra, schema)).where("topic = 0").first()
        return round(r["mean_prevalence"], 9), r["peak_year"], r["first_year"], r["last_year"]

    assert stats([]) == (0.4, 2000, 1999, 2001)
    assert stats([(1998, 0, float("nan"))]) == (0.4, 2000, 1998, 2001)
    none = timelines.timeline_stats(spark.createDataFrame([(1998, 0, None), (1999, 0, float("nan"))], schema)).first()
    assert none["mean_prevalence"] is None and none["peak_year"] is None and none["last_year"] == 1999


def test_wide_and_long_timeline(spark):
    long = spark.createDataFrame([(2000, 0, 0.5), (2000, 1, 0.5), (2001, 1, 1.0)], "rights_year INT, topic INT, prevalence DOUBLE")
    wide = timelines.timeline_wide(long, [0, 1])
    assert [tuple(r) for r in wide.collect()] == [(2000, 0.5, 0.5), (2001, None, 1.0)]
    back = timelines.timeline_long(wide)
    assert dict(back.dtypes)["topic"] == "int" and back.count() == 4
    named = timelines.timeline_long(wide.withColumnRenamed("0", "law"))
    assert {r["topic"] for r in named.collect()} == {"law", "1"}
    with pytest.raises(MissingColumns):
        timelines.timeline_long(wide.withColumnRenamed("rights_year", "y"))


def test_density_gloss_keeps_outliers_and_order(spark):
    info = spark.createDataFrame([(0, 5, "0_a", ["a", "b"]), (1, 9, "1_c", ["c"]), (-1, 9, "-1_d", ["d"])], "topic INT, doc_count BIGINT, name STRING, words ARRAY<STRING>")
    line = spark.createDataFrame([(2000, 0, 0.5), (2000, 1, 0.5)], "rights_year INT, topic INT, prevalence DOUBLE")
    got = timelines.density_gloss(info, line).collect()
    assert [(r["topic_id"], r["peak_year"]) for r in got] == [(-1, None), (1, 2000), (0, 2000)]
    imported = spark.createDataFrame([(0, "a, b, c"), (1, "x y")], "Topic INT, Representation STRING")
    got = timelines.density_gloss(imported, line, 2).collect()
    assert [(r["topic_id"], r["top_words"]) for r in got] == [(0, "a, b"), (1, "x, y")]


def test_lda_gloss(spark):
    words = spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (0, 3, "c"), (7, 1, "z")], "topic INT, rank INT, word STRING")
    line = spark.createDataFrame([(2000, 0, 0.5)], "rights_year INT, topic INT, prevalence DOUBLE")
    got = [(r["topic_id"], r["top_words"], r["peak_year"]) for r in timelines.lda_gloss(words, line, 2).collect()]
    assert got == [(0, "a, b", 2000), (7, "z", None)]
    with pytest.raises(MissingColumns):
        timelines.lda_gloss(words.drop("rank"), line)


def test_reform_shift(spark):
    line = spark.createDataFrame([(y, 0, 1.0 if y >= 2000 else 0.0) for y in range(1990, 2010)], "rights_year INT, topic INT, prevalence DOUBLE")
    r = timelines.reform_shift(line, spark.createDataFrame([("r", 2000)], "reform STRING, reform_year INT"), 5).first()
    assert (r["before"], r["after"], r["shift"]) == (0.0, 1.0, 1.0)


def test_lda_invariants(docs):
    d = docs(*[(str(i), 1900 + i % 3, ("law court judge " if i % 2 else "tree leaf root ") * 4) for i in range(40)], ("none", 1900, "unknown"))
    v = vocab.build_vocab(d, 6, 3).persist()
    runs = []
    for _ in range(2):
        model, rows = topics.fit_lda(d, v, n_topics=2, seed=1)
        runs.append({r["doc_id"]: r["dist"] for r in rows.collect()})
    assert runs[0] == runs[1]
    assert all(abs(sum(x) - 1) < 1e-9 for x in runs[0].values())
    assert runs[0]["none"] == [0.5, 0.5]
    words = topics.lda_topic_words(model, v, 3).collect()
    groups = {t: {r["word"] for r in words if r["topic"] == t} for t in (0, 1)}
    assert {frozenset(g) for g in groups.values()} == {frozenset({"law", "court", "judge"}), frozenset({"tree", "leaf", "root"})}
    assert topics.top_topic(rows).where("top_topic NOT IN (0, 1)").isEmpty()


def test_argmax_first_wins(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5],)], "v ARRAY<DOUBLE>")
    assert df.select(argmax(F.col("v"))).first()[0] == 1


def test_gram_and_merging(docs):
    d = docs(("a", None, "x x y"), ("b", None, "x y y"), ("c", None, "q q r"), ("d", None, "q r r r")).withColumn(
        "topic", F.when(F.col("doc_id") == "a", 0).when(F.col("doc_id") == "b", 1).when(F.col("doc_id") == "c", 2).otherwise(3)
    )
    w = topics.class_term_weights(d, "topic")
    names = sorted({r["term"] for r in w.collect()})
    m = np.zeros((4, len(names)))
    for r in w.collect():
        m[r["topic"], names.index(r["term"])] = r["weight"]
    assert np.allclose(topics.topic_gram(w, [0, 1, 2, 3]), m @ m.T)
    assigned = d.select("doc_id", "topic")
    got = {r["doc_id"]: r["topic"] for r in topics.merge_topics(assigned, d, 2).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]
    auto = topics.merge_topics(assigned, d, "auto").select("topic").distinct().count()
    assert auto in (2, 3, 4)
    assert topics.merge_topics(assigned, d, None) is assigned


def test_merge_plan_keeps_the_asked_number():
    g = np.eye(5)
    assert len(set(topics.merge_plan(g, [5, 4, 3, 2, 1], 2))) == 2
    assert topics.merge_plan(g, [1, 1, 1, 1, 1], "auto") == [0, 1, 2, 3, 4]
    assert topics.merge_plan(np.ones((3, 3)), [3, 2, 1], "auto") == [0, 0, 0]


# --- vectors ---------------------------------------------------------------------------------------


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [1.0, 1.0])], "doc_id INT, win_no INT, embedding ARRAY<DOUBLE>")
    assert [round(x, 6) for x in V.mean_vectors(df).first()["embedding"]] == [0.666667, 0.666667]


def test_encoders(docs):
    d = docs(*[(str(i), None, "a b c d e f " * 3) for i in range(6)], ("empty", None, ""))
    hashed = V.embed_documents(d, V.HashingEncoder(16), 8, 5)
    assert hashed.count() == 6 and hashed.where(F.size("embedding") != 16).isEmpty()
    trained = V.Word2VecEncoder(dim=4, min_count=1, partitions=1)
    assert V.embed_documents(d, trained, 8, 5).where(F.size("embedding") == 4).count() == 6

    def factory():
        def encode(windows):
            assert len(windows) <= 2
            return np.array([[len(w), 1.0] for w in windows])

        return encode

    got = V.embed_documents(d, V.BatchEncoder(factory, batch_size=2), 8, 5).collect()
    sizes = [len(r["tokens"]) for r in token_windows(d.where("doc_id = '1'"), 8, 5).collect()]
    assert all(r["embedding"] == [pytest.approx(np.mean(sizes)), 1.0] for r in got) and len(got) == 6
    with pytest.raises(ValueError):
        V.BatchEncoder(factory, 0)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_against_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(B, "BLOCK", 40)  # many cells and blocks
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * 8
    x = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 5))
    x[100:200] = x[100]  # a third of the rows are copies
    if metric == "cosine":
        x[0] = 0.0
    near = neighbors.knn(vec(spark, enumerate(x)), k=4, metric=metric)
    got = {}
    for r in near.collect():
        got.setdefault(r["doc_id"], []).append((r["rank"], r["nbr"], round(r["dist"], 6)))
    if metric == "cosine":
        length = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(length > 0, length, 1)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    d = np.round(d, 9)
    np.fill_diagonal(d, np.inf)
    for i in range(300):
        want = sorted((max(d[i, j], 0), j) for j in range(300) if j != i)[:4]
        assert [w[0] for w in want] == pytest.approx([g[2] for g in sorted(got[i])], abs=1e-6)
        assert len({g[1] for g in got[i]}) == 4


def test_knn_other_table_and_probe(spark):
    base = vec(spark, [(10, (0, 0)), (11, (5, 5)), (12, (9, 9))])
    asked = vec(spark, [(1, (0, 1)), (2, (9, 8))])
    got = {(r["doc_id"], r["rank"]): r["nbr"] for r in neighbors.knn(asked, base, 2, "euclidean").collect()}
    assert got == {(1, 1): 10, (1, 2): 11, (2, 1): 12, (2, 2): 11}
    assert neighbors.knn(asked, base, 1, "euclidean", n_probe=1).count() == 2
    with pytest.raises(ValueError):
        neighbors.knn(asked, base, 1, "other")


def test_knn_vote_ties_go_to_the_nearest(spark):
    near = spark.createDataFrame([(1, 5, 0.1, 1), (1, 6, 0.2, 2)], "doc_id INT, nbr INT, dist DOUBLE, rank INT")
    labels = spark.createDataFrame([(5, "x"), (6, "a")], "doc_id INT, label STRING")
    assert neighbors.knn_vote(near, labels).first()["y_pred"] == "x"


def test_components_of_chain_hub_and_islands(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, i) for i in range(1001, 1400)]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(chain + hub + [(5, 5), (7, 6)], "a INT, b INT")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(1000, 1400)} == {1000}
    assert got[5] == 5 and got[6] == got[7] == 6 and len(got) == 61 + 400 + 3


def blobs():
    rows = [(i, (0.01 * i, 0.02 * (i % 2))) for i in range(5)]
    rows += [(10 + i, (10 + 0.01 * i, 0.02 * (i % 2))) for i in range(5)]
    return rows + [(99, (100.0, 0.0))]


def test_density_golden(spark):
    got = {r["doc_id"]: r["topic"] for r in neighbors.density_clusters(vec(spark, blobs()), 3).collect()}
    assert {got[i] for i in range(5)} == {0} and {got[10 + i] for i in range(5)} == {1} and got[99] == -1


def test_density_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 32)
    rng = np.random.default_rng(5)
    line = np.c_[np.linspace(0, 6, 120), rng.normal(size=120) * 0.02]  # one long chain over many blocks
    blob = rng.normal(size=(60, 2)) * 0.05 + [3, 4]
    noise = rng.uniform(-5, 10, size=(20, 2))
    x = np.vstack([line, blob, noise])
    eps, m, size = 0.3, 3, 10
    got = {r["doc_id"]: r["topic"] for r in neighbors.density_clusters(vec(spark, enumerate(x)), size, m, eps).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, m]  # column 0 is the row itself
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in range(i):
            if max(core[i], core[j], d[i, j]) <= eps:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(x)):
        if core[i] <= eps:
            groups.setdefault(root(i), set()).add(i)
    want = {frozenset(g) for g in groups.values() if len(g) >= size}
    found = {}
    for i, t in got.items():
        if t >= 0:
            found.setdefault(t, set()).add(i)
    assert {frozenset(g) for g in found.values()} == want and len(got) == len(x)
    assert [len(found[t]) for t in sorted(found)] == sorted((len(g) for g in want), reverse=True)


def test_density_all_noise(spark):
    got = neighbors.density_clusters(vec(spark, [(i, (10.0 * i, 0)) for i in range(4)]), 3, 2, eps=0.5)
    assert {r["topic"] for r in got.collect()} == {-1}


# --- clusters --------------------------------------------------------------------------------------


def labelled(spark, rows):
    return spark.createDataFrame([(i, c, [float(a) for a in v]) for i, (c, v) in enumerate(rows)], "doc_id INT, cluster INT, embedding ARRAY<DOUBLE>")


def test_silhouette_and_inertia_golden(spark):
    df = labelled(spark, [(0, (0, 0)), (0, (0, 1)), (1, (5, 0))])
    assert [round(r["s"], 6) for r in clustering.silhouette_points(df).orderBy("doc_id").collect()] == [0.8, 0.803884, 0.0]
    assert round(clustering.silhouette(df).first()["silhouette"], 6) == 0.534628
    assert clustering.inertia(df).first()["inertia"] == pytest.approx(0.5)


def test_silhouette_undefined_cases(spark):
    one = labelled(spark, [(0, (0, 0)), (0, (0, 1))])
    each = labelled(spark, [(0, (0, 0)), (1, (0, 1))])
    assert clustering.silhouette(one).first()["silhouette"] is None
    assert clustering.silhouette(each).first()["silhouette"] is None


def test_silhouette_in_many_blocks_and_on_a_sample(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(130, 3))
    c = rng.integers(0, 4, 130)

    def score(x, c):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        out = []
        for i in range(len(x)):
            own = c == c[i]
            a = d[i, own].sum() / max(own.sum() - 1, 1)
            b = min(d[i, c == k].mean() for k in set(c) if k != c[i])
            out.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
        return np.mean(out)

    df = labelled(spark, list(zip(c.tolist(), x.tolist())))
    assert clustering.silhouette(df).first()["silhouette"] == pytest.approx(score(x, c))
    sampled = clustering.silhouette(df, cap=100, target=40).first()["silhouette"]
    assert sampled == pytest.approx(score(x[::3], c[::3]))


def test_kmeans_sweep(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(20, 2)) * 0.1 + [5 * k, 0] for k in range(3)])
    labels, scores, centres = clustering.kmeans_sweep(vec(spark, enumerate(x)), [2, 3], n_init=3)
    by_k = {r["k"]: r for r in scores.collect()}
    assert by_k[3]["inertia"] < by_k[2]["inertia"] and by_k[3]["silhouette"] > 0.9 and by_k[2]["n_docs"] == 60
    assert labels.groupBy("k").count().where("count != 60").isEmpty() and centres.count() == 5
    check = vec(spark, enumerate(x)).join(labels.where("k = 3"), "doc_id")
    assert clustering.inertia(check).first()["inertia"] == pytest.approx(by_k[3]["inertia"], rel=1e-6)


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(50, 100.0, 0.10), (75, 60.0, None), (100, 50.0, 0.30)], (3, 75, 100, 87)),
        ([(50, 100.0, None), (75, 60.0, None), (100, 50.0, None)], (3, 75, 75, 75)),
        ([(50, 100.0, 0.1)], (1, 50, 50, 50)),
        ([(50, 100.0, 0.3), (75, 75.0, 0.3), (100, 50.0, float("nan"))], (3, 50, 50, 50)),
    ],
)
def test_recommend_k(spark, rows, want):
    got = clustering.recommend_k(spark.createDataFrame(rows, "k INT, inertia DOUBLE, silhouette DOUBLE"))
    assert tuple(got.first()) == want


# --- classifiers -----------------------------------------------------------------------------------


def preds(spark):
    return spark.createDataFrame(list(zip("aabc", "abbb")), "y_true STRING, y_pred STRING")


def test_metrics_golden(spark):
    df = preds(spark)
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion(df).collect()}
    assert [[cells[(t, p)] for p in "abc"] for t in "abc"] == [[1, 1, 0], [0, 1, 0], [0, 1, 0]]
    s = metrics.summary(df).first()
    assert (s["accuracy"], round(s["macro_f1"], 6)) == (0.5, 0.388889)
    report = {r["label"]: r for r in metrics.class_report(df).collect()}
    assert round(report["a"]["f1"], 6) == 0.666667 and report["b"]["f1"] == 0.5 and report["c"]["f1"] == 0
    assert round(report["weighted avg"]["f1"], 6) == 0.458333
    assert [report[x]["support"] for x in "abc"] == [2, 1, 1]
    wide = metrics.confusion_wide(metrics.confusion(df), ["a", "b", "c"]).collect()
    assert [[r[x] for x in "abc"] for r in wide] == [[1, 1, 0], [0, 1, 0], [0, 1, 0]]
    doc = metrics.metrics_document(df, labels=["a", "b", "c", "d"]).first()
    assert doc["labels"] == ["a", "b", "c", "d"] and doc["report"]["d"]["support"] == 0


def text_split(spark):
    rows = []
    for i in range(60):
        label = "law" if i % 2 else "tree"
        text = ("court judge ruling case" if i % 2 else "leaf root branch wood") + f" word{i % 5}"
        rows.append((str(i), label, "valid" if i % 5 == 0 else "train", text))
    return spark.createDataFrame(rows, "doc_id STRING, label STRING, split STRING, text STRING")


def test_baselines_learn_and_save(spark, tmp_path):
    got, fitted = classify.baselines(text_split(spark), 50, 2, (1, 2), max_iter=50, hidden=8)
    acc = {r["tag"]: r["accuracy"] for r in metrics.summary(got).collect()}
    assert acc == {"lr": 1.0, "mlp": 1.0}
    fitted["lr"].write().overwrite().save(str(tmp_path / "lr"))
    with pytest.raises(NoLabelledRows):
        classify.baselines(text_split(spark).where("false"))


def test_unseen_label_is_an_error(spark):
    model = classify.index_labels(text_split(spark))
    odd = text_split(spark).withColumn("label", F.lit("new"))
    with pytest.raises(Exception, match="nseen label"):
        model.transform(odd).collect()
    assert classify.index_labels(text_split(spark), "skip").transform(odd).count() == 0
    ids = {r["label"]: r["label_id"] for r in splits.label_mapping(text_split(spark)).collect()}
    assert ids == {"law": 0, "tree": 1}


def vector_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "p" if i % 2 else "q", "valid" if i % 4 == 0 or i % 4 == 1 else "train", [float(i % 2) * 3 + float(x) for x in rng.normal(size=3) * 0.2]) for i in range(80)]
    return spark.createDataFrame(rows, "doc_id INT, label STRING, split STRING, embedding ARRAY<DOUBLE>")


def test_vector_head_and_pseudo_labels(spark):
    got, table, _ = classify.vector_head(vector_rows(spark), (0.001, 0.1), 50)
    assert metrics.summary(got).first()["accuracy"] == 1.0 and table.count() == 2
    train, rest = classify.split_parts(vector_rows(spark))
    adopted = classify.pseudo_label(train, rest, threshold=0.8, rounds=2)
    assert adopted.count() == rest.count() == adopted.select("doc_id").distinct().count()
    right = adopted.join(rest.select("doc_id", F.col("label").alias("truth")), "doc_id").where("round IS NOT NULL AND label != truth")
    assert right.isEmpty()


def _side(x):
    return B.Side(x.ravel(), len(x))


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e6, 1e30])
def test_pairs_within_reach_are_those_of_the_distances(scale):
    """Single precision only leaves pairs out; what it keeps is held against the limit by the definition."""
    draw = np.random.default_rng(4)
    x, y = draw.normal(size=(60, 7)) * scale, draw.normal(size=(80, 7)) * scale
    y[:20] = x[:20] + draw.normal(size=(20, 7)) * scale * 1e-7
    apart = np.linalg.norm(x[:, None] - y[None], axis=2)
    assert np.allclose(_side(x).distances(_side(y)), apart, rtol=1e-9, atol=0)
    limit = np.sort(apart, axis=1)[:, 3]
    i, j, d = _side(x).within(_side(y), limit * (1 + 1e-12))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(a.tolist() for a in np.nonzero(apart <= limit[:, None])), strict=True))
    assert np.allclose(d, apart[i, j], rtol=1e-12, atol=0)


def test_a_task_reads_a_tile_and_a_span(spark, monkeypatch):
    """All pairs of blocks meet once, and no partition has more blocks than a tile and a span, however many there are."""
    import pandas as pd

    monkeypatch.setattr(B, "tile_size", lambda spark, n: 3)
    monkeypatch.setattr(B, "SPAN", 4)
    table = spark.range(30).select(F.col("id").alias("block"), F.array("id").alias("ids"))
    pairs = spark.range(30).select(F.col("id").alias("qblock")).crossJoin(table.select("block"))
    work = B.met_blocks(pairs, table, table.select("block", F.col("ids").cast("array<int>").alias("ids")), 30, 30)
    sizes = work.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))
    assert {(r["n"], r["keys"]) for r in sizes.collect()} <= {(7, 1), (5, 1)}

    def meet(batches):
        for _, block, asking in B.meetings(batches):
            yield pd.DataFrame({"a": [int(own.l_ids[0]) for own in asking], "b": int(block.r_ids[0])})

    met = work.mapInPandas(meet, "a LONG, b LONG")
    assert met.count() == 900 and met.distinct().count() == 900


@pytest.mark.parametrize("held", [3, 2048])
def test_silhouette_sums_over_many_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(B, "BLOCK", 16)
    monkeypatch.setattr(clustering, "HELD_SUMS", held)
    x, at = np.random.default_rng(5).normal(size=(100, 3)), np.arange(100) % 5
    df = spark.createDataFrame([(i, int(at[i]), x[i].tolist()) for i in range(100)], "doc_id LONG, label INT, embedding ARRAY<DOUBLE>")
    got = {r["doc_id"]: r["s"] for r in clustering.silhouette_points(df, "label").collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(100):
        a = d[i, at == at[i]].sum() / 19
        b = min(d[i, at == c].mean() for c in range(5) if c != at[i])
        assert np.isclose(got[i], (b - a) / max(a, b))


def test_zero_vectors_are_one_apart_beyond_the_first_block(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 8)
    x = np.random.default_rng(6).normal(size=(60, 3))
    x[::7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id LONG, embedding ARRAY<DOUBLE>")
    got = {(r["doc_id"], r["rank"]): (r["nbr"], r["dist"]) for r in neighbors.knn(df, k=4).collect()}
    length = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore"):
        cos = np.where(np.outer(length, length) > 0, x @ x.T / np.outer(length, length), 0.0)
    d = np.round(1 - cos, 9)
    for i in range(60):
        want = sorted((d[i, j], j) for j in range(60) if j != i)[:4]
        assert [got[i, r + 1][0] for r in range(4)] == [j for _, j in want]
        assert np.allclose([got[i, r + 1][1] for r in range(4)], [w for w, _ in want], atol=2e-9)
