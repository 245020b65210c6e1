"""Fitted models against plain numpy: the neural baseline, shared-pass k-means, LDA in passes, spectral coordinates, stored topics."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexitide.operators import classify, clustering, kmeans, lda, mlp, neighbors, spectral, topics, vocab
from lexitide.operators.descent import neighbor_graph
from lexitide.operators.topic_model import open_topic_model, topic_model


def vec(spark, x, first=0):
    rows = [(first + i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id LONG, embedding ARRAY<DOUBLE>").repartition(3)


# --- neural baseline ---------------------------------------------------------------------------------


def _plain_epochs(x, y, w1, head, shape, epochs, s):
    """Full-batch Adam whose means start anew each epoch, on dense matrices."""
    h, c = shape.hidden, shape.n_classes
    w1, head = w1.astype(np.float64).copy(), head.astype(np.float64).copy()
    losses = []
    for _ in range(epochs):
        b1, w2, b2 = head[:h], head[h : h + h * c].reshape(h, c), head[h + h * c :]
        hidden = np.maximum(x @ w1 + b1, 0)
        z = hidden @ w2 + b2
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        p[np.arange(len(y)), y] -= 1
        back = p / len(y)
        inner = (back @ w2.T) * (hidden > 0)
        g1 = x.T @ inner + s.penalty / len(y) * w1
        g = np.concatenate([inner.sum(axis=0), (hidden.T @ back + s.penalty / len(y) * w2).ravel(), back.sum(axis=0)])
        for w, grad in ((w1, g1), (head, g)):
            first, second = (1 - mlp.BETA1) * grad, (1 - mlp.BETA2) * grad * grad
            rate = s.rate * np.sqrt(1 - mlp.BETA2) / (1 - mlp.BETA1)
            w -= rate * first / (np.sqrt(second) + mlp.EPSILON)
    return w1, head, losses


def _weights(model):
    blocks = {r["block"]: np.frombuffer(r["payload"], np.float32) for r in model.weights.collect()}
    w1 = np.concatenate([blocks[b].reshape(-1, model.shape.hidden) for b in range(model.shape.n_blocks)])
    return w1, blocks[mlp.HEAD]


def test_mlp_equals_plain_steps(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 10)) * (rng.random((30, 10)) < 0.6)
    x[0] = 1.0  # every feature occurs
    y = rng.integers(0, 3, 30)
    rows = [(Vectors.sparse(10, [(j, float(v)) for j, v in enumerate(r) if v]) if i % 2 else Vectors.dense(r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    train = spark.createDataFrame(rows, ["features", "label_id"]).repartition(3)
    start = mlp.fit_mlp(train, 10, 3, hidden=5, epochs=0, seed=7, block_rows=4, steps=1)
    model = mlp.fit_mlp(train, 10, 3, hidden=5, epochs=4, rate=0.05, seed=7, workers=1, block_rows=4, steps=1)
    w1, head, losses = _plain_epochs(x, y, *_weights(start), start.shape, 4, mlp.Settings(0.05))
    got = _weights(model)
    # steps follow the gradient's sign, so entries whose gradient is nearly nothing may differ by a step
    close = np.isclose(got[0], w1, atol=1e-4).mean(), np.isclose(got[1], head, atol=1e-4).mean()
    assert min(close) > 0.95 and np.allclose(model.losses, losses, atol=1e-4)


def test_mlp_step_needs_no_copies_of_all_weights_it_touches():
    """a step copied every array it touches several times over."""
    n, hidden, rows = 6000, 64, 8
    rng = np.random.default_rng(3)
    idx = [np.sort(rng.choice(n, n // 2, replace=False)).astype(np.int32) for _ in range(rows)]
    batch = pa.table({
        "idx": pa.array(idx, pa.list_(pa.int32())),
        "val": pa.array([rng.random(len(i)).astype(np.float32) for i in idx], pa.list_(pa.float32())),
        "label": pa.array(rng.integers(0, 3, rows), pa.int32()),
    })
    net = mlp.Net(mlp.Shape(n, hidden, 3))
    net.step(batch, mlp.Settings())  # makes the moments
    tracemalloc.start()
    net.step(batch, mlp.Settings())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < net.w1.nbytes


def test_mlp_of_several_workers_learns_and_is_stored(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        label = i % 3
        own = rng.choice(300, 6, replace=False) + 300 * label  # a third of the features each
        common = rng.choice(100, 4, replace=False) + 900
        at = sorted({*own.tolist(), *common.tolist()})
        rows.append((i, Vectors.sparse(1000, at, [0.3] * len(at)), float(label)))
    df = spark.createDataFrame(rows, ["doc_id", "features", "label_id"])
    model = mlp.fit_mlp(df, 1000, 3, hidden=16, epochs=8, batch=20, rate=0.01, workers=3)
    assert model.losses[-1] < 0.5 * model.losses[0]
    found = model.predict(df, ["doc_id", "label_id"], workers=2)
    assert found.count() == 600 and found.where("prediction = label_id").count() > 570
    model.save(str(tmp_path / "net"))
    again = mlp.load_mlp(spark, str(tmp_path / "net")).predict(df, ["doc_id"], workers=1)
    assert {tuple(r) for r in again.collect()} == {(r["doc_id"], r["prediction"]) for r in found.collect()}


def test_head_keeps_its_best_epoch(spark):
    """Two rings: no line tells them apart, a hidden layer does; the weights kept are those of the best score."""
    rng = np.random.default_rng(14)
    angle, outer = rng.uniform(0, 2 * np.pi, 400), np.arange(400) % 2
    x = np.stack([(1 + outer) * np.cos(angle), (1 + outer) * np.sin(angle)], axis=1)
    rows = [(i, [float(v) for v in x[i]], "out" if outer[i] else "in", "valid" if i % 5 == 0 else "train") for i in range(400)]
    split = spark.createDataFrame(rows, "doc_id INT, embedding ARRAY<DOUBLE>, label STRING, split STRING")
    found, scores, model = classify.neural_head(split, hidden=32, epochs=12, patience=4, rate=0.02)
    told = scores.orderBy("epoch").collect()
    right = found.where("y_true = y_pred").count() / found.count()
    assert right > 0.9 and len(told) <= 12 and found.count() == 80
    best = max(r["macro_f1"] for r in told)
    from lexitide.operators import metrics

    assert metrics.summary(found).first()["macro_f1"] == pytest.approx(best)


def test_weights_seen_by_one_worker_keep_their_change():
    import pyarrow as pa

    blocks = [np.full((2, 3), v, np.float32) for v in (1.0, 4.0)]
    updates = [np.array([2, 0]), np.array([0, 0])]
    table = pa.table({"block": [0, 0], "payload": [b.tobytes() for b in blocks], "updates": [u.tobytes() for u in updates], "loss": [1.0, 2.0], "n": [3, 4]})
    out = mlp._average(table).to_pylist()[0]
    assert np.frombuffer(out["payload"], np.float32).reshape(2, 3).tolist() == [[1.0] * 3] * 2 and out["n"] == 7


def test_solver_has_no_more_tasks_than_cores(spark, monkeypatch):
    """a task per 4,096 rows shuffled a gradient each in every iteration."""
    seen = []

    class Told(Exception):
        pass

    def fit(train, n_train, max_iter):
        seen.append((train.rdd.getNumPartitions(), train.count(), n_train))
        raise Told

    monkeypatch.setattr(classify, "ROWS_PER_TASK", 1)
    monkeypatch.setattr(classify, "fit_logistic", fit)
    rows = [(i, "ab"[i % 2], "train" if i % 5 else "valid", f"red {'green' if i % 2 else 'blue'}") for i in range(60)]
    split = spark.createDataFrame(rows, "doc_id LONG, label STRING, split STRING, text STRING").repartition(24)
    with pytest.raises(Told):
        classify.baselines(split, 50, 2, (1, 1), models=("lr",))
    assert seen == [(spark.sparkContext.defaultParallelism, 48, 48)]


def test_text_mlp_serves_new_texts(spark, tmp_path):
    texts = [("court law judge law", "law"), ("tree leaf root tree", "tree")] * 30
    split = spark.createDataFrame([(i, t, y, "valid" if i % 5 == 0 else "train") for i, (t, y) in enumerate(texts)], "doc_id INT, text STRING, label STRING, split STRING")
    _, fitted = classify.baselines(split, 50, 2, (1, 1), models=("mlp",), hidden=8)
    fitted["mlp"].save(str(tmp_path / "m"))
    served = classify.load_text_mlp(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([(1, "judge court"), (2, "leaf root"), (3, "")], "doc_id INT, text STRING")
    got = {r["doc_id"]: r["y_pred"] for r in served.predict(new, ["doc_id"]).collect()}
    assert got[1] == "law" and got[2] == "tree" and set(got) == {1, 2, 3}


# --- term weights ------------------------------------------------------------------------------------


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (1, "alpha gamma"), (2, "alpha beta"), (3, ""), (4, None)], "doc_id INT, text STRING")
    f = {r["term"]: (r["tf"], r["df"]) for r in vocab.tfidf_features(docs, min_df=1, ngram=(1, 1)).collect()}
    assert f == {"alpha": (3, 3), "beta": (3, 2), "gamma": (1, 1)}
    weights = vocab.tfidf_weights(docs, vocab.tfidf_features(docs, min_df=1, ngram=(1, 1)), ngram=(1, 1)).collect()
    assert sorted((r["doc_id"], r["term"]) for r in weights) == [(1, "alpha"), (1, "alpha"), (1, "beta"), (1, "gamma"), (2, "alpha"), (2, "beta")]
    plan = vocab.tfidf_weights(docs, vocab.tfidf_features(docs, min_df=1, ngram=(1, 1)), ngram=(1, 1))._jdf.queryExecution().executedPlan().toString()
    before = plan.split("MapInArrow")[1]
    assert "Exchange" not in before.split("Scan")[0]


# --- k-means -----------------------------------------------------------------------------------------


def _plain_kmeans(x, centres, rounds=300):
    centres = centres.copy()
    for _ in range(rounds):
        best = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        moved = np.array([x[best == c].mean(0) if (best == c).any() else centres[c] for c in range(len(centres))])
        far = np.sqrt(((moved - centres) ** 2).sum(1)).max()
        centres = moved
        if far <= kmeans.TOLERANCE:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(-1).min(1).sum()


def test_all_models_advance_together(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(60, 4)) + 6 * rng.normal(size=4) for _ in range(5)])
    rows = vec(spark, x).select(F.col("doc_id").alias("id"), F.col("embedding").alias("v")).persist()
    specs = [(3, 1), (5, 1), (5, 2)]
    starts = [x[rng.choice(len(x), k, replace=False)] for k, _ in specs]
    fits = kmeans.fit_all(rows, specs, starts=starts)
    for fit, start in zip(fits, starts, strict=True):
        centres, cost = _plain_kmeans(x, start)
        assert np.allclose(fit.centres, centres) and fit.cost == pytest.approx(cost)
    drawn = kmeans.fit_all(rows, [(5, s) for s in range(6)])
    best = min(_plain_kmeans(x, x[rng.choice(len(x), 5, replace=False)])[1] for _ in range(30))
    assert min(f.cost for f in drawn) <= best * (1 + 1e-9)
    again = kmeans.fit_all(rows.repartition(5), [(5, 3)])[0]
    assert np.allclose(again.centres, drawn[3].centres)
    same = kmeans.fit_all(vec(spark, np.ones((6, 2))).select(F.col("doc_id").alias("id"), F.col("embedding").alias("v")), [(3, 1)])[0]
    assert same.cost == 0 and len(same.centres) == 1


def test_silhouette_is_over_all_rows_unless_asked(spark):
    import inspect

    assert inspect.signature(clustering.silhouette_points).parameters["cap"].default is None
    assert inspect.signature(clustering.kmeans_sweep).parameters["silhouette_cap"].default is None


# --- LDA ---------------------------------------------------------------------------------------------


def test_lda_jobs_do_not_grow_and_topics_are_found(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [[f"t{t}w{i}" for i in range(20)] for t in range(4)]
    docs = spark.createDataFrame([(i, 1900, rng.choice(words[i % 4], 40).tolist()) for i in range(800)], "doc_id INT, rights_year INT, full_text ARRAY<STRING>").repartition(4)
    terms = vocab.build_vocab(docs, 80, 3).persist()
    model, rows = topics.fit_lda(docs, terms, n_topics=4, batch_size=128)
    found = topics.lda_topic_words(model, terms, 20).groupBy("topic").agg(F.collect_set(F.substring("word", 1, 2)).alias("kinds")).collect()
    assert sorted(r["kinds"] for r in found) == [["t0"], ["t1"], ["t2"], ["t3"]]
    assert rows.where(F.array_max("dist") > 0.9).count() == 800
    model.save(str(tmp_path / "lda"))
    assert np.array_equal(lda.load_lda(spark, str(tmp_path / "lda")).stats, model.stats)
    status = spark.sparkContext.statusTracker()

    def jobs(df):
        spark.sparkContext.setJobGroup(f"lda-{id(df)}", "count")
        topics.fit_lda(df, terms, n_topics=4, batch_size=64, epochs=3)
        n = len(status.getJobIdsForGroup(f"lda-{id(df)}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    assert jobs(docs) == jobs(docs.unionByName(docs).unionByName(docs).coalesce(4))


def test_lda_is_as_good_as_one_job_per_batch(spark):
    """Mean log probability of a word, against the library's own online method on the same counts."""
    from pyspark.ml.clustering import LDA

    from lexitide.operators.sparse import sparse_rows
    from lexitide.operators.vocab import count_vectorizer, vocab_list

    rng = np.random.default_rng(4)
    shares = rng.dirichlet(np.full(60, 0.1), 5)
    texts = [[f"w{w}" for w in rng.choice(60, 50, p=rng.dirichlet(np.full(5, 0.2)) @ shares)] for _ in range(500)]
    docs = spark.createDataFrame([(i, 1900, t) for i, t in enumerate(texts)], "doc_id INT, rights_year INT, full_text ARRAY<STRING>").repartition(4)
    terms = vocab.build_vocab(docs, 60, 1).persist()
    counted = count_vectorizer(vocab_list(terms)).transform(docs).persist()
    rows = sparse_rows(counted, ["doc_id"], "counts").persist()
    settings = dict(k=5, optimizer="online", optimizeDocConcentration=False, learningDecay=0.7, learningOffset=10.0, subsamplingRate=0.2, maxIter=50, featuresCol="counts")
    own, other = [], []
    for seed in (1, 2, 3):  # one start may end in a worse optimum than another
        own.append(lda.fit(rows, terms.count(), 5, batch=100, seed=seed).log_likelihood(rows))
        theirs = LDA(seed=seed, **settings).fit(counted)
        other.append(lda.LdaModel(theirs.topicsMatrix().toArray().T, 0.2).log_likelihood(rows))
    assert max(own) >= max(other) - 0.02 and np.mean(own) >= np.mean(other) - 0.02


def test_topics_of_a_document_do_not_depend_on_its_neighbours():
    """A document is worked out until its own topics settle, so others in the batch change neither its result nor its rounds."""
    rng = np.random.default_rng(6)
    sizes = np.array([3, 0, 40, 1, 400, 7, 5000, 12])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words, counts = rng.integers(0, 300, bounds[-1]), rng.integers(1, 5, bounds[-1]).astype(float)
    weights = rng.gamma(0.3, 1.0, (300, 4)) + 1e-3
    total, apart = np.zeros((300, 4)), np.zeros((300, 4))
    together = lda.infer(bounds, words, counts, weights, 0.25, total)
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        alone = lda.infer(np.array([0, hi - lo]), words[lo:hi], counts[lo:hi], weights, 0.25, apart)
        assert np.allclose(together[i], alone[0], rtol=1e-6, atol=1e-9)
    assert np.allclose(total, apart, rtol=1e-6)
    assert np.isclose((weights * total).sum(), counts.sum(), rtol=1e-9)  # every word is given to topics once
    assert np.allclose(lda.digamma(np.array([0.02, 1.0, 10.0])), [-50.54478930567, -0.57721566490153, 2.25175258906672], rtol=1e-11)


def test_nearest_rows_are_held_over_blocks():
    """A task tells k rows per row of a block, however many blocks it has met; ties go to the smaller id."""
    from types import SimpleNamespace

    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 4, (20, 2)).astype(float), rng.integers(0, 4, (90, 2)).astype(float)
    best = neighbors.Nearest(np.arange(20), 3)
    for part in np.split(rng.permutation(90), 3):
        best.meet(SimpleNamespace(l_flat=x.ravel(), r_flat=y[part].ravel(), r_ids=part), "euclidean", True)
    got = best.rows()
    assert len(got) == 60
    for i in range(20):
        want = sorted((round(float(np.linalg.norm(x[i] - y[j])), 9), j) for j in range(90) if j != i)[:3]
        assert list(zip(got[got["id"] == i]["dist"], got[got["id"] == i]["nbr"], strict=True)) == want


def test_mean_distances_pack_rows(spark):
    """Means by the definition, told per block of rows and not per pair of rows."""
    from lexitide.plans import facts

    rng = np.random.default_rng(10)
    x = rng.random((120, 3))
    rows = [(k, i, i % k, x[i].tolist()) for k in (2, 3) for i in range(120)]
    got = facts._mean_distances(spark.createDataFrame(rows, "k INT, doc_id LONG, cluster INT, embedding ARRAY<DOUBLE>")).collect()
    assert len(got) == 3 * (2 + 3)
    for r in got:
        others = [j for j in range(120) if j != r["id"] and j % r["k"] == r["cluster"]]
        assert r["own"] == r["id"] % r["k"] and np.isclose(r["m"], np.linalg.norm(x[others] - x[r["id"]], axis=1).mean())


# --- spectral coordinates ----------------------------------------------------------------------------


def test_rings_are_separated(spark):
    rng = np.random.default_rng(5)
    angle = rng.uniform(0, 2 * np.pi, 160)
    radius = np.where(np.arange(160) < 80, 1.0, 3.0)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    graph = spectral.graph_weights(neighbors.knn(vec(spark, x), k=8, metric="euclidean"))
    found, values = spectral.spectral(graph, 2)
    rows = {r["id"]: r["embedding"] for r in found.collect()}
    made = np.array([rows[i] for i in range(160)])
    inner, outer = made[:80], made[80:]
    apart = [min(abs(a - b) for a in (inner[:, c].min(), inner[:, c].max()) for b in (outer[:, c].min(), outer[:, c].max())) for c in range(2)]
    split = [inner[:, c].max() < outer[:, c].min() or outer[:, c].max() < inner[:, c].min() for c in range(2)]
    assert any(split) and max(apart) > 0 and len(rows) == 160
    # principal components mix the rings: both have the same centre
    mixed = np.abs(x[:80].mean(0) - x[80:].mean(0)).max()
    assert mixed < 1.0 and values[0] == pytest.approx(1.0, abs=1e-9)


def test_eigenvectors_are_those_of_the_whole_matrix(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(60, 5)), rng.normal(size=(60, 5)) + 2])
    graph = spectral.graph_weights(neighbor_graph(vec(spark, x), k=10, metric="euclidean")).persist()
    found, values = spectral.spectral(graph, 3)
    w = np.zeros((120, 120))
    for r in graph.collect():
        w[r["a"], r["b"]] = r["w"]
    assert np.allclose(w, w.T)
    d = w.sum(1)
    want = np.sort(np.linalg.eigvalsh(w / np.sqrt(np.outer(d, d))))[::-1][:4]
    assert np.allclose(values, want, atol=1e-5)
    for r in spectral.residuals(graph, found, values).collect():
        assert r["length"] == pytest.approx(1.0, abs=1e-8) and r["residual"] < 1e-2


def test_neighbour_lists_are_read_once(spark):
    x = np.random.default_rng(31).normal(size=(40, 3))
    made, seen = neighbors.knn(vec(spark, x), k=4, metric="euclidean"), spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    graph = spectral.graph_weights(made.mapInArrow(told, made.schema))
    assert graph.count() and seen.value == 160


# --- stored topics -----------------------------------------------------------------------------------


def test_stored_topics_place_new_vectors(spark, tmp_path):
    rng = np.random.default_rng(7)
    centres = np.eye(6)[:3] * 5
    x = np.vstack([rng.normal(size=(50, 6)) * (0.05 if c else 0.4) + centres[c] for c in range(3)])
    made = vec(spark, x)
    fit = neighbors.density_fit(made, n_components=4, min_cluster_size=10, min_samples=5)
    labels = {r["doc_id"]: r["topic"] for r in fit.topics.collect()}
    groups = [max(set(g) - {-1}, key=g.count) for g in ([labels[50 * c + i] for i in range(50)] for c in range(3))]
    assert len(set(groups)) == 3
    topic_model(fit).save(str(tmp_path / "model"))
    new = np.vstack([rng.normal(size=(5, 6)) * 0.05 + centres[c] for c in range(3)] + [np.array([[-5.0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 5, -5]])])
    placed = open_topic_model(spark, str(tmp_path / "model")).assign(vec(spark, new, 1000))
    got = {r["doc_id"] - 1000: r["topic"] for r in placed.collect()}
    assert len(got) == 17 and got[15] == got[16] == -1
    for c in range(3):
        assert sum(got[5 * c + i] == groups[c] for i in range(5)) >= 4
    own = open_topic_model(spark, str(tmp_path / "model")).assign(made)
    agree = sum(labels[r["doc_id"]] == r["topic"] for r in own.collect() if labels[r["doc_id"]] >= 0)
    assert agree >= 0.95 * sum(t >= 0 for t in labels.values())


# --- drift -------------------------------------------------------------------------------------------


def _topical(spark):
    """Two decades of sentences on five themes; three words change their theme."""
    rng = np.random.default_rng(8)
    themes = [[f"t{t}w{i}" for i in range(12)] for t in range(5)]
    movers = {"mover0": (0, 3), "mover1": (1, 4), "mover2": (2, 0)}
    rows = []
    for d, year in enumerate((1915, 1925)):
        for i in range(900):
            t = i % 5
            words = rng.choice(themes[t], 10).tolist()
            words += [m for m, where in movers.items() if where[d] == t and rng.random() < 0.5]
            rows.append((len(rows), year, rng.permutation(words).tolist()))
    return spark.createDataFrame(rows, "doc_id INT, rights_year INT, full_text ARRAY<STRING>").repartition(4), set(movers)


def test_planted_drift_comes_first(spark):
    from lexitide.operators import drift

    docs, movers = _topical(spark)
    got = drift.embedding_drift(docs, 500, 3, 5, dims=8).orderBy("cosine").collect()
    assert len(got) == 63 and {r["term"] for r in got[:3]} == movers and (got[0]["from_decade"], got[0]["to_decade"]) == ("1910s", "1920s")
    assert got[2]["cosine"] < got[3]["cosine"] - 0.1


def test_tables_are_multiplied_by_parts(spark, monkeypatch):
    """Words of a decade are cut into parts and the table into squares; the product is that of the whole table."""
    from lexitide.operators import drift

    rng = np.random.default_rng(8)
    whole = np.where(rng.random((9, 9)) < 0.5, rng.random((9, 9)), 0)
    rows = [(1900, f"w{i}", f"w{j}", float(whole[i, j])) for i, j in zip(*np.nonzero(whole), strict=True)]
    table = spark.createDataFrame(rows, "decade INT, term STRING, context STRING, w DOUBLE")
    terms = [[f"w{i}" for i in range(9) if i % 3 == p] for p in range(3)]
    parts = spark.createDataFrame([(1900, p, t) for p, t in enumerate(terms)], "decade INT, part INT, terms ARRAY<STRING>")
    x = rng.random((9, 2))
    lists = spark.createDataFrame([(1900, p, 3, x[p::3].ravel().tolist()) for p in range(3)], "decade INT, part INT, n INT, q ARRAY<DOUBLE>")
    monkeypatch.setattr(drift, "AT_ONCE", 2)
    for r in drift._times(drift._squares(table, parts), lists).collect():
        assert np.allclose(np.array(r["q"]).reshape(3, 2), (whole @ x)[r["part"] :: 3])


def test_word_embeddings_are_leading_eigenvectors(spark):
    from lexitide.operators import drift

    rng = np.random.default_rng(9)
    m = np.abs(rng.normal(size=(25, 3))) @ np.diag([9.0, 4.0, 2.0]) @ np.abs(rng.normal(size=(3, 25))) / 10
    m = (m + m.T) / 2
    rows = [(1900, f"w{i:02d}", f"w{j:02d}", float(m[i, j])) for i in range(25) for j in range(25)]
    made = drift.word_embeddings(spark.createDataFrame(rows, "decade INT, term STRING, context STRING, w DOUBLE"), dims=3)
    e = np.array([r["embedding"] for r in made.orderBy("term").collect()])
    values = np.linalg.eigvalsh(m)
    top = values[np.argsort(-np.abs(values))[:3]]
    gram = e.T @ e
    assert np.allclose(np.diag(gram), np.abs(top), rtol=1e-6) and np.allclose(gram, np.diag(np.diag(gram)), atol=1e-6)


# --- most frequent terms -----------------------------------------------------------------------------


@pytest.mark.parametrize("counters", [8, 40, 4000])
def test_sketch_gives_the_rows_of_a_full_count(spark, counters):
    from lexitide.operators import heavy

    rng = np.random.default_rng(10)
    rows = [(i, [f"w{w}" for w in rng.zipf(1.3, 60) if w < 3000]) for i in range(300)] + [(301, []), (302, None)]
    docs = spark.createDataFrame(rows, "doc_id INT, full_text ARRAY<STRING>").repartition(4)
    assert [tuple(r) for r in heavy.sketched_vocab(docs, 20, 3, counters).orderBy("term_idx").collect()] == [
        tuple(r) for r in vocab.build_vocab(docs, 20, 3).orderBy("term_idx").collect()
    ]
    # fewer terms than wanted: all of them, counted exactly
    assert heavy.sketched_vocab(docs, 5000, 3, counters).count() == vocab.build_vocab(docs, 5000, 3).count()


def test_sketch_bounds_hold(spark):
    from lexitide.operators import heavy

    rng = np.random.default_rng(11)
    docs = spark.createDataFrame([(i, [f"w{w}" for w in rng.zipf(1.2, 50) if w < 5000]) for i in range(200)], "doc_id INT, full_text ARRAY<STRING>").repartition(4)
    found, error = heavy.sketch(docs, "full_text", 50)
    exact = {r["term"]: r["tf"] for r in vocab.term_counts(docs).collect()}
    least = {r["term"]: r["least"] for r in found.collect()}
    assert error > 0 and found.count() <= 4 * 50
    assert all(least.get(t, 0) <= n <= least.get(t, 0) + error for t, n in exact.items())


def test_sketched_features(spark):
    from lexitide.operators import heavy

    rng = np.random.default_rng(12)
    texts = [(i, " ".join(f"w{w}" for w in rng.zipf(1.4, 40) if w < 500)) for i in range(120)]
    docs = spark.createDataFrame([*texts, (500, None), (501, "")], "doc_id INT, text STRING").repartition(3)
    got = [tuple(r) for r in heavy.sketched_features(docs, 30, 2, (1, 2), 60).select("term", "term_idx", "tf", "df", "idf").orderBy("term_idx").collect()]
    assert got == [tuple(r) for r in vocab.tfidf_features(docs, 30, 2, (1, 2)).select("term", "term_idx", "tf", "df", "idf").orderBy("term_idx").collect()]


# --- merging topics ----------------------------------------------------------------------------------


@pytest.mark.parametrize("cells", [10_000, 60, 1])
@pytest.mark.parametrize("seed", range(6))
def test_merging_by_rows_equals_the_whole_matrix(cells, seed):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(size=(12, 30))) * (rng.random((12, 30)) < 0.5)
    x[1], x[7] = x[0] * 1.1 + 0.01, x[5] + 0.02  # alike from the start
    x[9] = 0
    gram, sizes = x @ x.T, rng.integers(1, 40, 12).tolist()
    calls = []

    def fetch(wanted):
        calls.append(len(wanted))
        return gram[wanted]

    for wanted in (1, 3, 8):
        merger = topics.TopicMerger(fetch, np.diag(gram), sizes, cells)
        merger.down_to(wanted)
        assert merger.target.tolist() == topics.merge_plan(gram, sizes, wanted)
    for threshold in (0.95, 0.6, 0.3):
        merger = topics.TopicMerger(fetch, np.diag(gram), sizes, cells)
        merger.while_alike(threshold)
        assert merger.target.tolist() == topics.merge_plan(gram, sizes, "auto", threshold)
    assert max(calls) <= max(1, cells // 12)


def test_merged_topics_of_documents(spark):
    rng = np.random.default_rng(13)
    words = [[f"t{t // 2}w{i}" for i in range(15)] for t in range(6)]  # topics 2i and 2i + 1 share their words
    rows = [(i, i % 6, rng.choice(words[i % 6], 12).tolist()) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id INT, topic INT, full_text ARRAY<STRING>")
    assigned = docs.select("doc_id", "topic").unionByName(spark.createDataFrame([(999, -1)], "doc_id INT, topic INT"))
    for nr, cells in ((3, 8_000_000), (3, 7), ("auto", 7)):
        got = {r["doc_id"]: r["topic"] for r in topics.merge_topics(assigned, docs, nr, cells=cells, threshold=0.5).collect()}
        assert got[999] == -1 and len(got) == 241
        assert {frozenset(i % 6 for i in got if i != 999 and got[i] == t) for t in range(3)} == {frozenset({0, 1}), frozenset({2, 3}), frozenset({4, 5})}
