import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexitide import session
from lexitide.functions import text as X
from lexitide.operators import documents, lexical, ranking, splits, vectors, vocab
from lexitide.plans import corpus
from lexitide.schemas import MissingColumns, NoLabelledRows


def starts(n, window, stride):
    """The rule in plain words: the first slice that reaches the end is the last."""
    out, s = [], 0
    while s < n:
        out.append(s)
        if s + window >= n:
            break
        s += stride
    return out


@pytest.mark.parametrize("n,window,stride", [(10, 4, 3), (3, 4, 3), (0, 4, 3), (10, 2, 5), (5, 5, 1), (11, 2, 5), (9, 1, 1)])
def test_windows(spark, n, window, stride):
    df = spark.createDataFrame([("d", [str(i) for i in range(n)])], "doc_id STRING, full_text ARRAY<STRING>")
    got = documents.token_windows(df, window, stride).orderBy("win_no").collect()
    assert [int(r["tokens"][0]) for r in got] == starts(n, window, stride)
    assert all(len(r["tokens"]) <= window for r in got)


def test_window_parameters():
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            X.windows(F.col("x") if False else None, *bad)


def test_decades(spark):
    df = spark.createDataFrame([(1934,), (1900,), (-5,), (None,)], "y INT")
    assert [r[0] for r in df.select(X.decade(F.col("y"))).collect()] == ["1930s", "1900s", "-10s", None]


def test_year_of(spark):
    df = spark.createDataFrame([("1950.5",), ("1941",), ("x",), (None,)], "y STRING")
    assert [r[0] for r in df.select(X.year_of(F.col("y"))).collect()] == [1950, 1941, None, None]


def test_representation(spark):
    df = spark.createDataFrame([("a, b , ,c",), ("a b c",), (" ",), (None,), ("['x', 'y']",)], "r STRING")
    assert [r[0] for r in df.select(X.representation_words(F.col("r"), 10)).collect()] == [["a", "b", "c"], ["a", "b", "c"], [], [], ["x", "y"]]
    assert df.select(X.representation_words(F.col("r"), 2)).first()[0] == ["a", "b"]


def test_vocab_ties_and_minimum(docs):
    got = vocab.build_vocab(docs(("1", None, "x x x y y z z z w")), 2, 2).orderBy("term_idx").collect()
    assert [(r["term"], r["tf"], r["term_idx"]) for r in got] == [("x", 3, 0), ("z", 3, 1)]


def test_count_vectors_match_ml_form(docs):
    d = docs(("1", None, "x x y q"), ("2", None, "Y q"))
    v = vocab.build_vocab(docs(("0", None, "x x y")), 10, 1)
    long = {(r["doc_id"], r["term_idx"]): r["tf"] for r in vocab.count_vectors(d, v).collect()}
    ml = {}
    for r in vocab.count_vectorizer(vocab.vocab_list(v)).transform(d).collect():
        ml.update({(r["doc_id"], int(i)): int(x) for i, x in zip(r["counts"].indices, r["counts"].values)})
    assert long == ml == {("1", 0): 2, ("1", 1): 1}


def test_tfidf_golden(spark):
    train = spark.createDataFrame([("1", "aa bb"), ("2", "aa cc cc")], "doc_id STRING, text STRING")
    f = vocab.tfidf_features(train, min_df=1, ngram=(1, 1)).persist()
    got = {(r["doc_id"], r["term"]): round(r["weight"], 6) for r in vocab.tfidf_weights(train, f, ngram=(1, 1)).collect()}
    assert got == {("1", "aa"): 0.579739, ("1", "bb"): 0.814802, ("2", "aa"): 0.335176, ("2", "cc"): 0.942156}


@pytest.mark.parametrize("ngram", [(1, 1), (1, 2), (2, 3)])
def test_tfidf_pipeline_equals_long_form(spark, ngram, tmp_path):
    train = spark.createDataFrame(
        [("1", "Aa bb cc aa bb"), ("2", "aa bb cc cc dd"), ("3", "zz")], "doc_id STRING, text STRING"
    )
    f = vocab.tfidf_features(train, min_df=1, ngram=ngram).persist()
    terms = vocab.vocab_list(f)
    pipe = vocab.tfidf_pipeline(f, ngram)
    pipe.write().overwrite().save(str(tmp_path / "p"))
    from pyspark.ml import PipelineModel

    ml = {}
    for r in PipelineModel.load(str(tmp_path / "p")).transform(train).collect():
        ml.update({(r["doc_id"], terms[int(i)]): round(x, 9) for i, x in zip(r["features"].indices, r["features"].values)})
    long = {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in vocab.tfidf_weights(train, f, ngram=ngram).collect()}
    assert ml == long and long


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t ARRAY<STRING>")
    assert [r[0] for r in df.select(X.ngrams(F.col("t"), 1, 3)).collect()] == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_texts_for_ids(spark):
    rows = [("a", "b0", 0, ["x", "y"]), ("a", "b1", 0, ["later"]), ("b", "b0", 1, ["z"]), ("c", "b0", 2, None), ("c", "b1", 1, ["second"])]
    d = spark.createDataFrame(rows, "doc_id STRING, batch STRING, line_no INT, full_text ARRAY<STRING>")
    ids = spark.createDataFrame([("b",), ("a",), ("q",), ("c",)], "doc_id STRING")
    got = {r["doc_id"]: (r["text"], r["found"]) for r in documents.texts_for_ids(ids, d).collect()}
    assert got == {"b": ("z", True), "a": ("x y", True), "q": ("", False), "c": ("second", True)}


@pytest.mark.parametrize("n,ratio,want", [(10, 0.25, 2), (5, 0.2, 1), (1, 0.2, 1), (4, 0.2, 1)])
def test_split_sizes(spark, n, ratio, want):
    df = spark.createDataFrame([(i, "x") for i in range(n)], "doc_id INT, label STRING")
    got = splits.stratified_split(df, 1, ratio).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got}.get("valid") == want


def test_split_is_exact_for_a_hot_class_and_stable(spark):
    hot = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("label"))
    one = splits.stratified_split(hot, 300, 0.2, 7).select("doc_id", "split")
    two = splits.stratified_split(hot.repartition(3), 300, 0.2, 7).select("doc_id", "split")
    assert one.exceptAll(two).isEmpty()
    sizes = splits.stratified_split(hot, 300, 0.2, 7).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "valid").alias("v"))
    assert all(r["n"] >= 300 and r["v"] == max(1, int(r["n"] * 0.2)) for r in sizes.collect())
    other = splits.stratified_split(hot, 300, 0.2, 8).select("doc_id", "split")
    assert not one.exceptAll(other).isEmpty()


def test_empty_split_is_an_error(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id INT, label STRING")
    with pytest.raises(NoLabelledRows):
        splits.require_rows(splits.stratified_split(df, 50))


def test_label_sources(spark):
    d = spark.createDataFrame([("1", "law"), ("2", None), ("3", "tax")], "doc_id STRING, domain STRING")
    assert {r["doc_id"]: r["label"] for r in documents.label_domain(d).collect()} == {"1": "law", "3": "tax"}
    ext = spark.createDataFrame([("1", "b"), ("1", "a"), ("2", None)], "doc_id STRING, label STRING")
    assert documents.label_domain(d, ext).count() == 2
    assert [(r["doc_id"], r["label"]) for r in documents.label_domain(d, ext, True).select("doc_id", "label").collect()] == [("1", "a")]
    with pytest.raises(NoLabelledRows):
        documents.label_domain(d.where("domain IS NULL"))
    with pytest.raises(MissingColumns):
        documents.label_domain(d.drop("domain"))


def test_row_index_over_table_and_groups(spark):
    df = spark.range(5000).select((F.col("id") * 7).alias("doc_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("g"))
    got = ranking.add_row_index(df.repartition(5), "doc_id").collect()
    assert all(r["row_idx"] == r["doc_id"] // 7 for r in got) and len(got) == 5000
    per = {}
    for r in ranking.add_row_index(df, "doc_id", by="g").collect():
        per.setdefault(r["g"], []).append((r["doc_id"], r["row_idx"]))
    for rows in per.values():
        assert [i for _, i in sorted(rows)] == list(range(len(rows)))


def test_limits(spark):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("batch"))
    assert ranking.corpus_limit(df, -1).count() == 30000
    assert ranking.corpus_limit(df, 50).agg(F.max("doc_id")).first()[0] == 49
    assert ranking.corpus_limit(df, 12000).agg(F.max("doc_id"), F.count("*")).first() == (11999, 12000)
    assert ranking.corpus_limit(df.withColumn("doc_id", F.col("doc_id").cast("string")), 12000).count() == 12000
    small, large = ranking.limit_per_group(df, "batch", "doc_id", 10), ranking.limit_per_group(df, "batch", "doc_id", 2000)
    assert {r["count"] for r in small.groupBy("batch").count().collect()} == {10}
    assert {(r["n"], r["m"] // 3) for r in large.groupBy("batch").agg(F.count("*").alias("n"), F.max("doc_id").alias("m")).collect()} == {(2000, 1999)}


@settings(max_examples=4, deadline=None)
@given(st.integers(60, 400), st.integers(5, 40))
def test_step_sample(spark, n, target):
    df = spark.range(n).select(F.col("id").alias("doc_id"))
    got = sorted(r["doc_id"] for r in ranking.step_sample(df, "doc_id", cap=50, target=target).collect())
    assert got == list(range(0, n, max(1, n // target)))


def test_class_given_word(docs):
    d = docs(("1", None, "w w w v"), ("2", None, "w v v v")).withColumn("label", F.col("doc_id"))
    p = {(r["term"], r["label"]): round(r["p"], 6) for r in lexical.class_given_word(d, prior="uniform", alpha=0.0).collect()}
    assert p[("w", "1")] == 0.75 and p[("w", "2")] == 0.25
    p = {(r["term"], r["label"]): round(r["p"], 6) for r in lexical.class_given_word(d, prior="uniform", alpha=1.0).collect()}
    assert p[("w", "1")] == 0.666667 and p[("w", "2")] == 0.333333
    prior = d.sparkSession.createDataFrame([("1", 0.1), ("2", 0.9)], "label STRING, prior DOUBLE")
    p = {(r["term"], r["label"]): round(r["p"], 6) for r in lexical.class_given_word(d, prior=prior, alpha=0.0).collect()}
    assert p[("w", "1")] == round(0.075 / (0.075 + 0.225), 6)
    with pytest.raises(ValueError):
        lexical.class_given_word(d, prior="other")


def test_cooccurrence_against_brute_force(docs):
    d = docs(("1", 1950, "a b c a q b"), ("2", 1950, "b b a")).withColumn("decade", F.lit(1950))
    v = vocab.build_vocab(docs(("0", None, "a b c")), 3, 1)
    got = {(r["term"], r["context"]): r["n"] for r in lexical.cooccurrence(d, v, 3, span=2).collect()}
    want = {}
    for words in ("a b c a q b".split(), "b b a".split()):
        for i, x in enumerate(words):
            for j, y in enumerate(words):
                if i != j and abs(i - j) <= 2 and x != "q" and y != "q":
                    want[(x, y)] = want.get((x, y), 0) + 1
    assert got == want


def test_step_sample_of_text_keys(spark):
    df = spark.range(90).select(F.concat(F.lit("d"), "id").alias("doc_id"))
    got = ranking.step_sample(df, "doc_id", cap=50, target=30)
    assert got.count() == 30 == got.distinct().count()


def test_corpus_limit_is_one_method_for_every_size(spark):
    from lexitide.operators.ranking import corpus_limit

    rows = spark.range(12_000).selectExpr("lpad(cast(id as string), 6, '0') AS doc_id", "id")
    for n in (1, 9_999, 10_001):
        got = [r["id"] for r in corpus_limit(rows, n).select("id").collect()]
        assert sorted(got) == list(range(n))
    ties = rows.selectExpr("CASE WHEN id < 3 THEN NULL WHEN id < 10 THEN 'a' ELSE 'b' END AS doc_id", "id")
    assert sorted(r["id"] for r in corpus_limit(ties, 2).collect()) <= [0, 1, 2]
    assert corpus_limit(ties, 5).count() == 5 and corpus_limit(ties, 50_000).count() == 12_000


@pytest.mark.parametrize("n", [3, 1000, 1001])
def test_group_limits_on_text_keys_ties_and_equal_rows(spark, n):
    """One method at every n: text keys, null keys first, ties, equal rows at the cut, a null group."""
    rows = [("a", f"k{i:05d}", i) for i in range(1200)] + [("b", "same", 0)] * 1100 + [("c", None, 1), ("c", "x", 2), ("c", None, 3), ("c", "a", 4)]
    rows += [(None, f"n{i % 7}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "g STRING, key STRING, v INT").repartition(5)
    got = ranking.limit_per_group(df, "g", "key", n).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], []).append(r)
    assert {g: len(x) for g, x in by_group.items()} == {"a": min(n, 1200), "b": min(n, 1100), "c": min(n, 4), None: min(n, 40)}
    assert sorted(r["key"] for r in by_group["a"]) == [f"k{i:05d}" for i in range(min(n, 1200))]
    first = sorted((r["key"] is not None, r["key"]) for r in by_group["c"])
    assert first == [(False, None), (False, None), (True, "a"), (True, "x")][:n]
    keys = sorted(r["key"] for r in by_group[None])
    assert keys == sorted(f"n{i % 7}" for i in range(40))[:n] and len({r["v"] for r in by_group[None]}) == len(by_group[None])


def test_positions_of_text_keys(spark):
    import hashlib

    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(500)] + ["tie"] * 50
    got = ranking.add_row_index(spark.createDataFrame([(k,) for k in keys], "key STRING").repartition(6), "key").collect()
    assert [r["key"] for r in sorted(got, key=lambda r: r["row_idx"])] == sorted(keys) and sorted(r["row_idx"] for r in got) == list(range(550))


def test_hashed_documents_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """what a task holds grew with the input. An id stays in one partition; texts may be null and ids repeat."""
    monkeypatch.setattr(session, "TASK_BYTES", 1000)
    rows = [(i % 150, "en", "word " * 20 if i % 10 else None) for i in range(200)] + [(None, "en", "none here")]
    spark.createDataFrame(rows, "doc_id LONG, lang STRING, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    for hashed in (corpus.tokens(spark, str(tmp_path), hashed=True), vectors._dealt(corpus.tokens(spark, str(tmp_path)))):
        assert hashed.rdd.getNumPartitions() >= 16
        placed = hashed.select("doc_id", F.spark_partition_id().alias("p"))
        assert placed.count() == 201 and placed.distinct().groupBy("doc_id").count().where("count > 1").isEmpty()
    counted = vocab.count_vectors(hashed, vocab.build_vocab(hashed, 10, 1), 10)
    tf = {(r["doc_id"]): r["tf"] for r in counted.where("term_idx = 0").collect()}
    assert len(tf) == 135 and tf[1] == 40 and tf[51] == 20  # 1 comes twice


def test_terms_are_summed_by_parts_of_the_texts(spark, monkeypatch):
    """one task summed the terms of a whole scan partition, however large."""
    monkeypatch.setattr(session, "TASK_BYTES", 200)
    rows = [(i % 30, f"red blue red w{i}" if i % 10 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").coalesce(1)
    deals = []
    plain = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: deals.append(a[0]) or plain(self, *a))
    found = {r["term"]: (r["tf"], r["df"]) for r in vocab.tfidf_features(df, 10, 2, (1, 2)).collect()}
    assert deals and deals[0] >= 6
    assert found == {"red": (180, 90), "blue": (90, 90), "red blue": (90, 90), "blue red": (90, 90)}


def test_weights_by_document_move_once(spark):
    """every weight moved with its term as a row of its own."""
    rows = [(i % 30 if i else None, f"red blue red w{i}" if i % 10 else "blue") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    features = vocab.tfidf_features(df, 10, 2, (1, 1))
    told = []
    for by_doc in (False, True):
        weights = vocab.tfidf_weights(df, features, 10, (1, 1), by_doc=by_doc)
        grouped = weights.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.max("weight").alias("high"), F.min("weight").alias("low"))
        told.append(sorted(grouped.collect(), key=repr))
        assert ("hashpartitioning(doc_id" in grouped._jdf.queryExecution().toString()) and len(told[-1]) == 58
    assert told[0] == told[1]
    plan = grouped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Generate") < plan.index("RepartitionByExpression")
