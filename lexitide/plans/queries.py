"""Registered queries: every operator over the supplied tables, each `(spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import text as X
from lexitide.functions.vectors import argmax, mean_vector
from lexitide.operators import classify, clustering, density_tree, descent, documents, drift, heavy, lexical, metrics, neighbors, ranking, spectral, splits, timelines, topics, vocab
from lexitide.operators import vectors as V
from lexitide.plans import corpus as C
from lexitide.plans import facts
from lexitide.sources import stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

LDA_TOPICS = 50
# Years of the reforms that the topic-shift report is asked about.
REFORMS = [("first", 1933), ("second", 1964), ("third", 1996)]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


# --- documents -------------------------------------------------------------------------------------


@query
def doc_projection(spark, sf):
    out = documents.project(C.tokens(spark, sf))
    return out.select("doc_id", "rights_year", "domain", "n_tokens", F.md5("text").alias("text_md5"))


@query
def doc_filter_counts(spark, sf):
    return documents.filter_counts(C.tokens(spark, sf)).where(F.col("batch").isNull()).select("processed", "skipped")


@query
def batch_rollup(spark, sf):
    return documents.filter_counts(C.tokens(spark, sf))


@query
def decade_counts(spark, sf):
    return splits.class_sizes(documents.label_decade(C.texts(spark, sf)))


@query
def label_source_domain(spark, sf):
    return splits.class_sizes(documents.label_domain(C.texts(spark, sf)))


@query
def label_join(spark, sf):
    return documents.label_domain(C.texts(spark, sf), C.labels(spark, sf)).select("doc_id", "rights_year", "label")


@query
def label_ids(spark, sf):
    return splits.label_mapping(documents.label_decade(C.texts(spark, sf)))


@query
def frequent_classes(spark, sf):
    labelled = documents.label_decade(C.texts(spark, sf)).select("doc_id", "label")
    return splits.frequent_classes(labelled, 78)


@query
def strat_split(spark, sf):
    labelled = documents.label_decade(C.texts(spark, sf))
    return splits.stratified_split(labelled).select("doc_id", "label", "split")


@query
def split_manifest(spark, sf):
    labelled = documents.label_decade(C.texts(spark, sf)).select("doc_id", "label")
    return splits.split_manifest(splits.stratified_split(labelled))


@query
def file_limit(spark, sf):
    return ranking.limit_per_group(C.texts(spark, sf), "batch", "doc_id", 20).select("batch", "doc_id")


@query
def file_limit_text(spark, sf):
    """The first 1,100 of each batch by a text key; batches have fewer rows at small scale and more at large."""
    docs = C.texts(spark, sf).withColumn("key", F.md5(F.col("doc_id").cast("string")))
    return ranking.limit_per_group(docs.select("batch", "doc_id", "key"), "batch", "key", 1_100)


@query
def corpus_limit(spark, sf):
    return ranking.corpus_limit(C.texts(spark, sf), 300).select("doc_id", "rights_year")


@query
def doc_text_for_ids(spark, sf):
    docs = C.tokens(spark, sf)
    copies = docs.select("doc_id", (F.col("batch") + 8).alias("batch"), "line_no", F.array(F.lit("later")).alias("full_text"))
    ids = C.vectors(spark, sf).select((F.col("doc_id") * 3).alias("doc_id"))
    found = documents.texts_for_ids(ids, copies.unionByName(docs, allowMissingColumns=True))
    return found.select("doc_id", "found", F.md5("text").alias("text_md5"))


@query
def token_windows(spark, sf):
    out = documents.token_windows(C.tokens(spark, sf), 256, 200)
    return out.select("doc_id", "win_no", F.size("tokens").alias("n_tokens"), F.md5(X.joined(F.col("tokens"))).alias("text_md5"))


@query
def window_counts(spark, sf):
    return documents.token_windows(C.tokens(spark, sf), 128, 100).groupBy("doc_id").agg(F.count("*").alias("n_windows"))


@query
def rep_parse(spark, sf):
    raw = C.table(spark, sf, "documents")
    commas = F.concat(F.lit("['"), "lang", F.lit("', '"), "source", F.lit("' , ,"), F.col("n_chars").cast("string"), F.lit("]"))
    blanks = F.concat(F.lit(" "), "lang", F.lit("  "), "source", F.lit(" "), F.col("n_chars").cast("string"))
    rep = raw.select("doc_id", F.when(F.col("doc_id") % 2 == 0, commas).otherwise(blanks).alias("rep"))
    return rep.select("doc_id", F.array_join(X.representation_words(F.col("rep"), 2), "|").alias("words"))


# --- vocabulary and features -----------------------------------------------------------------------


@query
def term_freq(spark, sf):
    return vocab.term_counts(C.tokens(spark, sf))


@query
def corpus_union(spark, sf):
    docs = C.table(spark, sf, "documents").select("text")
    both = docs.unionByName(C.table(spark, sf, "benchmark").select("text"))
    return vocab.term_counts(lexical.normalise(both))


@query
def normalised_terms(spark, sf):
    docs = C.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return vocab.term_counts(lexical.normalise(docs, stopwords=["the", "of", "and", "de", "la", "der", "die"], fold_accents=True))


@query
def vocab_topk(spark, sf):
    return vocab.build_vocab(C.tokens(spark, sf), 30_000, 3)


@query
def vocab_sketch(spark, sf):
    """The rows of `vocab_topk`, found by a sketch and a count of its candidates."""
    return heavy.sketched_vocab(C.tokens(spark, sf), 30_000, 3)


@query
def bigram_features_sketch(spark, sf):
    """The 2,000 most frequent words and pairs in two documents or more, with far fewer counters than there are pairs."""
    train = _time_split(spark, sf).where(F.col("split") == "train")
    found = heavy.sketched_features(train, 2_000, 2, (1, 2))
    return found.select("term", F.col("term_idx").cast("int").alias("term_idx"), "tf", "df", r6("idf"))


@query
def count_vectors(spark, sf):
    docs = C.tokens(spark, sf, hashed=True)
    return vocab.count_vectors(docs, vocab.build_vocab(docs, 30_000, 3), 30_000)


def _time_split(spark, sf, min_docs=50):
    return splits.stratified_split(documents.label_decade(C.texts(spark, sf)), min_docs)


def _tfidf(spark, sf, max_features, ngram):
    split = _time_split(spark, sf)
    features = vocab.tfidf_features(split.where(F.col("split") == "train"), max_features, 2, ngram)
    weights = vocab.tfidf_weights(split, features, max_features, ngram)
    return weights.select("doc_id", "term", r6("weight"))


@query
def tfidf_unigram(spark, sf):
    return _tfidf(spark, sf, 100_000, (1, 1))


@query
def tfidf_bigram(spark, sf):
    return _tfidf(spark, sf, 100_000, (1, 2))


@query
def tfidf_repeated_ids(spark, sf):
    """Every text twice under its id, the second time with its first 200 characters only: each row has its own weights."""
    docs = _time_split(spark, sf).select("doc_id", "split", "text")
    both = docs.withColumn("part", F.lit(0)).unionByName(docs.withColumns({"part": F.lit(1), "text": F.substring("text", 1, 200)}))
    features = vocab.tfidf_features(both.where(F.col("split") == "train"), 100_000, 2, (1, 1))
    weights = vocab.tfidf_weights(both, features, 100_000, (1, 1), by_doc=True)
    return weights.groupBy("doc_id", "term").agg(F.count("*").alias("n_rows"), F.round(F.max("weight"), 6).alias("high"), F.round(F.min("weight"), 6).alias("low"))


@query
def ctfidf_decade(spark, sf):
    """Flagship: the ten most distinctive words of each decade."""
    words = topics.class_tfidf(documents.label_decade(C.tokens(spark, sf)), "label", 10)
    return words.select("label", "rank", "term", "weight")


@query
def ctfidf_role(spark, sf):
    """The most distinctive words of each role in the conversations."""
    turns = C.table(spark, sf, "conversations").select("role", X.words(F.col("text")).alias("full_text"))
    return topics.class_tfidf(turns, "role", 10).select("role", "rank", "term", "weight")


# --- topics ----------------------------------------------------------------------------------------


def _topic_docs(spark, sf):
    return C.tokens(spark, sf).join(C.assigned(spark, sf).select("doc_id", "topic"), "doc_id")


def _topic_words(spark, sf):
    return topics.class_tfidf(_topic_docs(spark, sf), "topic", 10)


@query
def topic_words(spark, sf):
    return _topic_words(spark, sf).select("topic", "rank", "term", "weight")


@query
def gloss_words(spark, sf):
    return topics.gloss_words(_topic_words(spark, sf), 8, "topic", "term")


@query
def topic_info(spark, sf):
    info = topics.topic_info(C.assigned(spark, sf), _topic_words(spark, sf))
    return info.select("topic", "doc_count", "name", F.array_join("words", " ").alias("words"))


@query
def topic_numbers(spark, sf):
    return topics.number_by_size(C.assigned(spark, sf))


@query
def timeline_hard(spark, sf):
    return timelines.timeline_hard(C.assigned(spark, sf)).select("rights_year", "topic", r6("prevalence"))


@query
def timeline_wide(spark, sf):
    wide = timelines.timeline_wide(timelines.timeline_hard(C.assigned(spark, sf)), list(range(9)))
    return wide.select("rights_year", *[F.round(str(t), 6).alias(f"t{t}") for t in range(9)])


@query
def timeline_unpivot(spark, sf):
    wide = timelines.timeline_wide(timelines.timeline_hard(C.assigned(spark, sf)), list(range(9)))
    return timelines.timeline_long(wide).select("rights_year", "topic", r6("prevalence"))


@query
def timeline_stats(spark, sf):
    stats = timelines.timeline_stats(timelines.timeline_hard(C.assigned(spark, sf)))
    return stats.withColumn("mean_prevalence", F.round(F.col("mean_prevalence") + 1e-9, 6))


@query
def gloss_left_join(spark, sf):
    assigned = C.assigned(spark, sf)
    info = topics.topic_info(assigned, _topic_words(spark, sf))
    gloss = timelines.density_gloss(info, timelines.timeline_hard(assigned), 8)
    return gloss.withColumn("mean_prevalence", F.round(F.col("mean_prevalence") + 1e-9, 6))


@query
def lda_gloss_join(spark, sf):
    words = _topic_words(spark, sf).where(F.col("topic") >= 0).withColumnRenamed("term", "word")
    gloss = timelines.lda_gloss(words, timelines.timeline_hard(C.assigned(spark, sf)), 5)
    return gloss.withColumn("mean_prevalence", F.round(F.col("mean_prevalence") + 1e-9, 6))


def _soft(spark, sf):
    made = C.vectors(spark, sf).join(C.assigned(spark, sf), "doc_id")
    return topics.soft_topics(made, topics.topic_centroids(made))


@query
def timeline_soft(spark, sf):
    return timelines.timeline_soft(_soft(spark, sf)).select("rights_year", F.col("topic").cast("int").alias("topic"), r6("prevalence"))


@query
def argmax_topic(spark, sf):
    return _soft(spark, sf).select("doc_id", argmax(F.col("dist")).alias("top_topic"))


@query
def reform_shift(spark, sf):
    reforms = spark.createDataFrame(REFORMS, "reform STRING, reform_year INT")
    shift = timelines.reform_shift(timelines.timeline_hard(C.assigned(spark, sf)), reforms, 10)
    return shift.select("reform", "topic", r6("before"), r6("after"), r6("shift"))


def _lda(spark, sf):
    docs = C.tokens(spark, sf)
    terms = vocab.build_vocab(docs, 30_000, 3).persist()
    model, rows = topics.fit_lda(docs, terms, n_topics=LDA_TOPICS)
    return terms, model, rows


@query
def lda_doc_topics(spark, sf):
    rows = _lda(spark, sf)[2]
    return facts.topic_distributions(rows.withColumn("top_topic", argmax(F.col("dist"))), LDA_TOPICS)


@query
def lda_top_words(spark, sf):
    terms, model, _ = _lda(spark, sf)
    return facts.ranked_words(topics.lda_topic_words(model, terms, 15), vocab.build_vocab(C.tokens(spark, sf), 30_000, 3))


@query
def density_topics(spark, sf):
    return facts.numbered_clusters(neighbors.density_topics(C.vectors(spark, sf)).select("doc_id", "topic"), 30)


@query
def density_given(spark, sf):
    """Density clusters of the vectors themselves at a given radius."""
    # the vectors fill the sphere evenly, so clusters of the default size don't occur at any one radius
    return neighbors.density_clusters(C.vectors(spark, sf), min_cluster_size=2, min_samples=2, eps=1.1)


# distances at which the spanning tree of the vectors is compared with the graph itself
LEVELS = [1.0, 1.15, 1.18, 1.2, 1.22, 1.25, 1.3]


@query
def tree_levels(spark, sf):
    """Edges of the spanning tree of mutual reachability up to some distances: rows less connected parts of the whole graph."""
    tree = density_tree.spanning_tree(C.vectors(spark, sf), 5).persist()
    levels = spark.createDataFrame([(x,) for x in LEVELS], "level DOUBLE")
    counted = [tree.agg(F.lit(x).alias("level"), F.count_if(F.col("w") <= x).alias("n_edges")) for x in LEVELS]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionByName(one)
    whole = tree.agg(F.count("*").alias("n_tree"))
    return levels.join(out, "level").join(F.broadcast(whole)).select("level", "n_edges", "n_tree")  # one row


@query
def neighbor_graph(spark, sf):
    """Neighbour lists by descent over leaves of 128 rows, and their recall of the exact lists."""
    made = C.vectors(spark, sf)
    found = descent.neighbor_graph(made, k=10, leaf=128).persist()
    whole = found.agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id", "nbr").alias("n_pairs"), F.count_if(F.col("doc_id") == F.col("nbr")).alias("n_self"))
    seen = descent.recall(found, neighbors.knn(made, k=10))
    return whole.join(F.broadcast(seen)).select("n_rows", "n_pairs", "n_self", "n_exact", (F.col("recall") >= 0.95).alias("recalled"))  # one row


@query
def spectral_coordinates(spark, sf):
    """Leading eigenvectors of the neighbour graph: length one, and what is left of A x - value x."""
    graph = spectral.graph_weights(neighbors.knn(C.vectors(spark, sf), k=15)).persist()
    found, values = spectral.spectral(graph, 3)
    facts_of = spectral.residuals(graph, found, values)
    return facts_of.select(
        "i", (F.abs(F.col("length") - 1) < 1e-6).alias("unit"), (F.col("residual") < 0.05).alias("settled"), ((F.col("value") <= 1 + 1e-9) & (F.col("value") >= -1)).alias("bounded")
    )


@query
def topic_merge(spark, sf):
    """The smallest topic merged into its most similar one."""
    assigned = C.assigned(spark, sf).select("doc_id", "topic")
    n = assigned.where("topic >= 0").select("topic").distinct().count()
    return topics.merge_topics(assigned, _topic_docs(spark, sf), n - 1)


# --- vectors ---------------------------------------------------------------------------------------


@query
def store_check(spark, sf):
    return stores.check_vectors(C.vectors(spark, sf).withColumn("batch", F.col("doc_id") % 8))


@query
def embedding_mean(spark, sf):
    windows = C.vectors(spark, sf).select(F.floor(F.col("doc_id") / 4).cast("bigint").alias("doc_id"), "embedding")
    return V.mean_vectors(windows).select("doc_id", F.posexplode("embedding").alias("dim", "x")).select("doc_id", "dim", r6("x"))


@query
def hash_embed_docs(spark, sf):
    made = V.embed_documents(C.tokens(spark, sf, hashed=True), V.HashingEncoder(64), 256, 200, hashed=True)
    long = made.select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    # short fractions such as 1/640 sit on a rounding boundary; the offset moves them off it
    return long.select("doc_id", "dim", F.round(F.col("x") + 1e-9, 6).alias("x"))


@query
def w2v_docs(spark, sf):
    return facts.document_vectors(V.embed_documents(C.tokens(spark, sf, hashed=True), V.Word2VecEncoder(), hashed=True), 64)


@query
def embed_repeated_ids(spark, sf):
    """Every document twice under its id, the second time with its first ten words only: each row has its own vector."""
    docs = C.tokens(spark, sf).select("doc_id", "batch", "line_no", "full_text")
    short = docs.withColumns({"batch": F.col("batch") + 8, "full_text": F.slice("full_text", 1, 10)})
    long = V.embed_rows(docs.unionByName(short), V.HashingEncoder(64), 256, 200).select("doc_id", "batch", F.posexplode("embedding").alias("dim", "x"))
    return long.select("doc_id", "batch", "dim", F.round(F.col("x") + 1e-9, 6).alias("x"))


@query
def pca_2d(spark, sf):
    return facts.components(V.reduce_dims(C.vectors(spark, sf), 2), C.vectors(spark, sf))


@query
def knn_exact(spark, sf):
    near = neighbors.knn(C.vectors(spark, sf), k=5, metric="cosine")
    return near.select("doc_id", "nbr", F.col("rank").cast("int").alias("rank"), r6("dist"))


@query
def knn_euclidean(spark, sf):
    """Documents' nearest topic centroids."""
    made = C.vectors(spark, sf)
    centres = made.groupBy("label").agg(mean_vector(F.col("embedding")).alias("embedding"))
    near = neighbors.knn(made, centres.withColumnRenamed("label", "doc_id"), k=3, metric="euclidean")
    return near.select("doc_id", F.col("nbr").cast("bigint").alias("nbr"), F.col("rank").cast("int").alias("rank"), r6("dist"))


@query
def knn_probe(spark, sf):
    """Cell search over as many cells as there can be, which is exact."""
    near = neighbors.knn(C.vectors(spark, sf), k=5, metric="cosine", n_probe=1_000_000)
    return near.select("doc_id", "nbr", F.col("rank").cast("int").alias("rank"), r6("dist"))


@query
def knn_vote(spark, sf):
    made = C.vectors(spark, sf)
    return neighbors.knn_vote(neighbors.knn(made, k=15, metric="cosine"), made)


# --- clusters --------------------------------------------------------------------------------------


@query
def inertia_given(spark, sf):
    return clustering.inertia(C.vectors(spark, sf), "label").select(F.round("inertia", 4).alias("inertia"))


@query
def silhouette_given(spark, sf):
    points = clustering.silhouette_points(C.vectors(spark, sf), "label")
    return points.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("silhouette"))


@query
def step_sample(spark, sf):
    return ranking.step_sample(C.vectors(spark, sf).select("doc_id"), "doc_id", cap=300, target=120)


@query
def step_sample_text(spark, sf):
    keys = C.vectors(spark, sf).select(F.md5(F.col("doc_id").cast("string")).alias("key"))
    return ranking.step_sample(keys, "key", cap=300, target=120)


def _labelings(spark, sf):
    """The supplied labels folded to k = 2..10 clusters, one labeling per k."""
    ks = F.explode(F.sequence(F.lit(2), F.lit(10))).alias("k")
    rows = C.vectors(spark, sf).select("doc_id", "embedding", "label", ks)
    return rows.withColumn("cluster", (F.col("label") % F.col("k")).cast("int"))


def _k_metrics(spark, sf):
    folded = _labelings(spark, sf)
    scores = clustering.silhouette(folded, "cluster", by="k")
    return clustering.inertia(folded, "cluster", by="k").join(scores, "k")


@query
def k_metrics(spark, sf):
    return _k_metrics(spark, sf).select("k", F.round("inertia", 4).alias("inertia"), r6("silhouette"))


@query
def k_recommend(spark, sf):
    return clustering.recommend_k(_k_metrics(spark, sf))


@query
def elbow_k(spark, sf):
    """Without silhouettes: the elbow, and the middle candidate as fallback."""
    scored = clustering.inertia(_labelings(spark, sf), "cluster", by="k")
    return clustering.recommend_k(scored.withColumn("silhouette", F.lit(None).cast("double")))


@query
def kmeans_multi_k(spark, sf):
    made = C.vectors(spark, sf)
    labels, scores, centres = clustering.kmeans_sweep(made, [4, 8])
    found = facts.kmeans_silhouettes(labels, made, facts.kmeans(made, labels, scores, centres))
    return found.select("k", "n_rows", "n_docs", "n_nearest", "n_clusters", "inertia_close", "silhouette_same", "below_one_cluster")


@query
def kmeans_labels(spark, sf):
    made = C.vectors(spark, sf).withColumn("rights_year", C.year())
    labels, scores, centres = clustering.kmeans_sweep(made, [6], silhouettes=False)
    return facts.kmeans(made, labels, scores, centres).drop("inertia", "silhouette")


# --- classifiers -----------------------------------------------------------------------------------


@query
def confusion(spark, sf):
    return metrics.confusion(C.predictions(spark, sf), "labels")


@query
def accuracy_macro_f1(spark, sf):
    return metrics.summary(C.predictions(spark, sf), "labels").select("tag", r6("accuracy"), r6("macro_f1"), "n")


@query
def class_report(spark, sf):
    report = metrics.class_report(C.predictions(spark, sf), "labels")
    return report.select("tag", "label", r6("precision"), r6("recall"), r6("f1"), "support")


@query
def model_metrics(spark, sf):
    """Two tagged models at once; the second is aligned with the truth by id."""
    rows = C.predictions(spark, sf)
    swapped = metrics.align(
        rows.select("doc_id", F.col("y_pred").alias("y_true")), rows.select("doc_id", F.col("y_true").alias("y_pred"))
    )
    both = rows.withColumn("tag", F.lit("a")).unionByName(swapped.withColumn("tag", F.lit("b")))
    return metrics.summary(both).select("tag", r6("accuracy"), r6("macro_f1"), "n")


@query
def lr_predictions(spark, sf):
    split = _domain_split(spark, sf)
    return facts.predictions(classify.baselines(split, models=("lr",))[0], split)


@query
def mlp_predictions(spark, sf):
    split = _domain_split(spark, sf)
    return facts.predictions(classify.baselines(split, models=("mlp",))[0], split)


def _domain_split(spark, sf):
    """Languages, which the words tell, as labels; the years are made up from ids and tell nothing of the text."""
    return splits.stratified_split(documents.label_domain(C.texts(spark, sf)))


def _vector_split(spark, sf):
    """The quadrant of a vector's first two components as label; the supplied labels tell nothing of the vectors."""
    quadrant = F.concat_ws("", *[F.when(F.get("embedding", i) > 0, "+").otherwise("-") for i in (0, 1)])
    return splits.stratified_split(C.vectors(spark, sf).withColumn("label", quadrant))


@query
def vector_head(spark, sf):
    split = _vector_split(spark, sf)
    return facts.predictions(classify.vector_head(split)[0], split)


@query
def neural_head(spark, sf):
    split = _vector_split(spark, sf)
    return facts.predictions(classify.neural_head(split)[0], split)


@query
def pseudo_label(spark, sf):
    train, valid = classify.split_parts(_vector_split(spark, sf))
    # vectors of length one have small components: a weaker penalty lets confidence reach the threshold
    return facts.adopted_rows(classify.pseudo_label(train, valid, reg_param=0.0001), train, 0.9)


@query
def class_given_word(spark, sf):
    docs = C.tokens(spark, sf).withColumnRenamed("domain", "label")
    return lexical.class_given_word(docs, prior="uniform").select("term", "label", r6("p"))


@query
def class_given_word_empirical(spark, sf):
    docs = C.tokens(spark, sf).withColumnRenamed("domain", "label")
    return lexical.class_given_word(docs, prior="empirical", alpha=0.5, min_freq=5).select("term", "label", r6("p"))


@query
def semantic_drift(spark, sf):
    drift = lexical.semantic_drift(C.tokens(spark, sf), vocab_size=200)
    return drift.select("term", "from_decade", "to_decade", r6("cosine"))


@query
def drift_embeddings(spark, sf):
    """Drift of up to 30,000 words by aligned embeddings: rows, words, and whether all cosines are within bounds."""
    return facts.cosines(drift.embedding_drift(C.tokens(spark, sf), 30_000, dims=32))


@query
def decade_embeddings(spark, sf):
    """Per decade: words with an embedding, and whether its coordinates are orthogonal and in order of length."""
    made = drift.word_embeddings(lexical.information_table(C.tokens(spark, sf), 30_000), dims=16)
    return facts.orthogonal_coordinates(made)
