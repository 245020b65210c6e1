"""Whole stages from input directories to output directories, with the usual flags as keyword arguments.

Stages hand over Parquet; CSV copies are written for tables people read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import text as X
from lexitide.operators import classify, clustering, documents, metrics, neighbors, ranking, splits, timelines, topics, vocab
from lexitide.operators.topic_model import open_topic_model, topic_model
from lexitide.operators.vectors import embed_rows
from lexitide.schemas import NoLabelledRows
from lexitide.session import cut_lineage
from lexitide.sources import jsonl, stores
from lexitide.sources.stores import join_path as path_in


def embed_batches(
    spark: SparkSession,
    batches_dir: str,
    out_dir: str,
    encoder=None,
    window: int = 256,
    stride: int = 200,
    max_docs: int = -1,
    start_batch: int | None = None,
    end_batch: int | None = None,
) -> DataFrame:
    """Document vectors per batch; `max_docs` counts kept documents per file. Returns kept and skipped counts."""
    raw = jsonl.raw_batches(spark, batches_dir, start_batch, end_batch)
    docs = ranking.limit_per_group(jsonl.documents(raw), "batch", "line_no", max_docs).persist()
    out = embed_rows(docs.select("doc_id", "rights_year", "batch", "line_no", "full_text"), encoder, window, stride).drop("line_no")
    stores.write_vectors(out, path_in(out_dir, "vectors"), path_in(out_dir, "meta"), docs.select("batch").distinct())
    counts = jsonl.ingest_counts(raw, docs.select("batch", "line_no"), max_docs)
    stores.write_json(counts, path_in(out_dir, "run"))
    docs.unpersist()
    return counts


def cluster_vectors(
    spark: SparkSession, emb_dir: str, out_dir: str, k: Sequence[int], max_iter: int = 300, n_init: int = 10, random_state: int = 42
) -> DataFrame:
    """k-means for each k: labels, centres and metrics with their source files."""
    vectors = stores.require_sound(stores.read_vectors(spark, path_in(emb_dir, "vectors")))
    labels, scores, centres = clustering.kmeans_sweep(vectors, k, max_iter, n_init, random_state)
    sources = stores.sources_of(vectors).select("sources")
    labels.write.mode("overwrite").partitionBy("k").parquet(path_in(out_dir, "labels"))
    centres.write.mode("overwrite").parquet(path_in(out_dir, "centres"))
    scored = scores.join(F.broadcast(sources)).persist()  # one row of file names
    record = scored.agg(F.max("n_docs").alias("n_docs"), F.sort_array(F.collect_list("k")).alias("k"), F.first("sources").alias("sources"))
    settings = {"max_iter": max_iter, "n_init": n_init, "random_state": random_state}
    record = record.withColumns({c: F.lit(v) for c, v in settings.items()})
    record.write.mode("overwrite").parquet(path_in(out_dir, "run"))  # no JSON: those are read as metrics
    for one in k:
        stores.write_json(scored.where(F.col("k") == one), path_in(out_dir, f"kmeans_k{one}_metrics"))
        stores.write_csv(labels.where(F.col("k") == one).drop("k"), path_in(out_dir, f"kmeans_k{one}_labels"))
    return scored


def report_k(spark: SparkSession, kmeans_dir: str, out_dir: str | None = None) -> DataFrame:
    """Summary of all metric files and the recommended k."""
    out_dir = out_dir or kmeans_dir
    found = stores.read_kmeans_metrics(spark, kmeans_dir).persist()
    recommended = clustering.recommend_k(found)
    stores.write_csv(found, path_in(out_dir, "kmeans_summary"))
    stores.write_json(recommended, path_in(out_dir, "kmeans_recommendation"))
    return recommended


def lda_topics(
    spark: SparkSession,
    batches_dir: str,
    out_dir: str,
    n_topics: int = 50,
    vocab_size: int = 30_000,
    min_freq: int = 3,
    n_top_words: int = 15,
    max_docs: int = -1,
    random_state: int = 42,
) -> DataFrame:
    """Vocabulary, LDA, top words, top topic per document and yearly timeline. Returns the run's manifest.

    `max_docs` limits the fit; the vocabulary is always of the whole corpus.
    """
    docs = jsonl.read_docs(spark, batches_dir)
    terms = vocab.build_vocab(docs, vocab_size, min_freq).persist()
    fitted = ranking.corpus_limit(docs, max_docs)
    model, rows = topics.fit_lda(fitted, terms, n_topics, random_state)
    rows = rows.persist()
    if rows.isEmpty():
        raise NoLabelledRows("no documents to fit topics on")
    stores.save_model(model, path_in(out_dir, "model"))
    stores.write_csv(topics.lda_topic_words(model, terms, n_top_words).select("topic", "rank", "word"), path_in(out_dir, "topics"))
    stores.write_csv(topics.top_topic(rows), path_in(out_dir, "doc_topics"))
    stores.write_matrix(rows, path_in(out_dir, "doc_topic"))
    line = timelines.timeline_wide(timelines.timeline_soft(rows), list(range(n_topics)))
    stores.write_csv(line, path_in(out_dir, "timelines"))
    manifest = rows.agg(F.count("*").alias("n_docs"), F.lit(n_topics).alias("n_topics"), F.lit(min_freq).alias("min_freq"))
    manifest = manifest.withColumn("vocab", F.lit(terms.count()))
    stores.write_json(manifest, path_in(out_dir, "run"))
    return manifest


def lda_gloss(spark: SparkSession, topics_csv: str, timelines_csv: str, out_csv: str, top_n: int = 10) -> DataFrame:
    words = stores.read_topic_words(spark, topics_csv)
    line = timelines.timeline_long(stores.read_timeline(spark, timelines_csv))
    gloss = timelines.lda_gloss(words, line, top_n)
    stores.write_csv(gloss, out_csv)
    return gloss


def density_topics(
    spark: SparkSession,
    emb_dir: str,
    batches_dir: str,
    out_dir: str,
    min_cluster_size: int = 30,
    min_samples: int | None = None,
    nr_topics: int | str | None = None,
    n_components: int = 5,
    eps: float | None = None,
    max_docs: int = -1,
    calc_prob: bool = False,
    top_n: int = 10,
) -> DataFrame:
    """Topics from vectors: assignments, words, topic table and timeline. Returns the topic table."""
    stored = ranking.corpus_limit(stores.require_sound(stores.read_vectors(spark, path_in(emb_dir, "vectors"))), max_docs).persist()
    docs = jsonl.read_docs(spark, batches_dir)
    texts = documents.tokens_for_ids(stored.select("doc_id"), docs)
    fitted = neighbors.density_fit(stored, n_components, min_cluster_size, min_samples, eps)
    assigned = cut_lineage(stored.join(fitted.topics, "doc_id").select("doc_id", "rights_year", "topic"))
    with_text = assigned.select("doc_id", "topic").join(texts, "doc_id")
    if nr_topics is not None:
        merged = cut_lineage(topics.merge_topics(assigned, with_text, nr_topics))
        with_text = merged.select("doc_id", "topic").join(with_text.drop("topic"), "doc_id")
        assigned = merged
    info = topics.topic_info(assigned, topics.class_tfidf(with_text, "topic", top_n)).persist()
    names = [r["topic"] for r in info.where(F.col("topic") >= 0).select("topic").orderBy("topic").collect()]  # topics
    if calc_prob and names:
        made = stored.join(assigned.select("doc_id", "topic"), "doc_id")
        soft = topics.soft_topics(made, topics.topic_centroids(made)).select("doc_id", "rights_year", "dist").persist()
        stores.write_matrix(soft, path_in(out_dir, "doc_probs"))
        line = timelines.timeline_soft(soft)
    else:
        line = timelines.timeline_hard(assigned)
    exported = info.select(
        F.col("topic").alias("Topic"),
        F.col("doc_count").alias("Count"),
        F.col("name").alias("Name"),
        F.array_join("words", ", ").alias("Representation"),
    )
    info.write.mode("overwrite").parquet(path_in(out_dir, "topic_info"))
    stores.write_csv(exported, path_in(out_dir, "topics"))
    stores.write_csv(assigned.select("doc_id", "rights_year", "topic"), path_in(out_dir, "doc_topics"))
    stores.write_csv(timelines.timeline_wide(line, names), path_in(out_dir, "timelines"))
    topic_model(fitted, assigned).save(path_in(out_dir, "model"))
    record = assigned.agg(F.count("*").alias("n_docs"), F.count_distinct(F.when(F.col("topic") >= 0, F.col("topic"))).alias("n_topics"), F.count_if(F.col("topic") < 0).alias("n_noise"))
    settings = {"emb_dir": emb_dir, "batches_dir": batches_dir, "n_components": n_components, "min_cluster_size": min_cluster_size, "min_samples": fitted.min_samples, "eps": eps, "nr_topics": str(nr_topics), "calc_prob": calc_prob}
    stores.write_json(record.withColumns({c: F.lit(v) for c, v in settings.items()}), path_in(out_dir, "run"))
    return info


def assign_topics(spark: SparkSession, emb_dir: str, topics_dir: str, out_dir: str) -> DataFrame:
    """Topics of stored vectors by the model of an earlier `density_topics` run, noise -1; nothing is fitted again."""
    vectors = stores.require_sound(stores.read_vectors(spark, path_in(emb_dir, "vectors")))
    placed = open_topic_model(spark, path_in(topics_dir, "model")).assign(vectors).select("doc_id", "rights_year", "topic").persist()
    stores.write_csv(placed, path_in(out_dir, "doc_topics"))
    return placed


def density_gloss(spark: SparkSession, topics_csv: str, timelines_csv: str, out_csv: str, top_n: int = 10) -> DataFrame:
    info = stores.read_topic_info(spark, topics_csv)
    if "Count" in info.columns:
        info = info.withColumn("Count", F.col("Count").try_cast("bigint"))
    line = timelines.timeline_long(stores.read_timeline(spark, timelines_csv))
    gloss = timelines.density_gloss(info, line, top_n)
    stores.write_csv(gloss, out_csv)
    return gloss


def _write_dataset(labelled: DataFrame, out_dir: str, min_docs_per_class: int, val_ratio: float, seed: int) -> DataFrame:
    split = splits.stratified_split(labelled, min_docs_per_class, val_ratio, seed)
    stores.write_split(splits.require_rows(split), path_in(out_dir, "dataset"))
    stored = stores.read_split(labelled.sparkSession, path_in(out_dir, "dataset"))
    manifest = splits.split_manifest(stored, min_docs_per_class, val_ratio, seed)
    stores.write_json(manifest, path_in(out_dir, "run"))
    return manifest


def prepare_time_dataset(
    spark: SparkSession, batches_dir: str, out_dir: str, min_docs_per_class: int = 50, val_ratio: float = 0.2, seed: int = 42, max_docs: int = -1
) -> DataFrame:
    """Decade-labelled documents, rare decades dropped, split; `max_docs` counts documents before labelling."""
    docs = ranking.corpus_limit(jsonl.read_docs(spark, batches_dir), max_docs)
    labelled = documents.label_decade(docs).select("doc_id", "rights_year", "label", X.joined(F.col("full_text")).alias("text"))
    return _write_dataset(labelled, out_dir, min_docs_per_class, val_ratio, seed)


def prepare_domain_dataset(
    spark: SparkSession,
    batches_dir: str,
    out_dir: str,
    labels_csv: str | None = None,
    min_docs_per_class: int = 50,
    val_ratio: float = 0.2,
    seed: int = 42,
    max_docs: int = -1,
) -> DataFrame:
    """Documents labelled by an external table or their own domain, rare classes dropped, split."""
    docs = ranking.corpus_limit(jsonl.read_docs(spark, batches_dir), max_docs)
    table = stores.read_labels(spark, labels_csv) if labels_csv else None
    labelled = documents.label_domain(docs, table).select(
        "doc_id", "rights_year", "domain", X.joined(F.col("full_text")).alias("text"), "label"
    )
    return _write_dataset(labelled, out_dir, min_docs_per_class, val_ratio, seed)


def _write_metrics(preds: DataFrame, labels: list[str], out_dir: str) -> DataFrame:
    preds = preds.persist()
    document = metrics.metrics_document(preds, labels=labels)
    stores.write_json(document, path_in(out_dir, "metrics"))
    matrix = metrics.confusion_wide(metrics.confusion(preds, labels=labels), labels)
    stores.write_csv(matrix, path_in(out_dir, "confusion_matrix"))
    return document


def train_labels(split: DataFrame) -> list[str]:
    """Sorted labels of the training rows."""
    train = split.where(F.col("split") == "train")
    return [r["label"] for r in train.select("label").distinct().orderBy("label").collect()]  # one row per class


def train_baselines(
    spark: SparkSession,
    dataset_dir: str,
    out_dir: str,
    max_features: int = 100_000,
    min_df: int = 2,
    ngram: tuple[int, int] = (1, 2),
    models: Sequence[str] = ("lr", "mlp"),
    max_iter: int = 2000,
    hidden: int = 512,
    mlp_features: int | None = None,
) -> DataFrame:
    """TF-IDF with logistic regression and MLP: models, metrics and confusion matrices. Returns the metrics."""
    split = stores.read_split(spark, path_in(dataset_dir, "dataset"))
    preds, fitted = classify.baselines(split, max_features, min_df, ngram, models, max_iter, hidden, mlp_features)
    for tag, model in fitted.items():
        stores.save_model(model, path_in(out_dir, f"{tag}_model"))
    return _write_metrics(preds, train_labels(split), out_dir)


def train_vector_head(
    spark: SparkSession, dataset_dir: str, emb_dir: str, out_dir: str, reg_params: Sequence[float] = (0.0001, 0.001, 0.01, 0.1)
) -> DataFrame:
    """Linear classifier on stored document vectors, the best penalty kept. Returns the metrics."""
    split = stores.read_split(spark, path_in(dataset_dir, "dataset")).select("doc_id", "label", "split")
    vectors = stores.read_vectors(spark, path_in(emb_dir, "vectors")).select("doc_id", "embedding")
    preds, scores, model = classify.vector_head(split.join(vectors, "doc_id"), reg_params)
    stores.save_model(model, path_in(out_dir, "head_model"))
    stores.write_json(scores, path_in(out_dir, "candidates"))
    return _write_metrics(preds.withColumn("tag", F.lit("head")), train_labels(split), out_dir)
