"""Vector stores, label tables, topic tables, split tables and metric files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import text as X
from lexitide.schemas import KMEANS_METRICS, LABELS, TOPIC_WORDS, require_columns


def write_vectors(vectors: DataFrame, path: str, meta_path: str | None = None, batches: DataFrame | None = None) -> None:
    """Store `(doc_id, rights_year, embedding, batch)`; a re-run replaces only the batches it carries.

    A caller that knows the `batches` spares making the vectors again to list them.
    """
    require_columns(vectors, ["doc_id", "rights_year", "embedding", "batch"])
    out = vectors.withColumn("embedding", F.col("embedding").cast("array<float>"))
    replace_batches(out, path)
    if meta_path:
        stored = vectors.sparkSession.read.parquet(path)
        batches = vectors.select("batch").distinct() if batches is None else batches
        (
            stored.join(batches, "batch", "left_semi")
            .select("batch", "doc_id", "rights_year")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("ignoreNullFields", "false")
            .partitionBy("batch")
            .json(meta_path)
        )


def replace_batches(df: DataFrame, path: str) -> None:
    """Overwrite the batches in `df`, nothing else. Rebalancing gives few files per batch and splits a large one."""
    even = df.hint("rebalance", "batch")
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All stored batches, with the batch folder and file each row came from."""
    return spark.read.parquet(path).withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), "[^/]+/[^/]+$", 0))


def check_vectors(vectors: DataFrame) -> DataFrame:
    """One row per batch: vectors, distinct ids, smallest and largest dimension, rows that miss a part."""
    incomplete = F.col("doc_id").isNull() | F.col("embedding").isNull()
    return vectors.groupBy("batch").agg(
        F.count("*").alias("n_vectors"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
        F.count_if(incomplete).alias("n_incomplete"),
    )


def require_sound(vectors: DataFrame) -> DataFrame:
    """The same vectors, or an error if a row misses its id or vector or the vectors differ in length."""
    checks = F.count_if(F.col("doc_id").isNull() | F.col("embedding").isNull()), F.min(F.size("embedding")), F.max(F.size("embedding"))
    incomplete, low, high = vectors.agg(*checks).first()
    if incomplete or low != high:
        raise ValueError(f"vector store has {incomplete} incomplete rows and vectors of {low} to {high} components")
    return vectors


def sources_of(vectors: DataFrame) -> DataFrame:
    """Sorted names of the files behind a vector table (provenance of a run)."""
    return vectors.agg(F.sort_array(F.collect_set("source_file")).alias("sources"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """External labels `doc_id,label`."""
    header = spark.read.option("header", True).csv(path)
    require_columns(header, ["doc_id", "label"])
    return header.select("doc_id", "label").to(spark.createDataFrame([], LABELS).schema)


def read_topic_words(spark: SparkSession, path: str) -> DataFrame:
    """Topic words `(topic, rank, word)` from CSV."""
    df = require_columns(spark.read.option("header", True).csv(path), ["topic", "rank", "word"])
    return df.select(F.col("topic").try_cast("int").alias("topic"), F.col("rank").try_cast("int").alias("rank"), "word")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Wide timeline `rights_year, <topic>, ...` from CSV."""
    df = require_columns(spark.read.option("header", True).csv(path), ["rights_year"])
    topics = [c for c in df.columns if c != "rights_year"]
    return df.select(
        X.year_of(F.col("rights_year")).alias("rights_year"),
        *[X.no_nan(F.col(f"`{c}`").try_cast("double")).alias(c) for c in topics],
    )


def read_topic_info(spark: SparkSession, path: str) -> DataFrame:
    """Topic info with a `Topic` column; `Representation` is made up from the other columns if absent."""
    df = require_columns(spark.read.option("header", True).csv(path), ["Topic"])
    return with_representation(df).withColumn("Topic", F.col("Topic").try_cast("int"))


def with_representation(info: DataFrame) -> DataFrame:
    if "Representation" in info.columns:
        return info
    rest = [c for c in info.columns if c not in ("Topic", "Count", "Name")]
    text = F.concat_ws(", ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rest])
    return info.withColumn("Representation", text)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Labelled split without rows that miss text or label."""
    df = require_columns(spark.read.parquet(path), ["text", "label", "split"])
    return df.dropna(subset=["text", "label"])


def read_kmeans_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All k-means metric files of a directory, by k."""
    df = (
        spark.read.schema(KMEANS_METRICS)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .select(
            "k",
            "inertia",
            X.no_nan(F.col("silhouette").try_cast("double")).alias("silhouette"),
            "n_docs",
            F.col("_metadata.file_name").alias("file"),
        )
        .where(F.col("k").isNotNull())
    )
    if df.isEmpty():
        raise FileNotFoundError(f"no k-means metrics under {path}")
    return df.orderBy("k")


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV export; null becomes an empty field, arrays become JSON text."""
    flat = [
        F.to_json(F.col(f"`{f.name}`")).alias(f.name)
        if f.dataType.typeName() in ("array", "map", "struct")
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    writer = df.select(*flat).write.mode("overwrite").option("header", True)
    writer.option("quoteAll", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Metrics as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """Dense rows (document-topic or document-probability) as an array column in Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_split(labelled: DataFrame, path: str) -> None:
    labelled.hint("rebalance", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def save_model(model, path: str) -> None:
    """Any fitted Spark ML model or pipeline, or a model that saves itself."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        model.save(path)


def join_path(base: str, *parts: str) -> str:
    return os.path.join(base, *parts)
