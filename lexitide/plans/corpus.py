"""The supplied tables in the shape the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import text as X
from lexitide.session import dealt, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def year() -> F.Column:
    """Publication year derived from the id; every 17th document has none."""
    return F.when(F.col("doc_id") % 17 != 0, (1900 + (F.col("doc_id") * 37) % 120).cast("int"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(doc_id, rights_year, domain, batch, text)` of documents with at least one word.

    The word test stops at its first match, and tokens are made only by the plans that use them.
    """
    docs = table(spark, sf_dir, "documents")
    return docs.where(X.has_words(F.col("text"))).select(
        "doc_id", year().alias("rights_year"), F.col("lang").alias("domain"), (F.col("doc_id") % 8).alias("batch"), "text"
    )


def tokens(spark: SparkSession, sf_dir: str, hashed: bool = False) -> DataFrame:
    """`texts` with `full_text`. The raw text is spread over the cluster before it is split into words.

    `hashed` asks for placement by document id, for plans with several steps per document, in partitions of a bounded size.
    """
    raw = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    raw = dealt(raw, "doc_id", F.octet_length("text")) if hashed else spread(raw, "doc_id")
    worded = raw.select(
        "doc_id",
        year().alias("rights_year"),
        F.col("lang").alias("domain"),
        (F.col("doc_id") % 8).alias("batch"),
        F.col("doc_id").alias("line_no"),
        X.words(F.col("text")).alias("full_text"),
    )
    return worded


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(doc_id, embedding, label)`; vector and document ids are the same."""
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' years with the supplied vector labels as topics; label 0 plays the outlier topic -1."""
    topic = F.when(F.col("label") == 0, -1).otherwise(F.col("label") - 1).cast("int")
    return vectors(spark, sf_dir).select("doc_id", year().alias("rights_year"), topic.alias("topic"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External labels `(doc_id, label)` for part of the documents."""
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted labels `(doc_id, y_true, y_pred)` from the label table."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
