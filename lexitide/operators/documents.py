"""Document projections, labels, windows and texts by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.functions import text as X
from lexitide.operators.ranking import first_per_key
from lexitide.schemas import NoLabelledRows, require_columns


def project(docs: DataFrame) -> DataFrame:
    """`(doc_id, rights_year, domain, text, n_tokens)` of documents with tokens."""
    return docs.where(F.size("full_text") > 0).select(
        "doc_id",
        "rights_year",
        "domain",
        X.joined(F.col("full_text")).alias("text"),
        F.size("full_text").alias("n_tokens"),
    )


def label_decade(docs: DataFrame) -> DataFrame:
    """Documents labelled with their decade; rows without a year are dropped."""
    require_columns(docs, ["rights_year"])
    return docs.withColumn("label", X.decade(F.col("rights_year"))).where(F.col("label").isNotNull())


def label_domain(docs: DataFrame, labels: DataFrame | None = None, dedupe_labels: bool = False) -> DataFrame:
    """Documents labelled from an external table, else from their own `domain`.

    Documents without a label are dropped, so the left join becomes an inner one. A repeated label row
    repeats its document unless `dedupe_labels` is set, which keeps the smallest label.
    """
    if labels is None:
        require_columns(docs, ["domain"])
        out = docs.withColumn("label", F.col("domain")).where(F.col("label").isNotNull())
        if out.isEmpty():
            raise NoLabelledRows("no labels given and no document has a domain")
        return out
    require_columns(labels, ["doc_id", "label"])
    table = labels.select("doc_id", "label").dropna()
    if dedupe_labels:
        table = table.groupBy("doc_id").agg(F.min("label").alias("label"))
    return docs.join(table, "doc_id")


def token_windows(docs: DataFrame, window: int = 256, stride: int = 200) -> DataFrame:
    """One row per window: `(doc_id, win_no, tokens)` (F1)."""
    slices = X.windows(F.col("full_text"), window, stride)
    return X.unfold_at(docs, "doc_id", tokens=slices, names=("win_no", "tokens"))


def texts_for_ids(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Text of every wanted id, '' if it has none: `(doc_id, text, found)`.

    Of several rows with one id the first with a token list wins. Order of `ids` is the caller's column.
    """
    wanted = ids.select(F.col("doc_id")).distinct()
    texts = (
        docs.where(F.col("full_text").isNotNull())
        .join(wanted, "doc_id", "left_semi")
        .select("doc_id", "batch", "line_no", X.joined(F.col("full_text")).alias("text"))
    )
    first = first_per_key(texts, "doc_id", ["batch", "line_no"]).select("doc_id", "text")
    joined = ids.join(first, "doc_id", "left")
    return joined.withColumn("found", F.col("text").isNotNull()).withColumn("text", F.coalesce("text", F.lit("")))


def tokens_for_ids(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """`(doc_id, full_text)` of every wanted id that has a token list; of several rows with one id the first one's."""
    wanted = ids.select("doc_id").distinct()
    there = docs.where(F.size("full_text") > 0).join(wanted, "doc_id", "left_semi")
    return first_per_key(there, "doc_id", ["batch", "line_no"]).select("doc_id", "full_text")


def filter_counts(docs: DataFrame) -> DataFrame:
    """Kept and skipped documents per batch plus the total under batch null."""
    kept = F.coalesce(F.size("full_text"), F.lit(0)) > 0
    return (
        docs.select("batch", kept.alias("kept"))
        .rollup("batch")
        .agg(F.count_if("kept").alias("processed"), F.count_if(~F.col("kept")).alias("skipped"))
    )
