"""Classifier metrics from (y_true, y_pred) rows, for one or many tagged models at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tagged(preds: DataFrame, tag: str | None) -> DataFrame:
    df = preds if "tag" in preds.columns else preds.withColumn("tag", F.lit(tag or "model"))
    return df.select("tag", F.col("y_true").cast("string").alias("y_true"), F.col("y_pred").cast("string").alias("y_pred"))


def pair_counts(preds: DataFrame, tag: str | None = None) -> DataFrame:
    """`(tag, y_true, y_pred, n)`: everything below works on this small table."""
    return _tagged(preds, tag).groupBy("tag", "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion(preds: DataFrame, tag: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """Confusion matrix in long form, zeros kept: `(tag, y_true, y_pred, n)`.

    `labels` fixes the rows and columns (the training labels); by default all labels seen. The grid is
    unfolded from the label list held by each model's single row.
    """
    counts = pair_counts(preds, tag)
    cell = F.struct("y_true", "y_pred")
    seen = F.array_distinct(F.flatten(F.collect_list(F.array("y_true", "y_pred"))))
    model = counts.groupBy("tag").agg(
        F.map_from_entries(F.collect_list(F.struct(cell, "n"))).alias("cells"), F.array_sort(seen).alias("labels")
    )
    if labels is not None:
        model = model.withColumn("labels", F.array(*[F.lit(str(x)) for x in labels]))
    grid = model.select("tag", "cells", "labels", F.explode("labels").alias("y_true"))
    grid = grid.select("tag", "cells", "y_true", F.explode("labels").alias("y_pred"))
    n = F.coalesce(F.try_element_at("cells", F.struct("y_true", "y_pred")), F.lit(0).cast("bigint"))
    return grid.select("tag", "y_true", "y_pred", n.alias("n"))


def confusion_wide(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """Confusion matrix with one column per predicted label."""
    return matrix.groupBy("tag", "y_true").pivot("y_pred", labels).agg(F.first("n")).orderBy("tag", "y_true")


def class_scores(preds: DataFrame, tag: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every true or predicted label; 0/0 counts as 0."""
    counts = pair_counts(preds, tag)
    # each cell adds to its true label and to its predicted label
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    hit = F.when((F.col("y_true") == F.col("y_pred")) & (F.col("s.support") > 0), F.col("n")).otherwise(0)
    sums = (
        counts.select("tag", "y_true", "y_pred", "n", F.explode(sides).alias("s"))
        .groupBy("tag", F.col("s.label").alias("label"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum(hit).alias("hits"))
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return sums.select(
        "tag",
        "label",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )


def summary(preds: DataFrame, tag: str | None = None) -> DataFrame:
    """`(tag, accuracy, macro_f1, n)`; macro-F1 is over all labels true or predicted."""
    return class_scores(preds, tag).groupBy("tag").agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.sum("support").alias("n"),
    )


def class_report(preds: DataFrame, tag: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """Per-class rows plus `accuracy`, `macro avg` and `weighted avg`.

    `labels` fixes the rows, with zeros for a label that was neither true nor predicted; the averages
    are over those rows. By default all labels seen are reported.
    """
    scores = class_scores(preds, tag)
    if labels is not None:
        names = F.explode(F.array(*[F.lit(str(x)) for x in labels])).alias("label")
        grid = scores.select("tag").distinct().select("tag", names)
        scores = grid.join(scores, ["tag", "label"], "left").na.fill(0)
    total = F.sum("support")

    def weighted(c):
        return F.sum(F.col(c) * F.col("support")) / total

    averages = scores.groupBy("tag").agg(
        (F.sum("hits") / total).alias("acc"),
        total.alias("support"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )
    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), F.col("acc").alias("precision"), F.col("acc").alias("recall"), F.col("acc").alias("f1")),
        F.struct(F.lit("macro avg").alias("label"), F.col("m_precision").alias("precision"), F.col("m_recall").alias("recall"), F.col("m_f1").alias("f1")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("w_precision").alias("precision"), F.col("w_recall").alias("recall"), F.col("w_f1").alias("f1")),
    )
    tail = averages.select("tag", F.explode(rows).alias("r"), "support").select(
        "tag", "r.label", "r.precision", "r.recall", "r.f1", "support"
    )
    return scores.drop("hits").unionByName(tail)


def metrics_document(preds: DataFrame, tag: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """One row per model with accuracy, macro-F1, labels and the report as a map."""
    report = class_report(preds, tag, labels).groupBy("tag").agg(
        F.map_from_entries(
            F.collect_list(F.struct("label", F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support")))
        ).alias("report")
    )
    names = class_scores(preds, tag).groupBy("tag").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    if labels is not None:
        names = names.withColumn("labels", F.array(*[F.lit(str(x)) for x in labels]))
    return summary(preds, tag).join(names, "tag").join(report, "tag")


def align(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """External predictions `(doc_id, y_pred)` beside the truth `(doc_id, y_true)`."""
    return truth.select("doc_id", "y_true").join(predicted.select("doc_id", "y_pred"), "doc_id")
