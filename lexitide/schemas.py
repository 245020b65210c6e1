"""Fixed schemas of everything read from outside, and the early column guard."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The year is scanned as text: an INT field would send "1941" and 1950.5 to the corrupt column.
DOC = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("rights_year", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("full_text", T.ArrayType(T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
LABELS = "doc_id STRING, label STRING"
TOPIC_WORDS = "topic INT, rank INT, word STRING"
KMEANS_METRICS = "k INT, inertia DOUBLE, silhouette STRING, n_docs BIGINT, sources ARRAY<STRING>"


class MissingColumns(ValueError):
    """An input lacks columns the operator needs."""


class NoLabelledRows(ValueError):
    """Nothing is left to split or train on."""


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns {missing}; found {df.columns}")
    return df
