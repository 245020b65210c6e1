"""Column expressions over ARRAY<FLOAT|DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """Vector scaled to length one; a zero vector stays zero."""
    length = norm(v)
    return F.transform(as_double(v), lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def argmax(v: Column) -> Column:
    """Zero-based position of the first maximum (P10)."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def mean_vector(v: Column) -> Column:
    """Aggregate: element-wise mean of vectors, combined map-side."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.mean(array_to_vector(as_double(v))))


def sum_vector(v: Column) -> Column:
    """Aggregate: element-wise sum of vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.sum(array_to_vector(as_double(v))))
