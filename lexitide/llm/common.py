"""What the operators of this package share: shared-folder tables, row keys and sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexitide.session import ensure_checkpoint_dir

# The contract's words: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts its lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """One key for rows that agree in the given columns; rows that agree in all of them may share results."""
    return F.xxhash64(*[F.col(c) for c in columns])


def row_schema(rows: DataFrame, ddl: str) -> StructType:
    """The struct column `row` of `rows`, whatever its fields are called, and the columns of `ddl`."""
    return StructType([rows.schema["row"], *StructType.fromDDL(ddl).fields])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and bind it in `body`, without Python and without a second pass."""
    return F.element_at(F.transform(F.array(value), body), 1)
