"""Tolerant scan of gzip-JSONL document batches."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import text as X
from lexitide.schemas import DOC


def batch_name(path: str) -> Column:
    """A file's batch: its path below the folder that is read, without the ending.

    Files of one name in two folders are two batches. The folder is `path` up to its first pattern; a file that is not seen to
    lie below it (a relative path, say) goes by its bare name.
    """
    plain = re.split(r"/[^/]*[*?\[{]", path, maxsplit=1)[0]
    root = urllib.parse.quote(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", plain).rstrip("/"), safe="/%!$&'()*+,;=:@~")
    whole = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    below = F.when(whole.startswith(root + "/") & F.lit(root.startswith("/")), F.substring(whole, F.lit(len(root) + 2), F.length(whole)))
    return F.regexp_replace(F.coalesce(below, F.col("_metadata.file_name")), r"\.jsonl(\.gz)?$", "")


def raw_batches(
    spark: SparkSession,
    path: str,
    start_batch: int | None = None,
    end_batch: int | None = None,
    glob: str = "*.jsonl.gz",
) -> DataFrame:
    """Every non-blank line of the chosen batch files, parsed or flagged as corrupt.

    The index range is a predicate on the file name, so Spark drops files before reading them. Rows keep
    `(batch, line_no)` as explicit order: a gzip file is read by one task from top to bottom.
    """
    df = (
        spark.read.schema(DOC)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("pathGlobFilter", glob)
        .json(path)
    )
    index = X.file_index(F.col("_metadata.file_name"))
    if start_batch is not None:
        df = df.where(index >= start_batch)
    if end_batch is not None:
        df = df.where(index <= end_batch)
    placed = df.select(
        "*",
        batch_name(path).alias("batch"),
        F.col("_metadata.file_path").alias("_file"),
    )
    return with_line_numbers(placed)


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Replace `_file` by `line_no`, the place within the file, whatever files a task reads before it."""
    placed = lines.withColumn("_place", F.monotonically_increasing_id())
    # one row per file; an id of the line is read too, so that both reads parse the same lines
    first = placed.groupBy("_file").agg(F.min(F.struct("_place", "doc_id")).alias("_first"))
    return placed.join(first, "_file").withColumn("line_no", F.col("_place") - F.col("_first._place")).drop("_file", "_place", "_first")


def documents(raw: DataFrame) -> DataFrame:
    """Rows with a non-empty token list, a parsed year and an id that is never null."""
    tokens = F.col("full_text")
    # from the file's name and the place in it, so the id is the same whatever else is read
    made_up = F.concat(F.lit("doc_"), F.sha2(F.concat_ws("\x1f", "batch", "line_no", X.joined(tokens)), 256))
    return raw.where(F.size(tokens) > 0).select(
        F.coalesce("doc_id", made_up).alias("doc_id"),
        X.year_of(F.col("rights_year")).alias("rights_year"),
        "domain",
        "full_text",
        "batch",
        "line_no",
    )


def read_docs(spark: SparkSession, path: str, start_batch: int | None = None, end_batch: int | None = None) -> DataFrame:
    """Documents of a batch directory. Gzip gives one task per file, so narrow scans are spread out."""
    from lexitide.session import spread

    return spread(documents(raw_batches(spark, path, start_batch, end_batch)), "doc_id")


def quarantine(raw: DataFrame) -> DataFrame:
    """Lines that did not become documents, with the reason."""
    nothing_parsed = F.coalesce("doc_id", "rights_year", "domain").isNull() & F.col("full_text").isNull()
    corrupt = F.col("_corrupt_record").isNotNull()
    syntax_error = F.try_parse_json("_corrupt_record").isNull()
    reason = (
        F.when(corrupt & nothing_parsed & syntax_error, "bad_json")
        .when(corrupt & F.col("full_text").isNull(), "bad_tokens")
        .when(F.coalesce(F.size("full_text"), F.lit(0)) <= 0, "no_tokens")
    )
    return raw.select("batch", "line_no", F.col("_corrupt_record").alias("raw"), reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def ingest_counts(raw: DataFrame, limited: DataFrame | None = None, max_docs: int = -1) -> DataFrame:
    """Kept and skipped lines per batch, and in total under batch null.

    Where `limited` (the documents left of `raw`) holds `max_docs` of a batch, reading stopped at the last of them, and
    lines after it count as neither.
    """
    kept = F.coalesce(F.size("full_text"), F.lit(0)) > 0
    lines = raw.withColumn("kept", kept)
    if limited is not None and max_docs > 0:
        ends = limited.groupBy("batch").agg(F.count("*").alias("n"), F.max("line_no").alias("last"))
        lines = lines.join(ends, "batch", "left").where((F.coalesce("n", F.lit(0)) < max_docs) | (F.col("line_no") <= F.col("last")))
    return (
        lines
        .rollup("batch")
        .agg(F.count_if("kept").alias("processed"), F.count_if(~F.col("kept")).alias("skipped"))
    )
