"""Incremental ingest of newly arriving batch files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexitide.functions import text as X
from lexitide.operators.vectors import embed_rows
from lexitide.operators.vocab import top_terms
from lexitide.schemas import DOC
from lexitide.sources.jsonl import batch_name, documents, with_line_numbers
from lexitide.sources.stores import replace_batches


def stream_batches(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """Lines of batch files as they arrive, with their batch."""
    raw = (
        spark.readStream.schema(DOC)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("pathGlobFilter", "*.jsonl.gz")
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )
    return raw.select("*", batch_name(path).alias("batch"), F.col("_metadata.file_path").alias("_file"))


def ingest(
    spark: SparkSession, path: str, store: str, checkpoint: str, vectors: str | None = None, encoder=None,
    window: int = 256, stride: int = 200, max_files: int = 16, counts: str | None = None,
) -> StreamingQuery:
    """Write new files to a document store, and their vectors and counts if wanted, all partitioned by batch.

    A batch partition is replaced as a whole, so a repeated micro-batch leaves the same store. The query
    takes what is there and stops. `counts` is a folder of term and yearly counts, see `running_vocab` and `running_years`.
    """

    def write(frame: DataFrame, _epoch: int) -> None:
        lines = frame.persist()
        docs = documents(with_line_numbers(lines)).persist()
        replace_batches(docs, store)
        if vectors:
            rows = docs.select("doc_id", "rights_year", "batch", "line_no", "full_text")
            replace_batches(embed_rows(rows, encoder, window, stride).drop("line_no"), vectors)
        if counts:
            replace_batches(X.unfold(docs, "batch").groupBy("batch", "term").agg(F.count("*").alias("tf")), f"{counts}/terms")
            replace_batches(docs.groupBy("batch", "rights_year").agg(F.count("*").alias("n")), f"{counts}/years")
        docs.unpersist()
        lines.unpersist()

    query = stream_batches(spark, path, max_files).writeStream.foreachBatch(write)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_vocab(spark: SparkSession, counts: str, vocab_size: int = 30_000, min_freq: int = 3) -> DataFrame:
    """The vocabulary over all batches taken in so far, as `build_vocab` gives it for their documents.

    Stored counts are summed, texts are not read again. A batch that came twice, in one query or from a new checkpoint, counts once.
    """
    each = spark.read.parquet(f"{counts}/terms")
    return top_terms(each.groupBy("term").agg(F.sum("tf").alias("tf")), vocab_size, min_freq)


def running_years(spark: SparkSession, counts: str) -> DataFrame:
    """Documents per year over all batches taken in so far: `(rights_year, n)`."""
    return spark.read.parquet(f"{counts}/years").groupBy("rights_year").agg(F.sum("n").alias("n"))


def yearly_counts(spark: SparkSession, path: str, name: str, checkpoint: str, max_files: int = 16) -> StreamingQuery:
    """Documents per year over all files seen so far, kept as the in-memory table `name`."""
    docs = stream_batches(spark, path, max_files).where(F.size("full_text") > 0)
    counts = docs.groupBy(X.year_of(F.col("rights_year")).alias("rights_year")).agg(F.count("*").alias("n"))
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
