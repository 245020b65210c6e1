"""Session set-up and the few cluster-wide settings the operators depend on."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# A frame is broadcast only after it was measured to hold no more than these.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Raw bytes that a task gets where it holds all that its rows unfold to.
TASK_BYTES = 8 << 20
# Whether Spark deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the cluster's own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexitide")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, for sessions whose cluster doesn't have it installed.

    Call it once, before the first operator that runs Python on executors.
    """
    import lexitide

    home = pathlib.Path(lexitide.__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="lexitide-ship-")) / "lexitide.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, path.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints: the cluster's own setting, a fresh folder only in local mode."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="lexitide-ckpt-")
    sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an iterative result; survives the loss of executors.

    What the result was shuffled through is deleted as soon as it is written, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a frame made by `cut_lineage` that nothing reads any more."""
    held = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if held.isDefined():
        drop_folder(df.sparkSession, held.get())


def drop_folder(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """A frame as Parquet in the checkpoint folder, and its own folder there: a long table of few words takes a fraction of a checkpoint."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: text and lists by their length, eight for anything else."""
    parts = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (StringType, BinaryType)):
            parts.append(F.octet_length(c))
        elif isinstance(kind, (ArrayType, MapType, StructType)):
            parts.append(F.octet_length(F.to_json(F.struct(c))))
        else:
            parts.append(F.lit(8))
    return sum((F.coalesce(p, F.lit(0)).cast("long") for p in parts), F.lit(8).cast("long"))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Measure a summary table, then hint a broadcast only if it is small in rows and bytes; else leave the join to AQE.

    The frame is persisted first, so measuring does not run its plan twice.
    """
    kept = df.persist()
    head = kept.limit(max_rows + 1)
    rows, size = head.agg(F.count("*"), F.sum(row_bytes(kept))).first()
    return F.broadcast(kept) if rows <= max_rows and (size or 0) <= max_bytes else kept


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread rows by key when the scan has too few partitions to occupy the cluster.

    Unsplittable inputs (gzip, one row group) would otherwise be processed by a few tasks. Wide scans
    are returned as they are, so large inputs pay no extra shuffle here.
    """
    if df.rdd.getNumPartitions() < 2 * df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(key)
    return df


def dealt(df: DataFrame, key: str | Column, size: Column) -> DataFrame:
    """Hash rows by key into partitions of about `TASK_BYTES` each, `size` being the bytes of a row.

    A repartition without a number has as many partitions for a large input as for a small one, and fewer where they are
    coalesced, so what a task holds grows with the input. Here partitions grow in number. The size is summed in a scan first.
    """
    return df.repartition(task_count(df.sparkSession, df.agg(F.sum(size)).first()[0]), key)


def task_count(spark: SparkSession, n_bytes: int | None) -> int:
    """Tasks of about `TASK_BYTES` each for so many bytes, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-int(n_bytes or 0) // TASK_BYTES))
