"""Token ids of documents in binary shards with a minimal perfect hash index.

Files, under one folder of a shared file system:

- `shard-NNNNN-*.bin`: raw little-endian ids of consecutive documents in ascending `doc_id` order, nothing else; two
  bytes an id if the vocabulary has at most 65,536 entries, else four.
- `index/`: one row per bucket of keys, with a minimal perfect hash of the bucket's keys (`seeds`, `salt`), and per slot a
  32-bit `fingerprint`, the `shard`, the `offset` in ids and the `size`.
- `shards/`: one row per shard with its file, number of ids and number of ids before it.

A key's bucket, seed and slot are three hashes; its fingerprint tells keys that were never stored. The hash is built per
bucket by first-fit seeds: keys fall into small cells, large cells first, and each cell takes the first seed that sends
its keys to free slots. A bucket in which two documents have one 64-bit key, or a cell finds no seed, is hashed anew with a
second key under the next salt, which its index row keeps.

Every step is a Spark job on bounded tasks: texts move once, sorted by id range, and are encoded where they are written;
a task names its file by attempt, so a repeated task never writes into another's file and rows refer to one of them.
"""

from __future__ import annotations

import math
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitide.llm.textarrays import mix, slices
from lexitide.llm.tokenfiles import piece_encoder, tokenizer

BUCKET_KEYS = 50_000
CELL_KEYS = 4
SHARD_BYTES = 24 << 20  # of text
_MAX_STEP = 1 << 16
SEEDS_PER_SLOT = 64  # a cell without a seed by then (one in e^64) is taken to have none
MAX_SALTS = 16
_ENTRY = "doc_id LONG, copy INT, shard INT, file STRING, offset LONG, size LONG, width INT"
_INDEX = "bucket LONG, n_slots INT, salt INT, seeds BINARY, fingerprint BINARY, shard BINARY, offset BINARY, size BINARY"


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# ---- writing


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    shard = context.partitionId()
    name = f"shard-{shard:05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin"
    width = 2 if max(tokenizer(path).get_vocab_size(), end + 1) <= 65536 else 4
    encode = piece_encoder(path, width)
    tail = end.to_bytes(width, sys.byteorder)
    fs, root = _open(folder)
    at, out = 0, None
    try:
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}")
                ids = [encode(t) + tail for t in part.column("text").to_pylist()]
                sizes = np.array([len(i) // width for i in ids], np.int64)
                raw = np.frombuffer(b"".join(ids), f"u{width}")
                out.write(raw.astype(f"<u{width}", copy=False).tobytes())
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("copy"), pa.array(np.full(n, shard, np.int32)), pa.array([name] * n), pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(np.full(n, width, np.int32))],
                    ["doc_id", "copy", "shard", "file", "offset", "size", "width"],
                )
                at += int(sizes.sum())
    finally:
        if out is not None:
            out.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end: int = 0, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode `docs(doc_id, text)` into shards under `folder`, each document followed by the id `end`, and index them.

    A null text is empty. Ids are written in ascending `doc_id` order, a null id first; rows that repeat an id stay, in
    the order of their texts, and are numbered by `copy` from 0. An empty table writes an index without rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = max(1, math.ceil((total or 0) / shard_bytes), math.ceil(n / 1_000_000))
    ordered = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    entries = ordered.withColumn("copy", F.lit(0)).mapInArrow(lambda it: _write_shard(it, folder, tokenizer_path, end), _ENTRY)
    entries.write.parquet(f"{folder}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{folder}/entries")
    by_shard = entries.groupBy("shard", "file", "width").agg(F.sum("size").alias("n_ids"))
    # one row per shard
    shards = by_shard.withColumn("before", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    shards.withColumn("before", F.coalesce("before", F.lit(0))).write.parquet(f"{folder}/shards")
    copies = F.row_number().over(Window.partitionBy("doc_id").orderBy("shard", "offset")) - 1
    buckets = max(1, math.ceil(n / BUCKET_KEYS))
    keyed = entries.withColumn("copy", copies).withColumns({"key": _key(), "other": _key("other")}).withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)))
    index = keyed.select("bucket", "key", "other", "shard", "offset", "size").groupBy("bucket").applyInArrow(_build_bucket, _INDEX)
    index.withColumn("n_buckets", F.lit(buckets)).write.parquet(f"{folder}/index")


def _key(*more: str):
    """64-bit key of a document: its id and the number of its copy; `more` words make an independent one."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("int"), *[F.lit(m) for m in more])


def _salted(rows: pa.Table, salt: int) -> np.ndarray:
    """Keys of rows under a salt: the first key alone at 0, else both."""
    key, other = (rows.column(c).to_numpy().view(np.uint64) for c in ("key", "other"))
    return key if salt == 0 else mix(key ^ mix(other + np.uint64(salt)))


# ---- the minimal perfect hash of one bucket


def _slot(keys: np.ndarray, seed, n: int) -> np.ndarray:
    return (mix(keys ^ mix(np.asarray(seed, np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def _cell(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x5851F42D4C957F2D)) % np.uint64(max(1, -(-n // CELL_KEYS)))).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> np.ndarray | None:
    """Seeds per cell that send `keys` (unsigned) to the slots 0..n-1, each to its own; none if two are equal or a cell finds no seed."""
    n = len(keys)
    if len(np.unique(keys)) < n:
        return None
    cell = _cell(keys, n)
    order = np.argsort(cell, kind="stable")
    bounds = np.searchsorted(cell[order], np.arange(-(-n // CELL_KEYS) + 1))
    sizes = np.diff(bounds)
    seeds, free = np.zeros(len(sizes), np.uint32), np.ones(n, bool)
    for c in np.argsort(-sizes, kind="stable"):
        if not sizes[c]:
            break
        mine = keys[order[bounds[c] : bounds[c + 1]]]
        tried = 0
        step = 64
        while True:
            if tried > SEEDS_PER_SLOT * max(n, 1024):
                return None
            slots = _slot(mine[None, :], np.arange(tried, tried + step)[:, None], n)
            fits = free[slots].all(axis=1)
            if len(mine) > 1:
                s = np.sort(slots, axis=1)
                fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            hit = np.flatnonzero(fits)
            if len(hit):
                seeds[c] = tried + hit[0]
                free[slots[hit[0]]] = False
                break
            tried, step = tried + step, min(step * 4, _MAX_STEP)
    return seeds


def find_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return _slot(keys, seeds[_cell(keys, n)], n)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _build_bucket(rows: pa.Table) -> pa.Table:
    for salt in range(MAX_SALTS):
        keys = _salted(rows, salt)
        seeds = perfect_hash(keys)
        if seeds is not None:
            break
    else:
        raise ValueError("two documents agree in both of their keys, of 64 bits each")
    slot = find_slots(keys, seeds, len(keys))
    place = np.empty(len(keys), np.int64)
    place[slot] = np.arange(len(keys))
    raw = {c: rows.column(c).to_numpy()[place].astype(t).tobytes() for c, t in (("shard", "<i4"), ("offset", "<i8"), ("size", "<i8"))}
    columns = [rows.column("bucket")[0].as_py(), len(keys), salt, seeds.astype("<u4").tobytes(), _fingerprints(keys)[place].astype("<u4").tobytes(), raw["shard"], raw["offset"], raw["size"]]
    kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 5
    names = ["bucket", "n_slots", "salt", "seeds", "fingerprint", "shard", "offset", "size"]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(columns, kinds, strict=True)], names)


# ---- reading


def _find(left: pa.Table, right: pa.Table) -> pa.Table:
    """Entries of asked keys (left) in their bucket (right, one row or none)."""
    if len(right) and len(left):
        b = right.to_pylist()[0]
        keys = _salted(left, b["salt"])
        slot = find_slots(keys, np.frombuffer(b["seeds"], "<u4"), b["n_slots"])
        known = np.frombuffer(b["fingerprint"], "<u4")[slot] == _fingerprints(keys)
        taken, slot = pa.array(known), slot[known]
        found = left.select(["doc_id", "copy"]).filter(taken)
        for c, t in (("shard", "<i4"), ("offset", "<i8"), ("size", "<i8")):
            found = found.append_column(c, pa.array(np.frombuffer(b[c], t)[slot]))
        return found
    empty = pa.array([], pa.int64())
    return pa.table([empty, empty.cast(pa.int32()), empty.cast(pa.int32()), empty, empty], ["doc_id", "copy", "shard", "offset", "size"])


def _read(batches: Iterator[pa.RecordBatch], folder: str, payload: bool) -> Iterator[pa.RecordBatch]:
    fs, root = _open(folder)
    name, file = None, None
    for batch in batches:
        ids = []
        for r in batch.select(["file", "offset", "size", "width"]).to_pylist():
            if r["file"] != name:
                if file is not None:
                    file.close()
                name, file = r["file"], fs.open_input_file(f"{root}/{r['file']}")
            raw = file.read_at(r["size"] * r["width"], r["offset"] * r["width"])
            ids.append(np.frombuffer(raw, f"<u{r['width']}").astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), batch.column("start"), batch.column("size"), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(ids if payload else [None] * len(ids), pa.binary())], ["doc_id", "copy", "start", "n_tokens", "ids_crc32", "ids"])
    if file is not None:
        file.close()


def read_tokens(spark: SparkSession, folder: str, keys: DataFrame, payload: bool = True) -> DataFrame:
    """`(doc_id, copy, start, n_tokens, ids_crc32, ids)` of the stored documents among `keys(doc_id[, copy])`.

    `start` counts the ids of all documents before; `ids` are little-endian unsigned 32-bit, null without `payload`. Keys that were never stored
    have no row: their fingerprint differs, but for one in 2^32. Each key costs a few hashes in its bucket and one read.
    """
    index = spark.read.parquet(f"{folder}/index")
    first = index.select("n_buckets").first()
    buckets = first["n_buckets"] if first else 1
    if "copy" not in keys.columns:
        keys = keys.withColumn("copy", F.lit(0))
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("int").alias("copy")).withColumns({"key": _key(), "other": _key("other")})
    asked = asked.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)))
    schema = "doc_id LONG, copy INT, shard INT, offset LONG, size LONG"
    found = asked.groupBy("bucket").cogroup(index.drop("n_buckets").groupBy("bucket")).applyInArrow(_find, schema)
    placed = found.join(spark.read.parquet(f"{folder}/shards").select("shard", "file", "width", "before"), "shard")
    placed = placed.withColumn("start", F.col("before") + F.col("offset"))
    # a task reads a run of the payload in order
    near = placed.repartitionByRange("start").sortWithinPartitions("start")
    out = "doc_id LONG, copy INT, start LONG, n_tokens LONG, ids_crc32 LONG, ids BINARY"
    return near.select("doc_id", "copy", "start", "size", "file", "offset", "width").mapInArrow(lambda it: _read(it, folder, payload), out)


def stored_keys(spark: SparkSession, folder: str) -> DataFrame:
    """`(doc_id, copy)` of every stored document."""
    entries = spark.read.parquet(f"{folder}/entries")
    return entries.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("shard", "offset")) - 1).alias("copy"))
