"""Documents in chunks of bounded size: what is needed once per word goes over the network once per word and chunk.

A chunk is a run of a task's rows with about `CHUNK_BYTES` of text; its key is a hash of its rows, so that a chunk read
again is known again. If a later read cuts the rows otherwise, its chunks have unknown keys, and the caller works out
what it needs in place: slower, with the same result.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20


def rows_of(docs: DataFrame) -> DataFrame:
    """Whole rows as one struct column `row`."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """About how many chunks the texts make; at least 1."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(total / chunk_bytes))


def texts(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(pc.struct_field(batch.column("row"), "text"), "")


def chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """`(key, batches)` of each chunk of a task's rows."""
    held, size, key = [], 0, xxhash.xxh64(seed=9)
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(texts(batch)).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + chunk_bytes - size, side="right")))
            part = batch.slice(at, end - at)
            held.append(part)
            size += int(sizes[end - 1] - before)
            for t in texts(part).to_pylist():
                key.update(t.encode())
                key.update(b"\0")
            if size >= chunk_bytes or end < len(batch):
                yield int(np.uint64(key.intdigest()).view(np.int64)), held
                held, size, key = [], 0, xxhash.xxh64(seed=9)
            at = end
    if held:
        yield int(np.uint64(key.intdigest()).view(np.int64)), held


def packed(batches: list[pa.RecordBatch]) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return zstandard.compress(out.getvalue(), 3)


def unpacked(blob: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(zstandard.decompress(blob)))


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    for key, held in chunks(batches, chunk_bytes):
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([packed(held)], pa.binary())], ["chunk", "docs"])


def with_words(docs: DataFrame, per_word: DataFrame) -> DataFrame:
    """`(docs, words)`: packed chunks beside what `per_word(chunk, bucket, found)` has for them, by bucket; null if nothing."""
    found = per_word.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "found")).alias("words"))
    return rows_of(docs).mapInArrow(_pack, "chunk LONG, docs BINARY").join(found, "chunk", "left").select("docs", "words")
