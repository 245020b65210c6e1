"""Drift of words between decades by embeddings of the whole vocabulary (R2).

Each decade's positive pointwise mutual information is a sparse symmetric table over the vocabulary. Its leading eigenvectors are found
by a randomised range finder. A decade's words are cut into parts of about `PART` words and its table into squares of two parts, packed
once; a product joins squares with the vectors of a part, so a task multiplies whole squares and no entry of the table is a row again.
Vectors are kept orthonormal by one small Gram matrix per decade. Two decades' coordinates are turned onto each other by the rotation that
fits their common words best, worked out from another small matrix. Only matrices of block size reach the driver. What a step leaves on disk is
deleted when the next one has read it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions.vectors import norm, sum_vector
from lexitide.operators import blocks as B
from lexitide.operators.kmeans import matrix
from lexitide.operators.lexical import information_table
from lexitide.session import broadcast_if_small, cut_lineage, drop_checkpoint, drop_folder, written

SPARE = 8
ROUNDS = 3
PART = 4096  # words of a part
AT_ONCE = 1 << 16  # entries of a square that are multiplied together

_SQUARE = "decade INT, part INT, other INT, at BINARY, words BINARY, entries BINARY"
_ROWS = "decade INT, part INT, n INT, q ARRAY<DOUBLE>"


def _grams(rows: DataFrame, key: str, left: str, right: str) -> dict[int, np.ndarray]:
    """Per `key` the sum of outer products of two list columns: one small matrix per decade."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            k, x, y = batch.column("k").to_numpy(), matrix(batch.column("l")), matrix(batch.column("r"))
            for one in np.unique(k):
                totals[int(one)] = totals.get(int(one), 0) + x[k == one].T @ y[k == one]
        for one, total in totals.items():
            columns = [pa.array([one], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([total.shape[1]], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "part", "width"])

    parts = rows.select(F.col(key).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(add, "k INT, part ARRAY<DOUBLE>, width INT")
    found = parts.groupBy("k").agg(sum_vector(F.col("part")).alias("total"), F.max("width").alias("width")).collect()  # a row per decade
    return {r["k"]: np.array(r["total"]).reshape(-1, r["width"]) for r in found}


def _mixed(rows: DataFrame, column: str, mixes: dict[int, np.ndarray]) -> DataFrame:
    """`rows(decade, term, ...)` as `(decade, term, column)`, each decade's lists times its matrix."""
    shared = rows.sparkSession.sparkContext.broadcast(mixes)

    def mix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for decade, part in pdf.groupby("decade"):
                made = np.stack(part[column].to_numpy()) @ shared.value[decade]
                yield pd.DataFrame({"decade": part["decade"].to_numpy(), "term": part["term"].to_numpy(), column: list(made)})

    return rows.select("decade", "term", column).mapInPandas(mix, f"decade INT, term STRING, {column} ARRAY<DOUBLE>")


def _square(entries: pa.Table) -> pa.Table:
    """One square of a decade's table, entries in order of their line: lines and columns by the hashes that occur, and values as bytes."""
    lines, i = np.unique(entries.column("i").to_numpy(), return_inverse=True)
    columns, j = np.unique(entries.column("j").to_numpy(), return_inverse=True)
    order = np.lexsort((j, i))
    packed = [lines, columns, i[order].astype(np.int32), j[order].astype(np.int32), entries.column("w").to_numpy()[order]]
    head = [entries.column(c).slice(0, 1).combine_chunks() for c in ("decade", "part", "other")]
    return pa.table([*head, *[pa.array([x.tobytes()], pa.binary()) for x in packed]], ["decade", "part", "other", "lines", "columns", "at", "words", "entries"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squares with lines and columns by their places in the two parts, entries in order of their line there."""
    names = ["decade", "part", "other", "at", "words", "entries"]
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for i in range(len(batch)):
            found = []
            for used, hashes, at in (("lines", "line_hashes", "at"), ("columns", "column_hashes", "words")):
                wanted, place = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in ((used, np.int64), (at, np.int32)))
                known = _flat(batch, hashes, i)
                order = np.argsort(known)
                found.append(order[np.searchsorted(known, wanted, sorter=order)].astype(np.int32)[place])
            order = np.lexsort((found[1], found[0]))
            for told, x in zip(out, (*found, np.frombuffer(batch.column("entries")[i].as_buffer(), np.float64)), strict=True):
                told.append(x[order].tobytes())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], *[pa.array(x, pa.binary()) for x in out]], names)


def _squares(table: DataFrame, parts: DataFrame, n_parts: int | None = None) -> DataFrame:
    """The table in squares of two parts of a decade's words; `parts(decade, part, terms)`.

    Where the parts are the `n_parts` of `_part_of`, an entry is shuffled once, as two hashes and a value; others are joined to it.
    """
    if n_parts is None:
        words = parts.select("decade", "part", F.explode("terms").alias("term"))
        contexts = words.select("decade", F.col("part").alias("other"), F.col("term").alias("context"))
        table = table.join(words, ["decade", "term"]).join(contexts, ["decade", "context"])
    else:
        table = table.withColumns({"part": _part_of("term", n_parts), "other": _part_of("context", n_parts)})
    hashes = F.transform("terms", lambda t: F.xxhash64(t))
    entries = table.select("decade", "part", "other", F.xxhash64("term").alias("i"), F.xxhash64("context").alias("j"), F.col("w").cast("double").alias("w"))
    made = entries.groupBy("decade", "part", "other").applyInArrow(_square, _SQUARE.replace("at BINARY", "lines BINARY, columns BINARY, at BINARY"))
    lines = broadcast_if_small(parts.select("decade", "part", hashes.alias("line_hashes")))
    columns = broadcast_if_small(parts.select("decade", F.col("part").alias("other"), hashes.alias("column_hashes")))
    return made.join(lines, ["decade", "part"]).join(columns, ["decade", "other"]).mapInArrow(_placed, _SQUARE)


def _part_of(column: str, n_parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n_parts)).cast("int")


def _flat(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy()


def _told(head: dict, vectors: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array([head[c]], pa.int32()) for c in ("decade", "part", "n")]
    flat = pa.ListArray.from_arrays(pa.array([0, vectors.size], pa.int32()), pa.array(vectors.ravel()))
    return pa.RecordBatch.from_arrays([*numbers, flat], ["decade", "part", "n", "q"])


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, row in enumerate(batch.select(["decade", "part", "n", "width"]).to_pylist()):
            at, words, entries = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in (("at", np.int32), ("words", np.int32), ("entries", np.float64)))
            x = B.matrix(_flat(batch, "q", i), row["width"])
            image = np.zeros((row["n"], x.shape[1]))
            for lo in range(0, len(at), AT_ONCE):
                cut = slice(lo, lo + AT_ONCE)
                lines, starts = np.unique(at[cut], return_index=True)
                image[lines] += np.add.reduceat(entries[cut, None] * x[words[cut]], starts, axis=0)
            yield _told(row, image)


def _added(images: pa.Table) -> pa.Table:
    """One part's images by the squares of its line, added up."""
    batch = images.combine_chunks().to_batches()[0]
    total = sum(_flat(batch, "q", i) for i in range(len(batch)))
    return pa.Table.from_batches([_told(batch.slice(0, 1).select(["decade", "part", "n"]).to_pylist()[0], total)])


def _times(squares: DataFrame, rows: DataFrame) -> DataFrame:
    """`(decade, part, n, q)`: the table of each decade times its vectors `rows(decade, part, n, q)`; a row per part."""
    right = rows.select("decade", F.col("part").alias("other"), F.col("n").alias("width"), "q")
    lines = rows.select("decade", "part", "n")
    met = squares.join(right, ["decade", "other"]).join(lines, ["decade", "part"])
    return met.mapInArrow(_multiplied, _ROWS).groupBy("decade", "part").applyInArrow(_added, _ROWS)


def _part_grams(rows: DataFrame, right: str = "q") -> dict[int, np.ndarray]:
    """Per decade the sum of outer products of `q` and another list column."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["decade", "n"]).to_pylist()):
                gram = B.matrix(_flat(batch, "q", i), row["n"]).T @ B.matrix(_flat(batch, right, i), row["n"])
                yield pa.RecordBatch.from_arrays([pa.array([row["decade"]], pa.int32()), pa.array([gram.ravel()], pa.list_(pa.float64()))], ["k", "total"])

    found = rows.mapInArrow(add, "k INT, total ARRAY<DOUBLE>").groupBy("k").agg(sum_vector(F.col("total")).alias("total")).collect()  # a row per decade
    return {r["k"]: np.array(r["total"]).reshape(int(round(len(r["total"]) ** 0.5)), -1) for r in found}


def _part_mixed(rows: DataFrame, mixes: dict[int, np.ndarray]) -> DataFrame:
    """`rows(decade, part, n, q)` with each decade's vectors times its matrix."""
    shared = rows.sparkSession.sparkContext.broadcast(mixes)

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["decade", "part", "n"]).to_pylist()):
                yield _told(row, B.matrix(_flat(batch, "q", i), row["n"]) @ shared.value[row["decade"]])

    return rows.select("decade", "part", "n", "q").mapInArrow(mix, _ROWS)


def _whitening(gram: np.ndarray) -> np.ndarray:
    """The square mix that makes vectors with this Gram matrix orthonormal; directions of next to nothing become zero."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    some = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    return vectors * np.where(some, 1 / np.sqrt(np.where(some, values, 1.0)), 0.0)


def word_embeddings(table: DataFrame, dims: int = 64, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """`(decade, term, embedding)` from a symmetric `table(decade, term, context, w)`: its leading eigenvectors (by size of the
    eigenvalue), each times the root of that size."""
    table, folder = written(table)
    words = table.select("decade", "term").distinct().persist()
    n_parts = max(1, -(-(words.groupBy("decade").count().agg(F.max("count")).first()[0] or 0) // PART))
    listed = words.groupBy("decade", _part_of("term", n_parts).alias("part"))
    parts = cut_lineage(listed.agg(F.array_sort(F.collect_list("term")).alias("terms")))  # about PART words
    squares = cut_lineage(_squares(table, parts, n_parts))
    words.unpersist()
    drop_folder(table.sparkSession, folder)
    draws = F.transform("terms", lambda t: F.array(*[F.xxhash64(F.lit(seed), F.lit(i), t) / float(2**63) for i in range(dims + SPARE)]))
    rows = cut_lineage(parts.select("decade", "part", F.size("terms").alias("n"), F.flatten(draws).alias("q")))
    for _ in range(rounds + 1):
        image = cut_lineage(_times(squares, rows))
        once = cut_lineage(_part_mixed(image, {k: _whitening(g) for k, g in _part_grams(image).items()}))
        before, rows = rows, cut_lineage(_part_mixed(once, {k: _whitening(g) for k, g in _part_grams(once).items()}))
        for old in (before, image, once):
            drop_checkpoint(old)
    image = _times(squares, rows).withColumnRenamed("q", "image")
    inner = _part_grams(rows.join(image, ["decade", "part", "n"]), "image")
    turns = {}
    for k, m in inner.items():
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[:dims]
        turns[k] = vectors[:, order] * np.sqrt(np.abs(values[order]))
    made = _part_mixed(rows, turns).join(parts, ["decade", "part"])
    width = F.floor(F.size("q") / F.col("n")).cast("int")
    told = made.select("decade", F.posexplode("terms").alias("i", "term"), width.alias("width"), "q")
    return told.select("decade", "term", F.slice("q", F.col("i") * F.col("width") + 1, F.col("width")).alias("embedding"))


def aligned_drift(made: DataFrame) -> DataFrame:
    """`(term, from_decade, to_decade, cosine)` of words in consecutive decades, the earlier one turned onto the later."""
    made = cut_lineage(made)
    later = made.select((F.col("decade") - 10).alias("decade"), "term", F.col("embedding").alias("later"))
    both = cut_lineage(made.join(later, ["decade", "term"]))
    turns = {}
    for k, cross in _grams(both, "decade", "embedding", "later").items():
        u, _, v = np.linalg.svd(cross)
        turns[k] = u @ v
    turned = _mixed(both, "embedding", turns).join(both.select("decade", "term", "later"), ["decade", "term"])
    dot = F.aggregate(F.zip_with("embedding", "later", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    lengths = norm(F.col("embedding")) * norm(F.col("later"))
    named = [F.concat(c.cast("string"), F.lit("s")) for c in (F.col("decade"), F.col("decade") + 10)]
    return turned.select("term", named[0].alias("from_decade"), named[1].alias("to_decade"), F.when(lengths > 0, dot / lengths).otherwise(0.0).alias("cosine"))


def embedding_drift(docs: DataFrame, vocab_size: int = 30_000, min_freq: int = 3, span: int = 5, dims: int = 64) -> DataFrame:
    """Drift of every vocabulary word between consecutive decades: `(term, from_decade, to_decade, cosine)`."""
    return aligned_drift(word_embeddings(information_table(docs, vocab_size, min_freq, span), dims))
