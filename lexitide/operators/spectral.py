"""Coordinates that follow a neighbour graph: leading eigenvectors of its normalised weights.

A table row holds a document's entries in the basis vectors; a product with the weight matrix is a join of links with rows and a
sum per row, which Spark combines before its shuffle. The basis grows by one block of products a step (block Lanczos), kept
orthonormal by Gram matrices, and the eigenvectors are the best ones within it. The driver sees matrices of basis size only: the
weights between basis vectors come from each step's first Gram matrix, so products are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexitide.functions.vectors import sum_vector
from lexitide.operators.kmeans import matrix
from lexitide.session import cut_lineage

SPARE = 4  # vectors in a block beyond the wanted ones
STEPS = 10
SMALLEST = 1e-9  # share of a direction's length below which it lies in the basis already


def graph_weights(near: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`(a, b, w)` in both directions from neighbour lists: exp(-d^2 / (s_a s_b)), s the distance to a row's last neighbour.

    A link of either list counts, one of both once; equal rows have weight 1.
    """
    # the lists are read four times below
    links = cut_lineage(near.select(F.col(id_col).alias("a"), F.col("nbr").alias("b"), "dist"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist")).groupBy("a", "b").agg(F.min("dist").alias("dist"))
    spread = links.groupBy("a").agg(F.max("dist").alias("s"))
    told = both.join(spread.withColumnRenamed("s", "sa"), "a").join(spread.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b")
    scale = F.col("sa") * F.col("sb")
    return told.select("a", "b", F.when(scale > 0, F.exp(-F.col("dist") * F.col("dist") / scale)).otherwise(F.lit(1.0)).alias("w"))


def _gram(rows: DataFrame, left: list[str], right: str) -> np.ndarray:
    """Sum over rows of the outer product of list columns, the left ones end to end; a matrix of basis size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = np.hstack([matrix(batch.column(f"l_{c}")) for c in left]).T @ matrix(batch.column("r"))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([total.shape[1]], pa.int32())], ["part", "width"])

    parts = rows.select(*[F.col(c).alias(f"l_{c}") for c in left], F.col(right).alias("r")).mapInArrow(add, "part ARRAY<DOUBLE>, width INT")
    out = parts.agg(sum_vector(F.col("part")).alias("total"), F.max("width").alias("width")).first()
    return np.array(out["total"]).reshape(-1, out["width"])


def _combined(rows: DataFrame, name: str, **mixes: np.ndarray) -> DataFrame:
    """`rows` with `name`: the sum of list columns, each times a matrix."""
    keep = [c for c in rows.columns if c != name]
    shared = rows.sparkSession.sparkContext.broadcast(mixes)
    packed = rows.select(F.struct(*keep).alias("row"), *[F.col(c).alias(f"m_{c}") for c in mixes])

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                made = sum(matrix(batch.column(f"m_{c}")) @ m for c, m in shared.value.items())
                ends = pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], ["row", "made"])

    kind = StructType([packed.schema["row"], *StructType.fromDDL("made ARRAY<DOUBLE>").fields])
    return packed.mapInArrow(mix, kind).select("row.*", F.col("made").alias(name))


def _product(links: DataFrame, rows: DataFrame, column: str, width: int) -> DataFrame:
    """`(id, product)`: the normalised weights times a list column of `width` entries.

    The entries are summed as columns of their own: sums of lists would be sorted by row and made anew for every link.
    """
    there = rows.select(F.col("id").alias("b"), *[F.get(column, F.lit(i)).alias(f"x{i}") for i in range(width)])
    sums = links.join(there, "b").groupBy(F.col("a").alias("id")).agg(*[F.sum(F.col(f"x{i}") * F.col("w")).alias(f"y{i}") for i in range(width)])
    return sums.select("id", F.array(*[f"y{i}" for i in range(width)]).alias("product"))


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """The mix that makes vectors with this Gram matrix orthonormal; directions that are nearly nothing are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    some = values > SMALLEST**2 * max(values.max(initial=0.0), 1e-300)
    return vectors[:, some] / np.sqrt(values[some])


def spectral(weights: DataFrame, dims: int = 5, steps: int = STEPS, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """`(id, embedding)` and the eigenvalues: `dims` coordinates after the constant one, of symmetric links `weights(a, b, w)`.

    Eigenvectors are those of D^-1/2 W D^-1/2 divided by the root of the degree, so that a coordinate is constant on a
    connected part if its eigenvalue is 1. Rows without links are not in the graph. Signs are such that the largest entry
    sum of cubes is positive; equal eigenvalues leave the choice within their space open.
    """
    degrees = weights.groupBy("a").agg(F.sum("w").alias("degree"))
    degrees = cut_lineage(degrees.select(F.col("a").alias("id"), F.sqrt("degree").alias("root")))
    norm = degrees.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    links = weights.join(norm, "a").join(degrees.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    links = cut_lineage(links.select("a", "b", (F.col("w") / (F.col("ra") * F.col("rb"))).alias("w")))
    width = dims + 1 + SPARE
    draws = [F.xxhash64(F.lit(seed), F.lit(i), "id") / float(2**63) for i in range(width - 1)]
    rows = degrees.select("id", "root", F.array("root", *[d * F.col("root") for d in draws]).alias("last"))
    mix = _orthonormal(_gram(cut_lineage(rows), ["last"], "last"))
    rows = cut_lineage(_combined(rows, "last", last=mix).withColumn("basis", F.col("last")))
    inner = np.zeros((0, 0))
    for step in range(1, steps + 1):
        new = cut_lineage(rows.join(_product(links, rows, "last", mix.shape[1]), "id"))
        inside = _gram(new, ["basis"], "product")  # the weights between the basis so far and its last block
        known = len(inside) - inside.shape[1]
        inner = np.block([[inner, inside[:known]], [inside[:known].T, (inside[known:] + inside[known:].T) / 2]])
        if step == steps:
            break
        new = cut_lineage(_combined(new, "product", product=np.eye(inside.shape[1]), basis=-inside))
        # once more for the digits that the first projection loses
        again = _gram(new, ["basis", "product"], "product")
        inside, size = again[: len(inside)], again[len(inside) :]
        size = size - inside.T @ inside
        mix = _orthonormal(size) if np.trace(size) > SMALLEST**2 else np.zeros((len(size), 0))
        if not mix.shape[1]:
            break
        made = _combined(new, "last", product=mix, basis=-inside @ mix)
        rows = cut_lineage(made.select("id", "root", "last", F.concat("basis", "last").alias("basis")))
    values, vectors = np.linalg.eigh(inner)
    order = np.argsort(-values, kind="stable")[: dims + 1]
    made = cut_lineage(_combined(rows, "vectors", basis=vectors[:, order]).select("id", "root", "vectors"))
    cubes = made.agg(*[F.sum(F.pow(F.get("vectors", i), 3)).alias(f"c{i}") for i in range(1, len(order))]).first()
    signs = [1.0 if (cubes[f"c{i}"] or 0.0) >= 0 else -1.0 for i in range(1, len(order))]
    coordinates = F.array(*[F.get("vectors", i) * s / F.col("root") for i, s in enumerate(signs, 1)])
    return made.select("id", coordinates.alias("embedding"), "vectors"), values[order]


def residuals(weights: DataFrame, found: DataFrame, values: np.ndarray) -> DataFrame:
    """`(i, value, length, residual)`: per eigenvector its length and that of A x - value x, worked out from the links anew."""
    roots = weights.groupBy("a").agg(F.sqrt(F.sum("w")).alias("root"))
    links = weights.join(roots.withColumnRenamed("root", "ra"), "a").join(roots.select(F.col("a").alias("b"), F.col("root").alias("rb")), "b")
    image = _product(links.select("a", "b", (F.col("w") / (F.col("ra") * F.col("rb"))).alias("w")), found.select("id", "vectors"), "vectors", len(values))
    pairs = found.join(image, "id").select(F.posexplode(F.arrays_zip(F.col("vectors").alias("x"), F.col("product").alias("y"))).alias("i", "s"))
    listed = F.array(*[F.lit(float(v)) for v in values])
    told = pairs.select("i", "s.*", F.get(listed, F.col("i")).alias("value"))
    gap = F.col("y") - F.col("value") * F.col("x")
    return told.groupBy("i", "value").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.sqrt(F.sum(gap * gap)).alias("residual"))
