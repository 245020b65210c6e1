"""Vectors packed into bounded blocks, and the numpy kernels that compare two blocks.

All-pairs work (neighbours, density links, silhouette) is expressed as joins of block tables: a row is a
block of at most a few thousand vectors, a task compares two blocks with one matrix product and emits a
result per vector. Pairs of vectors are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions.vectors import as_double, norm, unit

BLOCK = 1024
MAX_CELLS = 4096
TILE = 16
SPAN = 64  # blocks that one task of `met_blocks` reads beside a tile's
LEFT, RIGHT = 0, 1


def metric_vector(embedding: Column, metric: str) -> Column:
    """Vector whose Euclidean distances order rows as `metric` does.

    For cosine that is the unit vector; zero vectors get an axis of their own, which puts them at distance 1 from all
    others. Two of them fall together here; `metric_distances` sets them apart.
    """
    if metric == "euclidean":
        return as_double(embedding)
    if metric == "cosine":
        own_axis = F.when(norm(embedding) == 0, 1.0).otherwise(0.0)
        return F.concat(unit(embedding), F.array(own_axis))
    raise ValueError(f"unknown metric {metric!r}")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances; close pairs, where the product form loses digits, are computed directly."""
    xx = np.einsum("ij,ij->i", x, x)
    yy = np.einsum("ij,ij->i", y, y)
    sq = x @ y.T
    sq *= 2.0
    np.subtract(xx[:, None] + yy[None, :], sq, out=sq)
    # few pairs are below the largest limit; each is then held against its own
    i, j = np.nonzero(sq < 1e-5 * (xx.max(initial=0.0) + yy.max(initial=0.0)))
    own = sq[i, j] < 1e-5 * (xx[i] + yy[j])
    i, j = i[own], j[own]
    for lo in range(0, len(i), 65536):
        a, b = i[lo : lo + 65536], j[lo : lo + 65536]
        diff = x[a] - y[b]
        sq[a, b] = np.einsum("ij,ij->i", diff, diff)
    return np.sqrt(np.maximum(sq, 0.0, out=sq), out=sq)


class Side:
    """A block's vectors, made ready to be compared: with columns for the squared lengths, a product is a table of squared distances.

    `rough` is the same in single precision; `least` tells which squared distances of it can't be trusted to be above a limit.
    """

    def __init__(self, flat, n: int):
        self.v = matrix(flat, n)
        self.sq = np.einsum("ij,ij->i", self.v, self.v)
        self.longest = float(self.sq.max(initial=0.0))
        self.one = np.ones((n, 1))

    @cached_property
    def asks(self) -> np.ndarray:
        return np.hstack([-2.0 * self.v, self.sq[:, None], self.one])

    @cached_property
    def told(self) -> np.ndarray:
        return np.hstack([self.v, self.one, self.sq[:, None]])

    @cached_property
    def rough_asks(self) -> np.ndarray:
        return self.asks.astype(np.float32)

    @cached_property
    def rough_told(self) -> np.ndarray:
        return self.told.astype(np.float32)

    def distances(self, other: "Side") -> np.ndarray:
        """As `distances` has them."""
        sq = self.asks @ other.told.T
        i, j = np.nonzero(sq < 1e-5 * (self.longest + other.longest))
        self._directly(sq, other, i, j)
        return np.sqrt(np.maximum(sq, 0.0, out=sq), out=sq)

    def _directly(self, sq: np.ndarray, other: "Side", i: np.ndarray, j: np.ndarray) -> None:
        own = sq[i, j] < 1e-5 * (self.sq[i] + other.sq[j])
        i, j = i[own], j[own]
        for lo in range(0, len(i), 65536):
            a, b = i[lo : lo + 65536], j[lo : lo + 65536]
            diff = self.v[a] - other.v[b]
            sq[a, b] = np.einsum("ij,ij->i", diff, diff)

    def within(self, other: "Side", limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows at most `limit` (of each own row) apart and their distances; single precision leaves out what is clearly farther."""
        # rounding of the entries and of each sum, of lengths that add up to four times the longest at most
        slack = (self.v.shape[1] + 8) * 2.0**-22 * (self.longest + other.longest)
        top = limit * limit * (1 + 1e-6) + slack
        if self.longest + other.longest + top.max(initial=0.0) < 1e37:  # far from where single precision ends
            far = self.rough_asks @ other.rough_told.T > top.astype(np.float32)[:, None]
        else:
            far = self.asks @ other.told.T > top[:, None]
        i, j = np.nonzero(~far)
        d = np.empty(len(i))
        for lo in range(0, len(i), 65536):
            a, b = i[lo : lo + 65536], j[lo : lo + 65536]
            diff = self.v[a] - other.v[b]
            d[lo : lo + len(a)] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        some = d <= limit[i]
        return i[some], j[some], d[some]


def metric_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of `metric_vector`s in the metric itself; cosine between two zero vectors is 1, as between any other and one."""
    return metric_of(distances(x, y), x, y, metric)


def metric_of(d: np.ndarray, x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of `metric_vector`s in the metric itself, given the Euclidean ones."""
    if metric == "cosine":
        d = d * d / 2.0
        d[np.ix_(x[:, -1] > 0, y[:, -1] > 0)] = 1.0
    return d


def chunks(v: pd.Series, size: int = 1024) -> Iterator[np.ndarray]:
    """Vectors of a batch as matrices of at most `size` rows, which bounds their distances to all pivots."""
    for lo in range(0, len(v), size):
        yield np.stack(v.iloc[lo : lo + size].to_numpy()).astype(np.float64)


def matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


@dataclass
class Cells:
    """Pivot vectors with the number and reach of the rows assigned to each: a model, MAX_CELLS at most."""

    pivots: np.ndarray
    counts: np.ndarray
    radius: np.ndarray
    first_block: np.ndarray
    n_blocks: np.ndarray


def choose_pivots(rows: DataFrame, n: int) -> np.ndarray:
    """About n / BLOCK rows picked by hash, at most MAX_CELLS."""
    wanted = int(min(MAX_CELLS, max(1, -(-n // BLOCK))))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()
    return np.array([r["v"] for r in picked], dtype=np.float64)


def assign_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot `cell` and the distance `reach` to it."""

    @F.pandas_udf("cell INT, reach DOUBLE")
    def nearest(v: pd.Series) -> pd.DataFrame:
        parts = []
        for x in chunks(v):
            d = distances(x, pivots)
            c = d.argmin(axis=1)
            parts.append(pd.DataFrame({"cell": c.astype(np.int32), "reach": d[np.arange(len(c)), c]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"cell": [], "reach": []})

    return rows.withColumn("_c", nearest("v")).select("*", "_c.cell", "_c.reach").drop("_c")


def cell_table(assigned: DataFrame, pivots: np.ndarray) -> Cells:
    n = len(pivots)
    counts, radius = np.zeros(n, dtype=np.int64), np.zeros(n)
    for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("r")).collect():
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    blocks = -(-counts // BLOCK)
    return Cells(pivots, counts, radius, np.concatenate([[0], np.cumsum(blocks)[:-1]]), blocks)


def add_block(assigned: DataFrame, cells: Cells) -> DataFrame:
    """Block number of each row: a large cell is split by a hash of the id into blocks of about BLOCK rows."""
    n_blocks, first = cells.n_blocks, cells.first_block

    @F.pandas_udf("bigint")
    def number(cell: pd.Series, h: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        return pd.Series(first[c] + np.mod(h.to_numpy(), np.maximum(n_blocks[c], 1)))

    return assigned.withColumn("block", number("cell", F.xxhash64("id")))


def pack(rows: DataFrame, *extra: str) -> DataFrame:
    """One row per block: `(block, ids, flat, <extra>s)`, all in the same order."""
    listed = F.collect_list(F.struct("id", "v", *extra)).alias("rows")
    lists = [F.col(f"rows.{e}").alias(f"{e}s") for e in extra]
    return rows.groupBy("block").agg(listed).select("block", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"), *lists)


def near_cells(rows: DataFrame, cells: Cells, reach) -> DataFrame:
    """Distinct `(qblock, cell)` to compare; `reach(d, x)` gives each row's wanted cells from its pivot distances."""
    pivots = cells.pivots

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = 0
            for x in chunks(pdf["v"]):
                wanted = reach(distances(x, pivots), x)
                owner = pdf["block"].to_numpy()[at : at + len(x)]
                at += len(x)
                for b in np.unique(owner):
                    hit = np.flatnonzero(wanted[owner == b].any(axis=0))
                    yield pd.DataFrame({"qblock": b, "cell": hit.astype(np.int32)})

    return rows.select("block", "v").mapInPandas(run, "qblock BIGINT, cell INT").distinct()


def block_pairs(wanted: DataFrame, cells: Cells) -> DataFrame:
    """`(qblock, block)` for every block of every wanted cell."""
    spark = wanted.sparkSession
    table = [(int(c), int(cells.first_block[c]), int(n)) for c, n in enumerate(cells.n_blocks) if n]
    listed = spark.createDataFrame(table, "cell INT, first BIGINT, n BIGINT")  # MAX_CELLS rows at most
    numbers = F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)
    return wanted.join(F.broadcast(listed), "cell").select("qblock", F.explode(numbers).alias("block"))


def tile_size(spark, n_blocks: int) -> int:
    """How many blocks a task takes together: up to TILE, as long as there are four times as many tiles as cores."""
    return int(max(1, min(TILE, n_blocks // (4 * spark.sparkContext.defaultParallelism))))


def join_blocks(pairs: DataFrame, left: DataFrame, right: DataFrame, tile: int = 1) -> DataFrame:
    """Rows `(qblock, block, l_<column>, r_<column>...)` of wanted pairs; partitioned by tiles of qblocks, so results combine locally.

    A block moves once to every tile of `tile` qblocks that asks for it, not to every qblock.
    """
    asks = pairs.withColumn("qtile", F.floor(F.col("qblock") / tile)).groupBy("qtile", "block").agg(F.collect_set("qblock").alias("asks"))  # `tile` at most
    r = right.select("block", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "block"])
    q = left.select(F.floor(F.col("block") / tile).alias("qtile"), F.col("block").alias("qblock"), *[F.col(c).alias(f"l_{c}") for c in left.columns if c != "block"])
    met = asks.join(r.hint("shuffle_hash"), "block").join(q.hint("shuffle_hash"), "qtile")
    return met.where(F.array_contains("asks", F.col("qblock"))).drop("qtile", "asks")


def met_blocks(pairs: DataFrame, left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """Rows for `meetings`: a partition has the blocks of one tile of `left` and those of a span of `right` that any of them asks for.

    `pairs` are `(qblock, block)`; blocks are numbered below `n_left` and `n_right`. A task reads `TILE + SPAN` blocks at most,
    and a block goes to Python once per tile, not per pair.
    """
    cores = 4 * left.sparkSession.sparkContext.defaultParallelism
    tile = tile_size(left.sparkSession, n_left)
    tiles = -(-max(1, n_left) // tile)
    span = int(max(1, min(SPAN, tiles * n_right // cores)))
    spans = -(-max(1, n_right) // span)
    key = (F.floor(F.col("qblock") / tile) * spans + F.floor(F.col("block") / span)).cast("int").alias("key")
    asks = pairs.groupBy(key, "block").agg(F.collect_set("qblock").alias("asks"))  # `tile` at most
    named = {f"{side}_{f.name}": f.dataType for side, df in (("l", left), ("r", right)) for f in df.schema.fields if f.name != "block"}

    def columns(side: str) -> list[Column]:
        return [F.col(c[2:]).alias(c) if c.startswith(side) else F.lit(None).cast(kind).alias(c) for c, kind in named.items()]

    theirs = asks.join(right.hint("shuffle_hash"), "block").select("key", F.lit(RIGHT).alias("side"), "block", "asks", *columns("r"))
    tiled = asks.select("key", F.floor(F.col("key") / spans).alias("tile")).distinct()
    own = left.withColumn("tile", F.floor(F.col("block") / tile)).join(tiled, "tile")
    own = own.select("key", F.lit(LEFT).alias("side"), "block", F.lit(None).cast("array<bigint>").alias("asks"), *columns("l"))
    return own.unionByName(theirs).repartitionById(tiles * spans, F.col("key")).sortWithinPartitions("key", "side")


def meetings(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, object, list]]:
    """`(key, block, asking)`: each block of a span (`r_` columns) with those of the tile that asked for it (`l_`), one tile after the other."""
    at, held = None, {}
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.key != at:
                at, held = row.key, {}
            if row.side == LEFT:
                held[row.block] = row
            else:
                yield at, row, [held[b] for b in sorted(row.asks)]
