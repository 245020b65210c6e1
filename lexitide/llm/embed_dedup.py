"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Unit vectors are projected on fixed random directions. Two of them collide on a projection if one lies in the window
centred at the other; linked vectors (cosine at least `cosine`) collide far more often than others. A pair whose count
reaches a threshold is verified by its exact cosine. Windows and thresholds follow from the recall asked for: for a pair
exactly at the limit a projection's difference is normal with a known deviation, so its count is binomial.

- Copies of one vector are joined once and only counted.
- Vectors are sorted along their first projection and cut into strips of `strip` vectors. Two strips meet in one group
  of rows only if they are no farther apart on it than linked vectors can be (the difference of two projections on a
  unit direction is at most the vectors' distance), so the first window loses nothing.
- A group counts collisions of its pairs in bounded blocks, in two rounds: few projections for all pairs, the others
  for pairs that are still likely. It hands on, per vector, its number of links and one star link, never the pairs.

The number of strip pairs, hence the work, grows with the square of the rows where the data fill the sphere evenly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import stored
from lexitide.operators.graph import connected_components

FIRST, ALL = 16, 48  # projections of the first round, and of both
HALF_WIDTH = 1.5  # of a window, in deviations of a linked pair's difference
RECALL = 0.995  # of each round, for a pair exactly at the limit
STRIP = 4096
_BLOCK = 1024


def directions(dim: int, n: int = ALL, seed: int = 7) -> np.ndarray:
    """`n` random unit directions."""
    a = np.random.default_rng(seed).standard_normal((dim, n))
    return a / np.linalg.norm(a, axis=0)


def needed(n: int, half_width: float = HALF_WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the limit reaches with probability `recall` on `n` projections."""
    p = math.erf(half_width / math.sqrt(2))
    tail, k = 0.0, n
    while k > 0:
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= recall:
            return k
        k -= 1
    return 0


def _linked(a: np.ndarray, b: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of `a` and `b` that link, block by block."""
    dim = a.shape[1]
    lines = directions(dim)
    # deviation of a difference: the distance at the limit, spread over `dim` directions
    reach = HALF_WIDTH * math.sqrt(2 - 2 * cosine) / math.sqrt(dim)
    pa_, pb = (x @ lines for x in (a, b))
    scale = 30000 / 2.0
    qa, qb = (np.ascontiguousarray(np.round(p.T * scale).astype(np.int16)) for p in (pa_, pb))
    window = np.uint16(2 * math.ceil(reach * scale + 1))
    low, high = needed(FIRST), needed(ALL)
    for i in range(0, len(a), _BLOCK):
        for j in range(0, len(b), _BLOCK):
            x, y = qa[:, i : i + _BLOCK], qb[:, j : j + _BLOCK]
            count = np.zeros((x.shape[1], y.shape[1]), np.uint8)
            gap, hit = np.empty(count.shape, np.int16), np.empty(count.shape, bool)
            for k in range(FIRST):  # |difference| <= reach, as one unsigned comparison
                np.subtract((x[k].astype(np.int32) + window // 2).astype(np.int16)[:, None], y[k][None, :], out=gap)
                np.less_equal(gap.view(np.uint16), window, out=hit)
                np.add(count, hit.view(np.uint8), out=count)
            r, c = np.nonzero(count >= low)
            total = count[r, c].astype(np.int16)
            for k in range(FIRST, ALL):
                total += np.abs(x[k][r].astype(np.int32) - y[k][c]) * 2 <= int(window)
            r, c = r[total >= high] + i, c[total >= high] + j
            if len(r):
                exact = np.concatenate([np.einsum("ij,ij->i", a[r[s : s + 65536]], b[c[s : s + 65536]]) for s in range(0, len(r), 65536)])
                r, c = r[exact >= cosine], c[exact >= cosine]
            yield r, c


def _forest(parent: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Smallest member of each node's group after the links are added; `parent` holds the groups so far."""
    while len(r):
        x, y = parent[r], parent[c]
        apart = x != y
        if not apart.any():
            break
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def _group(left: int, right: int, rows: pa.Table, cosine: float) -> pa.Table:
    """Per vector of two strips: its links between them and the smallest vector it reaches by those."""
    rows = rows.sort_by("class")
    strip, ids, weight = (rows.column(c).to_numpy() for c in ("strip", "class", "copies"))
    units = rows.column("unit").to_numpy()
    dims = np.array([len(u) for u in units])
    count, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for dim in np.unique(dims):
        one, two = (np.flatnonzero((strip == s) & (dims == dim)) for s in (left, right))
        if not len(one) or not len(two):
            continue
        for r, c in _linked(np.stack(units[one]), np.stack(units[two]), cosine):
            r, c = one[r], two[c]
            if left == right:
                r, c = r[r < c], c[r < c]
            np.add.at(count, r, weight[c])
            np.add.at(count, c, weight[r])
            parent = _forest(parent, r, c)
    some = np.flatnonzero(count)
    return pa.table({"class": ids[some], "links": count[some], "root": ids[parent[some]]})


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.9, strip: int = STRIP) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)` per row of `vectors(vec_id, embedding)`, whatever its other columns.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; so do vectors of
    different lengths. `n_links` counts the other rows linked directly, copies included. A null `vec_id` takes part
    and names a group only if it has no other member. Repeated ids are rows of their own. An empty table gives an
    empty result. Links found have a cosine of `cosine` or more in double precision; a pair exactly at the limit is
    found with probability of about 0.99, closer pairs with more.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", x.alias("v"))
    top = F.array_max(F.transform("v", lambda e: F.abs(e)))
    finite = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    good = F.coalesce(~finite & (F.size("v") > 0) & (top > 0), F.lit(False))
    # scaled by the largest component first, so that no square over- or underflows
    scaled = F.transform("v", lambda e: e / F.col("top"))
    rows = rows.withColumn("top", F.when(good, top)).withColumn("s", F.when(good, scaled)).withColumn("norm", F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, e: a + e * e)))
    rows = stored(rows.select("vec_id", F.transform("s", lambda e: e / F.col("norm") + F.lit(0.0)).alias("unit")), "units")
    classes = rows.where("unit IS NOT NULL").groupBy("unit").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = classes.withColumn("dim", F.size("unit"))
    dims = [r["dim"] for r in classes.select("dim").distinct().orderBy("dim").limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("more than 1,000 vector lengths in one table")
    line = F.lit(None).cast("double")
    for d in dims:
        a = F.array(*[F.lit(float(e)) for e in directions(d, 1)[:, 0]])
        line = F.when(F.col("dim") == d, F.aggregate(F.zip_with("unit", a, lambda e, f: e * f), F.lit(0.0), lambda s, e: s + e)).otherwise(line)
    classes = stored(classes.withColumn("line", line).withColumn("class", F.xxhash64("unit")), "vector-classes")
    strips, pairs = _strips(classes, cosine, strip)
    schema = "class LONG, links LONG, root LONG"
    grouped = strips.join(pairs, "strip").groupBy("left", "right")
    found = stored(grouped.applyInArrow(lambda key, t: _group(key[0].as_py(), key[1].as_py(), t, cosine), schema), "vector-links")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("class").alias("a"), F.col("root").alias("b")).distinct()).withColumnRenamed("id", "class")
    named = classes.select("class", "unit", "low", "copies").join(groups, "class", "left").join(counts, "class", "left")
    named = named.withColumn("root", F.coalesce("component", "class"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    keyed = rows.select("vec_id", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")).alias("class"))
    out = keyed.join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _strips(classes: DataFrame, cosine: float, strip: int) -> tuple[DataFrame, DataFrame]:
    """Classes with their strip along the first projection, and for each strip the pairs of strips that it meets in."""
    n = classes.count()
    cuts = max(1, math.ceil(n / strip))
    parted = classes.repartitionByRange(cuts, "dim", "line").withColumn("strip", F.spark_partition_id().cast("long"))
    parted = stored(parted.select("class", "unit", "copies", "dim", "line", "strip"), "strips")
    bounds = parted.groupBy("strip", "dim").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    near = math.sqrt(2 - 2 * cosine) + 1e-9
    a, b = (bounds.withColumnsRenamed({"strip": s, "lo": f"{s}_lo", "hi": f"{s}_hi"}) for s in ("left", "right"))
    met = a.join(b, "dim").where((F.col("left") <= F.col("right")) & (F.col("right_lo") <= F.col("left_hi") + near) & (F.col("left_lo") <= F.col("right_hi") + near))
    pairs = met.select("left", "right").distinct().withColumn("strip", F.explode(F.array_distinct(F.array("left", "right"))))
    return parted.select("class", "unit", "copies", "strip"), pairs
