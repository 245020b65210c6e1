"""Near-duplicate groups by SimHash: a segment-popcount embedding of the fingerprints and a grid range-join.

A 64-bit fingerprint is cut into segments of four bits; the bit counts of its 16 segments are a point with integer
coordinates 0 to 4. One changed bit moves one coordinate by one, so the Manhattan distance of two points is at most
the number of differing bits, and a range join under it loses no link. Points at most two apart meet in a cell of the
unit grid at most one step from both, so each point enters its own cell and those one step away (33 at most) and the
range join is an equality join on cells. Pairs that meet are verified on the fingerprints.

Copies cost nothing: the join runs on distinct fingerprints. A crowded cell (thousands of near copies) is not paired up:
its fingerprints are embedded again with segments of one bit, where Manhattan and bit distance are the same. There a
cell holds at most 65 fingerprints and all of them link, so a star per cell states every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import row_key, stored
from lexitide.operators.graph import connected_components

SEGMENT_BITS = 4
CROWDED = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text: a bit is 1 if it is set in over half of the hashes of the word shingles."""
    words = (text or "").encode().lower().split()  # on bytes, both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.array([len(w) + 1 for w in words])).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(words) - width + 1)
    pieces = [joined[a:b] for a, b in zip(starts[:n], ends[width - 1 :] or ends[-1:], strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(values.view(np.int64))], ["row", "fp"])


def with_fingerprints(docs: DataFrame, keep: list[str] | None = None, width: int = 3, seed: int = 42) -> DataFrame:
    """The columns `keep` of `docs` (by default all) with the 64-bit fingerprint `fp` of `text`, 0 without words."""
    keep = [c for c in (keep or docs.columns) if c != "fp"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, fp LONG"
    return rows.mapInArrow(lambda it: _fingerprints(it, width, seed), schema).select("row.*", "fp")


def _cells(fp: Column) -> Column:
    """The grid cells of a fingerprint's point: its own and those one step away; three bits a coordinate."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(2**SEGMENT_BITS - 1))).cast("long") for i in range(0, 64, SEGMENT_BITS)]
    own = sum((c * F.lit(8**i) for i, c in enumerate(counts[1:], 1)), counts[0])
    steps = [F.when(c < SEGMENT_BITS, own + F.lit(8**i)) for i, c in enumerate(counts)] + [F.when(c > 0, own - F.lit(8**i)) for i, c in enumerate(counts)]
    return F.array_compact(F.array(own, *steps))


def unfolded(fps: DataFrame) -> DataFrame:
    """`(fp, cell)`: every cell of each fingerprint.

    Few bytes become many, so rows are spread by number and not by size; by another hash than that of the grouping by `fp`
    before, or the planner drops this exchange.
    """
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp", F.lit(1)))
    return spread.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """`(a, b)` over distinct `fp` at most two bits apart: every link of sparse cells, a star for crowded ones."""
    cells = unfolded(fps)
    sizes = cells.groupBy("cell").count().where("count > 1")
    # Spark sizes unfolded rows as if they were one per fingerprint, and written ones by their compressed files; it would broadcast them
    met = stored(cells.join(sizes.hint("merge"), "cell"), "cells")
    sparse = met.where(F.col("count") <= crowded).select("cell", "fp")
    other = sparse.withColumnRenamed("fp", "other")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2
    pairs = sparse.join(other.hint("merge"), "cell").where((F.col("fp") < F.col("other")) & close).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    flips = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    fine = met.where(F.col("count") > crowded).select("fp").distinct().select("fp", F.explode(flips).alias("middle"))
    stars = fine.groupBy("middle").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b")
    return pairs.unionByName(stars).distinct()


def with_groups(rows: DataFrame) -> DataFrame:
    """`rows(doc_id, fp)` with `root`, one fingerprint of the row's group, and `component_id`, the group's smallest id."""
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = connected_components(links(fps.select("fp"))).withColumnRenamed("id", "fp")
    rooted = stored(fps.join(groups, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root")), "groups")
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select(*rows.columns, "root", "component_id")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, width: int = 3, seed: int = 42) -> DataFrame:
    """`docs` (or its columns `keep`) with `fp` and `component_id`, the smallest `doc_id` reachable over fingerprints at most two bits apart.

    Null and wordless texts share the fingerprint 0 and link like any other. A null `doc_id` never names a group unless
    no member has an id. Rows that repeat are one more member each. Columns of `docs` called `fp`, `root` or
    `component_id` are replaced; an empty table gives an empty result.
    """
    rows = stored(with_fingerprints(docs.drop("component_id", "root"), keep, width, seed), "fingerprints")
    return with_groups(rows).drop("root")


def one_of_each(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, of several the one with the smallest row hash.

    Groups are found on ids, row hashes and fingerprints; texts move once, to be filtered. A null id is taken only if the
    group has no other. Of equal rows one stays; rows are equal if id and two independent hashes of 64 bits are, which 10^10
    different rows of one id fail to tell apart with a probability of 10^-19. Rows are carried whole, whatever their
    columns are called; an empty table gives none.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).alias("whole")
    key = F.struct("doc_id", F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g")).alias("row_key")
    keyed = docs.select("doc_id", "text", whole, key)
    rows = stored(with_fingerprints(keyed, ["doc_id", "row_key"], width, seed), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    first = with_groups(rows).groupBy("root").agg(F.min(order).alias("first")).select("first.row_key")
    rows = keyed.select("row_key", "whole")
    left = rows.join(first, rows["row_key"].eqNullSafe(first["row_key"]), "left_semi").dropDuplicates(["row_key"])
    return left.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])
