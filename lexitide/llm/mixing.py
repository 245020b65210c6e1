"""Mix sources, languages and topics to target shares: raking of token weights, then sampling by calibrated probabilities.

Iterative proportional fitting runs on the table of cells (source, language, topic) with their tokens: each sweep scales
the weights so that one margin after another meets its targets, until all do. A document's probability starts as its cell's
weight times one constant. Where that exceeds 1 the cell is taken whole and the others are raked again under that bound, so that
the sample still meets every margin that it can meet; what a value lacks altogether goes to the other values. `margins` reports
asked and achieved shares. Sampling hashes the row, so it is repeatable and needs no shuffle of texts.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.chunks import rows_of
from lexitide.llm.common import stored
from lexitide.llm.textarrays import Words, slices

TOPICS = 8
DIMENSIONS = ("source", "lang", "topic")
POWER = 0.8  # default targets: each value's share of tokens to this power, made to sum to one
FRACTION = 0.75  # of all tokens that a sample holds
SWEEPS, CLOSE = 50, 1e-6
REPORTED = 1e-3  # a margin that is off by more is worth more sweeps, and a word in the log

log = logging.getLogger(__name__)


def _topics(batches: Iterator[pa.RecordBatch], topics: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column("row"), pc.struct_field(batch.column("row"), "text")], ["row", "text"])
        for part in slices(batch, "text"):
            words = Words(part.column("text"), lower=True)
            topic = np.full(len(part), -1, np.int32)
            long = words.end - words.start >= 6
            h, row = words.hashes()[long], words.row[long]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            if len(h):
                head = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
                n = np.diff(np.r_[head, len(h)])
                # per row the most frequent word; among equally frequent ones the smallest hash
                best = np.lexsort((h[head], -n, row[head]))
                first = best[np.r_[True, row[head][best][1:] != row[head][best][:-1]]]
                topic[row[head][first]] = (h[head][first] % np.uint64(topics)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(topic), pa.array(np.diff(words.first).astype(np.int64))], ["row", "topic", "tokens"])


def with_topics(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """`docs` with `topic` (a group of the most frequent word of six bytes or more, -1 without one) and `tokens` (words)."""
    rows = rows_of(docs.drop("topic", "tokens"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, topic INT, tokens LONG"
    return rows.mapInArrow(lambda it: _topics(it, topics), schema).select("row.*", "topic", "tokens")


def default_targets(cells: DataFrame, dimension: str, power: float = POWER) -> DataFrame:
    """`(dimension, target)`: shares of tokens, smoothed towards even ones."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("p", F.pow("t", F.lit(power)))
    total = sums.agg(F.sum("p")).first()[0] or 1.0
    return sums.select(dimension, (F.col("p") / F.lit(total)).alias("target"))


def _with_targets(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """`cells` with `want_<dimension>`, the target share of each cell's value; null without a target."""
    for d, target in targets.items():
        named = target.select(F.col(d).alias("value"), F.col("target").alias(f"want_{d}"))
        cells = cells.join(named, F.col(d).eqNullSafe(F.col("value")), "left").drop("value")
    return cells


def _sweep(cells: DataFrame, dimensions: list[str], mass: Column, bounded: bool) -> DataFrame:
    """One round over all margins in one plan: `weight` scaled per value, and `gap_<dimension>`, by how much the margin was off.

    With `bounded` a cell counts as its tokens at most. The factor of a value is found exactly: with its cells in order of
    weight, the first place from which the scaled weights stay at or below 1, all cells before it being full. A window holds the cells of
    one value, which are counted groups and not documents.
    """
    for d in dimensions:
        value, want = Window.partitionBy(d), F.col(f"want_{d}") * mass
        share = F.least(F.lit(1.0), F.col("weight")) if bounded else F.col("weight")
        has = F.sum(F.col("tokens") * share).over(value)
        if bounded:
            ordered = value.orderBy(F.desc("weight"), *[c for c in dimensions if c != d])
            full = F.coalesce(F.sum("tokens").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            rest = F.sum(F.col("tokens") * F.col("weight")).over(ordered.rowsBetween(0, Window.unboundedFollowing))
            told = cells.withColumns({"factor": F.when(rest > 0, (want - full) / rest), "place": F.row_number().over(ordered), "has": has})
            fits = F.col("factor") * F.col("weight") <= 1
            found = F.min(F.when(fits, F.struct("place", "factor"))).over(value)["factor"]
            all_full = 1 / F.min(F.when(F.col("tokens") > 0, F.col("weight"))).over(value)
            factor = F.coalesce(F.when(want.isNotNull(), F.coalesce(found, all_full)), F.lit(1.0))
        else:
            told = cells.withColumn("has", has)
            factor = F.coalesce(F.when(F.col("has") > 0, want / F.col("has")), F.lit(1.0))
        gap = F.when(want > 0, F.abs(F.col("has") / want - 1))
        told = told.withColumns({"scaled": F.col("weight") * factor, f"gap_{d}": gap})
        cells = told.withColumn("weight", F.when(F.col("tokens") > 0, F.col("scaled")).otherwise(F.col("weight"))).drop("scaled", "factor", "place", "has")
    return cells


def _raked(cells: DataFrame, dimensions: list[str], mass: Column, bounded: bool, sweeps: int, close: float) -> DataFrame:
    """Sweeps until every margin is within `close`, or no sweep brings them nearer; stored once a sweep."""
    before, gap = float("inf"), 0.0
    for _ in range(sweeps):
        cells = stored(_sweep(cells, dimensions, mass, bounded), "raked")
        gaps = [f"gap_{d}" for d in dimensions]
        gap = cells.agg(F.max(F.greatest(*gaps) if len(gaps) > 1 else F.col(gaps[0]))).first()[0] or 0.0
        cells = cells.drop(*gaps)
        if gap <= close or (gap < REPORTED and abs(before - gap) <= 1e-3 * close):
            return cells
        before = gap
    log.warning("margins are off by a share of up to %.2g after %d sweeps; see margins()", gap, sweeps)
    return cells


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, close: float = CLOSE) -> DataFrame:
    """`cells` (a row per combination, with `tokens`) with `weight`, so that weighted token shares meet all `targets`.

    A value without a target keeps its weight. Ends when every margin is within `close`; after `sweeps` without that, the gap is
    logged. Cells without tokens keep weight 1.
    """
    ready = stored(_with_targets(cells.withColumn("weight", F.lit(1.0)), targets), "cells")
    total = float(ready.agg(F.sum("tokens")).first()[0] or 0)
    return _raked(ready, list(targets), F.lit(total), False, sweeps, close).drop(*[f"want_{d}" for d in targets])


def attainable(cells: DataFrame, dimension: str, target: DataFrame, fraction: float) -> DataFrame:
    """`(dimension, target)` lowered to what a value has: its tokens over the sample's. The excess goes to the other values, in proportion.

    Works on sums over values: each round takes one more set of values whole, so it ends.
    """
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    total = float(sums.agg(F.sum("tokens")).first()[0] or 0)
    held = sums.join(target.withColumnRenamed(dimension, "value"), F.col(dimension).eqNullSafe(F.col("value"))).drop("value")
    held = stored(held.withColumn("has", F.col("tokens") / F.lit(fraction * total) if total else F.lit(1.0)), "shares")
    asked = held.agg(F.sum("target")).first()[0] or 0.0
    scale = 1.0
    while True:
        whole = F.col("target") * F.lit(scale) >= F.col("has")
        taken, open_ = held.agg(F.sum(F.when(whole, F.col("has"))), F.sum(F.when(~whole, F.col("target")))).first()
        new = (asked - (taken or 0.0)) / open_ if open_ else scale
        if new <= scale * (1 + 1e-12):
            return held.select(dimension, F.least(F.col("has"), F.col("target") * F.lit(scale)).alias("target"))
        scale = new


def scale(raked: DataFrame, fraction: float) -> float:
    """The constant c for which the sum of `tokens * min(1, c * weight)` is `fraction` of all tokens."""
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    c = fraction
    while True:
        full = F.col("weight") * F.lit(c) >= 1
        taken, open_ = raked.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("tokens") * F.col("weight")))).first()
        new = (fraction * total - (taken or 0)) / open_ if open_ else c
        if new <= c * (1 + 1e-9):  # each round takes more cells whole, so this ends
            return c
        c = new


def probabilities(raked: DataFrame, targets: dict[str, DataFrame], fraction: float = FRACTION, sweeps: int = SWEEPS, close: float = CLOSE) -> DataFrame:
    """`raked` cells with `probability`, at most 1, for which the expected sample holds `fraction` of the tokens and meets the margins.

    Margins that no probabilities can meet are lowered first (`attainable`). Cells without tokens have probability `fraction`.
    """
    raked = stored(raked, "weights")
    total = float(raked.agg(F.sum("tokens")).first()[0] or 0)
    able = {d: attainable(raked, d, t, fraction) for d, t in targets.items()}
    start = raked.withColumnRenamed("weight", "raked").withColumn("weight", F.col("raked") * F.lit(scale(raked, fraction)))
    ready = stored(_with_targets(start, able), "bounded")
    bound = _raked(ready, list(targets), F.lit(fraction * total), True, sweeps, close).drop(*[f"want_{d}" for d in targets])
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight"))).otherwise(F.lit(fraction))
    return bound.withColumn("probability", chance).drop("weight").withColumnRenamed("raked", "weight")


def margins(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """`(dimension, value, tokens, asked, achieved)` of cells with `probability`: shares of the expected sample's tokens."""
    total = cells.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 1.0
    out = None
    for d, target in targets.items():
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("tokens"), (F.sum(F.col("tokens") * F.col("probability")) / F.lit(total)).alias("achieved"))
        asked = target.select(F.col(d).alias("asked_for"), F.col("target").alias("asked"))
        told = sums.join(asked, F.col(d).eqNullSafe(F.col("asked_for")), "left").select(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"), "tokens", "asked", "achieved")
        out = told if out is None else out.unionByName(told)
    return out


def calibrate(docs: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, seed: int = 11) -> DataFrame:
    """`docs` with `topic`, `tokens`, `weight`, `probability` and `sampled`.

    Null sources and languages are values of their own. A null text has no tokens and topic -1. Rows that repeat share
    one decision. Columns of `docs` with the added names are replaced; an empty table gives an empty result.
    """
    added = ["topic", "tokens", "weight", "probability", "sampled"]
    rows = stored(with_topics(docs.drop(*added)), "topics")
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    cells = stored(cells, "cells")
    targets = {d: stored(t, f"targets-{d}") for d, t in (targets or {d: default_targets(cells, d) for d in DIMENSIONS}).items()}
    chances = probabilities(rake(cells, targets), targets, fraction)
    weights = chances.select(*[F.col(d).alias(f"cell_{d}") for d in DIMENSIONS], "weight", "probability")
    on = None
    for d in DIMENSIONS:
        same = F.col(d).eqNullSafe(F.col(f"cell_{d}"))
        on = same if on is None else on & same
    joined = rows.join(weights, on)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    out = joined.withColumn("sampled", draw < F.col("probability"))
    return out.select(*rows.columns, "weight", "probability", "sampled")


def sample_to_targets(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled rows of `docs`."""
    return calibrate(docs, targets).where("sampled").select(*docs.columns)
