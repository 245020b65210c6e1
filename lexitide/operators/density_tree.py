"""Density clusters of differing density: a spanning tree of mutual reachability, its merge tree, and the stable clusters in it.

1. `spanning_tree`: rounds in which components take their lightest outgoing edges (Borůvka). The edges come from neighbour lists: a
   row knows all its edges up to the end of its list, so a component whose lightest known edge lies before the ends of all its rows'
   lists need not look further. Where fewer than half of the components can tell, the rows whose lists end too early are compared
   with the rows of all other components and get new lists. The largest component waits to be reached. Of parallel edges between
   two components the lightest stays.
2. `merge_tree`: in which order the edges, lightest first, join the rows, with the sizes on both sides. The edges are halved by
   weight: the lighter half falls into components, which are trees of their own, and the heavier half joins these
   components. Halves of at most `TASK_EDGES` edges are worked off in a task each, all at once.
3. `stable_clusters`: merges of two groups of at least the minimum size split a cluster, all others drop rows from it. Of nested
   clusters those stay whose rows hold together longest, summed over the inverse distance.

Rows of the tables are edges, merges and clusters; none is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.operators import blocks as B
from lexitide.operators.graph import connected_components
from lexitide.operators.neighbors import DIGITS, Nearest, _index, knn, numbered
from lexitide.operators.ranking import add_row_index, top_per_group
from lexitide.session import cut_lineage

TASK_EDGES = 200_000
MAX_ROUNDS = 64
MORE = 10  # neighbours of a first list beyond those that tell the core
LIST = 16  # edges of a list that a row gets later
LOOSE = 1.5  # how far a later list may reach, in lightest known edges of the component
LEAST_WEIGHT = 1e-9  # rows closer than this are taken to be this far apart


# ---- spanning tree


class Lightest(Nearest):
    """The lightest edges of the rows of a block out of their components, up to a limit of each row; ties to the smaller id."""

    def __init__(self, row):
        super().__init__(np.asarray(row.l_ids), LIST, row.l_flat)
        self.cores, self.comps = np.asarray(row.l_cores), np.asarray(row.l_comps)
        self.reach = np.array(row.l_limits, dtype=np.float64)

    def look(self, row, there: B.Side) -> None:
        """Take in the edges to the rows of another block."""
        r_ids, cores, comps = np.asarray(row.r_ids), np.asarray(row.r_cores), np.asarray(row.r_comps)
        if np.isinf(self.reach).any():
            w = np.maximum(np.round(self.side.distances(there), DIGITS), np.maximum(self.cores[:, None], cores[None, :]))
            w[self.comps[:, None] == comps[None, :]] = np.inf
            reach, open_rows = self.reach.copy(), np.flatnonzero(np.isinf(self.reach))
            if len(r_ids) > self.k:
                reach[open_rows] = np.partition(w[open_rows], self.k - 1, axis=1)[:, self.k - 1]
            i, j = np.nonzero((w <= reach[:, None]) & (w < np.inf))
            w = w[i, j]
        else:
            i, j, d = self.side.within(there, self.reach + 10.0**-DIGITS)
            w = np.maximum(np.round(d, DIGITS), np.maximum(self.cores[i], cores[j]))
            some = (w <= self.reach[i]) & (self.comps[i] != comps[j])
            i, j, w = i[some], j[some], w[some]
        if len(i):
            self.hold(i, r_ids[j], w)


def _pairs(cells: B.Cells, spark) -> DataFrame:
    """`(qblock, block, gap)`: every pair of blocks once, with a lower bound on distances between them."""
    pivots, radius, first, count = cells.pivots, cells.radius, cells.first_block, cells.n_blocks
    numbers = [c for c in range(len(pivots)) if count[c]]
    listed = spark.createDataFrame([(int(c),) for c in numbers], "cell INT").repartition(max(1, len(numbers) // 64))
    at = np.array(numbers)

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["cell"]:
                gaps = np.maximum(B.distances(pivots[c : c + 1], pivots[at])[0] - radius[c] - radius[at], 0)
                for other, gap in zip(at.tolist(), gaps.tolist(), strict=True):
                    if other < c:
                        continue
                    q, b = np.meshgrid(np.arange(first[c], first[c] + count[c]), np.arange(first[other], first[other] + count[other]), indexing="ij")
                    keep = q <= b
                    yield pd.DataFrame({"qblock": q[keep], "block": b[keep], "gap": gap})

    return listed.mapInPandas(pair, "qblock BIGINT, block BIGINT, gap DOUBLE")


def near_lists(vectors: DataFrame, min_samples: int, id_col: str = "doc_id") -> DataFrame:
    """`(id, nbr, dist, rank)`: each row's nearest others, `MORE` than those that tell its core."""
    return cut_lineage(knn(vectors, k=min_samples + MORE, metric="euclidean", id_col=id_col).select(F.col(id_col).alias("id"), "nbr", "dist", "rank"))


def cores_of(near: DataFrame, min_samples: int) -> DataFrame:
    """`(id, core)`: the distance to the `min_samples`-th neighbour, or to the farthest of fewer."""
    return near.where(F.col("rank") <= min_samples).groupBy("id").agg(F.max("dist").alias("core"))


def _edge(w, one, other) -> Column:
    """An edge as it is ordered: by weight, then by its smaller and its larger id."""
    return F.struct(w.alias("w"), F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))


def _end(lists: DataFrame, size: int, w: str, otherwise: Column) -> DataFrame:
    """`(id, end)`: the last edge of each list of `size`; edges that are not in the list come later. `otherwise` ends shorter ones."""
    last = lists.groupBy("id").agg(F.count("*").alias("n"), F.max(F.struct(w, "nbr")).alias("last"))
    return last.select("id", F.when(F.col("n") >= size, _edge(F.col(f"last.{w}"), F.col("id"), F.col("last.nbr"))).otherwise(otherwise).alias("end"))


def _parallel(edges: DataFrame) -> DataFrame:
    """The lightest of the edges between two components: `(lo, hi, e)`."""
    return cut_lineage(edges.where(F.col("lo") != F.col("hi")).groupBy("lo", "hi").agg(F.min("e").alias("e")))


def spanning_tree(vectors: DataFrame, min_samples: int, id_col: str = "doc_id", near: DataFrame | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """`(a, b, w)`: a minimum spanning tree of mutual reachability max(core_a, core_b, distance); one edge less than rows.

    A row's core is the distance to its `min_samples`-th neighbour, or to its farthest where it has fewer. Ids must be
    distinct and ordered. Equal weights go to the smaller ids. `near` are lists by `near_lists`.
    """
    spark = vectors.sparkSession
    near = near_lists(vectors, min_samples, id_col) if near is None else near
    cores = cores_of(near, min_samples)
    rows = vectors.select(F.col(id_col).alias("id"), B.metric_vector(F.col("embedding"), "euclidean").alias("v"))
    rows = cut_lineage(rows.join(cores, "id", "left").withColumn("core", F.coalesce("core", F.lit(0.0))))
    indexed, cells = _index(rows)
    indexed = cut_lineage(indexed.select("id", "v", "core", "block"))
    pairs = cut_lineage(_pairs(cells, spark))
    id_type = rows.schema["id"].dataType.simpleString()
    nowhere = F.struct(F.lit(float("inf")).alias("w"), F.lit(None).cast(id_type).alias("a"), F.lit(None).cast(id_type).alias("b"))
    core = indexed.groupBy("id").agg(F.max("core").alias("core"))
    known = near.join(core, "id").join(core.select(F.col("id").alias("nbr"), F.col("core").alias("n_core")), "nbr")
    edges = _parallel(known.select(F.least("id", "nbr").alias("lo"), F.greatest("id", "nbr").alias("hi"), _edge(F.greatest("core", "n_core", "dist"), F.col("id"), F.col("nbr")).alias("e")))
    ends = _end(near, min_samples + MORE, "dist", nowhere)
    state = cut_lineage(core.select("id", F.col("id").alias("comp")).join(ends, "id", "left").withColumn("end", F.coalesce("end", nowhere)))
    tree = None
    for _ in range(2 * MAX_ROUNDS):
        both = edges.select(F.col("lo").alias("comp"), "e", "lo", "hi").unionByName(edges.select(F.col("hi").alias("comp"), "e", "lo", "hi"))
        picks = both.groupBy("comp").agg(F.min(F.struct("e", "lo", "hi")).alias("pick"))
        told = state.groupBy("comp").agg(F.min("end").alias("end"), F.count("*").alias("n")).join(picks, "comp", "left")
        told = cut_lineage(told.select("comp", "n", "pick", "end", F.coalesce(F.col("pick.e") <= F.col("end"), F.lit(False)).alias("sure")))
        whole = told.agg(F.count("*").alias("n"), F.count_if("sure").alias("sure"), F.max(F.struct("n", "comp")).alias("largest")).first()
        if whole["n"] <= 1:
            break
        few = max(whole["n"], edges.count()) <= task_edges
        if not whole["sure"] if few else 2 * whole["sure"] < whole["n"] - 1:
            waiting = told.where(~F.col("sure") & (F.col("comp") != F.lit(whole["largest"]["comp"]))).select("comp", F.col("pick.e").alias("e"))
            asked = state.join(waiting, "comp").where(F.col("e").isNull() | (F.col("end") < F.col("e")))
            asked = cut_lineage(asked.select("id", F.coalesce(F.col("e.w") * LOOSE + 1e-6, F.lit(float("inf"))).alias("limit")))
            found = cut_lineage(_looked(indexed, cells, pairs, state.select("id", "comp"), asked))
            short = F.struct(F.col("limit").alias("w"), F.lit(None).cast(id_type).alias("a"), F.lit(None).cast(id_type).alias("b"))
            ends = asked.join(_end(found, LIST, "w", F.lit(None)), "id", "left").select("id", F.coalesce("end", short).alias("new"))
            state = cut_lineage(state.join(ends, "id", "left").select("id", "comp", F.coalesce("new", "end").alias("end")))
            comps = state.select("id", "comp")
            fresh = found.join(comps, "id").join(comps.select(F.col("id").alias("nbr"), F.col("comp").alias("other")), "nbr")
            edges = _parallel(edges.unionByName(fresh.select(F.least("comp", "other").alias("lo"), F.greatest("comp", "other").alias("hi"), _edge(F.col("w"), F.col("id"), F.col("nbr")).alias("e"))))
            continue
        if few:
            done = cut_lineage(_taken(edges, told, id_type))
            found_edges, merged = done.where("a IS NOT NULL").select("a", "b", "w"), done.where("id IS NOT NULL").select("id", "component")
        else:
            best = cut_lineage(told.where("sure").select("pick.*").distinct())
            found_edges = best.select("e.a", "e.b", "e.w")
            merged = cut_lineage(connected_components(best.select(F.col("lo").alias("a"), F.col("hi").alias("b"))))
        tree = found_edges if tree is None else cut_lineage(tree.unionByName(found_edges))
        new = merged.select(F.col("id").alias("comp"), "component")
        state = cut_lineage(state.join(new, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp"), "end"))
        for side in ("lo", "hi"):
            edges = edges.join(merged.select(F.col("id").alias(side), F.col("component").alias("_new")), side, "left").withColumn(side, F.coalesce("_new", side)).drop("_new")
        edges = _parallel(edges.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), "e"))
    else:
        raise RuntimeError(f"the spanning tree was not done in {2 * MAX_ROUNDS} rounds")
    if tree is None:
        return spark.createDataFrame([], f"a {id_type}, b {id_type}, w DOUBLE")
    return tree


def _taken(edges: DataFrame, told: DataFrame, id_type: str) -> DataFrame:
    """`(id, component, a, b, w)`: all edges that components can tell, one after the other, and what they join; one or the other is null.

    Edges are looked at from the lightest. An edge is the lightest one out of a component if it lies before the component's
    end: a lighter one that was left out would lie beyond that end.
    """
    some = told.where(F.col("pick").isNotNull())
    of = F.lit(None).cast(id_type)
    listed = edges.select("lo", "hi", "e.*").unionByName(some.select(F.col("comp").alias("lo"), of.alias("hi"), "end.*"))

    def take(t: pa.Table) -> pa.Table:
        rows = list(zip(*[t.column(c).to_pylist() for c in ("w", "a", "b", "lo", "hi")], strict=True))
        # an end without ids lies before all edges of its weight
        end = {lo: (w, 0) if a is None else (w, 1, a, b) for w, a, b, lo, hi in rows if hi is None}
        parent = {x: x for x in end}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        taken = []
        for w, a, b, lo, hi in sorted(r for r in rows if r[4] is not None):
            x, y = sorted((root(lo), root(hi)))
            if x != y and (w, 1, a, b) <= max(end[x], end[y]):
                parent[y], end[x] = x, min(end[x], end[y])
                taken.append((None, None, a, b, w))
        joined = [(x, root(x), None, None, None) for x in parent]
        kinds = [t.schema.field("lo").type] * 4 + [pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*taken, *joined), kinds, strict=True)], ["id", "component", "a", "b", "w"])

    kind = f"id {id_type}, component {id_type}, a {id_type}, b {id_type}, w DOUBLE"
    return listed.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(take, kind)


def _looked(indexed: DataFrame, cells: B.Cells, pairs: DataFrame, comps: DataFrame, asked: DataFrame) -> DataFrame:
    """`(id, nbr, w)`: the `LIST` lightest edges, up to its limit, of every row of `asked(id, limit)` out of its component.

    Asked rows of blocks in sequence make a pack of some `BLOCK` rows. A pack meets the blocks that can hold such an edge of a row of it.
    """
    spark = indexed.sparkSession
    rows = cut_lineage(indexed.join(comps, "id"))
    asking = cut_lineage(rows.join(asked, "id"))
    about = rows.groupBy("block").agg(F.min("core").alias("core"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    q_about = asking.groupBy("block").agg(
        F.min("core").alias("q_core"), F.max("limit").alias("limit"), F.min("comp").alias("q_low"), F.max("comp").alias("q_high"), F.count("*").alias("n")
    )
    q_about = cut_lineage(q_about.withColumnRenamed("block", "qblock"))
    counts = q_about.select("qblock", "n").orderBy("qblock").collect()  # a row per block
    begun = np.concatenate([[0], np.cumsum([r["n"] for r in counts])])[: len(counts)]
    packs = spark.createDataFrame([(r["qblock"], int(at) // B.BLOCK) for r, at in zip(counts, begun, strict=True)], "qblock LONG, pack LONG")
    ways = pairs.unionByName(pairs.where("qblock != block").select(F.col("block").alias("qblock"), F.col("qblock").alias("block"), "gap"))
    useful = ways.join(q_about.join(packs, "qblock"), "qblock").join(about, "block").where(
        (F.greatest("gap", "core", "q_core") <= F.col("limit") * (1 + 1e-9) + 1e-9)
        & ~((F.col("low") == F.col("high")) & (F.col("q_low") == F.col("q_high")) & (F.col("low") == F.col("q_low")))
    )
    met = useful.select(F.col("pack").alias("qblock"), "block").distinct()
    packed = asking.join(packs.withColumnRenamed("qblock", "block"), "block").drop("block").withColumnRenamed("pack", "block")
    n_packs = 1 + (int(begun[-1]) // B.BLOCK if len(counts) else 0)
    work = B.met_blocks(met, B.pack(packed, "core", "comp", "limit"), B.pack(rows, "core", "comp"), n_packs, int(cells.n_blocks.sum()))
    id_type = indexed.schema["id"].dataType.simpleString()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for key, block, asks in B.meetings(batches):
            if key != at:
                yield from (best.rows() for best in held.values())
                at, held = key, {}
            there = B.Side(block.r_flat, len(block.r_ids))
            for own in asks:
                if own.block not in held:
                    held[own.block] = Lightest(own)
                held[own.block].look(block, there)
        yield from (best.rows() for best in held.values())

    found = work.mapInPandas(look, f"id {id_type}, nbr {id_type}, dist DOUBLE").withColumnRenamed("dist", "w")
    return top_per_group(found, "id", [F.asc("w"), F.asc("nbr")], LIST).select("id", "nbr", "w")


# ---- merge tree

_MERGES = "e LONG, w DOUBLE, a LONG, b LONG, n_a LONG, n_b LONG"


def _replay(edges: pa.Table, n_points: int) -> pa.Table:
    """Merges of one tree of at most `TASK_EDGES` edges, lightest first; a group is named by its last merge."""
    order = np.argsort(edges.column("e").to_numpy(), kind="stable")
    e, w, a, b, n_a, n_b = (edges.column(c).to_numpy()[order] for c in ("e", "w", "a", "b", "n_a", "n_b"))
    parent: dict[int, int] = {}
    name, size = {}, {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = np.zeros((4, len(e)), np.int64)
    for k in range(len(e)):
        x, y = root(int(a[k])), root(int(b[k]))
        n_x, n_y = size.get(x, int(n_a[k])), size.get(y, int(n_b[k]))
        out[:, k] = name.get(x, x), name.get(y, y), n_x, n_y
        parent[y] = x
        name[x], size[x] = n_points + int(e[k]), n_x + n_y
    return pa.table([pa.array(e), pa.array(w), *[pa.array(c) for c in out]], ["e", "w", "a", "b", "n_a", "n_b"])


def merge_tree(tree: DataFrame, points: DataFrame, n_points: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """`(e, w, a, b, n_a, n_b)`: the merges of a spanning tree in order of weight.

    `points(id, row_idx)` numbers the rows from 0. A merge joins two nodes: a row by its number, or an earlier merge e as
    `n_points + e`, with the rows on each side.
    """
    at_a, at_b = points.select(F.col("id").alias("a"), F.col("row_idx").alias("na")), points.select(F.col("id").alias("b"), F.col("row_idx").alias("nb"))
    numbered = tree.join(at_a, "a").join(at_b, "b").select("w", F.col("na").alias("a"), F.col("nb").alias("b"))
    ranked = add_row_index(numbered.withColumn("key", F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))), "key", index_col="e")
    one = F.lit(1).cast("long")
    open_edges = cut_lineage(ranked.select("e", "w", "a", "b", one.alias("n_a"), one.alias("n_b"), F.lit(0).cast("long").alias("problem")))
    done = None
    while True:
        sizes = open_edges.groupBy("problem").agg(F.count("*").alias("n"), F.floor((F.min("e") + F.max("e")) / 2).alias("middle"))
        told = open_edges.join(sizes, "problem")
        small = told.where(F.col("n") <= task_edges).select("problem", "e", "w", "a", "b", "n_a", "n_b")
        solved = cut_lineage(small.groupBy("problem").applyInArrow(lambda t: _replay(t, n_points), _MERGES))
        done = solved if done is None else done.unionByName(solved)
        large = told.where(F.col("n") > task_edges).drop("n")
        if large.isEmpty():
            return done
        open_edges = cut_lineage(_halved(cut_lineage(large), n_points))


def _halved(edges: DataFrame, n_points: int) -> DataFrame:
    """Each problem's lighter edges by component, and its heavier ones between these components."""
    light, heavy = edges.where(F.col("e") <= F.col("middle")), edges.where(F.col("e") > F.col("middle"))
    comps = cut_lineage(connected_components(light.select("a", "b")))
    lighter = light.join(comps.select(F.col("id").alias("a"), F.col("component").alias("part")), "a")
    lighter = cut_lineage(lighter.select("e", "w", "a", "b", "n_a", "n_b", F.col("part").alias("problem")))
    nodes = lighter.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("id"), F.col("n_b").alias("n")))).alias("s"), "problem")
    mass = nodes.select("problem", "s.*").distinct().groupBy("problem").agg(F.sum("n").alias("n"))
    top = lighter.groupBy("problem").agg((F.max("e") + n_points).alias("name"))
    named = comps.join(mass.join(top, "problem"), comps["component"] == F.col("problem")).select("id", "name", "n")
    named = cut_lineage(named)
    for side in ("a", "b"):
        new = named.select(F.col("id").alias(side), F.col("name").alias("_name"), F.col("n").alias("_n"))
        heavy = heavy.join(new, side, "left").withColumns({side: F.coalesce("_name", side), f"n_{side}": F.coalesce("_n", f"n_{side}")}).drop("_name", "_n")
    # a node is in one problem only, so its smallest node names a problem
    heavy = cut_lineage(heavy)
    names = heavy.groupBy("problem").agg(F.min(F.least("a", "b")).alias("new"))
    heavier = heavy.join(names, "problem").select("e", "w", "a", "b", "n_a", "n_b", F.col("new").alias("problem"))
    return lighter.unionByName(heavier)


# ---- clusters


def _strength(w: Column) -> Column:
    return 1.0 / F.greatest(w, F.lit(LEAST_WEIGHT))


def stable_clusters(merges: DataFrame, n_points: int, min_cluster_size: int) -> DataFrame:
    """`(point, cluster)` of rows in a chosen cluster, named by its uppermost merge; other rows are noise.

    A merge of two groups of `min_cluster_size` rows or more ends the cluster above it and starts two. A cluster's stability
    sums, over its rows, 1 / distance at which the row leaves it less 1 / distance at which it starts. A cluster is chosen if it
    is at least as stable as the best choice below it and no cluster above is chosen; the whole is never chosen.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has two rows or more")
    m, top = min_cluster_size, 2 * n_points - 2
    split = (F.col("n_a") >= m) & (F.col("n_b") >= m)
    leaving = F.when(split, F.col("n_a") + F.col("n_b")).otherwise(F.when(F.col("n_a") < m, F.col("n_a")).otherwise(0) + F.when(F.col("n_b") < m, F.col("n_b")).otherwise(0))
    nodes = cut_lineage(merges.select((F.col("e") + n_points).alias("node"), "a", "b", "n_a", "n_b", split.alias("split"), _strength(F.col("w")).alias("strength"), leaving.alias("leaving")))
    sides = F.array(F.struct(F.col("a").alias("child"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("child"), F.col("n_b").alias("n")))
    children = nodes.select("node", "split", "strength", F.inline(sides))
    own = connected_components(children.where(~F.col("split")).select(F.col("child").alias("a"), F.col("node").alias("b")))
    alone = nodes.select(F.col("node").alias("id"))
    parts = alone.join(own, "id", "full").select("id", F.coalesce("component", "id").alias("component"))
    heads = parts.groupBy("component").agg(F.max("id").alias("cluster"))
    member = cut_lineage(parts.join(heads, "component").select("id", "cluster"))
    of_node = nodes.join(member.withColumnRenamed("id", "node"), "node")
    births = children.where("split").select(F.col("child").alias("cluster"), F.col("strength").alias("birth"), "n", F.col("node").alias("above"))
    births = births.join(member.select(F.col("id").alias("above"), F.col("cluster").alias("parent")), "above").drop("above")
    gains = of_node.groupBy("cluster").agg(F.sum(F.col("leaving") * F.col("strength")).alias("gain"))
    tree = births.join(gains, "cluster").select("cluster", "parent", (F.col("gain") - F.col("n") * F.col("birth")).alias("stability"))
    chosen = _chosen(cut_lineage(tree), top)
    rows = member.where(F.col("id") < n_points).select(F.col("id").alias("point"), "cluster")
    return rows.join(chosen, "cluster").select("point", F.col("chosen").alias("cluster"))


def _chosen(tree: DataFrame, top: int) -> DataFrame:
    """`(cluster, chosen)`: the chosen cluster at or above each cluster, where there is one.

    Values are folded from the leaves up, all clusters whose children are known at once: as many rounds as the tree of
    clusters (at most twice rows / minimum size) is high. Choices go down by pointer doubling.
    """
    wanted = tree.groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("n_children"))
    state = cut_lineage(tree.join(wanted, "cluster", "left").select("*").fillna(0, ["n_children"]))
    known = cut_lineage(state.where("n_children = 0").select("cluster", "parent", F.col("stability").alias("value"), F.lit(True).alias("wins")))
    waiting = state.where("n_children > 0")
    while True:
        below = known.groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("below"), F.count("*").alias("n_known"))
        ready = waiting.join(below, "cluster").where("n_known = n_children").join(known.select("cluster"), "cluster", "left_anti")
        fresh = cut_lineage(ready.select("cluster", "parent", F.greatest("stability", "below").alias("value"), (F.col("stability") >= F.col("below")).alias("wins")))
        if fresh.isEmpty():
            break
        known = cut_lineage(known.unionByName(fresh))
    # `best` is the uppermost winner between a cluster and `up`, exclusive
    walk = known.select("cluster", F.when(F.col("parent") != top, F.col("parent")).alias("up"), F.when(F.col("wins"), F.col("cluster")).alias("best"))
    while True:
        walk = cut_lineage(walk)
        if walk.where(F.col("up").isNotNull()).isEmpty():
            return walk.where(F.col("best").isNotNull()).select("cluster", F.col("best").alias("chosen"))
        over = walk.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("best").alias("_best"))
        walk = walk.join(over, "up", "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_best", "best").alias("best"))


@dataclass
class TreeFit:
    """`topics(id_col, topic)`, `cores(id, core)` and, per topic, the longest link between two of its rows `radii(topic, radius)`."""

    topics: DataFrame
    cores: DataFrame
    radii: DataFrame


def tree_fit(vectors: DataFrame, min_cluster_size: int, min_samples: int, id_col: str = "doc_id") -> TreeFit:
    """Clusters of any density, each with its own range of radii; numbered by size, then by the smallest id, noise -1.

    With fewer than twice the minimum size of rows there is no split, and every row is noise.
    """
    keys = vectors.select(F.col(id_col).alias("id"))
    n = keys.count()
    noise = vectors.select(id_col, F.lit(-1).alias("topic"))
    spark, kind = vectors.sparkSession, keys.schema["id"].dataType.simpleString()
    no_radii = spark.createDataFrame([], "topic INT, radius DOUBLE")
    if n == 0:
        return TreeFit(noise, spark.createDataFrame([], f"id {kind}, core DOUBLE"), no_radii)
    near = near_lists(vectors, min_samples, id_col)
    cores = cores_of(near, min_samples)
    if n < 2 * min_cluster_size:
        return TreeFit(noise, cores, no_radii)
    points = cut_lineage(add_row_index(keys, "id"))
    tree = cut_lineage(spanning_tree(vectors, min_samples, id_col, near))
    merges = cut_lineage(merge_tree(tree, points, n))
    found = stable_clusters(merges, n, min_cluster_size)
    named = cut_lineage(found.join(points.withColumnRenamed("row_idx", "point"), "point").select("id", F.col("cluster").alias("component")))
    topics = cut_lineage(numbered(vectors.select(id_col), named, id_col, min_cluster_size))
    side = topics.select(F.col(id_col).alias("a"), "topic").where("topic >= 0")
    inner = tree.join(side, "a").join(side.select(F.col("a").alias("b"), F.col("topic").alias("other")), "b").where("topic = other")
    return TreeFit(topics, cores, inner.groupBy("topic").agg(F.max("w").alias("radius")))


def tree_clusters(vectors: DataFrame, min_cluster_size: int = 30, min_samples: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Density clusters with noise -1: `(id_col, topic)`, see `tree_fit`."""
    return tree_fit(vectors, min_cluster_size, min_samples or min_cluster_size, id_col).topics
