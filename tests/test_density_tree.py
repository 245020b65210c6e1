"""Spanning trees, merge trees and stable clusters against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide.operators import density_tree, neighbors
from lexitide.operators.ranking import add_row_index


def vec(spark, x, ids=None):
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "doc_id LONG, embedding ARRAY<DOUBLE>").repartition(3)


def reachability(x, m):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(m, len(x) - 1)]
    out = np.round(np.maximum(np.maximum(core[:, None], core[None, :]), d), neighbors.DIGITS)
    return out


def plain_tree(w):
    """Kruskal with ties to the smaller ids."""
    n = len(w)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for value, a, b in sorted((w[a, b], a, b) for a in range(n) for b in range(a + 1, n)):
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((a, b, value))
    return out


def plain_clusters(edges, n, m):
    """Point sets of the chosen clusters, from the top down by recursion on point sets."""
    strength = {e: 1 / max(e[2], density_tree.LEAST_WEIGHT) for e in edges}

    def parts(points, inner):
        """The heaviest inner edge taken out: the two sides."""
        cut = max(inner, key=lambda e: (e[2], e[0], e[1]))
        rest = [e for e in inner if e != cut]
        side, grow = {cut[0]}, True
        while grow:
            grow = False
            for a, b, _ in rest:
                if (a in side) != (b in side):
                    side |= {a, b}
                    grow = True
        return cut, side, points - side, rest

    def cluster(points, inner, birth):
        """`(stability, best value, chosen sets)` of the cluster that starts here."""
        start, stability = points, 0.0
        while inner:
            cut, left, right, rest = parts(points, inner)
            lam = strength[cut]
            if len(left) >= m and len(right) >= m:
                stability += len(points) * (lam - birth)
                below = [cluster(s, [e for e in rest if e[0] in s], lam) for s in (left, right)]
                value = sum(v for v, _ in below)
                return (stability, [start]) if stability >= value else (value, [c for _, chosen in below for c in chosen])
            for s in (left, right):
                if len(s) < m:
                    stability += len(s) * (lam - birth)
            keep = left if len(left) >= m else right if len(right) >= m else set()
            points, inner = keep, [e for e in rest if e[0] in keep]
        return stability, [start]

    whole, inner = set(range(n)), list(edges)
    # the whole is never chosen: down to the first split
    while inner:
        cut, left, right, rest = parts(whole, inner)
        if len(left) >= m and len(right) >= m:
            return [c for s in (left, right) for c in cluster(s, [e for e in rest if e[0] in s], strength[cut])[1]]
        whole = left if len(left) >= m else right if len(right) >= m else set()
        inner = [e for e in rest if e[0] in whole]
    return []


def blobs(seed, dense=60, loose=60, noise=15):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(size=(dense, 3)) * 0.05, rng.normal(size=(loose, 3)) * 1.0 + 8, rng.uniform(-15, 25, (noise, 3))])


@pytest.mark.parametrize("block", [16])
def test_spanning_tree(spark, monkeypatch, block):
    monkeypatch.setattr("lexitide.operators.blocks.BLOCK", block)
    x = blobs(1, 40, 40, 10)
    x[5] = x[6] = x[7]  # ties
    got = sorted(tuple(r) for r in density_tree.spanning_tree(vec(spark, x), 4).select("a", "b", "w").collect())
    want = sorted(plain_tree(reachability(x, 4)))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-8)


@pytest.mark.parametrize("task_edges", [10_000, 100])
def test_spanning_tree_compares_only_rows_whose_lists_end_too_early(spark, monkeypatch, task_edges):
    monkeypatch.setattr("lexitide.operators.blocks.BLOCK", 16)
    asked, looked = [], density_tree._looked

    def counted(*args):
        asked.append(args[-1].count())
        return looked(*args)

    monkeypatch.setattr(density_tree, "_looked", counted)
    x = np.vstack([blobs(1, 100, 10, 0), np.repeat(blobs(3, 2, 2, 2), 20, axis=0)])  # copies fill whole lists
    got = sorted(tuple(r) for r in density_tree.spanning_tree(vec(spark, x), 4, task_edges=task_edges).select("a", "b", "w").collect())
    want = sorted(plain_tree(reachability(x, 4)))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-8)
    assert 0 < sum(asked) <= 2 * len(x)  # every round compared every row before


@pytest.mark.parametrize("task_edges", [1000, 7])
def test_merge_tree(spark, task_edges):
    x = blobs(2, 30, 30, 8)
    edges = plain_tree(reachability(x, 3))
    n = len(x)
    tree = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in edges], "a LONG, b LONG, w DOUBLE")
    points = add_row_index(spark.range(n), "id")
    got = {r["e"]: r for r in density_tree.merge_tree(tree, points, n, task_edges).collect()}
    group, sets = {i: i for i in range(n)}, {i: {i} for i in range(n)}
    for e, (a, b, w) in enumerate(sorted(edges, key=lambda t: (t[2], t[0], t[1]))):
        x_, y_ = group[a], group[b]
        assert {got[e]["a"], got[e]["b"]} == {x_, y_} and got[e]["w"] == pytest.approx(w)
        assert {(got[e]["a"], got[e]["n_a"]), (got[e]["b"], got[e]["n_b"])} == {(x_, len(sets[x_])), (y_, len(sets[y_]))}
        sets[n + e] = sets[x_] | sets[y_]
        group.update(dict.fromkeys(sets[n + e], n + e))
    assert len(got) == n - 1


@pytest.mark.parametrize("seed", [3])
def test_clusters_of_differing_density(spark, seed):
    """Two blobs, one twenty times as dense, and noise: no single radius finds both."""
    x, m = blobs(seed), 10
    got = {r["doc_id"]: r["topic"] for r in density_tree.tree_clusters(vec(spark, x), m, 5).collect()}
    want = plain_clusters(plain_tree(reachability(x, 5)), len(x), m)
    found = {frozenset(i for i, t in got.items() if t == topic) for topic in set(got.values()) - {-1}}
    assert found == {frozenset(c) for c in want} and len(got) == len(x)
    dense, loose = [t for i, t in got.items() if i < 60], [t for i, t in got.items() if 60 <= i < 120]
    assert max(dense.count(t) for t in set(dense) - {-1}) >= 55 and max(loose.count(t) for t in set(loose) - {-1}) >= 45
    assert set(dense) & set(loose) <= {-1}


def test_random_points_and_few_rows(spark):
    x = np.random.default_rng(9).normal(size=(90, 4))
    got = {r["doc_id"]: r["topic"] for r in density_tree.tree_clusters(vec(spark, x), 4, 2).collect()}
    want = plain_clusters(plain_tree(reachability(x, 2)), len(x), 4)
    assert {frozenset(i for i, t in got.items() if t == topic) for topic in set(got.values()) - {-1}} == {frozenset(c) for c in want}
    sizes = [sum(t == k for t in got.values()) for k in range(max(got.values()) + 1)]
    assert sizes == sorted(sizes, reverse=True)
    assert {r["topic"] for r in density_tree.tree_clusters(vec(spark, x[:6]), 4, 2).collect()} == {-1}
    assert density_tree.tree_clusters(vec(spark, x[:1]).limit(0), 4, 2).count() == 0
    same = density_tree.tree_clusters(vec(spark, np.zeros((12, 2))), 3, 2).where(F.col("topic") >= 0)
    assert same.count() == len([i for c in plain_clusters(plain_tree(np.zeros((12, 12))), 12, 3) for i in c])


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbor_graph(spark, metric):
    """Leaves far smaller than the data, on clustered and on evenly spread vectors; zero vectors and equal ones too."""
    from lexitide.operators.descent import neighbor_graph, recall

    rng = np.random.default_rng(21)
    x = np.vstack([rng.normal(size=(300, 8)), rng.normal(size=(300, 8)) * 0.1 + 3, np.zeros((2, 8)), np.ones((5, 8))])
    df = vec(spark, x)
    exact = neighbors.knn(df, k=6, metric=metric)
    found = neighbor_graph(df, k=6, metric=metric, leaf=40).persist()
    assert found.count() == 6 * len(x) and found.select("doc_id", "nbr").distinct().count() == 6 * len(x)
    assert found.where("doc_id = nbr").isEmpty()
    assert recall(found, exact).first()["recall"] >= 0.95
    whole = neighbor_graph(df, k=6, metric=metric, leaf=1024)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in exact.collect()}


@pytest.mark.parametrize("tile", [1, 3])
def test_blocks_meet_whatever_the_tile(spark, monkeypatch, tile):
    from lexitide.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "tile_size", lambda spark, n: tile)
    x = np.random.default_rng(22).normal(size=(120, 4))
    got = {(r["doc_id"], r["rank"]): r["nbr"] for r in neighbors.knn(vec(spark, x), k=4, metric="euclidean").collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, r + 1): int(j) for i in range(120) for r, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
