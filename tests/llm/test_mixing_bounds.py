"""Raking under probabilities of at most 1: margins that can be met are met, the others are lowered and named."""

from __future__ import annotations

import numpy as np
import pytest

from lexitide.llm import mixing


def _cells(spark, rows):
    return spark.createDataFrame(rows, "source STRING, lang STRING, topic INT, tokens LONG")


def _targets(spark, cells, **given):
    out = {d: mixing.default_targets(cells, d) for d in mixing.DIMENSIONS}
    for d, shares in given.items():
        kind = "INT" if d == "topic" else "STRING"
        out[d] = spark.createDataFrame(list(shares.items()), f"{d} {kind}, target DOUBLE")
    return out


@pytest.fixture
def crossed(spark):
    rng = np.random.default_rng(31)
    rows = [(s, la, t, int(rng.integers(50, 400))) for s in ("a", "b", "c", None) for la in ("x", "y", "z") for t in range(-1, 3)]
    return _cells(spark, rows)


def test_feasible_margins_hold_with_full_cells(spark, crossed):
    """One cell is far too small for its shares: it is taken whole, and every margin holds all the same."""
    cells = crossed.unionByName(_cells(spark, [("d", "x", 0, 2000), ("d", "y", 0, 2000), ("d", "w", 0, 40), ("a", "w", 1, 400)]))
    total = cells.agg({"tokens": "sum"}).first()[0]
    share = {r["lang"]: r["t"] / total for r in cells.groupBy("lang").agg(mixing.F.sum("tokens").alias("t")).collect()}
    wanted = {la: v * 0.9 for la, v in share.items() if la != "w"} | {"w": 1 - 0.9 * (1 - share["w"])}
    if wanted["w"] * 0.5 > share["w"]:
        wanted = {la: v * (1 - 1.9 * share["w"]) / (1 - share["w"]) for la, v in share.items() if la != "w"} | {"w": 1.9 * share["w"]}
    targets = _targets(spark, cells, lang=wanted)
    done = mixing.probabilities(mixing.rake(cells, targets), targets, fraction=0.5).persist()
    rows = done.collect()
    assert all(0 <= r["probability"] <= 1 for r in rows) and any(r["probability"] == 1 for r in rows)
    for r in mixing.margins(done, targets).collect():
        assert r["achieved"] == pytest.approx(r["asked"], abs=1e-3), r
    assert sum(r["tokens"] * r["probability"] for r in rows) == pytest.approx(0.5 * total, rel=1e-4)


def test_what_a_value_lacks_goes_to_the_others(spark, crossed):
    cells = crossed
    share = {r["lang"]: r["t"] for r in cells.groupBy("lang").agg(mixing.F.sum("tokens").alias("t")).collect()}
    total = sum(share.values())
    wanted = {"x": 0.9, "y": 0.07, "z": 0.03}  # x holds about a third of the tokens
    able = {r["lang"]: r["target"] for r in mixing.attainable(cells, "lang", _targets(spark, cells, lang=wanted)["lang"], 0.75).collect()}
    assert able["x"] == pytest.approx(share["x"] / (0.75 * total)) and sum(able.values()) == pytest.approx(1)
    assert able["y"] / able["z"] == pytest.approx(7 / 3) or able["y"] == pytest.approx(share["y"] / (0.75 * total))
    targets = _targets(spark, cells, lang=wanted)
    done = mixing.probabilities(mixing.rake(cells, targets), targets).persist()
    told = {(r["dimension"], r["value"]): r for r in mixing.margins(done, targets).collect()}
    assert told["lang", "x"]["asked"] == 0.9 and told["lang", "x"]["achieved"] == pytest.approx(able["x"], abs=1e-2)
    assert {d for d, _ in told} == set(mixing.DIMENSIONS) and len(told) == 3 + 4 + 4


def test_nothing_clipped_means_plain_raking(spark, crossed):
    targets = _targets(spark, crossed)
    raked = mixing.rake(crossed, targets)
    done = mixing.probabilities(raked, targets, fraction=0.3)
    constant = mixing.scale(raked, 0.3)
    weights = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in raked.collect()}
    for r in done.collect():
        assert r["probability"] == pytest.approx(min(1.0, constant * weights[r["source"], r["lang"], r["topic"]]), rel=1e-4)
