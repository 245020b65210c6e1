"""Identifiers that no expression and no digit gives away: found by the cues beside them."""

from __future__ import annotations

from lexitide.llm import pii


def _found(spark, rows):
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id LONG, text STRING")
    out = pii.find_personal_data(frame.repartition(3)).collect()
    return {r["doc_id"]: [rows[r["doc_id"]][s["start"] : s["end"]] for s in sorted(r["found"]) if s["kind"] == len(pii.BASE)] for r in out}


def test_words_without_digits_short_ones_and_runs(spark):
    names = ["Élodie", "marlow", "id9", "q"]
    rows = [f"é reach me: u{i}@mail.example.com over and out" for i in range(30)]
    rows += [f"é reach me: {n}, over there" for n in names]
    rows += ["é reach me: jo at home over and out"]
    rows += ["over me and the reach of q marlow here"] * 3 + ["me first and me last over it all"] * 40 + ["q r s q"] * 5
    got = _found(spark, rows)
    for k, n in enumerate(names):
        assert got[30 + k] == [n]
    assert "jo at home" in got[34]
    # a name that mostly stands beside a cue would be found anywhere, a word that doesn't is not
    assert all(not got[i] for i in range(30)) and all("q" not in got[i] for i in range(35, len(rows)))


def test_chains_go_on_until_nothing_is_added(spark):
    rows = [f"a0: u{i}@mail.example.com" for i in range(300)]
    for k in range(6):
        # instances of one cue are the support of the next
        rows += [f"a{k}: n{k}x{i:03d}" for i in range(6)] + [f"a{k + 1}: n{k}x{i:03d}" for i in range(6)] * 20
    rows += ["a6: final"]
    got = _found(spark, rows)
    assert got[len(rows) - 1] == ["final"]
