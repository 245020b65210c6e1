"""License scan against plain Python: places of phrases, word counts, notices with changed words."""

from __future__ import annotations

import collections
import re

import numpy as np

from lexitide.llm import license_scan
from lexitide.llm.license_templates import BASE, NAMES, NOTICES
from lexitide.llm.queries import op11_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RNG = np.random.default_rng(17)
_VOCAB = ["the", "of", "license", "GNU", "public", "general", "apache", "cc", "by", "mit", "to", "and", "Über", "日本", "x1", "software", "copy"]


def _prose(n):
    return " ".join(_RNG.choice(_VOCAB, n).tolist())


_MIT, _ISC = NOTICES["mit"], NOTICES["isc"]
ROWS = [
    (0, _prose(400)), (1, None), (2, ""), (3, " .,; \n"), (4, "Released under the MIT License."), (5, "GNU General  Public-License, version 3. CC BY-NC 4.0"),
    (6, f"{_prose(50)}\n{_MIT}\n{_prose(20)}"), (7, _MIT.replace("free of charge", "at no cost").replace("merge, ", "")), (8, " ".join(_MIT.split()[:30])),
    (9, f"{_ISC} {_ISC}"), (10, "cc by cc by cc by sa"), (10, "cc by cc by cc by sa"), (None, "apache license"), (11, "ccby mit\x00license éapache license"), (12, _prose(30_000)),
    (13, "CC BY" + " " + "x apache LICENSE, version 2.0"),
]


def _low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def _expected(text):
    w = WORD.findall(_low(text))
    at = {phrase: _places(w, phrase) for phrase in BASE}
    starts = sorted(i for found in at.values() for i in found)
    base = sorted({BASE[p] for p, found in at.items() if found})
    names = {NAMES[n] for n in NAMES if _places(w, " ".join(WORD.findall(n)))}
    ends = [starts[0], starts[-1]] if starts else [None, None]
    return (len(w), len(starts), *ends, ",".join(base)), sorted({*base, *names})


def test_phrases_and_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id LONG, text STRING, `row` STRING, `n.words` INT").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_license_scan(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 5 + ["string", "string", "double"]
    rows = got.collect()
    assert collections.Counter((r[0], *r[1:6]) for r in rows) == collections.Counter((i, *_expected(t)[0]) for i, t in ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    notices = {6: "mit", 7: "mit", 9: "isc"}
    for i, t in ROWS:
        assert by_id[i]["labels"] == ",".join(sorted({*_expected(t)[1], *([notices[i]] if i in notices else [])})), i
    assert all(0 <= r["score"] <= 1 for r in rows) and by_id[6]["score"] == by_id[4]["score"] == 1.0 and by_id[1]["score"] == 0.0
    assert 0.1 < by_id[8]["score"] < 0.5 and 0.7 < by_id[7]["score"] < 1


def test_spans_carry_rows_whole(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id LONG, text STRING, `row` STRING, `n.words` INT")
    found = license_scan.scan_licenses(docs)
    assert found.schema["row"].dataType.fieldNames() == ["doc_id", "row", "n.words"]
    by_id = {r["row"]["doc_id"]: r["spans"] for r in found.collect()}
    twice = [(s["start"], s["end"]) for s in by_id[9] if s["label"] == "isc"]
    n = len(WORD.findall(_low(_ISC)))
    assert twice == [(0, n), (n, 2 * n)]  # the copies lie on diagonals of their own
    assert [(s["start"], s["label"]) for s in by_id[4]] == [(3, "mit")] and by_id[1] == []
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_merged_diagonals(spark):
    """A word put in and one left out: three diagonals, one span, all template words but the missing one covered."""
    template = license_scan.Template("t", tuple(f"w{i}".encode() for i in range(20)), 0.7)
    words = [f"w{i}" for i in range(20)]
    text = " ".join(["x", *words[:6], "new", *words[6:13], *words[14:], "y"])
    docs = spark.createDataFrame([(1, text), (2, " ".join(words[:10])), (3, " ".join(reversed(words)))], "doc_id LONG, text STRING")
    got = {r["row"]["doc_id"]: r for r in license_scan.scan_licenses(docs, [template]).collect()}
    assert got[1]["labels"] == "t" and got[1]["score"] == 19 / 20 and [(s["start"], s["end"]) for s in got[1]["spans"]] == [(1, 21)]
    assert (got[2]["labels"], got[2]["score"], got[3]["score"], got[3]["n_base"]) == ("", 0.5, 0.0, 0)
