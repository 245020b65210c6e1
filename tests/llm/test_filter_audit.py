"""The filter audit against plain Python, and the transducer's hash table with forced collisions."""

from __future__ import annotations

import collections
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from lexitide.llm import filter_audit
from lexitide.llm.queries import op12_filter_audit
from lexitide.llm.transducer import CAPITAL, POINT, START, SYMBOL, Pass, first_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RNG = np.random.default_rng(5)
_VOCAB = ["the", "The", "of", "naïve", "日本", "x#1", "A|B", "é", "nbsp word", "end\x1cof", "ﬁ"]


def _prose(n, vocab=_VOCAB):
    return " ".join(_RNG.choice(vocab, n).tolist())


_MANY = [f"w{i}" for i in range(2000)]
_LONG = _prose(400, _MANY)
ROWS = [
    (0, _prose(40), "en"), (1, None, "en"), (2, "", None), (3, " \t\n", ""), (4, _LONG, "de"), (5, _LONG, "en"), (5, _LONG, "en"), (6, _LONG, "fr"), (None, _LONG, "en"),
    (7, _prose(300, _MANY) + " #", "en"), (8, "BIG " * 250, "en"), (9, _prose(250, _MANY) + "AAAA " * 40, "de"), (10, _prose(40_000, _MANY), "en"), (None, "lone", None),
    (12, "a\x0bb\x0cc\rd e", "de"), (13, "one", "de"), (11, "one", "fr"),
]
LABELS = [(0, 1, 0), (4, 1, 1), (5, 1, 0), (5, 0, 1), (6, 0, 1), (7, None, None), (8, 1, 1), (99, 1, 1), (None, 1, 1)]


def _expected():
    texts = [(i, t or "", p or "") for i, t, p in ROWS]
    low = {}
    for i, t, _ in texts:
        if i is not None:
            low[t] = min(low.get(t, i), i)
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, x in LABELS if x == 1 and i is not None}
    docs = []
    for i, t, p in texts:
        w = WORD.findall(t)
        hits = [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            re.search(r"[#$%&*|]", t) is not None, i is not None and low[t] < i,
        ]
        docs.append((p, {c for c, h in zip("ABCDE", hits, strict=True) if h}, i in good, i in toxic))
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    out, shapley = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in orders:
            for step in range(1, 6):
                x, before = order[step - 1], set(order[: step - 1])
                gone = [d for d in mine if x in d[1] and not d[1] & before]
                shapley[part, x] += len(gone)
                kept = sum(not d[1] & (before | {x}) for d in mine)
                redundant = sum(x in d[1] and bool(d[1] & before) for d in mine)
                out[part, order, step] = (kept, len(gone), redundant, sum(d[1] == {x} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone))
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_all_orders(spark, tmp_path):
    rows = [(i, t, p, "x", 0) for i, t, p in ROWS]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, `own` STRING, `n.words` INT").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id LONG, quality INT, toxic INT")
    got = filter_audit.audit(docs, labels)
    want = _expected()
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) == 600 * 4
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    query = op12_filter_audit(spark, str(tmp_path))
    assert query.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in query.collect()} == want
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_counts_of_one_pass():
    texts = ["a  Bé#", None, "", "x", " y", "z ", "日本 \U0001f600 AB|"]
    seen = Pass(pa.array(texts))
    plain = [t or "" for t in texts]
    assert seen.count(START).tolist() == [len(WORD.findall(t)) for t in plain]
    assert seen.count(POINT).tolist() == [len(t) for t in plain]
    assert seen.count(CAPITAL).tolist() == [len(re.findall("[A-Z]", t)) for t in plain]
    assert seen.count(SYMBOL).tolist() == [len(re.findall(r"[#$%&*|]", t)) for t in plain]


@pytest.mark.parametrize("bits", [0, 1, 4, 64])
def test_words_are_told_apart_by_bytes(bits):
    """Whatever the hash says: with none of its bits, every span starts at the same slot."""
    texts = ["aa bb aa b bb cc", "aa aa dd", "", "bb bb bb", _prose(200)]
    seen = Pass(pa.array(texts))
    first = first_spans(seen.data, seen.start, seen.end, seen.row, bits)
    assert np.bincount(seen.row[first], minlength=len(texts)).tolist() == [len(set(WORD.findall(t))) for t in texts]
