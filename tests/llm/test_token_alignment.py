"""Two tokenizers aligned on the same texts, against plain Python over every pair of token ends."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexitide.llm import token_alignment
from lexitide.llm.queries import op13_cross_tokenizer

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_RNG = np.random.default_rng(11)
_VOCAB = ["the", "of", "Über", "naïve", "x1", "don't", "日本", "é", "<|endoftext|>", "tail nbsp", "ﬁ", "</s>", "\U0001f600", "  ", "\n\n", "\t", "1234567", "<0x41>"]


def _prose(n):
    return " ".join(_RNG.choice(_VOCAB, n).tolist())


_COPY = _prose(30)
ROWS = [
    (0, _prose(60)), (1, None), (2, ""), (3, " "), (4, "a"), (5, " leading"), (6, "x▁y is spelt otherwise"), (7, _COPY), (8, _COPY), (8, _COPY), (None, _COPY),
    (9, "\0 nul"), (10, _prose(5000)), (11, "the the the of of"), (12, "of the"), (13, "\n"), (14, "tail  "), (15, "<unk><s>"), (16, "③①"),
]


def _tokens():
    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=B_PATH)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbol = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}

    def a(text):
        return [(i, bytes(symbol[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]

    def b(text):
        return [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]

    return a, b


def _expected(rows):
    a, b = _tokens()
    found, count = [], collections.Counter()
    for i, text in rows:
        x, y = a(text or ""), b(text or "")
        whole = f" {text}".encode()
        if not text or b"".join(s for _, s in x) != whole or b"".join(s for _, s in y) != whole:
            found.append((i, 0, 0, [], ""))
            continue
        ends_a = np.cumsum([len(s) for _, s in x]).tolist()
        ends_b = np.cumsum([len(s) for _, s in y]).tolist()
        links = [(x[j][0], y[k][0]) for j, e in enumerate(ends_a) for k, f in enumerate(ends_b) if e == f] if len(x) < 500 else None
        both = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for end in both:
            groups.append("|".join(",".join(str(t) for (t, _), e in zip(toks, ends, strict=True) if low < e <= end) for toks, ends in ((x, ends_a), (y, ends_b))))
            low = end
        if links is None:
            links = [(x[ends_a.index(e)][0], y[ends_b.index(e)][0]) for e in both]
        count.update(links)
        found.append((i, len(x), len(y), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    high = collections.Counter()
    for (_, q), n in count.items():
        high[q] = max(high[q], n)
    out = collections.Counter()
    for i, n_a, n_b, links, digest in found:
        out[i, n_a, n_b, len(links), len(links), sum(count[p] == high[p[1]] for p in links), sum(count[p] for p in links), digest] += 1
    return out


def test_alignment(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", b"x", 1) for i, t in ROWS], "doc_id LONG, text STRING, lang STRING, `key` BINARY, `copies` INT").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_cross_tokenizer(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    want = _expected(ROWS)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    small = token_alignment.cross_align(docs, A_PATH, B_PATH, chunk_bytes=300).select(got.columns)
    assert collections.Counter(tuple(r) for r in small.collect()) == want


def test_pairs_and_nothing(spark):
    docs = spark.createDataFrame([(1, "of the"), (2, "of the"), (3, None)], "doc_id LONG, text STRING")
    aligned = token_alignment.align_texts(docs, A_PATH, B_PATH)
    counts = {(r["a_id"], r["b_id"]): (r["count"], r["best"]) for r in token_alignment.pair_counts(aligned).collect()}
    a, b = _tokens()
    assert counts == {(x[0], y[0]): (2, True) for x, y in zip(a("of the"), b("of the"), strict=True)}
    assert token_alignment.cross_align(docs.limit(0), A_PATH, B_PATH).count() == 0
    lone = token_alignment.cross_align(docs.where("doc_id = 3"), A_PATH, B_PATH).collect()
    assert [tuple(r) for r in lone] == [(3, 0, 0, 0, 0, 0, 0, "")]
