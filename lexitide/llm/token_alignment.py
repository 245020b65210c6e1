"""How two tokenizers cut the same texts: common boundaries, groups of tokens between them, and counts of token pairs.

Tokenizer A is byte-level BPE and reads a space and the text; B is a sentence-piece model with byte fallback, which puts
that space before the text itself. Where the bytes of their tokens both spell space and text, the ends of A's and B's
tokens are offsets in the same bytes.

1. Rows are shuffled by full text, so that each distinct text is tokenized and aligned once, with its number of copies.
2. A task aligns its texts in chunks of bounded size: measures and links per text, and each distinct pair of the chunk once
   with its count, weighted by copies.
3. Pair counts are summed over the chunks. Each chunk asks for its distinct pairs and gets their counts, once per pair.
4. Measures go back to the rows by a digest of the text.

The most frequent pair is asked for once per chunk, as are all other frequent ones; a group of copies is one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import stored
from lexitide.llm.textarrays import slices
from lexitide.llm.tokenfiles import gather, piece_encoder, tokenizer

CHUNK_BYTES = 1 << 20
KEPT = 100_000  # pieces that a worker remembers in each of two generations
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = "chunk BINARY, pairs ARRAY<LONG>, counts ARRAY<LONG>, texts ARRAY<STRUCT<key: BINARY, n_a: LONG, n_b: LONG, n_groups: LONG, n_links: LONG, groups_sha256: STRING, links: BINARY>>"
_ANSWER = "key BINARY, n_a LONG, n_b LONG, n_groups LONG, n_links LONG, n_best LONG, count_sum LONG, groups_sha256 STRING"


# ---- tokenizers


def _byte_of_symbol() -> dict[str, int]:
    """Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """A tokenizer's function from texts to ids, and the bytes of its tokens, end to end."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], tokens: list[bytes]):
        self.encode = encode  # to the ids of all texts and the number of ids of each
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`(ids of all texts, number of ids before each text and in all)`."""
        ids, sizes = self.encode(texts)
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def spelt(self, ids: np.ndarray) -> bytes:
        return gather(self.data, self.start, ids).tobytes()


@lru_cache(maxsize=2)
def byte_level(path: str) -> Vocabulary:
    """A: special tokens' strings are plain text, and a space goes before each text."""
    t = tokenizer(path, special=False)
    width = 2 if t.get_vocab_size() <= 65536 else 4
    encoded = piece_encoder(path, width, special=False, kept=KEPT)
    symbols = _byte_of_symbol()
    added = t.get_added_tokens_decoder()
    pieces = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    spelt = [added[i].content.encode() if i in added else bytes(symbols[c] for c in p) for i, p in enumerate(pieces)]

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [encoded(f" {x}") for x in texts]
        sizes = np.array([len(x) for x in found], np.int64) // width
        return np.frombuffer(b"".join(found), f"u{width}").astype(np.int64), sizes

    return Vocabulary(encode, spelt)


@lru_cache(maxsize=2)
def sentence_piece(path: str) -> Vocabulary:
    """B: a piece spells itself with U+2581 as space, a byte token its byte, a control token nothing."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)

    def spelt(i: int) -> bytes:
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace("▁", " ").encode()

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = sp.encode(texts, num_threads=1)
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    return Vocabulary(encode, [spelt(i) for i in range(sp.get_piece_size())])


# ---- alignment


@lru_cache(maxsize=2)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids below n in decimals before each of the separators `,|;`: zero-padded bytes by `[3 * id + separator]`, and lengths."""
    spelt = [f"{i}{c}".encode() for i in range(n) for c in ",|;"]
    width = max(map(len, spelt))
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in spelt), np.uint8).reshape(-1, width), np.array([len(s) for s in spelt])


def _take(ids: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the given texts only, with their bounds."""
    return gather(ids, bounds, rows), np.concatenate([[0], np.cumsum((bounds[1:] - bounds[:-1])[rows])])


class Alignment:
    """Texts cut by A and B: per text counts, the digest of its groups, and the id pair of every link."""

    def __init__(self, a: Vocabulary, b: Vocabulary, texts: list[str]):
        n = len(texts)
        (ids_a, bounds_a), (ids_b, bounds_b) = a(texts), b(texts)
        wanted = [f" {t}".encode() if t else b"" for t in texts]
        good = [
            w != b"" and a.spelt(ids_a[bounds_a[i] : bounds_a[i + 1]]) == w and b.spelt(ids_b[bounds_b[i] : bounds_b[i + 1]]) == w
            for i, w in enumerate(wanted)
        ]
        rows = np.flatnonzero(good)
        ids_a, bounds_a = _take(ids_a, bounds_a, rows)
        ids_b, bounds_b = _take(ids_b, bounds_b, rows)
        # every text fills the same bytes in both, so offsets may run on over all texts
        ends_a, ends_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
        text_ends = np.cumsum([len(wanted[i]) for i in rows]).astype(np.int64)
        marks = np.zeros(int(text_ends[-1]) + 1 if len(rows) else 1, np.uint8)
        marks[ends_a] += 1
        marks[ends_b] += 2
        both_a, both_b = marks[ends_a] == 3, marks[ends_b] == 3
        at_a, at_b = np.flatnonzero(both_a), np.flatnonzero(both_b)
        self.text = rows[np.searchsorted(text_ends, ends_a[at_a])]  # of each group, whose last tokens are its link
        self.pairs = (ids_a[at_a] << 32) | ids_b[at_b]
        self.n_a, self.n_b, self.n_groups = np.zeros(n, np.int64), np.zeros(n, np.int64), np.bincount(self.text, minlength=n)
        self.n_a[rows], self.n_b[rows] = np.diff(bounds_a), np.diff(bounds_b)
        self.digests = [""] * n
        spelt, sizes = _listed(ids_a, ids_b, both_a, both_b, max(len(a.size), len(b.size)))
        ends = np.cumsum(sizes)
        last = bounds_a[1:] + bounds_b[1:] - 1
        lo = 0
        for i, hi in zip(rows.tolist(), ends[last].tolist() if len(rows) else [], strict=True):
            self.digests[i] = hashlib.sha256(spelt[lo : hi - 1]).hexdigest()
            lo = hi


def _listed(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_ids: int) -> tuple[bytes, np.ndarray]:
    """All groups as `a1,a2|b1;...` in one string, and the length of each token's part of it; `last` marks a group's last tokens."""
    table, length = _decimals(n_ids)
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    b_before = np.concatenate([[0], np.flatnonzero(last_b) + 1])  # B tokens before each group
    a_through = np.flatnonzero(last_a) + 1  # A tokens through each group
    code[np.arange(len(ids_a)) + b_before[group_a]] = 3 * ids_a + last_a
    code[np.arange(len(ids_b)) + a_through[group_b]] = 3 * ids_b + 2 * last_b
    flat = table[code].ravel()
    return flat[flat != 0].tobytes(), length[code]


def _align(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    a, b = byte_level(path_a), sentence_piece(path_b)
    for batch in batches:
        for part in slices(batch, "text", chunk_bytes):
            texts, keys = part.column("text").to_pylist(), part.column("key")
            copies = part.column("copies").to_numpy()
            found = Alignment(a, b, texts)
            link, pairs = pd.factorize(found.pairs)
            order = np.argsort(pairs)
            place = np.empty(len(pairs), np.int64)
            place[order] = np.arange(len(pairs))
            pairs, link = pairs[order], place[link]
            counts = np.bincount(link, weights=copies[found.text], minlength=len(pairs)).astype(np.int64)
            # in order within each text, which packs better
            links = (np.sort(found.text * max(1, len(pairs)) + link) % max(1, len(pairs))).astype(np.int32)
            ends = (4 * np.concatenate([[0], np.cumsum(found.n_groups)])).astype(np.int32)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(links)])
            numbers = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_groups)]
            rows = pa.StructArray.from_arrays([keys, *numbers, pa.array(found.digests, pa.string()), blobs], ["key", *MEASURES, "groups_sha256", "links"])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(pairs, pa.int64()), pa.array(counts, pa.int64()), rows)]
            yield pa.RecordBatch.from_arrays([keys.slice(0, 1), *lists], ["chunk", "pairs", "counts", "texts"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            texts = batch.column("texts")[i].values
            found = batch.column("found")[i].values
            n_links = texts.field("n_links").to_numpy()
            count_sum, n_best = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            if found is not None and n_links.any():
                order = np.argsort(found.field("pair").to_numpy())  # as numbered in the chunk
                links = np.frombuffer(b"".join(texts.field("links").to_pylist()), np.int32)
                some = n_links > 0
                starts = (np.cumsum(n_links) - n_links)[some]
                count_sum[some] = np.add.reduceat(found.field("count").to_numpy()[order][links], starts)
                n_best[some] = np.add.reduceat(found.field("best").to_numpy(zero_copy_only=False)[order][links].astype(np.int64), starts)
            columns = [texts.field("key"), *[texts.field(m) for m in MEASURES], pa.array(n_best), pa.array(count_sum), texts.field("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, ["key", *MEASURES, "n_best", "count_sum", "groups_sha256"])


def _key() -> F.Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def align_texts(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`(chunk, pairs, counts, texts)`, stored: each distinct text of `docs` aligned once, by chunks (see the module)."""
    distinct = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = distinct.select("text", "copies", _key().alias("key"))
    return stored(keyed.mapInArrow(lambda it: _align(it, path_a, path_b, chunk_bytes), _ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """`(pair, a_id, b_id, count, best)`: links of every id pair in the corpus, and whether no A id has more with the B id.

    The rows are pairs of vocabulary entries; those of one B id are at most as many as A has entries.
    """
    each = aligned.select(F.inline(F.arrays_zip("pairs", "counts")))
    summed = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("count"))
    told = summed.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(2**32 - 1)).alias("b_id"), "count")
    return told.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b_id")))


def cross_align(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`doc_id` of every row of `docs` with `n_a n_b n_groups n_links n_best count_sum groups_sha256` of its text.

    A null or empty text, or one that A's or B's tokens don't spell byte by byte, has no tokens: zeros and an empty string.
    Tokens are never empty (control tokens don't occur in texts), so a group has one link: its last tokens. Rows that repeat, with or
    without an id, count as often as they occur and are all returned. Other columns are not read; an empty table gives none.
    Texts meet their measures by SHA-256.
    """
    aligned = align_texts(docs, path_a, path_b, chunk_bytes)
    counts = stored(pair_counts(aligned).select("pair", "count", "best"), "pairs")
    asked = aligned.select("chunk", F.explode("pairs").alias("pair"))
    found = asked.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    told = aligned.select("chunk", "texts").join(found, "chunk", "left").select("texts", "found")
    measures = stored(told.mapInArrow(_answer, _ANSWER), "measures")
    return docs.select("doc_id", _key().alias("key")).join(measures, "key", "left").drop("key")
