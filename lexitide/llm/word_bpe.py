"""Encode and decode texts with a word-end BPE vocabulary through a table of distinct words.

Words are split at ASCII white space, which such a vocabulary drops and never merges over, so that a text's ids are its
words' ids in order.

1. Each chunk of documents (bounded size) sends its distinct words to the word table, by a hash of the word.
2. The word table encodes every distinct word once and answers each chunk.
3. A chunk's documents look up their words' ids by position. Decoding joins ids with the vocabulary's pieces; pieces of a
   word stay together, so a chunk does that once per word as well.

Texts move once, packed; words move once per chunk and not per occurrence, so frequent words are never hot.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lexitide.llm.chunks import chunk_count, chunks, rows_of, texts, unpacked, with_words
from lexitide.llm.tokenfiles import encode_words, gather, tokenizer


def _by_bucket(documents: Iterable[list[bytes]], buckets: int) -> dict[int, list[bytes]]:
    """Distinct words of documents, sorted, by bucket."""
    distinct: set[bytes] = set()
    for words in documents:
        distinct.update(words)
    out: dict[int, list[bytes]] = {}
    for word in sorted(distinct):
        out.setdefault(zlib.crc32(word) % buckets, []).append(word)
    return out


def _words(held: list[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in held:
        for text in texts(batch).to_pylist():
            yield text.encode().split()


def _distinct(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for key, held in chunks(batches):
        found = _by_bucket(_words(held), buckets)
        blobs = [zstandard.compress(b"\n".join(w), 3) for w in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([key] * len(found), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "words"])


def _pack_ids(ids: list[list[int]]) -> bytes:
    sizes = np.fromiter(map(len, ids), "<u4", len(ids))
    flat = np.fromiter((i for x in ids for i in x), "<u4", int(sizes.sum()))
    return zstandard.compress(np.r_[np.array([len(ids)], "<u4"), sizes, flat].astype("<u4").tobytes(), 3)


def _unpack_ids(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), "<u4")
    return raw[1 : raw[0] + 1].astype(np.int64), raw[raw[0] + 1 :]


def _encode_bucket(rows: pa.Table, path: str) -> pa.Table:
    known: dict[bytes, list[int]] = {}
    seen, answers = [], []
    for chunk, blob in zip(rows.column("chunk").to_pylist(), rows.column("words").to_pylist(), strict=True):
        if chunk in seen:  # equal chunks ask the same
            continue
        words = zstandard.decompress(blob).split(b"\n")
        fresh = [w for w in words if w not in known]
        known.update(zip(fresh, encode_words(path, [w.decode() for w in fresh]), strict=True))
        seen.append(chunk)
        answers.append(_pack_ids([known[w] for w in words]))
    bucket = rows.column("bucket")[0].as_py()
    return pa.table([pa.array(seen, pa.int64()), pa.array([bucket] * len(seen), pa.int32()), pa.array(answers, pa.binary())], ["chunk", "bucket", "found"])


def _digest(batches: Iterator[pa.RecordBatch], path: str, buckets: int, payload: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path)
    pieces = [(t.id_to_token(i) or "").encode() for i in range(t.get_vocab_size())]
    for outer in batches:
        for blob, answers in zip(outer.column("docs"), outer.column("words"), strict=True):
            held = unpacked(blob.as_py())
            asked = _by_bucket(_words(held), buckets)
            answers = {a["bucket"]: a["found"] for a in answers.as_py() or ()}
            order = [w for words in asked.values() for w in words]
            got = [_unpack_ids(answers[b]) if b in answers else _unpack_ids(_pack_ids(encode_words(path, [w.decode() for w in words]))) for b, words in asked.items()]
            sizes = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
            ids = np.concatenate([g[1] for g in got]).astype("<u4") if got else np.zeros(0, "<u4")
            start = np.r_[0, np.cumsum(sizes)]
            bounds = start.tolist()
            # joined to the vocabulary's pieces, once per distinct word
            spelt = list(map(pieces.__getitem__, ids.tolist()))
            decoded = [b" ".join(spelt[a:b]) for a, b in zip(bounds, bounds[1:])]
            place = dict(zip(order, range(len(order)), strict=True))
            del spelt
            for batch in (b.slice(i, 256) for b in held for i in range(0, len(b), 256)):
                out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                for text in texts(batch).to_pylist():
                    at = list(map(place.__getitem__, text.encode().split()))
                    mine = gather(ids, start, np.array(at, np.int64)).tobytes()
                    # a word without pieces leaves no separator
                    spelling = b" ".join([d for d in map(decoded.__getitem__, at) if d])
                    out["n_tokens"].append(len(mine) // 4)
                    out["ids_sha256"].append(hashlib.sha256(mine).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(spelling).hexdigest())
                    out["ids"].append(mine if "ids" in payload else None)
                    out["decoded"].append(spelling.decode() if "decoded" in payload else None)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], ["row", *out])


def encode_and_decode(docs: DataFrame, tokenizer_path: str, payload: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """`docs` with `n_tokens`, `ids_sha256`, `decoded_sha256`, `ids` and `decoded` added.

    `ids` are little-endian unsigned 32-bit integers of the whole text, as the tokenizer gives them without special
    tokens, truncation or padding; `decoded` is its decoding of them. Either is null unless `payload` names it. A null text is
    empty and has no ids. Columns of `docs` with these names are replaced; rows that repeat stay; an empty table gives
    an empty result. The tokenizer must have no decoder, as word-end vocabularies have none.
    """
    if tokenizer(tokenizer_path).decoder is not None:
        raise ValueError("this tokenizer decodes by rules of its own; the id-to-piece join needs one without a decoder")
    added = {"n_tokens": "LONG", "ids_sha256": "STRING", "decoded_sha256": "STRING", "ids": "BINARY", "decoded": "STRING"}
    docs = docs.drop(*added)
    buckets = chunk_count(docs)
    rows = rows_of(docs)
    words = rows.mapInArrow(lambda it: _distinct(it, buckets), "bucket INT, chunk LONG, words BINARY")
    encoded = words.groupBy("bucket").applyInArrow(lambda t: _encode_bucket(t, tokenizer_path), "chunk LONG, bucket INT, found BINARY")
    out = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in added.items())
    done = with_words(docs, encoded).mapInArrow(lambda it: _digest(it, tokenizer_path, buckets, payload), out)
    return done.select("row.*", *added)
