"""Duplicate passages by relative Lempel-Ziv parsing against content-defined reference blocks.

Every document is both text to factor and reference. Its reference blocks are the `block`-word sequences whose hash is
the smallest among the blocks of some `window`-word window. The choice depends on the window's words alone, so two
equal windows hold the same block at the same place, and a document need only be parsed against blocks it shares.

1. Index: one row per *run* (the windows of a document that chose the same block), keyed by the block. A run whose whole
   content occurs earlier is a match with the earliest place of that content, its reference. A run that is the first of its
   content, under a block that also occurs with other content, lies at a factor boundary.
2. Boundary check: the windows of boundary runs are compared one by one; those that also start earlier are matches.
3. Parse, from left to right: a match is extended greedily while the next one continues the same reference at the same offset.
   The factor so found, (start, words, reference document, reference start), is at least `window` words long and stands
   word for word at its reference; words of factors are removed. Factors may overlap, where a text runs from one reference
   into another.

Shuffled are about two rows for eleven words, ids and hashes only, then boundary windows, and the texts once for the
boundaries and once for the result. A block or window shared by a large part of the corpus is settled within each
slice of a task first, so that a slice hands on one row of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexitide.llm.common import row_schema, stored
from lexitide.llm.textarrays import Spans, Words, mix, slices

_RUN = "block LONG, content LONG, doc_id {t}, text_key LONG, lo INT, hi INT, later BOOLEAN, ref_id {t}, ref_lo INT"
_WINDOW = "content LONG, doc_id {t}, text_key LONG, lo INT, later BOOLEAN, ref_id {t}, ref_lo INT"
_FACTOR = "ARRAY<STRUCT<start: INT, n_words: INT, ref_id: {t}, ref_start: INT>>"


def _id_order(ids: pa.Array) -> np.ndarray:
    """Rows' order by id, equal for equal ids, null first."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _later(content: np.ndarray, order: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the same content begins earlier (smaller id, or same id and smaller start) in this slice, and the first place of each."""
    later, first = np.zeros(len(content), bool), np.zeros(len(content), np.int64)
    if len(content):
        by = np.lexsort((lo, order, content))
        c, o, s = content[by], order[by], lo[by]
        fresh = np.r_[True, c[1:] != c[:-1]]
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        later[by] = (o != o[head]) | (s != s[head])
        first[by] = by[head]
    return later, first


def _references(part: pa.RecordBatch, row: np.ndarray, lo: np.ndarray, later: np.ndarray, head: np.ndarray) -> list[pa.Array]:
    """`ref_id` and `ref_lo` of places that are settled in this slice, null for the others."""
    ids = part.column("doc_id").take(pa.array(row[head], mask=~later))
    return [ids, pa.array(lo[head].astype(np.int32), mask=~later)]


def _runs(batches: Iterator[pa.RecordBatch], window: int, block: int) -> Iterator[pa.RecordBatch]:
    width = window - block + 1
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            n = len(words) - window + 1
            if n <= 0:
                continue
            span = Spans(words.hashes())
            at = np.arange(len(words) - block + 1)
            blocks = span(at, at + block)
            # the smallest block hash of each window; among equal ones the rightmost
            best = np.full(n, 2**64 - 1, np.uint64)
            for j in range(width):
                np.minimum(best, (blocks[j : j + n] & ~np.uint64(63)) | np.uint64(width - 1 - j), out=best)
            start = np.flatnonzero(words.row[:n] == words.row[window - 1 :])
            if not len(start):
                continue
            anchor = start + width - 1 - (best[start] & np.uint64(63)).astype(np.int64)
            opens = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
            head = np.flatnonzero(opens)
            tail = np.r_[head[1:], len(start)] - 1
            lo, hi, anchor = start[head], start[tail], anchor[head]
            row = words.row[lo]
            content = mix(span(lo, hi + window) ^ (anchor - lo).astype(np.uint64))
            key = blocks[anchor]
            first = words.first[row]
            later, head = _later(content, _id_order(part.column("doc_id"))[row], lo - first)
            # a run settled here goes on under a key of its own
            key = np.where(later, mix(content + (row * 2654435761 + lo).astype(np.uint64)), key)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), part.column("doc_id").take(taken), part.column("text_key").take(taken),
                 pa.array((lo - first).astype(np.int32)), pa.array((hi - first).astype(np.int32)), pa.array(later), *_references(part, row, lo - first, later, head)],
                ["block", "content", "doc_id", "text_key", "lo", "hi", "later", "ref_id", "ref_lo"],
            )


def _boundary_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            runs = part.column("runs")
            sizes = pc.list_value_length(runs).to_numpy(zero_copy_only=False)
            flat = runs.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            many = hi - lo + 1
            row = np.repeat(row, many)
            lo = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            if not len(lo):
                continue
            start = lo + words.first[row]
            content = Spans(words.hashes())(start, start + window)
            later, head = _later(content, _id_order(part.column("doc_id"))[row], lo)
            content = np.where(later, mix(content + (row * 2654435761 + lo).astype(np.uint64)), content)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(content.view(np.int64)), part.column("doc_id").take(taken), part.column("text_key").take(taken), pa.array(lo.astype(np.int32)),
                 pa.array(later), *_references(part, row, lo, later, head)],
                ["content", "doc_id", "text_key", "lo", "later", "ref_id", "ref_lo"],
            )


def _factors(matches: list[dict]) -> list[dict]:
    """Matches `(lo, hi, ref_id, ref_lo)` of one document, each extended while the next goes on along the same reference."""
    out: list[dict] = []
    open_: dict[tuple, dict] = {}
    for m in sorted(matches, key=lambda m: (m["lo"], -m["hi"])):
        line = m["ref_id"], m["ref_lo"] - m["lo"]
        last = open_.get(line)
        if last is not None and m["lo"] <= last["hi"] + 1:
            last["hi"] = max(last["hi"], m["hi"])
        else:
            open_[line] = dict(m)
            out.append(open_[line])
    return out


def _parse(batches: Iterator[pa.RecordBatch], window: int, texts: bool, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("ref_id", id_type), ("ref_start", pa.int32())]))
    for batch in batches:
        batch = batch.append_column("text", pc.struct_field(batch.column("row"), "text"))
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            n_words = np.diff(words.first)
            factors, removed, kept, digests = [], [], [], []
            for i, spans in enumerate(part.column("spans").to_pylist()):
                found = _factors(spans or [])
                gone = np.zeros(n_words[i], bool)
                for f in found:
                    gone[f["lo"] : f["hi"] + window] = True
                at = words.first[i]
                left = np.flatnonzero(~gone) + at
                text = b" ".join([words.data[s:e].tobytes() for s, e in zip(words.start[left], words.end[left])])
                factors.append([{"start": f["lo"], "n_words": f["hi"] - f["lo"] + window, "ref_id": f["ref_id"], "ref_start": f["ref_lo"]} for f in found])
                removed.append(int(gone.sum()))
                kept.append(text.decode() if texts else None)
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string()), pa.array(factors, kind)],
                ["row", "n_words", "n_removed", "kept_text", "kept_sha256", "factors"],
            )


def remove_duplicate_passages(docs: DataFrame, window: int = 20, block: int = 10, texts: bool = True) -> DataFrame:
    """`docs` with `n_words`, `n_removed`, `kept_text`, `kept_sha256` and `factors` added.

    Factors have `start`, `n_words`, `ref_id` and `ref_start`: the document (null for one without an id) and the word where they
    also stand, earlier. `kept_text` holds the kept words joined by one space, or null if `texts` is false.

    A word goes if a `window`-word window over it also starts earlier: in a smaller `doc_id`, or in the same one at an
    earlier word. A null text has no words. Rows with one `doc_id` count as one document: the same window at the same
    start in two of them is no repetition. A null id comes before all others. Columns of `docs` with the names of the
    added ones are replaced; an empty table gives an empty result.
    """
    if not 1 <= block <= window or window - block >= 63:
        raise ValueError(f"block {block} does not fit window {window}")
    added = ["n_words", "n_removed", "kept_text", "kept_sha256", "factors"]
    docs = docs.drop(*added)
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    runs = base.mapInArrow(lambda it: _runs(it, window, block), _RUN.format(t=kind))
    ordered = runs.repartition("block").sortWithinPartitions("block", "content", "doc_id", "lo")
    of_block = Window.partitionBy("block")
    alike = Window.partitionBy("block", "content").orderBy("doc_id", "lo")
    place, first = F.rank().over(alike), F.first(F.struct("doc_id", "lo")).over(alike)
    many = F.min("content").over(of_block) != F.max("content").over(of_block)
    seen = ordered.withColumns({"many": many, "first": first}).withColumn("sure", F.col("later") | (place > 1)).where("sure OR many")
    refs = [F.when(F.col("later"), F.col(f"ref_{c}")).otherwise(F.col(f"first.{c if c == 'lo' else 'doc_id'}")).alias(f"ref_{c}") for c in ("id", "lo")]
    spans = stored(seen.select("doc_id", "text_key", "lo", "hi", "sure", *refs), "factors")

    boundary = spans.where("NOT sure").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    asked = _same_row(base, boundary, "inner").select("doc_id", "text_key", "text", "runs")
    windows = asked.mapInArrow(lambda it: _boundary_windows(it, window), _WINDOW.format(t=kind))
    alike = Window.partitionBy("content").orderBy("doc_id", "lo")
    told = windows.withColumns({"again": F.rank().over(alike) > 1, "first": F.first(F.struct("doc_id", "lo")).over(alike)}).where("later OR again")
    checked = told.select("doc_id", "text_key", "lo", F.col("lo").alias("hi"), *refs)

    found = spans.where("sure").select("doc_id", "text_key", "lo", "hi", "ref_id", "ref_lo").unionByName(checked)
    per_doc = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi", "ref_id", "ref_lo")).alias("spans"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))
    out = row_schema(whole, f"n_words LONG, n_removed LONG, kept_text STRING, kept_sha256 STRING, factors {_FACTOR.format(t=kind)}")
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    parsed = _same_row(whole, per_doc, "left").select("row", "spans").mapInArrow(lambda it: _parse(it, window, texts, id_type), out)
    return parsed.select("row.*", *added)


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the row's id (null equals null) and text."""
    right = right.withColumnsRenamed({"doc_id": "other_id", "text_key": "other_key"})
    on: Column = left["doc_id"].eqNullSafe(right["other_id"]) & (left["text_key"] == right["other_key"])
    return left.join(right, on, how)
