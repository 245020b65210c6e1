"""License names and notices in texts, by votes of word k-grams on offset diagonals.

1. One scan turns each text into runs of words that occur in some template, as word numbers; all other words end a run,
   for no gram that holds one can match. Runs and word counts are stored; texts don't move.
2. Spark joins the rolling k-grams of the runs with the templates' k-grams, by hash and then word by word.
3. A hit votes for the diagonal (place in the text minus place in the template) of its template. Votes are counted per text,
   template and diagonal; neighbouring diagonals, which an inserted or missing word sets apart, are merged.
4. A merged span is verified by the share of the template's words that its grams cover.

A text's votes for one diagonal are at most as many as the template has grams. Templates are few; their grams are broadcast
only below a stated number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitide.llm.common import row_schema, stored
from lexitide.llm.license_templates import BASE, NAMES, NOTICES
from lexitide.session import BROADCAST_ROWS

GRAM = 4  # words; shorter templates are one gram
NOTICE_SHARE = 0.7  # of a notice's words
DRIFT = 4  # words that neighbouring diagonals of a notice may lie apart

_SOLID = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _SOLID or b >= 128 else 32 for b in range(256))
_RUNS = "ARRAY<STRUCT<start: INT, ids: ARRAY<INT>>>"


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters, in UTF-8."""
    return text.encode().translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    """Words with a label; `least` is the share of them that a span must cover, `base` tells the contract's phrases."""

    label: str
    words: tuple[bytes, ...]
    least: float = 1.0
    base: bool = False

    @property
    def gram(self) -> int:
        return min(GRAM, len(self.words))

    @property
    def drift(self) -> int:
        return DRIFT if self.least < 1 else 0


def default_templates() -> list[Template]:
    phrases = [Template(label, tuple(words(text)), base=True) for text, label in BASE.items()]
    names = [Template(label, tuple(words(text))) for text, label in NAMES.items()]
    return phrases + names + [Template(label, tuple(words(text)), NOTICE_SHARE) for label, text in NOTICES.items()]


# ---- runs of template words


def _ragged(lengths: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]), pa.int32()), values)


def _runs(batches: Iterator[pa.RecordBatch], known: dict[bytes, int], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_runs, starts, sizes, ids = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            found = words(text or "")
            numbers = np.fromiter(map(known.get, found, repeat(-1)), np.int32, len(found))
            edges = np.flatnonzero(np.diff(np.concatenate([[False], numbers >= 0, [False]]).astype(np.int8)))
            lo, hi = edges[::2], edges[1::2]
            lo, hi = lo[hi - lo >= least], hi[hi - lo >= least]
            n_words.append(len(found))
            n_runs.append(len(lo))
            starts += lo.tolist()
            sizes += (hi - lo).tolist()
            ids += [numbers[a:b] for a, b in zip(lo, hi, strict=True)]
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        runs = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), _ragged(sizes, flat)], ["start", "ids"])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_words, pa.int64()), _ragged(n_runs, runs)], ["row", "n_words", "runs"])


def _numbered(templates: Sequence[Template]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(sorted({w for t in templates for w in t.words}))}


# ---- diagonals


def _template_grams(spark: SparkSession, templates: Sequence[Template], known: dict[bytes, int]) -> DataFrame:
    """`(hash, gram, template, at)`: every rolling gram of every template; broadcast if few."""
    rows = [
        ([known[w] for w in t.words[at : at + t.gram]], number, at)
        for number, t in enumerate(templates)
        for at in range(len(t.words) - t.gram + 1)
    ]
    grams = spark.createDataFrame(rows, "words ARRAY<INT>, template INT, at INT").select(F.xxhash64("words").alias("hash"), "words", "template", "at")
    return F.broadcast(grams) if len(rows) <= BROADCAST_ROWS else grams


def _template_facts(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    rows = [(i, t.label, len(t.words), t.gram, t.drift, t.least, t.base) for i, t in enumerate(templates)]
    facts = spark.createDataFrame(rows, "template INT, label STRING, length INT, k INT, drift INT, least DOUBLE, base BOOLEAN")
    return F.broadcast(facts) if len(rows) <= BROADCAST_ROWS else facts


def spans(runs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """`(rid, label, base, start, end, share, found)` of merged diagonals of `runs(rid, runs)`.

    `start` and `end` (exclusive) are words of the text, `share` the part of the template's words that verified grams cover
    there, `found` whether that is enough.
    """
    spark = runs.sparkSession
    known = _numbered(templates)
    sizes = F.explode(F.lit(sorted({t.gram for t in templates}))).alias("k")
    lone = runs.select("rid", F.inline("runs")).select("rid", "start", "ids", sizes).where(F.size("ids") >= F.col("k"))
    # a run's grams; the sequence starts at 0 and never runs backwards, as runs have k words or more
    each = F.transform(F.sequence(F.lit(0), F.size("ids") - F.col("k")), lambda i: F.struct((F.col("start") + i).alias("place"), F.slice("ids", i + 1, F.col("k")).alias("gram")))
    grams = lone.select("rid", F.inline(each)).select("rid", "place", "gram", F.xxhash64("gram").alias("hash"))
    theirs = _template_grams(spark, templates, known)
    hits = grams.join(theirs, (grams["hash"] == theirs["hash"]) & (grams["gram"] == theirs["words"]))
    votes = hits.groupBy("rid", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    told = votes.join(_template_facts(spark, templates), "template")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > F.col("drift")).cast("int"), F.lit(0))
    grouped = told.withColumn("apart", apart).withColumn("merged", F.sum("apart").over(along))
    covered = F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1)))
    ends = [F.min(F.col("diagonal") + F.array_min("ats")).alias("start"), F.max(F.col("diagonal") + F.array_max("ats") + F.col("k")).alias("end")]
    merged = grouped.groupBy("rid", "template", "merged", "label", "length", "least", "base").agg(F.size(F.array_distinct(F.flatten(F.collect_list(covered)))).alias("n"), *ends)
    share = F.col("n") / F.col("length")
    return merged.select("rid", "label", "base", F.col("start").cast("long"), F.col("end").cast("long"), share.alias("share"), (share >= F.col("least")).alias("found"))


# ---- documents


def scan_licenses(docs: DataFrame, templates: Sequence[Template] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` of every row (by default all but `text`), as struct `row`, with what the templates find in its text.

    `n_words`; of base phrases `n_base` (places), `first_word` and `last_word` (smallest and largest start, null without any) and
    `base_labels`; `labels` with those of all verified spans; `score`, the largest share of a template's words in one span;
    `spans`, the verified spans as `(label, start, end)` in order. Lists of labels are distinct, sorted and joined by commas.

    A null text is empty. Every row is looked at by itself, so rows that repeat have the same result each; a text of any length is
    one row of the scan. Names of columns are free, as the row is carried whole. An empty table gives none.
    """
    templates = default_templates() if templates is None else list(templates)
    keep = [c for c in docs.columns if c != "text"] if keep is None else list(keep)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
    known, least = _numbered(templates), min(t.gram for t in templates)
    found = rows.mapInArrow(lambda it: _runs(it, known, least), row_schema(rows, f"n_words LONG, runs {_RUNS}"))
    scanned = stored(found.select(F.monotonically_increasing_id().alias("rid"), "*"), "license-runs")
    place = F.when(F.col("base") & F.col("found"), F.col("start"))
    by_row = spans(scanned.select("rid", "runs"), templates).groupBy("rid").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        F.collect_set(F.when(place.isNotNull(), F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(F.col("found"), F.col("label"))).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("start", "end", "label")))).alias("spans"),
    )
    listed = [F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c) for c in ("base_labels", "labels")]
    told = scanned.select("rid", "row", "n_words").join(by_row, "rid", "left")
    return told.select(
        "row", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", *listed,
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array()).alias("spans"),
    )
