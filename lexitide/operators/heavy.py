"""The most frequent terms among very many: a mergeable sketch names candidates, a second pass counts only them.

Every task keeps at most `counters` terms (Misra-Gries): when it holds more, the count of the first one too many is taken off all, and
terms left with nothing go. So a task's count is too small by at most what it took off, and so is the sum over tasks by the sum
`error` of these; a term that no task kept occurs at most `error` times. The candidates are counted exactly. If enough of them
occur more often than any other term can, they are the answer; otherwise more counters are used, in the end as many as there are
terms, which makes the sketch exact. What is shuffled is bounded by counters and tasks, not by terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.functions import text as X
from lexitide.session import BROADCAST_ROWS, cut_lineage

COUNTERS_PER_TERM = 4  # counters of a task for each wanted term, to begin with
MORE = 4


class Summary:
    """Counts of at most `size` terms, each too small by at most `error`."""

    def __init__(self, size: int):
        self.size, self.error, self.counts = size, 0, {}

    def add(self, terms: list[str], counts: list[int]) -> None:
        held = self.counts
        for term, n in zip(terms, counts, strict=True):
            held[term] = held.get(term, 0) + n
        if len(held) > self.size:
            n = np.fromiter(held.values(), np.int64, len(held))
            off = int(np.partition(n, len(n) - self.size - 1)[len(n) - self.size - 1])
            self.counts = {t: c - off for t, c in held.items() if c > off}
            self.error += off


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    seen = Summary(size)
    for batch in batches:
        for at in range(0, len(batch), 1024):
            found = pc.value_counts(batch.column("tokens").slice(at, 1024).flatten().drop_null())
            seen.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
    terms, counts = [None, *seen.counts], [seen.error, *seen.counts.values()]
    for at in range(0, len(terms), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + 65536], pa.string()), pa.array(counts[at : at + 65536], pa.int64())], ["term", "n"])


def sketch(docs: DataFrame, tokens: str, counters: int) -> tuple[DataFrame, int]:
    """`(term, least)` and the error: every term occurs `least` times or more, and at most `least` + error; other terms at most error."""
    told = cut_lineage(docs.select(F.col(tokens).alias("tokens")).mapInArrow(lambda it: _sketch(it, counters), "term STRING, n LONG"))
    error = told.where(F.col("term").isNull()).agg(F.sum("n")).first()[0] or 0
    return told.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("least")), int(error)


def frequent_terms(docs: DataFrame, n: int, tokens: str = "full_text", min_freq: int = 1, min_df: int = 1, counters: int | None = None) -> DataFrame:
    """`(term, tf, df)`: the `n` terms with most occurrences among those with `min_freq` of them, in `min_df` rows; ties to the smaller term.

    The same rows as counting every term. `docs` is read twice, or twice more for each time that more counters are needed.
    """
    counters, wanted = counters or COUNTERS_PER_TERM * n, 2 * n
    while True:
        found, error = sketch(docs, tokens, counters)
        found = cut_lineage(found.orderBy(F.desc("least"), "term").limit(wanted + 1))
        held = found.count()
        # no term beyond the candidates occurs more often than this
        left_out = found.agg(F.min("least")).first()[0] + error if held > wanted else error
        candidates = found.orderBy(F.desc("least"), "term").limit(wanted).select("term")
        known = F.broadcast(candidates) if wanted <= BROADCAST_ROWS else candidates
        each = F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
        once = F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
        told = docs.select(F.inline_outer(F.concat(each, once) if min_df > 1 else each)).where(F.col("term").isNotNull())
        counted = told.join(known, "term", "left_semi").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        counted = cut_lineage(counted.where((F.col("tf") >= min_freq) & (F.col("df") >= (min_df if min_df > 1 else 0))))
        sure = counted.where(F.col("tf") > left_out).count()
        # all terms that may be wanted are candidates, or the n most frequent ones are certain
        if sure >= n or left_out < min_freq:
            return counted.orderBy(F.desc("tf"), "term").limit(n)
        counters, wanted = counters * MORE, wanted * MORE


def sketched_vocab(docs: DataFrame, vocab_size: int = 30_000, min_freq: int = 3, counters: int | None = None) -> DataFrame:
    """`build_vocab`'s rows `(term, term_idx, tf)`, found by a sketch and a second pass (A2, K2)."""
    from lexitide.operators.vocab import top_terms

    found = frequent_terms(docs, vocab_size, "full_text", min_freq, counters=counters)
    return top_terms(found.select("term", "tf"), vocab_size, min_freq)


def sketched_features(train: DataFrame, max_features: int = 100_000, min_df: int = 2, ngram: tuple[int, int] = (1, 2), counters: int | None = None) -> DataFrame:
    """`tfidf_features`' rows for n-grams that are too many to count one by one."""
    from lexitide.operators.vocab import with_idf

    worded = train.select(X.words(F.col("text")).alias("words"))
    grams = worded.select(X.ngrams(F.col("words"), *ngram).alias("grams"))
    return with_idf(frequent_terms(grams, max_features, "grams", 1, min_df, counters), train.count())
