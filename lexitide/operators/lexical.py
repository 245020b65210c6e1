"""Lexical statistics: P(class | word) under several priors, and drift of word use over decades."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexitide.functions import text as X
from lexitide.operators.vocab import bounded, build_vocab
from lexitide.session import broadcast_if_small, written

HELD_PAIRS = 4 << 20  # pairs of words that a task counts before it returns them
TOLD_PAIRS = 1 << 16


def class_given_word(
    docs: DataFrame, label_col: str = "label", prior: str | DataFrame = "empirical", alpha: float = 1.0, min_freq: int = 1
) -> DataFrame:
    """P(class | word) by Bayes' rule: `(term, label, p)`, every class for every word.

    P(word | class) is smoothed by `alpha` over the vocabulary. The prior is the share of tokens per class
    ('empirical'), 'uniform', or a table `(label, prior)`.
    """
    counts = (
        X.unfold(docs, F.col(label_col).alias("label"))
        .groupBy("label", "term")
        .agg(F.count("*").alias("n"))
    ).persist()
    words = counts.groupBy("term").agg(
        F.sum("n").alias("tf"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by_label")
    ).where(F.col("tf") >= min_freq)
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    if isinstance(prior, DataFrame):
        totals = totals.join(prior.select("label", F.col("prior").cast("double")), "label")
    elif prior == "empirical":
        totals = totals.withColumn("prior", F.col("total") / F.sum("total").over(Window.partitionBy()))  # one row per class
    elif prior == "uniform":
        totals = totals.withColumn("prior", F.lit(1.0) / F.count("*").over(Window.partitionBy()))
    else:
        raise ValueError(f"unknown prior {prior!r}")
    classes = totals.collect()  # one row per class
    size = words.count()
    listed = F.array(
        *[
            F.struct(F.lit(r["label"]).alias("label"), F.lit(float(r["total"])).alias("total"), F.lit(float(r["prior"])).alias("prior"))
            for r in sorted(classes, key=lambda r: str(r["label"]))
        ]
    )
    grid = words.select("term", "by_label", F.explode(listed).alias("c"))
    hits = F.coalesce(F.col("by_label")[F.col("c.label")], F.lit(0))
    joint = (hits + alpha) / (F.col("c.total") + alpha * size) * F.col("c.prior")
    scored = grid.select("term", F.col("c.label").alias("label"), joint.alias("j"))
    return scored.select("term", "label", (F.col("j") / F.sum("j").over(Window.partitionBy("term"))).alias("p"))


def _sorted_words(vocab: DataFrame) -> list[str]:
    """The vocabulary in Spark's order of strings; model-sized, bounded by its `vocab_size`."""
    return sorted({r["term"] for r in vocab.select("term").collect()}, key=str.encode)


def _numbers(batches: Iterator[pa.RecordBatch], words: pa.Array) -> Iterator[pa.RecordBatch]:
    """Documents as the numbers of their words, four bytes each; -1 for other words."""
    for batch in batches:
        lists = batch.column("tokens")
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        found = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy().astype(np.int32)
        seqs = pa.array([found[lo:hi].tobytes() if (found[lo:hi] >= 0).any() else None for lo, hi in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("by"), seqs], ["doc_id", "by", "seq"])


def _near(seqs: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words at most `span` apart in rows of one document: each known word with the `span` known ones behind it."""
    rows = [np.frombuffer(s, np.int32) for s in seqs]
    at = np.concatenate([np.flatnonzero(r >= 0) for r in rows])
    number = np.concatenate([r[r >= 0] for r in rows])
    if len(rows) > 1:
        order = np.lexsort((number, at))
        at, number = at[order], number[order]
    left, right = [], []
    for step in range(1, span + 1):
        close = at[step:] - at[:-step] <= span
        left.append(number[:-step][close])
        right.append(number[step:][close])
    return np.concatenate(left), np.concatenate(right)


def _counted(batches: Iterator[pa.RecordBatch], n_words: int, span: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """`(by, x, y, n)` with x <= y, added up over many documents before anything is returned."""
    held: dict = {}
    waiting = 0

    def told() -> Iterator[pa.RecordBatch]:
        for by, parts in held.items():
            key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=len(key)).astype(np.int64)
            for lo in range(0, len(key), TOLD_PAIRS):
                cut = key[lo : lo + TOLD_PAIRS]
                columns = [pa.array([by], kind).take(pa.array(np.zeros(len(cut), np.int32))), pa.array((cut // n_words).astype(np.int32)), pa.array((cut % n_words).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[lo : lo + TOLD_PAIRS])], ["by", "x", "y", "n"])

    for batch in batches:
        for by, seqs in zip(batch.column("by").to_pylist(), batch.column("seqs").to_pylist(), strict=True):
            x, y = _near(seqs, span)
            key, n = np.unique(np.minimum(x, y).astype(np.int64) * n_words + np.maximum(x, y), return_counts=True)
            held.setdefault(by, []).append((key, n))
            waiting += len(key)
            if waiting >= HELD_PAIRS:
                yield from told()
                held, waiting = {}, 0
    yield from told()


def _pair_counts(docs: DataFrame, words: list[str], span: int, by: str) -> DataFrame:
    """`(by, x, y, n)` with x <= y: how often two words, as numbers in `words`, are at most `span` positions apart."""
    texts = docs.select("doc_id", F.col(by).alias("by"), F.col("full_text").alias("tokens"))
    kinds = {c: texts.schema[c].dataType for c in ("doc_id", "by")}
    known = pa.array(words, pa.string())
    spelt = texts.mapInArrow(lambda it: _numbers(it, known), f"doc_id {kinds['doc_id'].simpleString()}, by {kinds['by'].simpleString()}, seq BINARY")
    # rows of one id are one document
    listed = spelt.where(F.col("seq").isNotNull()).groupBy("doc_id", "by").agg(F.collect_list("seq").alias("seqs")).select("by", "seqs")
    n_words, kind = max(1, len(words)), to_arrow_type(kinds["by"])
    counted = listed.mapInArrow(lambda it: _counted(it, n_words, span, kind), f"by {kinds['by'].simpleString()}, x INT, y INT, n LONG")
    return counted.groupBy("by", "x", "y").agg(F.sum("n").alias("n"))


def _both_ways(pairs: DataFrame, words: list[str], value: str, by: str) -> DataFrame:
    """`(by, term, context, value)` in both orders from pairs of numbers with x <= y."""
    spark = pairs.sparkSession
    named = bounded(spark.createDataFrame(list(enumerate(words)), "i INT, word STRING"), len(words))
    other = F.when(F.col("x") != F.col("y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    turned = pairs.select("by", F.explode(F.array_compact(F.array(F.struct("x", "y"), other))).alias("p"), value).select("by", "p.*", value)
    turned = turned.join(named.select(F.col("i").alias("x"), F.col("word").alias("term")), "x").join(named.select(F.col("i").alias("y"), F.col("word").alias("context")), "y")
    return turned.select(F.col("by").alias(by), "term", "context", value)


def cooccurrence(docs: DataFrame, vocab: DataFrame, vocab_size: int, span: int = 5, by: str = "decade") -> DataFrame:
    """Counts of vocabulary words at most `span` positions apart, per `by`: `(by, term, context, n)`, symmetric.

    Each word is paired with the vocabulary words that follow it within the span, so the work grows with
    tokens times span and not with the square of a document. Words are numbers of four bytes from the scan to the counts, and a
    pair is shuffled in one order only.
    """
    words = _sorted_words(vocab)
    pairs = _pair_counts(docs, words, span, by)
    return _both_ways(pairs.withColumn("n", F.when(F.col("x") == F.col("y"), 2 * F.col("n")).otherwise(F.col("n"))), words, "n", by)


def _margins(pairs: DataFrame, n_words: int) -> DataFrame:
    """`(by, sums, n_all)`: per decade the counts of every word as one list, and their sum."""

    def listed(rows: pa.Table) -> pa.Table:
        sums = np.zeros(n_words, np.int64)
        sums[rows.column("i").to_numpy()] = rows.column("n").to_numpy()
        return pa.table([rows.column("by").slice(0, 1).combine_chunks(), pa.array([sums], pa.list_(pa.int64())), pa.array([int(sums.sum())], pa.int64())], ["by", "sums", "n_all"])

    each = pairs.select("by", F.explode(F.array("x", "y")).alias("i"), "n").groupBy("by", "i").agg(F.sum("n").alias("n"))
    return each.groupBy("by").applyInArrow(listed, "by INT, sums ARRAY<LONG>, n_all LONG")


def information_table(docs: DataFrame, vocab_size: int, min_freq: int = 3, span: int = 5) -> DataFrame:
    """Positive pointwise mutual information of vocabulary words in each decade: `(decade, term, context, w)`, symmetric."""
    dated = docs.where(F.col("rights_year").isNotNull())
    dated = dated.withColumn("decade", (F.floor(F.col("rights_year") / F.lit(10.0)) * 10).cast("int"))
    words = _sorted_words(build_vocab(docs, vocab_size, min_freq))
    pairs = written(_pair_counts(dated, words, span, "decade"))[0]
    rows = pairs.join(broadcast_if_small(_margins(pairs, max(1, len(words)))), "by")
    n = F.when(F.col("x") == F.col("y"), 2 * F.col("n")).otherwise(F.col("n"))
    information = F.log(n * F.col("n_all") / (F.get("sums", "x") * F.get("sums", "y")))
    return _both_ways(rows.select("by", "x", "y", information.alias("w")).where(F.col("w") > 0), words, "w", "decade")


def semantic_drift(docs: DataFrame, vocab_size: int = 200, min_freq: int = 3, span: int = 5) -> DataFrame:
    """Cosine of each word's context vectors in consecutive decades: `(term, from_decade, to_decade, cosine)` (R2).

    Vectors hold positive pointwise mutual information over the same vocabulary in every decade, so they
    need no alignment. Words with a vector in both decades are reported. For large vocabularies see `drift.embedding_drift`.
    """
    ppmi = information_table(docs, vocab_size, min_freq, span).persist()
    lengths = ppmi.groupBy("decade", "term").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len")).persist()
    nxt = ppmi.select((F.col("decade") - 10).alias("decade"), "term", "context", F.col("w").alias("w2"))
    dots = ppmi.join(nxt, ["decade", "term", "context"]).groupBy("decade", "term").agg(F.sum(F.col("w") * F.col("w2")).alias("dot"))
    nxt_len = lengths.select((F.col("decade") - 10).alias("decade"), "term", F.col("len").alias("len2"))
    both = lengths.join(nxt_len, ["decade", "term"]).join(dots, ["decade", "term"], "left")
    return both.select(
        "term",
        F.concat(F.col("decade").cast("string"), F.lit("s")).alias("from_decade"),
        F.concat((F.col("decade") + 10).cast("string"), F.lit("s")).alias("to_decade"),
        (F.coalesce("dot", F.lit(0.0)) / (F.col("len") * F.col("len2"))).alias("cosine"),
    )


def normalise(docs: DataFrame, stopwords: list[str] | None = None, fold_accents: bool = False) -> DataFrame:
    """Raw `text` to `full_text`: words, optionally without accents and stop words."""
    text = X.folded(F.lower("text")) if fold_accents else F.col("text")
    out = docs.withColumn("full_text", X.words(text))
    if stopwords is None:
        return out
    from pyspark.ml.feature import StopWordsRemover

    remover = StopWordsRemover(inputCol="full_text", outputCol="_kept", stopWords=stopwords, caseSensitive=True)
    return remover.transform(out).drop("full_text").withColumnRenamed("_kept", "full_text")
