"""Term counts, vocabularies, count vectors and TF-IDF weights."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions import text as X
from lexitide.operators.sparse import sparse_rows
from lexitide.session import BROADCAST_ROWS, task_count


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every term in the corpus: `(term, tf)` (A1)."""
    return X.unfold(docs).groupBy("term").agg(F.count("*").alias("tf"))


def build_vocab(docs: DataFrame, vocab_size: int = 30_000, min_freq: int = 3) -> DataFrame:
    """Terms with at least `min_freq` occurrences, the `vocab_size` most frequent: `(term, term_idx, tf)` (A2, K2).

    Frequency means occurrences, not documents. Ties are broken by the term.
    """
    return top_terms(term_counts(docs), vocab_size, min_freq)


def top_terms(counts: DataFrame, vocab_size: int = 30_000, min_freq: int = 3) -> DataFrame:
    """The vocabulary of a table of counts `(term, tf)`: `(term, term_idx, tf)`."""
    order = [F.desc("tf"), F.asc("term")]
    top = counts.where(F.col("tf") >= min_freq).orderBy(*order).limit(vocab_size)
    # the window sees the vocabulary only, never the corpus
    return top.withColumn("term_idx", F.row_number().over(Window.orderBy(*order)) - 1).select("term", "term_idx", "tf")


def bounded(vocab: DataFrame, size: int) -> DataFrame:
    """Broadcast a table cut to `size` rows if that bound is small enough, else let Spark choose."""
    return F.broadcast(vocab) if size <= BROADCAST_ROWS else vocab


def doc_term_counts(docs: DataFrame, terms: str = "full_text") -> DataFrame:
    """`(doc_id, term, tf)`. Documents already hashed by id are counted without a further shuffle."""
    return X.unfold(docs, "doc_id", tokens=terms).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def count_vectors(docs: DataFrame, vocab: DataFrame, vocab_size: int = 30_000) -> DataFrame:
    """Counts of vocabulary terms per document: `(doc_id, term_idx, tf)`; other terms are ignored (M1)."""
    known = bounded(vocab.select("term", "term_idx"), vocab_size)
    return doc_term_counts(docs).join(known, "term").select("doc_id", "term_idx", "tf")


def vocab_list(vocab: DataFrame) -> list[str]:
    """The vocabulary in index order; model-sized, bounded by its `vocab_size`."""
    return [r["term"] for r in vocab.orderBy("term_idx").collect()]


def count_vectorizer(vocab: list[str], input_col: str = "full_text", output_col: str = "counts") -> CountVectorizerModel:
    """The same counts as an ML vector column, case kept, unknown terms ignored (M1)."""
    return CountVectorizerModel.from_vocabulary(vocab, inputCol=input_col, outputCol=output_col)


def tfidf_features(train: DataFrame, max_features: int = 100_000, min_df: int = 2, ngram: tuple[int, int] = (1, 2)) -> DataFrame:
    """Features fitted on training texts: `(term, term_idx, tf, df, idf)`.

    A feature needs `min_df` documents; of those the `max_features` with most occurrences stay. The
    inverse document frequency is ln((1 + n) / (1 + df)) + 1. A document is a row, whatever its id: each row
    tells its terms and, once each, its distinct terms, and both are summed before they are shuffled. Texts are dealt out
    before that, so that a task sums the terms of a bounded part of them.
    """
    order = [F.desc("tf"), F.asc("term")]
    n_docs, n_bytes = train.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    dealt = train.select("text", F.monotonically_increasing_id().alias("place")).repartition(task_count(train.sparkSession, n_bytes), "place")
    worded = dealt.select(X.words(F.col("text")).alias("words"))
    grams = worded.select(X.ngrams(F.col("words"), *ngram).alias("grams"))
    every = F.transform("grams", lambda g: F.struct(g.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    once = F.transform(F.array_distinct("grams"), lambda g: F.struct(g.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    told = grams.select(F.inline_outer(F.concat(every, once))).where(F.col("term").isNotNull())
    stats = (
        told.groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        .where(F.col("df") >= min_df)
        .orderBy(*order)
        .limit(max_features)
    )
    return with_idf(stats, n_docs)


def with_idf(stats: DataFrame, n_docs: int) -> DataFrame:
    """Chosen terms `(term, tf, df)` with their weight `idf` and their place `term_idx` by frequency, then term."""
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    index = F.row_number().over(Window.orderBy(F.desc("tf"), F.asc("term"))) - 1
    return stats.withColumn("idf", idf).withColumn("term_idx", index)


def tfidf_weights(
    docs: DataFrame, features: DataFrame, max_features: int = 100_000, ngram: tuple[int, int] = (1, 2), by_doc: bool = False
) -> DataFrame:
    """Length-one TF-IDF rows in long form: `(doc_id, term, weight)`, each row of `docs` by itself.

    Terms are counted and weighed in the row by the pipeline; only weights unfold, and neither texts nor tokens move. With
    `by_doc` the rows are hashed by id before they unfold, indices and weights as lists, for later steps per document.
    """
    kept = features.persist()
    made = tfidf_pipeline(kept, ngram).transform(docs.select("doc_id", "text"))
    rows = sparse_rows(made, ["doc_id"]).select("row.doc_id", "idx", "val")
    if by_doc:
        rows = rows.repartition(task_count(docs.sparkSession, docs.agg(F.sum(F.octet_length("text"))).first()[0]), "doc_id")
    long = rows.select("doc_id", F.inline(F.arrays_zip(F.col("idx").alias("term_idx"), F.col("val").alias("weight"))))
    return long.join(bounded(kept.select("term", "term_idx"), max_features), "term_idx").select("doc_id", "term", "weight")


def tfidf_pipeline(features: DataFrame, ngram: tuple[int, int] = (1, 2), output_col: str = "features") -> PipelineModel:
    """The same weights as a saveable ML pipeline from `text` to a sparse vector column."""
    rows = features.select("term", "term_idx", "idf").orderBy("term_idx").collect()  # at most max_features rows
    low, high = ngram
    # the raw literal keeps the pattern's backslashes in SQL
    stages = [SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower(coalesce(text, '')), r'{X.WORD}', 0) AS _n1 FROM __THIS__")]
    stages += [NGram(n=n, inputCol="_n1", outputCol=f"_n{n}") for n in range(max(low, 2), high + 1)]
    grams = ", ".join(f"_n{n}" for n in range(low, high + 1))
    stages.append(SQLTransformer(statement=f"SELECT *, concat({grams}) AS _grams FROM __THIS__"))
    stages.append(count_vectorizer([r["term"] for r in rows], "_grams", "_counts"))
    stages.append(ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_counts", outputCol="_raw"))
    stages.append(Normalizer(p=2.0, inputCol="_raw", outputCol=output_col))
    scratch = ", ".join({"_n1", "_grams", "_counts", "_raw"} | {f"_n{n}" for n in range(max(low, 2), high + 1)})
    stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({scratch}) FROM __THIS__"))
    return PipelineModel(stages)

