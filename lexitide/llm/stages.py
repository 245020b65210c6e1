"""The stages of the corpus pipeline; each takes and (but for the last) returns rows with the columns of `documents`.

A stage works on `doc_id`, `text`, `source` and `lang` and carries all other columns as one struct beside them (and the text once), so
columns of any name, dots and the operators' own names included, come back as they were. Null values in any column, empty and very long
texts, ties and repeated rows are as each operator states; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"
_WHOLE = "stage_row"


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns and the text beside the rest of the row, whose fields are numbered."""
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    return docs.select(*needed, "text", rest.alias(_WHOLE))


def _back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows as they came, with the text as the stage leaves it."""
    return df.select(*[F.col("text") if c == "text" else F.col(f"{_WHOLE}.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality model keeps. Null and empty texts fail; rows that repeat share a verdict."""
    from lexitide.llm.quality import judge

    return _back(judge(_carried(docs)).where("kept"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: three-word shingles, fingerprints at most two bits apart.

    The smallest id stays; a null id only if its group has no other; of equal rows one. Wordless texts are one group.
    """
    from lexitide.llm.simhash import one_of_each

    return one_of_each(docs, width=3)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets. Every row stays, null texts stay null."""
    from lexitide.llm.pii import redact

    return _back(redact(_carried(docs, "doc_id")), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that source, language and topic shares of tokens meet their targets, as far as the tokens allow.

    Null sources and languages are values of their own; rows that repeat share one decision.
    """
    from lexitide.llm.mixing import sample_to_targets

    return _back(sample_to_targets(_carried(docs, "doc_id", "source", "lang")), docs)


def word_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left. A null text has none; rows that repeat stay; other columns are not read."""
    from lexitide.llm.word_bpe import encode_and_decode

    found = encode_and_decode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path(WORD_BPE), ("ids",))
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")
