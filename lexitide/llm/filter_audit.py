"""How filters overlap: for every order of five filters, what each step removes, and what others would have removed anyway.

Documents are measured in one pass of a byte transducer per text. What counts afterwards is only the set of filters that
a document fails, so documents are counted by that set, and all orders are worked out from at most 32 counts per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import row_schema
from lexitide.llm.textarrays import slices
from lexitide.llm.transducer import CAPITAL, POINT, START, SYMBOL, Pass

FILTERS = "ABCDE"
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            seen = Pass(part.column("text"))
            counts = [seen.count(START), seen.distinct(), seen.count(CAPITAL), seen.count(POINT), seen.count(SYMBOL)]
            yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(c, pa.int64()) for c in counts]], ["row", *MEASURES])


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`(row, n_words, n_distinct, n_capitals, n_points, n_symbols)`: the columns `keep` as one struct, and what the pass counts.

    A null text is empty; words are runs of anything but ASCII white space, compared byte by byte.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
    return rows.mapInArrow(_measure, row_schema(rows, ", ".join(f"{m} LONG" for m in MEASURES)))


def failed_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """`(part, fails, n, n_good, n_toxic)`: documents by the letters of the filters that they fail.

    A: under 200 words. B: distinct words under half of the words. C: capitals over 3 % of the code points. D: a symbol.
    E: the text of a smaller `doc_id` anywhere in the table.

    Null and empty texts are equal; a null `part` is the empty string. Texts are the same if their SHA-256 is. A row that
    repeats another's id and text counts once more and does not fail E by it; a row without an id neither fails E nor makes
    others fail it. A document has a label if any of its rows in `labels` has it. Copies are counted before they meet,
    so a text that many documents share makes one row per part and label. Other columns are not read; an empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), "text")
    rules = {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 3 * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }
    own = F.concat(*[F.when(fails, letter).otherwise("") for letter, fails in rules.items()])
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    measured = measure(keyed, ["doc_id", "part", "key"]).select("row.*", own.alias("own")).join(marked, "doc_id", "left")
    same = ["key", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "own"]
    by_id = measured.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    without_id = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    copies = by_id.groupBy("key", "part", "good", "toxic", "own").agg(
        F.sum("n").alias("n"), without_id.alias("n_no_id"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low")
    )
    lowest = F.col("low") == F.min("low").over(Window.partitionBy("key"))  # a row per part and labels
    first = F.col("n_no_id") + F.when(lowest, F.col("n_low")).otherwise(0)
    lone = F.struct(F.col("own").alias("fails"), F.col("first").alias("n"))
    repeated = F.struct(F.concat("own", F.lit("E")).alias("fails"), (F.col("n") - F.col("first")).alias("n"))
    told = copies.withColumn("first", first).select("part", "good", "toxic", F.inline(F.array(lone, repeated)))
    counted = told.where("n > 0").groupBy("part", "fails")
    return counted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def interactions(fails: DataFrame) -> DataFrame:
    """`(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)` for all 120 orders.

    `fails` is `failed_filters`' result: a part has at most 32 rows, which one list holds.
    """
    listed = fails.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "n_good", "n_toxic")).alias("sets"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = listed.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.lit(list(range(1, len(FILTERS) + 1)))))
    steps = steps.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("earlier", F.expr("substring(filter_order, 1, step - 1)"))

    def fails_it(s):
        return s["fails"].contains(F.col("letter"))

    def passed(s):
        return F.call_function("translate", s["fails"], F.col("earlier"), F.lit("")) == s["fails"]

    def total(holds, amount=lambda s: s["n"]):
        return F.aggregate("sets", F.lit(0).cast("long"), lambda acc, s: acc + F.when(holds(s), amount(s)).otherwise(0))

    def removed(s):
        return passed(s) & fails_it(s)

    return steps.select(
        "part", "filter_order", "step",
        total(lambda s: passed(s) & ~fails_it(s)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda s: ~passed(s) & fails_it(s)).alias("redundant"),
        total(lambda s: s["fails"] == F.col("letter")).alias("unique_fails"),
        total(removed, lambda s: s["n_good"]).alias("good_lost"),
        total(removed, lambda s: s["n_toxic"]).alias("toxic_lost"),
        # each of the filters that a document fails removes it in the same number of orders
        total(fails_it, lambda s: s["n"] * (120 / F.length(s["fails"])).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Every order of the five filters over `docs`, by `part`: see `failed_filters` and `interactions`."""
    return interactions(failed_filters(docs, labels, part))
