"""Yearly topic prevalence, its reshapes and summaries, and the gloss tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions import text as X
from lexitide.functions.vectors import mean_vector
from lexitide.operators.topics import gloss_words
from lexitide.schemas import require_columns


def timeline_soft(doc_topics: DataFrame, dist_col: str = "dist") -> DataFrame:
    """Mean topic probability per year, long form; documents without a year are left out (A4).

    Distributions are averaged as vectors, so a year's rows are combined before the shuffle and the
    topics are unfolded afterwards.
    """
    yearly = doc_topics.where(F.col("rights_year").isNotNull()).groupBy("rights_year")
    means = yearly.agg(mean_vector(F.col(dist_col)).alias("means"))
    return X.unfold_at(means, "rights_year", tokens="means", names=("topic", "prevalence"))


def timeline_hard(assigned: DataFrame, topic_col: str = "topic") -> DataFrame:
    """Share of each year's documents per topic, 0.0 where a topic is absent.

    Outliers (-1) count in the denominator and get no row of their own.
    """
    dated = assigned.where(F.col("rights_year").isNotNull())
    counts = dated.groupBy("rights_year", F.col(topic_col).alias("topic")).agg(F.count("*").alias("n"))
    # one row per year: its topic counts as a map, and its total; the topic list is the same for all years
    years = counts.groupBy("rights_year").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("by_topic")
    )
    every_topic = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("by_topic")).over(_everything()))))
    shares = years.withColumn("topics", F.filter(every_topic, lambda t: t >= 0))
    absent = F.coalesce(F.col("by_topic")[F.col("topic")], F.lit(0))
    return shares.select("rights_year", "total", "by_topic", F.explode("topics").alias("topic")).select(
        "rights_year", "topic", (absent / F.col("total")).alias("prevalence")
    )


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()  # over the year table only: one row per year


def timeline_wide(timeline: DataFrame, topics: list[int]) -> DataFrame:
    """One column per topic, by year."""
    wide = timeline.groupBy("rights_year").pivot("topic", topics).agg(F.first("prevalence"))
    return wide.orderBy("rights_year")


def timeline_long(wide: DataFrame) -> DataFrame:
    """Wide timeline unfolded; the topic becomes a number where the column name is one."""
    require_columns(wide, ["rights_year"])
    topics = [c for c in wide.columns if c != "rights_year"]
    typed = wide.select("rights_year", *[F.col(f"`{c}`").cast("double").alias(c) for c in topics])
    long = typed.unpivot("rights_year", topics, "topic", "prevalence")
    numeric = all(_is_int(c) for c in topics)
    return long.withColumn("topic", F.col("topic").cast("int")) if numeric else long


def _is_int(name: str) -> bool:
    try:
        int(name)
    except ValueError:
        return False
    return True


def timeline_stats(timeline: DataFrame) -> DataFrame:
    """Per topic: mean prevalence, peak year (earliest of equals), first and last year.

    NaN counts as missing. First and last year span all rows of the topic; the active years are those
    with a prevalence above zero.
    """
    t = timeline.withColumn("prevalence", X.no_nan(F.col("prevalence")))
    present = F.col("prevalence").isNotNull()
    best = F.max_by("rights_year", F.when(present, F.struct("prevalence", -F.col("rights_year"))))
    return t.groupBy("topic").agg(
        F.avg("prevalence").alias("mean_prevalence"),
        F.when(F.count_if(present) > 0, best).alias("peak_year"),
        F.min("rights_year").alias("first_year"),
        F.max("rights_year").alias("last_year"),
        F.min(_active("rights_year")).alias("first_active_year"),
        F.max(_active("rights_year")).alias("last_active_year"),
    )


def _active(year: str) -> Column:
    return F.when(F.col("prevalence") > 0, F.col(year))


STATS = ["mean_prevalence", "peak_year", "first_year", "last_year"]


def lda_gloss(topic_words: DataFrame, timeline: DataFrame, top_n: int = 10) -> DataFrame:
    """Top words and timeline summary per topic, by topic."""
    require_columns(topic_words, ["topic", "rank", "word"])
    words = gloss_words(topic_words, top_n)
    joined = words.join(timeline_stats(timeline).select("topic", *STATS), "topic", "left")
    return joined.withColumnRenamed("topic", "topic_id").orderBy("topic_id")


def density_gloss(info: DataFrame, timeline: DataFrame, top_n: int = 10) -> DataFrame:
    """Topic info with top words and timeline summary, largest topic first.

    `info` is our topic table `(topic, doc_count, name, words)` or an imported one with
    `Topic, Count, Name, Representation`. The outlier topic keeps null statistics.
    """
    if "Topic" in info.columns:
        listed = X.representation_words(F.col("Representation"), top_n)
        info = info.withColumn("top_words", F.array_join(listed, ", "))
        renames = {"Topic": "topic_id", "Count": "doc_count", "Name": "topic_name"}
    else:
        require_columns(info, ["topic", "words"])
        info = info.withColumn("top_words", F.array_join(F.slice("words", 1, top_n), ", ")).drop("words")
        renames = {"topic": "topic_id", "name": "topic_name"}
    info = info.withColumnsRenamed({k: v for k, v in renames.items() if k in info.columns})
    stats = timeline_stats(timeline).select(F.col("topic").alias("topic_id"), *STATS)
    joined = info.join(stats, "topic_id", "left")
    if "doc_count" in joined.columns:
        return joined.orderBy(F.desc("doc_count"), F.asc("topic_id"))
    return joined.orderBy("topic_id")


def reform_shift(timeline: DataFrame, reforms: DataFrame, span: int = 10) -> DataFrame:
    """Mean prevalence in the `span` years before and after each reform: `(reform, reform_year, topic, ...)`.

    Each reform is unfolded into its years, so the range condition becomes an equality on the year.
    """
    years = reforms.select(
        "reform", "reform_year", F.explode(F.sequence(-F.lit(span), F.lit(span) - 1)).alias("offset")
    ).withColumn("rights_year", F.col("reform_year") + F.col("offset"))
    side = years.join(timeline, "rights_year")
    return side.groupBy("reform", "reform_year", "topic").agg(
        F.avg(F.when(F.col("offset") < 0, F.col("prevalence"))).alias("before"),
        F.avg(F.when(F.col("offset") >= 0, F.col("prevalence"))).alias("after"),
    ).withColumn("shift", F.col("after") - F.col("before"))
