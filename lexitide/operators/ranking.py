"""Positions and quotas computed without sending a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.session import broadcast_if_small, cut_lineage

HASH_BUCKETS = 4096


def add_row_index(df: DataFrame, order_col: str, by: str | None = None, index_col: str = "row_idx") -> DataFrame:
    """Zero-based position of each row by `order_col`, over the table or within `by`; keys of any ordered type, nulls first.

    Rows are dealt into ranges of the order and sorted there; a row's position is the number of rows in the ranges before it
    plus its place in its own range. Rows that tie are dealt by a hash of the row, so a frequent key has no range to itself.
    """
    keys = [c for c in (by, order_col) if c is not None]
    ordered = [*[F.col(c) for c in keys], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    ranges = cut_lineage(df.repartitionByRange(*ordered).sortWithinPartitions(*ordered))
    # a checkpointed range is one partition, whose number and places this id holds
    placed = ranges.withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    before, start = [], 0
    for r in placed.groupBy(part).count().orderBy("_part").collect():  # one row per range
        before.append((r["_part"], start))
        start += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "_part LONG, _before LONG")
    whole = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(index_col, F.col("_before") + place)
    whole = whole.drop("_id", "_part", "_before")
    if by is None:
        return whole
    starts = whole.groupBy(F.col(by).alias("_group")).agg(F.min(index_col).alias("_start"))
    within = whole.join(broadcast_if_small(starts), F.col(by).eqNullSafe(F.col("_group")))
    return within.withColumn(index_col, F.col(index_col) - F.col("_start")).drop("_group", "_start")


def corpus_limit(df: DataFrame, n: int, order_col: str = "doc_id") -> DataFrame:
    """The first n rows by `order_col`; n <= 0 keeps all (K1).

    One method for every n and key type: the keys alone are dealt into ranges and counted, only the range that holds the
    n-th row is ordered, and the rows are filtered by its key. Null keys come first; of rows that tie at the cut any may stay.
    """
    if n <= 0:
        return df
    key = F.col(order_col)
    keys = cut_lineage(df.select(key.alias("key")).repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    before = 0
    for part in keys.groupBy("part").count().orderBy("part").collect():  # one row per range
        if before + part["count"] >= n:
            break
        before += part["count"]
    else:
        return df
    cut = keys.where(F.col("part") == part["part"]).orderBy("key").limit(n - before).agg(F.max("key")).first()[0]
    if cut is None:
        return df.where(key.isNull()).limit(n)
    less = keys.where(F.col("key").isNull() | (F.col("key") < F.lit(cut))).count()
    return df.where(key.isNull() | (key < F.lit(cut))).unionByName(df.where(key == F.lit(cut)).limit(n - less))


def limit_per_group(df: DataFrame, by: str, order_col: str, n: int) -> DataFrame:
    """The first n rows of every group.

    One method for every n, key type and group size: positions are worked out on keys and two hashes of the row, each
    group's n-th key is its cut, and rows are filtered by it. Nulls come first and of rows that tie at the cut any may stay.
    """
    if n <= 0:
        return df
    row = [F.col(f"`{c}`") for c in df.columns]
    # a row's place among ties: two independent hashes of 64 bits
    keyed = df.withColumn("_at", F.struct(F.col(order_col).alias("key"), F.xxhash64(*row).alias("h"), F.xxhash64(F.lit(1), *row).alias("g")))
    last = add_row_index(keyed.select(F.col(by).alias("_by"), "_at"), "_at", by="_by").where(F.col("row_idx") == n - 1)
    cuts = broadcast_if_small(last.select("_by", F.col("_at").alias("_cut")))  # a row per group of n rows or more
    met = keyed.join(cuts, F.col(by).eqNullSafe(F.col("_by")), "left")
    sure = met.where(F.col("_cut").isNull() | (F.col("_at") < F.col("_cut"))).select(*row)
    # equal rows at the cut: as many copies of one as are still wanted
    edge = met.where(F.col("_at") == F.col("_cut")).dropDuplicates(["_by"]).select(F.col("_by").alias("_edge"), *row)
    counts = met.where(F.col("_at") < F.col("_cut")).groupBy(F.col("_by").alias("_of")).agg(F.count("*").alias("_less"))
    wanted = edge.join(counts, F.col("_edge").eqNullSafe(F.col("_of")), "left").withColumn("_i", F.explode(F.sequence(F.lit(1), n - F.coalesce("_less", F.lit(0)))))
    return sure.unionByName(wanted.select(*row))


def step_sample(df: DataFrame, order_col: str, cap: int = 50_000, target: int = 20_000, total: int | None = None) -> DataFrame:
    """Above `cap` rows keep every max(1, N // target)-th row by position in the order of `order_col`, else keep all."""
    n = df.count() if total is None else total
    step = max(1, n // target)
    if n <= cap or step == 1:
        return df
    return add_row_index(df, order_col).where(F.col("row_idx") % step == 0).drop("row_idx")


def top_per_group(df: DataFrame, by: str, order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """Rank from 1 inside each group, first n kept; the cut is applied before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn(rank_col, place).where(F.col(rank_col) <= n)


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of every key."""
    return top_per_group(df, key, [F.col(c) for c in order], 1, "_first").drop("_first")


def hash_cut(df: DataFrame, group: str, key: str, quota: Column, seed: int) -> DataFrame:
    """Per group, the hash value at which a seeded pick of `quota` rows ends: `(group, n, cut_hash, cut_key)`.

    `quota` is an expression over the group size `n`. Keys are hashed, counted in hash buckets per group,
    and only the bucket the quota falls into is ordered; that bucket holds about n / HASH_BUCKETS rows.
    """
    keyed = df.select(F.col(group), F.col(key), seeded_hash(key, seed).alias("_h"))
    keyed = keyed.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    per_bucket = keyed.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(group).orderBy("_b")
    edges = (
        per_bucket.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("n", F.sum("_n").over(Window.partitionBy(group)))
        .withColumn("_quota", quota)
        .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select(group, "_b", "n", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    place = F.row_number().over(Window.partitionBy(group).orderBy("_h", key))
    return (
        keyed.join(broadcast_if_small(edges), [group, "_b"])
        .withColumn("_place", place)
        .where(F.col("_place") == F.col("_need"))
        .select(group, "n", F.col("_h").alias("cut_hash"), F.col(key).alias("cut_key"))
    )


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
