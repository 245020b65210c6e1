"""Density topics as a stored model: the index of the rows it was fitted on, opened later to place new vectors.

The folder holds tables only: `blocks` (packed vectors by block), `cells` (pivots, counts and radii), `rows` (each row's core distance
and topic), `topics` (how close a new row must be), and `settings` (metric reduction and parameters). Nothing is fitted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions.vectors import as_double, unit
from lexitide.operators import blocks as B
from lexitide.operators.neighbors import DensityFit, Index, build_index, search


@dataclass
class TopicModel:
    """An opened model: the neighbour index of the fitted rows and what is known of them."""

    index: Index
    rows: DataFrame
    topics: DataFrame
    components: np.ndarray
    min_samples: int

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.index.packed.write.mode("overwrite").parquet(f"{path}/blocks")
        c = self.index.cells
        listed = [(i, [float(x) for x in c.pivots[i]], int(c.counts[i]), float(c.radius[i]), int(c.first_block[i]), int(c.n_blocks[i])) for i in range(len(c.pivots))]
        kind = "cell INT, pivot ARRAY<DOUBLE>, n LONG, radius DOUBLE, first_block LONG, n_blocks LONG"
        spark.createDataFrame(listed, kind).write.mode("overwrite").parquet(f"{path}/cells")  # a row per pivot
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.topics.write.mode("overwrite").parquet(f"{path}/topics")
        settings = [([[float(x) for x in line] for line in self.components], self.min_samples)]
        spark.createDataFrame(settings, "components ARRAY<ARRAY<DOUBLE>>, min_samples INT").write.mode("overwrite").parquet(f"{path}/settings")

    def assign(self, vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """`vectors` with `topic`: that of the fitted row nearest by mutual reachability, -1 if that row is noise or too far.

        A new row's core is its distance to the `min_samples`-th fitted row. Too far is beyond the distance at which the topic's
        rows came together, so a row far from all topics is noise.
        """
        components = F.array(*[F.array(*[F.lit(float(x)) for x in line]) for line in self.components])
        v = unit(F.col("embedding"))
        reduced = F.transform(components, lambda line: F.aggregate(F.zip_with(line, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
        asked = vectors.select(F.col(id_col).alias("id"), reduced.alias("v"))
        near = search(asked, self.index, self.min_samples, "euclidean", self_join=False)
        known = near.join(self.rows.select(F.col("id").alias("nbr"), "core", "topic"), "nbr")
        own = near.groupBy("id").agg(F.max("dist").alias("own"))
        reach = known.join(own, "id").withColumn("reach", F.greatest("dist", "core", "own"))
        best = reach.groupBy("id").agg(F.min(F.struct("reach", "dist", "nbr", "topic")).alias("b")).select("id", "b.topic", "b.reach")
        placed = best.join(self.topics, "topic").where(F.col("reach") <= F.col("radius") * (1 + 1e-9)).select(F.col("id").alias(id_col), "topic")
        return vectors.join(placed, id_col, "left").withColumn("topic", F.coalesce("topic", F.lit(-1)))


def topic_model(fit: DensityFit, topics: DataFrame | None = None, id_col: str = "doc_id") -> TopicModel:
    """The model of a fit; `topics(id_col, topic)` are its topics where they were merged afterwards.

    A merged topic reaches as far as the farthest of those that went into it.
    """
    rows = fit.reduced.select(F.col(id_col).alias("id"), as_double(F.col("embedding")).alias("v"))
    first = fit.topics.select(F.col(id_col).alias("id"), F.col("topic").alias("first"))
    last = (fit.topics if topics is None else topics).select(F.col(id_col).alias("id"), "topic")
    known = last.join(fit.cores, "id")
    merged = first.join(last, "id").select("first", "topic").distinct().join(fit.radii.withColumnRenamed("topic", "first"), "first")
    radii = merged.where("topic >= 0").groupBy("topic").agg(F.max("radius").alias("radius"))
    return TopicModel(build_index(rows), known, radii, fit.components, fit.min_samples)


def open_topic_model(spark: SparkSession, path: str) -> TopicModel:
    listed = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # a row per pivot
    cells = B.Cells(
        np.array([r["pivot"] for r in listed]), np.array([r["n"] for r in listed]), np.array([r["radius"] for r in listed]),
        np.array([r["first_block"] for r in listed]), np.array([r["n_blocks"] for r in listed]),
    )
    settings = spark.read.parquet(f"{path}/settings").first()
    index = Index(spark.read.parquet(f"{path}/blocks"), cells)
    return TopicModel(index, spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/topics"), np.array(settings["components"]), settings["min_samples"])
