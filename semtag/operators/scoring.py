"""Posteriors, best types and results: array form on the row, long form over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import argmax, distribution, fill_dense, normalize


def score_items(df: DataFrame, types: Column, scores: str = "scores", coarse: dict[str, str] | None = None, include_scores: bool = False) -> DataFrame:
    """df with type_id, confidence, coarse_type_id if a roll-up is given, distribution if asked for. Narrow."""
    df = df.withColumn("__types", types).withColumn("__p", normalize(fill_dense(F.col(scores), F.col("__types"))))
    df = df.withColumn("__best", argmax(F.col("__types"), F.col("__p")))
    df = df.withColumn("type_id", F.col("__best.type_id")).withColumn("confidence", F.col("__best.confidence"))
    if coarse is not None:
        df = df.withColumn("coarse_type_id", coarse_rollup(F.col("type_id"), coarse))
    if include_scores:
        df = df.withColumn("distribution", distribution(F.col("__types"), F.col("__p")))
    return df.drop("__types", "__p", "__best")


def coarse_rollup(type_id: Column, coarse: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in coarse.items() for x in kv]), type_id)


def normalize_long(scores: DataFrame) -> DataFrame:
    """item_id, ord, type_id, score -> also posterior, by a window over the item."""
    item = Window.partitionBy("item_id")
    score = F.coalesce("score", F.lit(0.0))
    total = F.sum(score).over(item)
    return scores.withColumn("posterior", F.when(total > 0, score / total).otherwise(F.lit(1.0) / F.count("*").over(item)))


def argmax_long(posteriors: DataFrame) -> DataFrame:
    """item_id, type_id, confidence: the greatest posterior, ties to the least ord; aggregates before it shuffles."""
    best = F.max(F.struct("posterior", (-F.col("ord")).alias("o"), "type_id")).alias("b")
    return posteriors.groupBy("item_id").agg(best).select("item_id", "b.type_id", F.col("b.posterior").alias("confidence"))


def assemble_results(tasks: DataFrame, items: DataFrame, fields: list[str], name: str = "entities") -> DataFrame:
    """One row for each input task (job_id, ord, task_id) with its items as an array, in reply order; none: empty.

    A repeated task_id repeats the result.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*fields).alias("e"))), lambda a, b: a["idx"] - b["idx"]), lambda x: x["e"])
    grouped = items.groupBy("job_id", "task_id").agg(listed.alias(name))
    joined = tasks.select("job_id", "ord", "task_id").join(grouped, ["job_id", "task_id"], "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType))).select("job_id", "ord", "task_id", name)
