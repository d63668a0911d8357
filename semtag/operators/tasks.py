"""Annotation tasks: building, validating and gating them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_END, strip


def lines_to_tasks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One task for each stripped, non-blank line: job_id, ord (from 1), task_id (``t1``, ``t2``, ...), text. Narrow."""
    lines = F.filter(F.transform(F.split(F.col(text_col), LINE_END), strip), lambda x: x != "")
    rows = df.select(F.col(id_col).cast("string").alias("job_id"), F.posexplode(lines).alias("pos", "text"))
    return rows.select("job_id", (F.col("pos") + 1).cast("long").alias("ord"), F.concat(F.lit("t"), F.col("pos") + 1).alias("task_id"), "text")


def validate_text_tasks(tasks: DataFrame) -> DataFrame:
    """tasks with ``reason``: null if accepted."""
    return tasks.withColumn("reason", F.when(F.col("task_id").isNull(), "missing task_id").when(F.col("text").isNull(), "missing text"))


def validate_table_tasks(tasks: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("task_id").isNull(), "missing task_id")
        .when(F.col("table_id").isNull(), "missing table_id")
        .when(F.coalesce(F.size("sampled_rows"), F.lit(0)) < 1, "no sampled rows")
    )
    return tasks.withColumn("reason", reason)


def jobs_without_tasks(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs that bring no task at all."""
    return jobs.join(tasks.select("job_id").distinct(), "job_id", "left_anti")


def require_schema(jobs: DataFrame, config: DataFrame) -> DataFrame:
    """Jobs that name an unknown vocabulary or none (null), with an error that lists the known ones, sorted: one name a vocabulary."""
    known = config.agg(F.array_join(F.array_sort(F.collect_set("schema")), ", ")).first()[0]
    unknown = jobs.join(config.select("schema"), "schema", "left_anti")
    return unknown.withColumn("error", F.concat(F.lit("unknown schema "), F.coalesce("schema", F.lit("null")), F.lit(f"; known: {known}")))


def gate_capability(jobs: DataFrame, config: DataFrame) -> DataFrame:
    """Jobs of known vocabularies with ``supported``: whether the vocabulary does their endpoint's kind of task."""
    fit = F.when(F.col("endpoint_type") == "ner", F.col("supports_text")).when(F.col("endpoint_type") == "tabular", F.col("supports_table")).otherwise(False)
    return jobs.join(config, "schema").withColumn("supported", fit).select(*jobs.columns, "supported")


def column_union(tasks: DataFrame) -> DataFrame:
    """Table tasks with ``columns``: all keys of their sampled rows, also those with null values. Narrow."""
    return tasks.withColumn("columns", F.array_distinct(F.flatten(F.transform("sampled_rows", F.map_keys))))


def sample_table_rows(rows: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """One table task for each table_id from rows (table_id, row_id, row map): its n first rows by ``order``, else by a hash of row_id.

    A bounded top-n, so that a table of any size is sampled without sorting it.
    """
    rank = F.col(order) if order else F.xxhash64("row_id")
    top = Window.partitionBy("table_id").orderBy(rank, "row_id")
    kept = rows.withColumn("__n", F.row_number().over(top)).where(F.col("__n") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__n", "row")), lambda a, b: a["__n"] - b["__n"]), lambda r: r["row"])
    return kept.groupBy("table_id").agg(listed.alias("sampled_rows")).select(F.concat(F.lit("task-"), "table_id").alias("task_id"), "table_id", "sampled_rows")


def sample_wide_table(df: DataFrame, table_id: str, n: int, order: list[str] | None = None) -> DataFrame:
    """One table task from one wide frame: its n first rows by ``order``, else by a hash of the row, as maps of column to text.

    A top-n that is bounded in each partition and merged; only the n rows are turned to maps and meet in one task.
    """
    columns = df.columns
    rank = [F.col(c) for c in order] if order else [F.xxhash64(*columns)]
    top = df.orderBy(*rank).limit(n).select(F.struct(*[r.alias(f"k{i}") for i, r in enumerate(rank)]).alias("k"), F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]).alias("row"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", F.map_entries("row").alias("row")))), lambda r: F.map_from_entries(r["row"]))
    return top.agg(listed.alias("sampled_rows")).where(F.size("sampled_rows") > 0).select(F.lit(f"task-{table_id}").alias("task_id"), F.lit(table_id).alias("table_id"), "sampled_rows")


def flatten_results(results: DataFrame) -> DataFrame:
    """Nested text results (job_id, ord, task_id, entities) as one row an entity, in order."""
    return results.select("job_id", "ord", "task_id", F.posexplode("entities").alias("entity_idx", "e")).select("job_id", "ord", "task_id", "entity_idx", "e.*")
