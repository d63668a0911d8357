"""Reading tasks, replies, vocabularies and JSON-LD; writing annotations, vocabularies and job states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import job_state, merge_states

TEXT_REQUEST = "job_id string, schema string, include_scores boolean, tasks array<struct<task_id:string,text:string>>"
TABLE_REQUEST = "job_id string, schema string, include_scores boolean, tasks array<struct<task_id:string,table_id:string,sampled_rows:array<map<string,string>>>>"
REPLIES = "job_id string, batch_id long, attempt int, raw_text string"


def read_text_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Requests (one JSON object a line) as one row a task; ``ord`` is its place in the list."""
    return spark.read.schema(TEXT_REQUEST).json(path).select("job_id", "schema", "include_scores", F.posexplode("tasks").alias("ord", "t")).select("job_id", "schema", "include_scores", F.col("ord").cast("long").alias("ord"), "t.*")


def read_table_tasks(spark: SparkSession, path: str) -> DataFrame:
    """As read_text_tasks. ``sampled_rows_json`` keeps numbers and booleans as they were written."""
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind).alias(name)
    tasks = F.posexplode(F.try_variant_get("v", "$.tasks", "array<variant>")).alias("ord", "t")
    rows = raw.select(get("job_id", "string"), get("schema", "string"), get("include_scores", "boolean"), tasks)
    of = lambda name, kind="string": F.try_variant_get("t", f"$.{name}", kind)
    return rows.select(
        "job_id", "schema", "include_scores", F.col("ord").cast("long").alias("ord"), of("task_id").alias("task_id"), of("table_id").alias("table_id"),
        F.to_json(of("sampled_rows", "variant")).alias("sampled_rows_json"),
        F.transform(of("sampled_rows", "array<map<string,variant>>"), lambda m: F.transform_values(m, lambda _, v: F.try_variant_get(v, "$", "string"))).alias("sampled_rows"),
    )


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """ord, type_id of a JSON file: a list, or an object that wraps one; items are ids or objects with an id.

    The first of the wrapping keys that is there counts, whatever it holds.
    """
    root = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = lambda at: F.try_variant_get("v", at, "array<variant>")
    there = lambda k: F.try_variant_get("v", f"$.{k}", "variant").isNotNull()
    wrapped = [F.when(there(k), F.coalesce(listed(f"$.{k}"), F.array().cast("array<variant>"))) for k in ("types", "type_ids", "items", "data")]
    items = root.select(F.posexplode(F.coalesce(listed("$"), *wrapped)).alias("ord", "x"))
    kind = F.schema_of_variant("x")
    own = F.when(kind == "STRING", F.try_variant_get("x", "$", "string"))
    inner = F.when(F.schema_of_variant(F.try_variant_get("x", "$.id", "variant")) == "STRING", F.try_variant_get("x", "$.id", "string"))
    found = items.select("ord", F.coalesce(own, inner).alias("type_id")).where("type_id is not null")
    found = found.groupBy("type_id").agg(F.min("ord").alias("ord")).select("ord", "type_id")
    if found.isEmpty():
        raise ValueError(f"{path} has no type ids")
    return found


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPLIES).parquet(path)


def read_jsonld(spark: SparkSession, directory: str) -> DataFrame:
    """path (under the directory), doc of every .jsonld file below it."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonld").text(directory, wholetext=True)
    tail = F.substring_index(F.col("_metadata.file_path"), directory.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select(tail.alias("path"), F.col("value").alias("doc"))


def write_annotations(df: DataFrame, path: str, by: str = "schema", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_annotations_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested results, one JSON object a line, with null fields."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_vocabulary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """id, label, iri sorted by id, over as many files as the sort makes."""
    df.orderBy("id").write.mode(mode).json(path)


def write_job_state(events: DataFrame, path: str) -> None:
    """Append status events; the state of a job is its last event (jobs.job_state)."""
    events.write.mode("append").parquet(path)


def append_job_log(events: DataFrame, table: str, buckets: int = 16) -> None:
    """Append status events to a table bucketed and sorted by job_id: jobs.job_state of it needs no exchange. All appends take one number of buckets."""
    events.write.bucketBy(buckets, "job_id").sortBy("job_id").format("parquet").mode("append").saveAsTable(table)


def compact_job_log(spark: SparkSession, log: str, states: str | None, into: str, buckets: int = 16) -> None:
    """Write table ``into``, the last state of each job of the log and of an earlier table of states (None: there is none yet), bucketed the same way.

    The log needs to hold the events since that table only; once ``into`` is there, a new log may begin. Nothing is replaced, so
    a run that fails leaves log and states as they were. Job ids are not null. If both tables have ``buckets`` buckets, no row is exchanged.
    """
    newest = job_state(spark.table(log).where("job_id is not null"))
    if states is not None:
        newest = merge_states(spark.table(states), newest)
    newest.write.bucketBy(buckets, "job_id").sortBy("job_id").format("parquet").mode("errorifexists").saveAsTable(into)
