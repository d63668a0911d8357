"""Whole workloads: text annotation, column typing, and two-step annotation with a large vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_selection_replies, parse_table_replies, parse_text_replies
from ..functions.scores import select_types
from ..functions.text import strings, text_task_size
from ..operators.batching import pack_batches, shard_types
from ..operators.model import Calls, run_attempts, settle_attempts
from ..operators.prompts import ascii_json, selection_prompt, table_prompt, tasks_json, text_prompt
from ..operators.scoring import assemble_results, score_items
from ..operators.validation import canonical_tasks, table_reply_errors, text_reply_errors
from ..operators.vocab import Vocabulary
from ..sources.shared import use_shared_folder


def text_batches(tasks: DataFrame, max_tasks: int = 10, max_chars: int = 12_000, shard_tasks: int | None = None) -> DataFrame:
    """job_id, batch_id, tasks (in order) from tasks (job_id, ord, task_id, text). Text joins its batch after packing."""
    sized = tasks.withColumn("size", text_task_size(F.col("task_id"), F.col("text")))
    packed = pack_batches(sized, max_tasks, max_chars, shard_tasks).select("job_id", "ord", (F.shiftleft("shard", 24) + F.col("batch")).alias("batch_id"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "task_id", "text")))
    return tasks.join(packed, ["job_id", "ord"]).groupBy("job_id", "batch_id").agg(listed.alias("tasks"))


def table_batches(tasks: DataFrame, max_tasks: int = 10, max_chars: int = 12_000, shard_tasks: int | None = None) -> DataFrame:
    """The same of table tasks with ``size`` and ``columns`` (batching.table_task_sizes, tasks.column_union)."""
    packed = pack_batches(tasks, max_tasks, max_chars, shard_tasks).select("job_id", "ord", (F.shiftleft("shard", 24) + F.col("batch")).alias("batch_id"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "task_id", "table_id", "columns", "sampled_rows_json")))
    return tasks.join(packed, ["job_id", "ord"]).groupBy("job_id", "batch_id").agg(listed.alias("tasks"))


def _types(batches: DataFrame, v: Vocabulary) -> DataFrame:
    """Batches with their allowed types: their own column, or the vocabulary's."""
    return batches if "types" in batches.columns else batches.withColumn("types", strings(v.types))


def validate_text(batches: DataFrame, v: Vocabulary) -> DataFrame:
    """Batch rows with raw_text -> parsed, is_valid, error_code. Narrow."""
    out = parse_text_replies(_types(batches, v))
    out = out.withColumn("parsed", canonical_tasks(F.col("reply.tasks"), F.col("types"), list(v.aliases), list(v.prefixes)))
    return _verdict(out, text_reply_errors(F.col("tasks"), F.col("parsed"), F.col("types"), v.dense))


def validate_tables(batches: DataFrame, v: Vocabulary) -> DataFrame:
    out = parse_table_replies(_types(batches, v))
    out = out.withColumn("parsed", canonical_tasks(F.col("reply.tasks"), F.col("types"), list(v.aliases), list(v.prefixes)))
    return _verdict(out, table_reply_errors(F.col("tasks"), F.col("parsed"), F.col("types"), v.dense))


def _verdict(df: DataFrame, errors) -> DataFrame:
    df = df.withColumn("errors", F.when(F.col("reply.error_code").isNull(), errors).otherwise(F.array("reply.error_code")))
    df = df.withColumn("error_code", F.try_element_at("errors", F.lit(1))).withColumn("error_detail", F.col("reply.error_detail"))
    return df.withColumn("is_valid", F.col("error_code").isNull()).drop("reply")


def settled(attempts: DataFrame, keep_valid_batches: bool = False, held: bool = False) -> DataFrame:
    """The attempts that count: each batch's first valid one, of jobs that didn't fail. Of the others, operators.jobs.job_outcomes tells.

    The verdict on a job and the rows it picks both read the attempts, so these are checkpointed once parsed, unless
    they are ``held`` already.
    """
    if not held:
        use_shared_folder(attempts.sparkSession)
        attempts = attempts.checkpoint()
    verdict = settle_attempts(attempts.select("job_id", "batch_id", "attempt", "is_valid", "error_code"), keep_valid_batches)
    good = verdict.where("not job_failed").select("job_id", "batch_id", "attempt")
    return attempts.join(good, ["job_id", "batch_id", "attempt"], "left_semi")


def answered(valid: DataFrame) -> DataFrame:
    """job_id, types, m (struct t, p) of every task of settled batches that has a reply: its last. A batch row knows all, so nothing is shuffled."""
    last = lambda t: F.try_element_at(F.filter("parsed", lambda p: p["task_id"] == t["task_id"]), F.lit(-1))
    matched = F.transform("tasks", lambda t: F.struct(t.alias("t"), last(t).alias("p")))
    return valid.select("job_id", "types", F.explode(F.filter(matched, lambda m: m["p"].isNotNull())).alias("m"))


def text_annotations(valid: DataFrame, v: Vocabulary, include_scores: bool = False) -> DataFrame:
    """Flat annotations of settled text batches; of a repeated task_id the last reply counts, for every occurrence. Narrow."""
    kept = answered(valid)
    items = kept.select("job_id", "m.t.ord", "m.p.task_id", "types", F.col("m.t.text").alias("task_text"), F.posexplode("m.p.items").alias("entity_idx", "i"))
    scored = score_items(items.select("*", "i.start", "i.end", "i.scores"), F.col("types"), coarse=v.coarse, include_scores=include_scores)
    scored = scored.withColumn("text", F.substring("task_text", F.col("start") + 1, F.col("end") - F.col("start")))
    columns = ["job_id", "ord", "task_id", "entity_idx", "start", "end", "text", "type_id", "confidence"]
    return scored.select(*columns, *[c for c in ("coarse_type_id", "distribution") if c in scored.columns])


def column_annotations(valid: DataFrame, v: Vocabulary, include_scores: bool = False) -> DataFrame:
    kept = answered(valid)
    items = kept.select("job_id", "m.t.ord", "m.p.task_id", "m.p.table_id", "types", F.posexplode("m.p.items").alias("column_idx", "i"))
    scored = score_items(items.select("*", "i.column", "i.scores"), F.col("types"), coarse=v.coarse, include_scores=include_scores)
    columns = ["job_id", "ord", "task_id", "table_id", "column_idx", "column", "type_id", "confidence"]
    return scored.select(*columns, *[c for c in ("coarse_type_id", "distribution") if c in scored.columns])


def text_attempts(tasks: DataFrame, v: Vocabulary, make: Callable, max_retries: int = 2, concurrency: int | None = None, calls: Calls = Calls(), **limits) -> DataFrame:
    """Tasks to all attempts of all their batches, checkpointed: packed, prompted, called and validated; in two steps if the vocabulary asks for a prefilter."""
    if not v.supports_text:
        raise ValueError(f"vocabulary {v.name} does not do texts")
    batches = _types(text_batches(tasks, **limits), v)
    if v.prefilter:
        batches = prefilter(batches, v, make, "text", max_retries, concurrency, calls=calls)
    slim = F.transform("tasks", lambda t: F.struct(t["task_id"].alias("task_id"), t["text"].alias("text")))
    batches = batches.withColumn("prompt", text_prompt(v, F.col("types"), slim))
    return run_attempts(batches, make, lambda df: validate_text(df, v), max_retries, concurrency, calls)


def annotate_texts(tasks: DataFrame, v: Vocabulary, make: Callable, include_scores: bool = False, max_retries: int = 2, concurrency: int | None = None, keep_valid_batches: bool = False, calls: Calls = Calls(), **limits) -> DataFrame:
    """Tasks to flat annotations with a model function."""
    attempts = text_attempts(tasks, v, make, max_retries, concurrency, calls, **limits)
    return text_annotations(settled(attempts, keep_valid_batches, held=True), v, include_scores)


def annotate_tables(tasks: DataFrame, v: Vocabulary, make: Callable, include_scores: bool = False, max_retries: int = 2, concurrency: int | None = None, keep_valid_batches: bool = False, calls: Calls = Calls(), **limits) -> DataFrame:
    if not v.supports_table:
        raise ValueError(f"vocabulary {v.name} does not do tables")
    batches = _types(table_batches(tasks, **limits), v)
    if v.prefilter:
        batches = prefilter(batches, v, make, "table", max_retries, concurrency, calls=calls)
    batches = batches.withColumn("prompt", table_prompt(v, F.col("types"), ascii_json(_tables_json(F.col("tasks")))))
    attempts = run_attempts(batches, make, lambda df: validate_tables(df, v), max_retries, concurrency, calls)
    return column_annotations(settled(attempts, keep_valid_batches, held=True), v, include_scores)


def _tables_json(tasks):
    one = lambda t: F.concat(F.lit('{"task_id":'), _quoted(t["task_id"]), F.lit(',"table_id":'), _quoted(t["table_id"]), F.lit(',"sampled_rows":'), t["sampled_rows_json"], F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(tasks, one), ","), F.lit("]"))


def _quoted(text):
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def selected_types(selections: DataFrame, types: list[str]) -> DataFrame:
    """job_id, batch_id, types from selections (job_id, batch_id, selected): the union over a batch's shards, in
    vocabulary order; all types if nothing was selected."""
    union = selections.groupBy("job_id", "batch_id").agg(F.array_distinct(F.flatten(F.collect_list("selected"))).alias("u"))
    every = strings(types)
    return union.select("job_id", "batch_id", F.when(F.size("u") == 0, every).otherwise(F.array_intersect(every, F.col("u"))).alias("types"))


def prefilter(batches: DataFrame, v: Vocabulary, make: Callable, mode: str, max_retries: int = 2, concurrency: int | None = None, max_chars: int = 12_000, calls: Calls = Calls()) -> DataFrame:
    """Batches with ``types`` narrowed by a first call for each shard of the vocabulary; a shard that stays invalid fails its job."""
    payload = tasks_json(F.col("tasks")) if mode == "text" else ascii_json(_tables_json(F.col("tasks")))
    use_shared_folder(batches.sparkSession)
    asked = batches.withColumn("payload", payload).checkpoint()  # feeds the shards and the calls
    asked = asked.withColumn("overhead", F.length(selection_prompt(v, F.array().cast("array<string>"), F.col("payload"), mode)).cast("long"))
    shards = shard_types(asked.select("overhead"), list(v.types), max_chars).select("overhead", "shard", F.col("type_ids").alias("shard_types"))
    prompts = asked.join(shards, "overhead").select("job_id", F.col("batch_id").alias("of_batch"), (F.col("batch_id") * 65536 + F.col("shard")).alias("batch_id"), "shard_types", selection_prompt(v, F.col("shard_types"), F.col("payload"), mode).alias("prompt"))

    def validate(df: DataFrame) -> DataFrame:
        out = parse_selection_replies(df)
        out = out.withColumn("selected", select_types(F.col("reply.items"), F.col("shard_types"), list(v.aliases), list(v.prefixes)))
        out = out.select("*", "reply.error_code", "reply.error_detail")
        return out.withColumn("is_valid", F.col("error_code").isNull()).drop("reply")

    attempts = run_attempts(prompts, make, validate, max_retries, concurrency, calls)
    good = settled(attempts, held=True).select("job_id", F.col("of_batch").alias("batch_id"), "selected")
    return batches.drop("types").join(selected_types(good, list(v.types)), ["job_id", "batch_id"])


def nested_results(tasks: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row a task with its entities, for every task, in input order."""
    fields = [c for c in annotations.columns if c not in ("job_id", "ord", "task_id", "entity_idx")]
    return assemble_results(tasks, annotations.withColumnRenamed("entity_idx", "idx").dropDuplicates(["job_id", "task_id", "idx"]), fields)
