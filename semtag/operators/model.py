"""The model call: a user's function or collected replies, retries, and settling attempts."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import use_shared_folder
from .prompts import retry_prompt


@dataclass(frozen=True)
class Calls:
    """How a task calls the model: prompts in one call, calls at once (from threads of their own), seconds that one may take."""

    group: int = 1
    at_once: int = 1
    timeout: float = 60.0


def call_once(generate: Callable[[list[str]], list[str]], asked: list[str], timeout: float) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt of one call. Nothing is sent again.

    A call that raises or is late fails all its prompts. Of fewer replies than prompts, the prompts without one fail;
    more replies than prompts can't be matched, so all fail; what is no text fails alone. A late call's thread is left behind.
    """
    told: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            told.put((list(generate(asked)), None))
        except BaseException as e:  # the user's client may raise anything
            told.put((None, f"{type(e).__name__}: {e}"))

    threading.Thread(target=run, daemon=True).start()
    try:
        replies, error = told.get(timeout=timeout)
    except queue.Empty:
        replies, error = None, f"TimeoutError: no reply in {timeout:g} s"
    if error is None and len(replies) > len(asked):
        error = f"{len(replies)} replies to {len(asked)} prompts"
    if error is not None:
        return [(None, error)] * len(asked)
    short = [(None, f"{len(replies)} replies to {len(asked)} prompts")] * (len(asked) - len(replies))
    return [(r, None) if isinstance(r, str) else (None, f"the reply is no text but {type(r).__name__}") for r in replies] + short


def annotate_with(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], concurrency: int | None = None, calls: Calls = Calls()) -> DataFrame:
    """prompts (with ``prompt``) plus ``raw_text`` and ``call_error``; every prompt is sent once.

    ``make()`` builds a client once in a task; ``concurrency`` is the number of tasks, each with ``calls.at_once`` calls
    at a time, of up to ``calls.group`` prompts. A null prompt isn't sent.
    """
    spread = prompts.repartition(concurrency) if concurrency else prompts

    at = spread.columns.index("prompt")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = None
        with ThreadPoolExecutor(calls.at_once) as pool:
            for batch in batches:
                given = batch.column(at).to_pylist()
                sent = [i for i, p in enumerate(given) if p is not None]
                groups = [sent[i : i + calls.group] for i in range(0, len(sent), calls.group)]
                if groups and generate is None:
                    generate = make()
                told: list[tuple[str | None, str | None]] = [(None, "no prompt")] * len(given)
                for group, replies in zip(groups, pool.map(lambda g: call_once(generate, [given[i] for i in g], calls.timeout), groups), strict=True):  # noqa: B023
                    for i, reply in zip(group, replies, strict=True):
                        told[i] = reply
                added = [pa.array([x[i] for x in told], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "raw_text", "call_error"])

    added = [T.StructField(name, T.StringType()) for name in ("raw_text", "call_error")]
    return spread.mapInArrow(call, T.StructType([*spread.schema.fields, *added]))


def replay(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Batches with the replies that were collected for them, one row an attempt."""
    return batches.join(replies, [c for c in ("job_id", "batch_id") if c in batches.columns and c in replies.columns])


def run_attempts(batches: DataFrame, make, validate: Callable[[DataFrame], DataFrame], max_retries: int = 2, concurrency: int | None = None, calls: Calls = Calls()) -> DataFrame:
    """All attempts of all batches: call, validate, and call again, with the error, for those not yet valid.

    ``validate`` adds is_valid, error_code and error_detail. The batches and each round are checkpointed, so that packing and
    prompts aren't made again for a later round and no prompt is sent again when something later is recomputed. A failure of the call itself (error_code ``call_failed``) is not
    tried again and so fails its job, and no other.
    """
    use_shared_folder(batches.sparkSession)
    batches = batches.checkpoint()
    todo, rounds = batches, []
    for attempt in range(max_retries + 1):
        done = validate(annotate_with(todo, make, concurrency, calls)).withColumn("attempt", F.lit(attempt))
        done = done.withColumn("error_code", F.when(F.col("call_error").isNotNull(), "call_failed").otherwise(F.col("error_code")))
        done = done.withColumn("error_detail", F.coalesce("call_error", "error_detail")).withColumn("is_valid", F.col("is_valid") & F.col("call_error").isNull()).drop("call_error").checkpoint()
        rounds.append(done)
        failed = done.where("not is_valid and error_code != 'call_failed'")
        if attempt == max_retries or failed.isEmpty():
            break
        told = F.concat_ws(": ", "error_code", "error_detail").alias("__told")
        todo = batches.join(failed.select("job_id", "batch_id", told), ["job_id", "batch_id"])
        todo = todo.withColumn("prompt", retry_prompt(F.col("prompt"), F.col("__told"))).select(*batches.columns)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def settle_attempts(attempts: DataFrame, keep_valid_batches: bool = False) -> DataFrame:
    """job_id, batch_id, attempt (the first valid one, else null), error_code (the last, if none), job_failed.

    A batch without a valid attempt fails its whole job; ``keep_valid_batches`` fails only the batch.
    """
    batches = attempts.groupBy("job_id", "batch_id").agg(
        F.min(F.when(F.col("is_valid"), F.col("attempt"))).alias("attempt"),
        F.max_by(F.when(~F.col("is_valid"), F.col("error_code")), "attempt").alias("last_error"),
    )
    batches = batches.select("job_id", "batch_id", "attempt", F.when(F.col("attempt").isNull(), F.col("last_error")).alias("error_code"))
    if keep_valid_batches:
        return batches.withColumn("job_failed", F.col("attempt").isNull())
    failed = batches.groupBy("job_id").agg(F.max(F.col("attempt").isNull()).alias("job_failed"))
    return batches.join(failed, "job_id")
