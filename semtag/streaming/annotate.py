"""Annotation as a stream: submissions in, annotations and job states out, each job once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import job_outcomes
from ..operators.model import Calls, settle_attempts
from ..operators.vocab import Vocabulary
from ..plans.workloads import settled, text_annotations, text_attempts
from ..sources.shared import use_shared_folder


def dedupe_stream(submissions: DataFrame, key: str = "job_id", time: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """A key's first row; later ones are dropped while they come within ``delay``, which bounds the state."""
    timed = submissions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark([key])


def stream_annotate(tasks: DataFrame, annotate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``annotate`` over each micro-batch of tasks and write to out, by epoch.

    An epoch that is run again overwrites only its own folder, so results stand once whatever is
    retried. Readers drop a late re-delivery by (job_id, task_id).
    """

    def write(batch: DataFrame, epoch: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = tasks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def annotate_submissions(
    submissions: DataFrame,
    v: Vocabulary,
    make: Callable,
    out: str,
    checkpoint: str,
    include_scores: bool = False,
    max_retries: int = 2,
    concurrency: int | None = None,
    calls: Calls = Calls(),
    available_now: bool = True,
    **limits: int,
) -> StreamingQuery:
    """The whole annotation of a stream of jobs (job_id, created_at, tasks: array<struct<task_id,text>>): packed, called, validated, scored.

    An epoch writes ``out/results/epoch=N``, ``out/events/epoch=N`` (its jobs' states) and last ``out/manifest/epoch=N``, which commits
    it; ``committed`` reads only what is committed. An epoch that is run again overwrites its own folders. What is collected of
    an epoch is one number; its rows stay in Spark. Send submissions through dedupe_stream first.
    """
    use_shared_folder(submissions.sparkSession)
    adaptive = submissions.sparkSession.conf.get("spark.sql.adaptive.enabled")

    def run(batch: DataFrame, epoch: int) -> None:
        # a stream turns adaptive plans off, for its state's sake; what follows has no state, and its shuffles have rows for a few tasks only
        session = batch.sparkSession
        before = session.conf.get("spark.sql.adaptive.enabled")
        session.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            annotate(batch, epoch)
        finally:
            session.conf.set("spark.sql.adaptive.enabled", before)

    def annotate(batch: DataFrame, epoch: int) -> None:
        jobs = batch.select("job_id", "created_at", "tasks").checkpoint()
        tasks = jobs.select("job_id", F.posexplode("tasks").alias("ord", "t")).select("job_id", F.col("ord").cast("long").alias("ord"), "t.task_id", "t.text")
        attempts = text_attempts(tasks, v, make, max_retries, concurrency, calls, **limits)
        text_annotations(settled(attempts, held=True), v, include_scores).write.mode("overwrite").parquet(f"{out}/results/epoch={epoch}")
        verdict = settle_attempts(attempts.select("job_id", "batch_id", "attempt", "is_valid", "error_code"))
        ends = job_outcomes(jobs, verdict).join(verdict.select("job_id").distinct().withColumn("__called", F.lit(True)), "job_id", "left")
        # tasks whose types couldn't even be narrowed have no batches
        lost = F.col("__called").isNull() & (F.coalesce(F.size("tasks"), F.lit(0)) > 0)
        ends = ends.join(jobs, "job_id").select("job_id", F.when(lost, "failed").otherwise(F.col("status")).alias("status"), F.when(lost, "no selection").otherwise(F.col("error")).alias("error"), F.lit(2).alias("step"), "created_at")
        states = jobs.select("job_id", F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.lit(None).cast("string").alias("error"), F.lit(i).alias("step")) for i, s in enumerate(("queued", "processing"))])).alias("s"), "created_at")
        states.select("job_id", "s.*", "created_at").unionByName(ends).write.mode("overwrite").parquet(f"{out}/events/epoch={epoch}")
        batch.sparkSession.createDataFrame([(jobs.count(),)], "jobs long").coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/epoch={epoch}")

    writer = submissions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def committed(spark: SparkSession, out: str, what: str) -> DataFrame:
    """``results`` or ``events`` of committed epochs, with their epoch; a job that came again in a later epoch counts in its first only."""
    read = lambda name: spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}")
    done = read("manifest").select("epoch")
    first = read("events").join(done, "epoch", "left_semi").groupBy("job_id").agg(F.min("epoch").alias("epoch"))
    return read(what).join(first, ["job_id", "epoch"], "left_semi")
