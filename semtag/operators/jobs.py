"""Job tracking over a log of status events (job_id, seq, status, updated_at, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import use_shared_folder

STATUSES = ("queued", "processing", "completed", "failed")


def job_state(events: DataFrame) -> DataFrame:
    """The last event of each job; combines before it shuffles."""
    rest = [c for c in events.columns if c != "job_id"]
    return events.groupBy("job_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "seq")).alias("s")).select("job_id", "s.*")


def merge_states(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Of two tables of states, one row a job (job_id, seq, status, updated_at, ...; the same columns), each job's state that is last by (updated_at, seq).

    One join on the job; tables bucketed alike meet without an exchange.
    """
    rest = [c for c in older.columns if c != "job_id"]
    held = lambda df, name: df.select("job_id", F.struct(*rest).alias(name))
    both = held(older, "__a").join(held(newer, "__b"), "job_id", "full_outer")
    later = lambda s: F.struct(s["updated_at"], s["seq"])
    b_wins = F.col("__a").isNull() | (later(F.col("__b")) > later(F.col("__a")))
    return both.select("job_id", F.when(b_wins, F.col("__b")).otherwise(F.col("__a")).alias("s")).select("job_id", "s.*")


def job_view(state: DataFrame, asked: DataFrame) -> DataFrame:
    """job_id, found, status, result only if completed, error only if failed, for asked job ids."""
    joined = asked.select("job_id").join(state.withColumn("__found", F.lit(True)), "job_id", "left")
    return joined.select(
        "job_id",
        F.coalesce("__found", F.lit(False)).alias("found"),
        "status",
        F.when(F.col("status") == "completed", F.col("result")).alias("result"),
        F.when(F.col("status") == "failed", F.col("error")).alias("error"),
    )


def queue_depth(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n_jobs"))


def fifo_order(jobs: DataFrame, k: int | None = None) -> DataFrame:
    """Waiting jobs, oldest first, ties by job_id, nulls last, with ``position`` from 1.

    Jobs are dealt by ranges and sorted there; a position is the number of jobs in earlier ranges plus the
    place inside its own, so that no task holds all jobs. ``k`` gives only the first k, by a bounded top-k.
    """
    use_shared_folder(jobs.sparkSession)
    order = [F.col("created_at").asc_nulls_last(), F.col("job_id").asc_nulls_last()]
    if k is not None:
        jobs = jobs.orderBy(*order).limit(k)
    placed = jobs.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")).checkpoint()
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for part in range(max(counts, default=0) + 1):
        starts.append(before)
        before += counts.get(part, 0)
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("position", F.get(F.lit(starts).cast("array<long>"), F.col("__part")) + inside + 1).drop("__part", "__id")


def admit(arrivals: DataFrame, depth: int, maxsize: int = 1000) -> DataFrame:
    """arrivals with position and ``admitted``: in order of arrival, while the queue has room."""
    return fifo_order(arrivals).withColumn("admitted", F.col("position") + F.lit(depth) <= maxsize)


def dedupe_submissions(submissions: DataFrame) -> DataFrame:
    """The first submission of each job_id, by created_at, then seq: for ids that are never taken in between (accept_submissions knows takings)."""
    rest = [c for c in submissions.columns if c != "job_id"]
    return submissions.groupBy("job_id").agg(F.min_by(F.struct(*rest), F.struct("created_at", "seq")).alias("s")).select("job_id", "s.*")


def accept_submissions(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Submissions (job_id, kind ``submit`` or ``take``, at, seq) with ``accepted``: whether the id wasn't waiting already.

    A submission is accepted if its job's event before is a taking or there is none; takings only delimit the islands
    of submissions and are no rows of the result. Order: at, then seq; null times come first. A job's events are dealt by
    time ``bucket`` (of date_trunc), so that a job with most events has many tasks: inside a bucket the event before is known
    there; for a bucket's first event it is the last one of the job's bucket before, of which there is one row each.
    """
    at = F.col("at").cast("timestamp")
    dealt = events.where(F.col("kind").isin("submit", "take")).withColumn("__bucket", F.date_trunc(bucket, at))
    inside = Window.partitionBy("job_id", "__bucket").orderBy(F.col("at").asc_nulls_first(), F.col("seq").asc_nulls_first())
    seen = dealt.withColumn("__before", F.lag("kind").over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    order = F.struct(at.isNotNull().alias("k"), at.alias("a"), F.col("seq").isNotNull().alias("s"), F.col("seq").alias("q"))
    lasts = dealt.groupBy("job_id", "__bucket").agg(F.max_by("kind", order).alias("__last"))
    chain = Window.partitionBy("job_id").orderBy(F.col("__bucket").asc_nulls_first())
    ahead = lasts.select(F.col("job_id").alias("__job"), F.col("__bucket").alias("__at"), F.lag("__last").over(chain).alias("__ahead"))
    told = seen.join(ahead, F.col("job_id").eqNullSafe(F.col("__job")) & F.col("__bucket").eqNullSafe(F.col("__at")), "left")
    before = F.when(F.col("__first"), F.col("__ahead")).otherwise(F.col("__before"))
    return told.where("kind = 'submit'").withColumn("accepted", F.coalesce(before == "take", F.lit(True))).select(*events.columns, "accepted")


Clamp = tuple[int, int, int]  # depth -> min(max(depth + shift, least), most)
NOTHING: Clamp = (0, 0, 1 << 62)


def then(first: Clamp, second: Clamp) -> Clamp:
    """The clamp that is first, then second."""
    inside = lambda x: min(max(x + second[0], second[1]), second[2])
    return first[0] + second[0], inside(first[1]), inside(first[2])


def apply(clamp: Clamp, depth: int) -> int:
    return min(max(depth + clamp[0], clamp[1]), clamp[2])


def admit_with_departures(events: DataFrame, maxsize: int = 1000, depth: int = 0) -> DataFrame:
    """Arrivals (queue, at, seq, kind ``arrive`` or ``leave``) with ``depth_before`` and ``admitted``: whether the queue had room.

    An arrival joins while fewer than ``maxsize`` wait, else it is refused; a leaving takes one off, if one waits. Each
    queue starts with ``depth``. Order: at, then seq, both not null; queues may be null. An event is a function of the
    depth that adds and clamps, and such functions compose to one of three numbers. So events are dealt by ranges; each range
    tells the composed function of its first and last queue, these few numbers give the depth that each range
    begins with, and then each range goes through its events. No task holds a queue whole.
    """
    use_shared_folder(events.sparkSession)
    order = ["queue", "at", "seq"]
    slim = events.where(F.col("kind").isin("arrive", "leave"))
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    at_queue, at_kind, at_part = (dealt.columns.index(c) for c in ("queue", "kind", "__part"))
    arrive, leave = (1, 0, maxsize), (-1, 0, max(maxsize, depth))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = None, []  # the first and the last run: [queue, clamp]
        for batch in batches:
            for q, kind, part in zip(*(batch.column(i).to_pylist() for i in (at_queue, at_kind, at_part)), strict=True):  # noqa: B007
                if not runs or runs[-1][0] != q:
                    runs = [*runs[:1], [q, NOTHING]]
                runs[-1][1] = then(runs[-1][1], arrive if kind == "arrive" else leave)
        rows = [(part, i == 0, q, list(clamp)) for i, (q, clamp) in enumerate(runs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.bool_(), batch_type, pa.list_(pa.int64())))], names=["part", "first", "queue", "clamp"])

    kind = slim.schema["queue"].dataType
    batch_type = to_arrow_type(kind)
    fields = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("queue", kind), T.StructField("clamp", T.ArrayType(T.LongType()))])
    found = sorted(dealt.mapInArrow(summarise, fields).collect(), key=lambda r: (r["part"], not r["first"]))
    starts: dict[int, int] = {}  # by part, the depth of its first queue when it begins
    last: tuple | None = None
    for r in found:
        going_on = r["first"] and last is not None and last[0] == r["queue"]
        begin = last[1] if going_on else depth
        if r["first"]:
            starts[r["part"]] = begin
        last = r["queue"], apply(tuple(r["clamp"]), begin)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            before = []
            for q, kind, part in zip(*(batch.column(i).to_pylist() for i in (at_queue, at_kind, at_part)), strict=True):
                if now is None or now[0] != q:
                    n = starts[part] if now is None else depth
                    now = (q,)
                before.append(n)
                n = apply(arrive if kind == "arrive" else leave, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "depth_before"])

    walked = dealt.mapInArrow(walk, T.StructType([*dealt.schema.fields, T.StructField("depth_before", T.LongType())]))
    return walked.where("kind = 'arrive'").withColumn("admitted", F.col("depth_before") < maxsize).drop("__part")


def job_outcomes(jobs: DataFrame, settled: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """job_id, status (``completed`` or ``failed``), error of every job, and result if ``results`` (job_id, result) are given.

    ``settled``: what model.settle_attempts makes of all attempts. A failed job tells the code of its first
    failed batch. A job without batches completes, with nothing.
    """
    failed = settled.where("attempt is null").groupBy("job_id").agg(F.min_by("error_code", "batch_id").alias("error"), F.first(F.lit(True)).alias("__bad"))
    broken = settled.where("job_failed").select("job_id").distinct()
    bad = F.col("__bad").isNotNull()
    out = jobs.select("job_id").join(failed.join(broken, "job_id"), "job_id", "left")
    out = out.select("job_id", F.when(bad, "failed").otherwise("completed").alias("status"), F.when(bad, F.coalesce("error", F.lit("no reply"))).alias("error"))
    if results is None:
        return out
    return out.join(results.select("job_id", "result"), "job_id", "left").withColumn("result", F.when(F.col("status") == "completed", F.col("result")))


def dispatch(jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text jobs, table jobs, and jobs of no known endpoint with an error."""
    other = ~F.coalesce(F.col("endpoint_type").isin("ner", "tabular"), F.lit(False))
    failed = jobs.where(other).withColumn("error", F.concat(F.lit("unknown endpoint "), F.coalesce("endpoint_type", F.lit("null"))))
    return jobs.where("endpoint_type = 'ner'"), jobs.where("endpoint_type = 'tabular'"), failed
