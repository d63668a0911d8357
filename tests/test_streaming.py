import pytest

from semtag.operators.vocab import BUILT_IN, FINE_TO_COARSE
from semtag.queries import _echo_model
from semtag.streaming import annotate


def submissions(spark, at):
    rows = [(f"j{i}", [(f"t{k}", f"some words {i} {k}", "more")[:2] for k in range(i % 3)], f"2024-01-01 00:0{i}:00") for i in range(6)]
    for half in (0, 1):
        df = spark.createDataFrame(rows[3 * half : 3 * half + 3] + rows[:1] * half, "job_id string, tasks array<struct<task_id:string,text:string>>, created_at string")
        df.selectExpr("job_id", "tasks", "cast(created_at as timestamp) as created_at").coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def run(spark, at, stream):
    annotate.annotate_submissions(stream, BUILT_IN["fine"], _echo_model(list(FINE_TO_COARSE)), f"{at}/out", f"{at}/state").awaitTermination()


def rows(spark, at, what):
    return sorted(map(str, (x.asDict() for x in annotate.committed(spark, f"{at}/out", what).drop("epoch").collect())))


def test_a_restart_gives_the_same_rows(spark, tmp_path, monkeypatch):
    plain, broken = f"{tmp_path}/a", f"{tmp_path}/b"
    run(spark, plain, submissions(spark, plain))
    stream, calls, whole = submissions(spark, broken), [], annotate.settle_attempts

    def fails_once(attempts, *rest):
        calls.append(1)
        if len(calls) == 2:  # results of the second epoch are written, its states and manifest aren't
            raise RuntimeError("lost")
        return whole(attempts, *rest)

    monkeypatch.setattr(annotate, "settle_attempts", fails_once)
    with pytest.raises(Exception, match="lost"):
        run(spark, broken, stream)
    assert len(rows(spark, broken, "results")) < len(rows(spark, plain, "results"))
    run(spark, broken, submissions_again(spark, broken))
    for what in ("results", "events"):
        assert rows(spark, broken, what) == rows(spark, plain, what)
    # the job sent again in the second file counts once; a job without tasks completes
    states = [x for x in annotate.committed(spark, f"{plain}/out", "events").collect() if x["job_id"] == "j0"]
    assert sorted(x["status"] for x in states) == ["completed", "processing", "queued"]


def submissions_again(spark, at):
    return spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def test_jobs_in_processing_end_when_time_has_passed(spark, tmp_path):
    from semtag.operators.jobs import job_state
    from semtag.streaming.states import job_state_changes

    rows = [[("a", 1, "queued", "00:00:00"), ("a", 2, "processing", "00:00:30"), ("b", 3, "processing", "00:00:00"), ("b", 3, "processing", "00:00:00"), ("b", 4, "completed", "00:01:00"), ("b", 2, "failed", "00:00:10")], [("c", 5, "processing", "05:00:00")], [("d", 6, "queued", "05:01:00")]]
    for part in rows:
        df = spark.createDataFrame(part, "job_id string, seq long, status string, at string").selectExpr("job_id", "seq", "status", "cast(concat('2024-01-01 ', at) as timestamp) as updated_at")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = job_state_changes(stream, wait=600, delay="1 minute").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {x["job_id"]: (x["status"], str(x["updated_at"])[11:19]) for x in job_state(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert last == {"a": ("failed", "00:10:30"), "b": ("completed", "00:01:00"), "c": ("processing", "05:00:00"), "d": ("queued", "05:01:00")}


def test_job_states_combine_before_they_are_shuffled(spark, tmp_path):
    """Without timers no event passes Python or the exchange: a job is one row there, in each epoch."""
    from semtag.operators.jobs import job_state
    from semtag.streaming.states import job_state_changes, write_changes

    for epoch in (0, 1):
        rows = spark.range(5000).selectExpr("id % 7 as job_id", f"id * 2 + {epoch} as seq", "if(id % 2 = 0, 'queued', 'completed') as status", f"timestamp_seconds(id div 100 * {1 - epoch} + 10) as updated_at")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = write_changes(job_state_changes(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    told = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert [p["numRowsUpdated"] for p in told] == [7, 7] and not any("transformWithState" in p["operatorName"] for p in told)
    key = lambda df: sorted(map(tuple, df.selectExpr("cast(job_id as string)", "seq", "status").collect()))
    assert key(job_state(spark.read.parquet(f"{tmp_path}/out").drop("epoch"))) == key(job_state(spark.read.parquet(f"{tmp_path}/in")))


def test_an_epoch_of_submissions_has_many_files(spark, tmp_path):
    """So that one task doesn't write or read an epoch whole."""
    from semtag.queries import _submission_stream

    made = spark.range(200).selectExpr("id div 2 as conv_id", "cast(id % 2 as int) as turn", "'a word' as text")
    made.write.parquet(f"{tmp_path}/conversations.parquet")
    stream = _submission_stream(spark, str(tmp_path), f"{tmp_path}/at")
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(list((tmp_path / "at/in").glob("*.parquet"))) == 8 and [p["numInputRows"] > 0 for p in query.recentProgress] == [True, True]
