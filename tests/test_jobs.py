import random

from hypothesis import given
from hypothesis import strategies as st

from semtag.operators.jobs import NOTHING, accept_submissions, admit_with_departures, apply, then

CLAMPS = st.tuples(st.integers(-5, 5), st.integers(-9, 0), st.integers(0, 9))


@given(st.lists(CLAMPS, max_size=8), st.integers(-20, 20))
def test_clamps_compose(clamps, depth):
    whole, one_by_one = (0, -(1 << 62), 1 << 62), depth
    for c in clamps:
        whole, one_by_one = then(whole, c), apply(c, one_by_one)
    assert apply(whole, depth) == one_by_one and apply(NOTHING, 7) == 7


def test_ids_are_taken_again_only_after_they_left(spark):
    r = random.Random(1)
    rows, want, waiting = [], {}, set()
    for seq in range(600):
        job = r.choice(["hot", "hot", "a", "b", None])
        kind = r.choice(["submit", "submit", "take", "other"])
        rows.append((job, kind, None if seq < 5 else f"2024-01-01 {seq // 60:02d}:{seq // 10 % 6:01d}0:00", seq, "mine"))
        if kind == "submit":
            want[seq] = job not in waiting
            waiting.add(job)
        elif kind == "take":
            waiting.discard(job)
    df = spark.createDataFrame(rows, "job_id string, kind string, at string, seq int, accepted_by string").selectExpr("job_id", "kind", "cast(at as timestamp) as at", "seq", "accepted_by").repartition(5)
    got = accept_submissions(df)
    assert got.columns == [*df.columns, "accepted"] and {x["seq"]: x["accepted"] for x in got.collect()} == want
    assert accept_submissions(df.where("false")).count() == 0


def test_rooms_left_by_departures(spark):
    r = random.Random(2)
    rows, depth, want = [], {}, {}
    for seq in range(900):
        q, kind = r.choice(["hot"] * 6 + ["a", None]), r.choice(["arrive"] * 3 + ["leave"] * 2 + ["other"])
        rows.append((q, seq // 3, seq, kind, "mine"))
        n = depth.get(q, 2)
        if kind == "arrive":
            want[seq] = (n, n < 4)
            depth[q] = min(n + 1, 4)
        elif kind == "leave":
            depth[q] = max(n - 1, 0)
    df = spark.createDataFrame(rows, "queue string, at int, seq int, kind string, more string").repartition(3)
    got = admit_with_departures(df, maxsize=4, depth=2).collect()
    assert {x["seq"]: (x["depth_before"], x["admitted"]) for x in got} == want and len(got) == len(want)
    assert admit_with_departures(df.where("false")).count() == 0


def test_states_of_a_bucketed_log_need_no_exchange(spark):
    import uuid

    from semtag.operators.jobs import job_state, merge_states
    from semtag.sources.io import append_job_log, compact_job_log

    log, states, after = (f"t{uuid.uuid4().hex}" for _ in range(3))
    r = random.Random(5)
    rows = [(f"j{r.randrange(40)}", i, r.choice(["queued", "completed"]), i // 2) for i in range(500)]
    df = spark.createDataFrame(rows, "job_id string, seq int, status string, updated_at int")
    for part in (0, 1):
        append_job_log(df.where(f"seq % 2 = {part} and seq < 300"), log, 4)
    compact_job_log(spark, log, None, states, 4)
    rest, again = df.where("seq >= 250"), f"{log}b"
    append_job_log(rest, again, 4)
    compact_job_log(spark, again, states, after, 4)
    told = lambda x: sorted(map(tuple, x.collect()))
    assert told(spark.table(after)) == told(job_state(df)) and spark.table(states).count() == 40
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(job_state(spark.table(log))) and "Exchange" not in plan(merge_states(spark.table(states), job_state(spark.table(again))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    for name in (log, again, states, after):
        spark.sql(f"drop table {name}")
