import json

from pyspark.sql import functions as F

from semtag import queries
from semtag.operators.vocab import BUILT_IN, Vocabulary
from semtag.plans import workloads
from semtag.streaming.annotate import dedupe_stream, stream_annotate


def payload(prompt):
    return json.JSONDecoder().raw_decode(prompt[prompt.index("\nTasks:\n") + 8 :])[0]


def allowed(prompt):
    return prompt.split("\nAllowed types: ")[1].split("\n")[0].split(", ")


def test_text_annotation_with_retries(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    tasks = spark.createDataFrame([("j", i, f"t{i % 7}", f"text é number {i}") for i in range(8)], "job_id string, ord long, task_id string, text string")
    flat = workloads.annotate_texts(tasks, BUILT_IN["fine"], queries._echo_model(list(BUILT_IN["fine"].types)), include_scores=True, max_tasks=3)
    rows = sorted(flat.collect(), key=lambda x: x["ord"])
    assert [x["ord"] for x in rows] == list(range(8)) and all(x["text"] == "text" for x in rows)
    assert all(abs(sum(x["distribution"].values()) - 1) < 1e-9 and x["confidence"] == max(x["distribution"].values()) for x in rows)
    assert all(x["coarse_type_id"] == BUILT_IN["fine"].coarse[x["type_id"]] for x in rows)


def test_a_job_whose_model_never_answers_well_has_no_results(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    tasks = spark.createDataFrame([("bad", 0, "a", "no"), ("good", 0, "a", "yes it is")], "job_id string, ord long, task_id string, text string")

    def make():
        def one(p):
            return "[]" if payload(p)[0]["text"] == "no" else json.dumps([{"task_id": "a", "entities": [{"start": 0, "end": 3, "text": "yes", "scores": {t: 1 for t in allowed(p)}}]}])

        return lambda prompts: [one(p) for p in prompts]

    assert {x["job_id"] for x in workloads.annotate_texts(tasks, BUILT_IN["coarse"], make).collect()} == {"good"}


def test_a_call_that_raises_fails_its_job_only(spark, tmp_path):
    from semtag.operators import jobs, model

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    tasks = spark.createDataFrame([("bad", 0, "a", "no"), ("good", 0, "a", "yes it is"), ("late", 0, "a", "yes")], "job_id string, ord long, task_id string, text string").coalesce(1)

    def make():
        def one(p):
            if payload(p)[0]["text"] == "no":
                raise TimeoutError("too slow")
            assert "not valid" not in p or "Your last answer was not valid: bad_shape: " in p
            if payload(p)[0]["text"] == "yes" and "not valid" not in p:
                return "{}"
            return json.dumps([{"task_id": "a", "entities": [{"start": 0, "end": 3, "text": "yes", "scores": {t: 1 for t in allowed(p)}}]}])

        return lambda prompts: [one(p) for p in prompts]

    v = BUILT_IN["coarse"]
    assert {x["job_id"] for x in workloads.annotate_texts(tasks, v, make).collect()} == {"good", "late"}
    batches = workloads.text_batches(tasks).withColumn("prompt", workloads.text_prompt(v, workloads.strings(v.types), F.transform("tasks", lambda t: F.struct(t["task_id"].alias("task_id"), t["text"].alias("text")))))
    attempts = model.run_attempts(batches, make, lambda df: workloads.validate_text(df, v))
    bad = attempts.where("job_id = 'bad'").collect()
    assert [(x["attempt"], x["error_code"], x["error_detail"]) for x in bad] == [(0, "call_failed", "TimeoutError: too slow")]
    got = jobs.job_outcomes(tasks.select("job_id").union(spark.createDataFrame([("none",)], "job_id string")), model.settle_attempts(attempts))
    assert {tuple(x) for x in got.collect()} == {("bad", "failed", "call_failed"), ("good", "completed", None), ("late", "completed", None), ("none", "completed", None)}


def test_two_steps_with_a_large_vocabulary(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    types = tuple(f"dpv:T{i}" for i in range(3000))
    v = Vocabulary("dpv", types, dense=False, prefixes=(("dpv-pd:", "dpv:"),), prefilter=True)
    tasks = spark.createDataFrame([("j", 0, "a", "hello"), ("k", 0, "a", "other")], "job_id string, ord long, task_id string, text string")

    def make():
        def one(p):
            assert len(p) <= 12_000 or "entities" in p
            if "could occur" in p:
                return json.dumps([t.replace("dpv:", "dpv-pd:") for t in allowed(p) if t.endswith("777")]) if payload(p)[0]["text"] == "hello" else "[]"
            task = payload(p)[0]
            return json.dumps([{"task_id": "a", "entities": [{"start": 0, "end": 5, "text": task["text"], "scores": {t: i + 1 for i, t in enumerate(allowed(p)[:3])}}]}])

        return lambda prompts: [one(p) for p in prompts]

    got = {x["job_id"]: (x["type_id"], x["confidence"]) for x in workloads.annotate_texts(tasks, v, make).collect()}
    assert got == {"j": ("dpv:T2777", 0.5), "k": ("dpv:T2", 0.5)}


def test_table_annotation(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [("j", i, f"t{i}", f'ta"ble{i}', json.dumps([{"name": "x", "age": i}]), ["name", "age"], 50) for i in range(3)]
    tasks = spark.createDataFrame(rows, "job_id string, ord long, task_id string, table_id string, sampled_rows_json string, columns array<string>, size long")

    def make():
        def one(p):
            return json.dumps([{"task_id": t["task_id"], "table_id": t["table_id"], "columns": [{"column": c, "scores": {"XSD:integer" if c == "age" else "NE:PERSON": 1}} for c in t["sampled_rows"][0]]} for t in payload(p)])

        return lambda prompts: [one(p) for p in prompts]

    got = {(x["ord"], x["column"]): (x["type_id"], x["coarse_type_id"]) for x in workloads.annotate_tables(tasks, BUILT_IN["sti"], make).collect()}
    assert got == {(i, c): t for i in range(3) for c, t in {"age": ("xsd:integer", "LIT:NUMBER"), "name": ("NE:PERSON", "NE:PERSON")}.items()}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.sql("select cast(id % 5 as string) as job_id, concat('w', id % 5) as text, timestamp '2024-01-01' as created_at from range(20)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream_annotate(dedupe_stream(stream), lambda b: b.select("job_id", F.upper("text").alias("text")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = sorted((x["job_id"], x["text"]) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(str(i), f"W{i}") for i in range(5)]


def test_every_prompt_is_sent_once(spark, tmp_path):
    """A bad, a late and a short call among a hundred prompts: each prompt goes out once, and only what has no reply fails."""
    import time as _time

    from semtag.operators.model import Calls, annotate_with

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(100)] + [(100, None)], "i int, prompt string").repartition(2)

    def make(group):
        def start():
            from pathlib import Path

            def generate(asked):
                for p in asked:
                    with Path(f"{tmp_path}/{group}-{p}").open("a") as f:
                        f.write("sent\n")
                if "p7" in asked:
                    raise RuntimeError("bad prompt")
                if "p33" in asked:
                    _time.sleep(30)
                if "p50" in asked:
                    return [f"re {p}" for p in asked[:-1]]
                if "p60" in asked:
                    return [*asked, "more"]
                return [5 if p == "p70" else f"re {p}" for p in asked]

            return generate

        return start

    for group in (1, 10):
        rows = {x["i"]: x for x in annotate_with(prompts, make(group), calls=Calls(group, 4, 3.0)).collect()}
        sent = {f.name.split("-")[1]: f.read_text().count("sent") for f in tmp_path.glob(f"{group}-*")}
        assert sent == {f"p{i}": 1 for i in range(100)} and len(rows) == 101
        for i, x in rows.items():
            assert (x["raw_text"] is None) == (x["call_error"] is not None) and x["raw_text"] in (None, f"re p{i}")
        failed = {i for i, x in rows.items() if x["call_error"]}
        assert failed >= {7, 33, 60, 70, 100} and (failed == {7, 33, 50, 60, 70, 100} if group == 1 else len(failed) <= 3 * 10 + 3)
        assert "RuntimeError: bad prompt" in rows[7]["call_error"] and "TimeoutError" in rows[33]["call_error"]
