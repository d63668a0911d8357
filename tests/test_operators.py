import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semtag.functions.text import ascii_json_length, shorten_iri, strip, text_task_size
from semtag.operators import jobs, model, rules, tasks, vocab
from semtag.operators.batching import greedy_batches, greedy_shards, pack_batches, shard_types, table_task_sizes
from semtag.sources import io


def test_lines(spark):
    text = " first \r\n\n second third\x85\x1c fourth \n  "
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = [(x["job_id"], x["ord"], x["task_id"], x["text"]) for x in tasks.lines_to_tasks(df).collect()]
    want = [s.strip() for s in text.splitlines() if s.strip()]
    assert got == [("1", i + 1, f"t{i + 1}", s) for i, s in enumerate(want)]


def test_json_sizes(spark):
    odd = ["", "plain", 'q"\\\n\r\t\b\f', "é😀 \x00\x1f\x7f~", "ẞ" * 10]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string")
    got = {x["i"]: (x["n"], x["t"]) for x in df.select("i", ascii_json_length(F.col("s")).alias("n"), text_task_size(F.lit("id"), F.col("s")).alias("t")).collect()}
    assert got == {i: (len(json.dumps(s)) - 2, len(json.dumps({"task_id": "id", "text": s}))) for i, s in enumerate(odd)}
    assert df.select(strip(F.lit("\x1f  a b ")).alias("s")).first()["s"] == "a b"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(1, 6), st.integers(1, 80))
def test_batches_are_those_of_a_plain_loop(sizes, most, chars):
    want, batch, n, total = [], 0, 0, 0
    for s in sizes:
        if n and (n + 1 > most or total + s > chars):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + s
        want.append(batch)
    assert greedy_batches(np.array(sizes, int), most, chars).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=9), min_size=1, max_size=30), st.integers(0, 60), st.integers(5, 70))
def test_shards_keep_prompts_in_bounds(types, overhead, most):
    want, current = [], []
    for t in types:
        if current and overhead + len(", ".join([*current, t])) > most:
            want.append(current)
            current = []
        current.append(t)
    want.append(current)
    shards = greedy_shards(np.array([len(t) for t in types]), overhead, most)
    assert [[types[i] for i in np.flatnonzero(shards == s)] for s in range(shards[-1] + 1)] == want


def test_packing_jobs(spark):
    rows = [("a", i, s) for i, s in enumerate([5000, 5000, 3000, 13000, 10])] + [("b", i, 1) for i in range(25)]
    df = spark.createDataFrame(rows, "job_id string, ord long, size long")
    got = {(x["job_id"], x["ord"]): x["batch"] for x in pack_batches(df).collect()}
    assert [got["a", i] for i in range(5)] == [0, 0, 1, 2, 3] and [got["b", i] for i in range(25)] == [i // 10 for i in range(25)]
    sharded = pack_batches(df, shard_tasks=12).where("job_id = 'b'").collect()
    assert {(x["shard"], x["batch"]) for x in sharded} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)}
    assert shard_types(spark.sql("select 99999 as overhead"), ["x", "y"]).where("too_long").count() == 2


def test_validation_and_gates(spark):
    made = spark.createDataFrame([("a", "b", [{"k": "v"}]), (None, "b", [{}]), ("a", None, [{}]), ("a", "b", []), ("a", "b", None)], "task_id string, table_id string, sampled_rows array<map<string,string>>")
    assert [x["reason"] for x in tasks.validate_table_tasks(made).collect()] == [None, "missing task_id", "missing table_id", "no sampled rows", "no sampled rows"]
    config = vocab.vocabulary_tables(spark).config
    asked = spark.createDataFrame([(1, "sti", "ner"), (2, "sti", "tabular"), (3, "zzz", "ner"), (4, "fine", None)], "job_id int, schema string, endpoint_type string")
    assert {x["job_id"]: x["supported"] for x in tasks.gate_capability(asked, config).collect()} == {1: False, 2: True, 4: False}
    assert tasks.require_schema(asked, config).first()["error"] == "unknown schema zzz; known: coarse, dpv, fine, sti"


def test_table_tasks(spark):
    rows = spark.createDataFrame([("t", i, {"a": str(i)} if i % 2 else {"b": None}) for i in range(9)] + [("u", 1, {})], "table_id string, row_id int, row map<string,string>")
    sampled = tasks.column_union(tasks.sample_table_rows(rows, 3, order="row_id"))
    got = {x["table_id"]: x for x in sampled.collect()}
    assert sorted(got["t"]["columns"]) == ["a", "b"] and got["u"]["columns"] == [] and len(got["t"]["sampled_rows"]) == 3
    assert {x["table_id"]: len(x["sampled_rows"]) for x in tasks.sample_table_rows(rows, 3).collect()} == {"t": 3, "u": 1}
    task = {"task_id": "x", "table_id": "y", "sampled_rows": [{"é": 1.5, "b": None}]}
    df = spark.createDataFrame([("x", "y", json.dumps(task["sampled_rows"]))], "task_id string, table_id string, sampled_rows_json string")
    assert table_task_sizes(df).first()["size"] == len(json.dumps(task))


def test_iris(spark):
    cases = {
        "https://w3id.org/dpv#A": "dpv:A", "http://w3id.org/dpv/#A": "dpv:A", "https://w3id.org/dpv/pd#A": "dpv-pd:A", "https://w3id.org/dpv/legal/eu#A#b": "dpv-legal/eu:A#b",
        "https://w3id.org/dpv/x": "dpv:x", "https://example.org/#A": "https://example.org/#A", "https://w3id.org/dpvx#A": "https://w3id.org/dpvx#A",
    }
    df = spark.createDataFrame(list(cases.items()), "iri string, want string")
    assert all(x["got"] == x["want"] for x in df.withColumn("got", shorten_iri(F.col("iri"))).collect())


def test_vocabulary_from_jsonld(spark, tmp_path):
    pref, label = "http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2000/01/rdf-schema#label"
    base = "https://w3id.org/dpv#"
    a = [{"@id": base + "A", pref: [{"@value": "x"}, {"@language": "en", "@value": "A en"}]}, {"@id": base + "B", pref: [], label: {"@value": "B"}}, {"@id": base + "C"}, {"@id": "_:b", label: [{"@value": "n"}]}, 7, {"@id": 5, label: [{"@value": "n"}]}]
    b = {"@graph": [{"@id": base + "A", label: [{"@value": "later"}]}, {"@id": base + "D", label: [{"@language": "fr", "@value": "D fr"}]}, {"@id": base + "E", label: [{"@value": ""}]}]}
    for name, doc in {"2.2/a/a.jsonld": a, "2.2/b.jsonld": b, "2.2/c-owl.jsonld": a, "2.1/d.jsonld": a}.items():
        (tmp_path / "dpv" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "dpv" / name).write_text(json.dumps(doc, indent=1))
    files = io.read_jsonld(spark, str(tmp_path / "dpv"))
    got = {x["id"]: x["label"] for x in vocab.build_vocabulary(files).collect()}
    assert got == {"dpv:A": "A en", "dpv:B": "B", "dpv:D": "D fr"}
    io.write_vocabulary(vocab.build_vocabulary(files), str(tmp_path / "v"))
    assert [x["id"] for x in spark.read.json(str(tmp_path / "v")).orderBy("id").collect()] == sorted(got)


def test_read_vocabulary_and_registry(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"items": ["b", {"id": "a"}, {"id": 3}, 4, "b"]}))
    assert [(x["ord"], x["type_id"]) for x in io.read_vocabulary(spark, str(tmp_path / "v.json")).orderBy("ord").collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "two.json").write_text(json.dumps({"data": ["z"], "type_ids": ["y"]}))
    assert [x["type_id"] for x in io.read_vocabulary(spark, str(tmp_path / "two.json")).collect()] == ["y"]
    for bad in ([], {"types": "a", "items": ["b"]}):
        (tmp_path / "empty.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            io.read_vocabulary(spark, str(tmp_path / "empty.json"))
    (tmp_path / "r.json").write_text(json.dumps([{"name": " mine ", "path": "v.json", "score_mode": "sparse", "type_alias_prefixes": {"x:": "y:"}}]))
    mine = vocab.read_registry(str(tmp_path / "r.json"))["mine"]
    assert mine.types == ("b", "a") and not mine.dense and mine.prefixes == (("x:", "y:"),) and mine.supports_text
    for bad in ({"name": "coarse"}, {"name": ""}, {"name": "x", "score_mode": "odd"}, {"name": "x", "prefilter_types": 1}, {"name": "x", "type_aliases": {"": "a"}}):
        (tmp_path / "r.json").write_text(json.dumps([bad]))
        with pytest.raises(ValueError):
            vocab.read_registry(str(tmp_path / "r.json"))


def test_requests(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"job_id": "j", "schema": "coarse", "tasks": [{"task_id": "b", "text": "x"}, {"task_id": "a", "text": "y"}]}))
    assert [(x["ord"], x["task_id"]) for x in io.read_text_tasks(spark, str(tmp_path / "t.json")).collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "u.json").write_text(json.dumps({"job_id": "j", "schema": "sti", "tasks": [{"task_id": "b", "table_id": "t", "sampled_rows": [{"n": 1.50, "t": True, "z": None}]}]}))
    row = io.read_table_tasks(spark, str(tmp_path / "u.json")).first()
    assert json.loads(row["sampled_rows_json"]) == [{"n": 1.5, "t": True, "z": None}] and row["sampled_rows"][0]["t"] == "true" and row["sampled_rows"][0]["z"] is None


def test_jobs(spark):
    log = spark.sql("select * from values (1, 1, 'queued', timestamp '2024-01-01 00:00:00', null, null), (1, 3, 'completed', timestamp '2024-01-01 00:00:01', 'r', 'e'), (1, 2, 'processing', timestamp '2024-01-01 00:00:01', null, null), (2, 4, 'failed', timestamp '2024-01-01 00:00:00', 'r', 'e') as t(job_id, seq, status, updated_at, result, error)")
    state = jobs.job_state(log)
    view = {x["job_id"]: tuple(x)[1:] for x in jobs.job_view(state, spark.sql("select explode(array(1, 2, 3)) as job_id")).collect()}
    assert view == {1: (True, "completed", "r", None), 2: (True, "failed", None, "e"), 3: (False, None, None, None)}
    assert {tuple(x) for x in jobs.queue_depth(state).collect()} == {("completed", 1), ("failed", 1)}
    waiting = spark.sql("select id as job_id, timestamp '2024-01-01' + make_interval(0, 0, 0, id % 3) as created_at from range(9)")
    order = [x["job_id"] for x in jobs.fifo_order(waiting).orderBy("position").collect()]
    assert order == [0, 3, 6, 1, 4, 7, 2, 5, 8] and [x["job_id"] for x in jobs.fifo_order(waiting, k=4).orderBy("position").collect()] == order[:4]
    assert sorted(x["job_id"] for x in jobs.admit(waiting, depth=6, maxsize=10).where("admitted").collect()) == [0, 1, 3, 6]
    text, tables, failed = jobs.dispatch(spark.sql("select * from values (1, 'ner'), (2, 'tabular'), (3, 'x'), (4, null) as t(job_id, endpoint_type)"))
    assert [df.count() for df in (text, tables, failed)] == [1, 1, 2]


def test_settling(spark):
    rows = [("a", 1, 0, False, "e0"), ("a", 1, 1, True, None), ("a", 2, 0, True, None), ("b", 1, 0, False, "e0"), ("b", 1, 2, False, "e2"), ("b", 2, 0, True, None)]
    df = spark.createDataFrame(rows, "job_id string, batch_id int, attempt int, is_valid boolean, error_code string")
    got = {(x["job_id"], x["batch_id"]): tuple(x)[2:] for x in model.settle_attempts(df).collect()}
    assert got == {("a", 1): (1, None, False), ("a", 2): (0, None, False), ("b", 1): (None, "e2", True), ("b", 2): (0, None, True)}
    assert model.settle_attempts(df, keep_valid_batches=True).where("job_failed").count() == 1


CELLS = {
    "550e8400-e29b-41d4-a716-446655440000": "ext:uuid", "a.b@c.org": "ext:email", "192.168.0.255": "ext:ipv4", "300.1.1.1": "LIT:STRING", "1:2:3:4:5:6:7:8": "ext:ipv6",
    "https://x.org/y": "ext:url", "P1DT2H": "ext:duration", "2024-01-02T03:04:05Z": "xsd:dateTime", "2024-01-02": "xsd:date", "5.5%": "ext:percentage", "true": "xsd:boolean",
    "-12": "xsd:integer", "3.": "xsd:decimal", "+44 20 7946 0958": "ext:phone", "urn:x:y": "xsd:anyURI", "words": "LIT:STRING", "": "LIT:STRING",
}


def test_rules(spark):
    df = spark.createDataFrame([(v, t) for v, t in CELLS.items()], "v string, t string")
    wrong = df.where(rules.cell_type(F.lit("c"), F.col("v")) != F.col("t")).collect()
    assert not wrong
    cells = spark.createDataFrame([("t", "a", " 1 "), ("t", "a", "2"), ("t", "a", "x"), ("t", "a", None), ("t", "lat", "1.5"), ("t", "none", None)], "table_id string, column string, value string")
    got = {x["column"]: tuple(x)[2:] for x in rules.profile_columns(cells).collect()}
    assert got == {"a": ("xsd:integer", 2 / 3, "LIT:NUMBER"), "lat": ("ext:lat", 1.0, "LIT:NUMBER")}


def test_gazetteer(spark):
    docs = spark.createDataFrame([(1, "a😀 Rome  is Rome\nx"), (2, None), (3, "")], "doc_id int, text string")
    terms = spark.createDataFrame([("Rome", "CITY"), ("is", "VERB")], "term string, type_id string")
    for most in (0, 10):
        got = sorted(tuple(x) for x in rules.match_gazetteer(docs, terms, broadcast_terms=most).collect())
        assert got == [(1, 3, 7, "Rome", "CITY", 1.0), (1, 9, 11, "is", "VERB", 1.0)]


def test_a_hot_job_is_packed_in_parts(spark):
    r = random.Random(3)
    jobs = {"hot": [r.choice([0, 5, 40, 900, 4000, 13_000]) for _ in range(4000)], None: [r.randint(1, 3000) for _ in range(700)], **{f"j{i}": [10] * (i % 7 + 1) for i in range(60)}}
    rows = [(j, 3 * i, n) for j, sizes in jobs.items() for i, n in enumerate(sizes)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = pack_batches(spark.createDataFrame(rows, "job_id string, ord long, size long").repartition(5))
        parts = got.rdd.mapPartitions(lambda p: [sum(x["job_id"] == "hot" for x in p)]).collect()
        found = {}
        for x in got.collect():
            found.setdefault(x["job_id"], {})[x["ord"]] = x["batch"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for j, sizes in jobs.items():
        assert [found[j][3 * i] for i in range(len(sizes))] == greedy_batches(np.array(sizes), 10, 12_000).tolist(), j
    assert max(parts) < 1000


def test_undated_jobs_come_last_and_unnamed_schemas_are_unknown(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(3, None), (1, None), (2, "2024-01-02 00:00:00"), (5, "2024-01-01 00:00:00"), (4, "2024-01-02 00:00:00"), (None, None)]
    made = spark.createDataFrame(rows, "job_id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert {x["job_id"]: x["position"] for x in jobs.fifo_order(made).collect()} == {5: 1, 2: 2, 4: 3, 1: 4, 3: 5, None: 6}
    assert {x["job_id"]: x["position"] for x in jobs.fifo_order(made, k=2).collect()} == {5: 1, 2: 2}
    assert {x["job_id"] for x in jobs.admit(made, depth=7, maxsize=10).where("admitted").collect()} == {5, 2, 4}
    assert jobs.fifo_order(made.where("false")).count() == 0
    asked = spark.createDataFrame([(1, "a"), (2, None), (3, "x")], "job_id int, schema string")
    config = spark.createDataFrame([("b",), ("a",)], "schema string")
    assert {(x["job_id"], x["error"]) for x in tasks.require_schema(asked, config).collect()} == {(2, "unknown schema null; known: a, b"), (3, "unknown schema x; known: a, b")}


def test_ascii_json_strings(spark):
    import json

    from semtag.functions.text import ascii_json_string

    texts = ["", "plain", 'q"b\\s/', "\n\r\t\b\f\x00\x1f\x7f", "é\u2028\uffff", "a😀b𝄞", "line\n", "\n", " ~", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", ascii_json_string(F.col("t")).alias("j"))
    assert [x["j"] for x in df.orderBy("i").collect()] == [json.dumps(t) for t in texts]
