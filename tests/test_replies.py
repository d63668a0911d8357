import pytest
from pyspark.sql import functions as F

from semtag.functions.replies import Invalid, first_json, parse_selection_replies, parse_table_replies, parse_tasks, parse_text_replies, proven_selection, proven_tasks
from semtag.operators.validation import column_errors, span_errors, table_reply_errors, task_set_errors, text_reply_errors

GOOD = '[{"task_id": "t1", "entities": [{"start": 0, "end": 7, "text": "Roberto", "scores": {"P": 1.0, "O": 0.1}}], "more": 1}]'


@pytest.mark.parametrize(("text", "code"), [(None, "empty_response"), (" \n", "empty_response"), ("none", "no_json"), ("[1, ", "bad_json"), ("{", "bad_json")])
def test_no_json(text, code):
    with pytest.raises(Invalid) as e:
        first_json(text)
    assert e.value.code == code


def test_json_after_prose_and_before_it():
    assert first_json('Sure: [{"task_id": "t1", "entities": []}] done [') == [{"task_id": "t1", "entities": []}]
    assert first_json("see [1]: [2]") == [1]
    assert first_json('{"a": 1, "a": 2}') == {"a": 2}


def text_reply(entity, task="t1"):
    import json

    return json.dumps([{"task_id": task, "entities": [entity]}])


@pytest.mark.parametrize(
    ("change", "code"),
    [({}, None), ({"start": "0"}, None), ({"start": True}, None), ({"end": 7.0}, None), ({"end": 7.5}, "bad_shape"), ({"end": "x"}, "bad_shape"), ({"text": 5}, "bad_shape"), ({"scores": []}, "bad_shape"), ({"scores": {"P": "0.5"}}, None), ({"scores": {"P": None}}, "bad_shape"), ({"scores": {"P": float("nan")}}, "non_finite_score"), ({"start": None}, "bad_shape")],
)
def test_shapes(change, code):
    entity = {"start": 0, "end": 7, "text": "Roberto", "scores": {"P": 1.0}} | change
    if code is None:
        assert parse_tasks(text_reply(entity), False)
    else:
        with pytest.raises(Invalid) as e:
            parse_tasks(text_reply(entity), False)
        assert e.value.code == code


@pytest.mark.parametrize("text", ['{"task_id": "t1"}', '[{"task_id": 1, "entities": []}]', '[{"entities": []}]', "[3]", '[{"task_id": "t"}]'])
def test_bad_shapes(text):
    with pytest.raises(Invalid) as e:
        parse_tasks(text, False)
    assert e.value.code == "bad_shape"


def test_frames(spark):
    df = spark.createDataFrame([(0, GOOD), (1, "x"), (2, None)], "i int, raw_text string")
    got = {x["i"]: x["reply"] for x in parse_text_replies(df).collect()}
    assert got[0]["tasks"][0]["items"][0]["scores"] == {"P": 1.0, "O": 0.1} and got[1]["error_code"] == "no_json" and got[2]["error_code"] == "empty_response"
    table = spark.createDataFrame([('[{"task_id": "t", "table_id": "b", "columns": [{"column": "c", "scores": {"x": 1}}]}]',)], "raw_text string")
    assert parse_table_replies(table).first()["reply"]["tasks"][0]["items"][0]["column"] == "c"
    chosen = spark.createDataFrame([('["a", "b"]',), ('["a", 1]',), ("{}",)], "raw_text string")
    assert [(x["reply"]["items"], x["reply"]["error_code"]) for x in parse_selection_replies(chosen).collect()] == [(["a", "b"], None), (None, "bad_shape"), (None, "bad_shape")]


def test_task_sets_and_spans(spark):
    one = spark.range(1)
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    for want, got, codes in [("ab", "ab", []), ("ab", "abb", []), ("ab", "a", ["missing_task"]), ("a", "abc", ["unknown_task"]), ("ab", "c", ["missing_task", "unknown_task"])]:
        assert one.select(task_set_errors(lit(list(want)), lit(list(got))).alias("e")).first()["e"] == codes
    spans = [("a😀b", 1, 2, "😀", []), ("abc", -1, 2, "ab", ["bad_offsets"]), ("abc", 1, 1, "", ["bad_offsets"]), ("abc", 2, 4, "c", ["bad_offsets"]), ("abc", 0, 2, "bc", ["text_mismatch"])]
    df = spark.createDataFrame(spans, "t string, s int, e int, said string, codes array<string>")
    assert all(x["got"] == x["codes"] for x in df.withColumn("got", span_errors(F.col("t"), F.col("s"), F.col("e"), F.col("said"))).collect())


def test_columns(spark):
    rows = [(["a", "b"], ["b", "a"], []), (["a"], ["a", "a"], ["duplicate_column"]), (["a"], ["b"], ["column_mismatch"]), ([], [], [])]
    df = spark.createDataFrame(rows, "want array<string>, got array<string>, codes array<string>")
    assert all(x["e"] == x["codes"] for x in df.withColumn("e", column_errors(F.col("want"), F.col("got"))).collect())


def test_whole_replies(spark):
    raw = [(0, GOOD, []), (1, GOOD.replace("t1", "t2"), ["missing_task", "unknown_task"]), (2, GOOD.replace("Roberto", "Robert"), ["text_mismatch"]), (3, GOOD.replace('"P": 1.0', '"P": -1'), ["negative_score"])]
    df = spark.createDataFrame(raw, "i int, raw_text string, codes array<string>")
    df = parse_text_replies(df).withColumn("tasks", F.expr("array(struct('t1' as task_id, 'Roberto Avogadro' as text))"))
    errors = text_reply_errors(F.col("tasks"), F.col("reply.tasks"), F.array(F.lit("P"), F.lit("O")), True)
    assert all(x["e"] == x["codes"] for x in df.withColumn("e", errors).collect())
    table = '[{"task_id": "t", "table_id": "%s", "columns": [{"column": "c", "scores": {"x": 1}}]}]'
    df = spark.createDataFrame([(table % "b", []), (table % "z", ["table_mismatch"])], "raw_text string, codes array<string>")
    df = parse_table_replies(df).withColumn("tasks", F.expr("array(struct('t' as task_id, 'b' as table_id, array('c') as columns))"))
    assert all(x["e"] == x["codes"] for x in df.withColumn("e", table_reply_errors(F.col("tasks"), F.col("reply.tasks"), F.array(F.lit("x")), False)).collect())


def strict(text, tables):
    try:
        return parse_tasks(text, tables)
    except Invalid:
        return None


def test_what_is_proven_equals_the_strict_parser(spark, capsys):
    """Every proven row has the strict parser's value; faulty and lax ones aren't proven, and fare as before."""
    import json

    entity = {"start": 0, "end": 7, "text": "Roberto", "scores": {"P": 1.0, "O": 1, "Q": 0.1, "R": 1e3, "S": -2}}
    changes = [{}, {"start": "0"}, {"start": True}, {"end": 7.0}, {"end": 7.5}, {"text": 5}, {"scores": []}, {"scores": {"P": "1"}}, {"scores": {"P": None}}, {"scores": {"P": float("nan")}}, {"start": None}, {"end": 2**31}, {"end": -(2**31)}, {"scores": {}}, {"text": "a\u00e9\U0001f600\n\"b"}, {"more": [1]}]
    texts = [text_reply(entity | c) for c in changes] + [f"Sure [: {GOOD}", f"Sure: {GOOD} and [more", GOOD[:-1], GOOD.replace('"P": 1.0', '"P": 1.0, "P": 2.0'), GOOD.replace("1.0", "1e400"), GOOD.replace("1.0", "01"), GOOD.replace("Roberto", r"\ud83d\ude00"), GOOD.replace("Roberto", r"\ud83d"), "[]", "[null]", '[{"task_id": "t", "entities": null}]', '[{"task_id": "t", "entities": [null]}]', '{"a": 1}', None, "", "no"]
    texts += [json.dumps([{"task_id": "t", "table_id": "b", "columns": [{"column": c, "scores": {"x": 1}}]}]) for c in ("c", 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw_text string")
    for tables, parse in ((False, parse_text_replies), (True, parse_table_replies)):
        rows = parse(df.withColumn("proven", proven_tasks(F.col("raw_text"), tables))).collect()
        proven = [x for x in rows if x["proven"] is not None]
        for x in rows:
            want = strict(x["raw_text"], tables)
            got = None if x["reply"]["tasks"] is None else [t.asDict(recursive=True) | {"items": [i.asDict(recursive=True) | {"scores": sorted(i["scores"].items())} for i in t["items"]]} for t in x["reply"]["tasks"]]
            assert got == (want and [t | {"items": [i | {"scores": sorted(i["scores"])} for i in t["items"]]} for t in want]), x["raw_text"]
            assert (x["reply"]["error_code"] is None) == (want is not None) and (x["proven"] is None or want is not None)
        with capsys.disabled():
            print(f"\n{len(rows) - len(proven)} of {len(rows)} made-up replies (tables: {tables}) went to Python")
        assert len(proven) >= (2 if tables else 7)
    chosen = spark.createDataFrame([('["a", "b"]',), ('["a", 1]',), ("{}",), ("[]",)], "raw_text string").select(proven_selection(F.col("raw_text")).alias("p"))
    assert [x["p"] for x in chosen.collect()] == [["a", "b"], None, None, []]


def test_share_of_collected_replies_that_leave_the_jvm(spark, capsys):
    import os

    from semtag import fixtures

    tables = os.environ.get("SEMTAG_TEST_TABLES", "/root/testdata/sf0.001")
    if not os.path.isdir(tables):
        pytest.skip("no tables")
    replies = fixtures.replies(spark, tables)
    n, proven = replies.agg(F.count("*"), F.count(proven_tasks(F.col("raw_text"), False))).first()
    with capsys.disabled():
        print(f"\n{n - proven} of {n} collected replies went to Python")
    unparsed = replies.where("raw_text like 'Sorry%'").count()
    assert n - proven == unparsed  # only those without JSON
