import math

from pyspark.sql import functions as F

from semtag.functions.scores import argmax, canonical_scores, distribution, fill_dense, normalize, score_errors, select_types
from semtag.operators.scoring import argmax_long, assemble_results, normalize_long, score_items

SCORES = "i int, scores map<string,double>"


def arr(*xs):
    return F.array(*map(F.lit, xs))


def test_normalize(spark):
    rows = [(0, [1.0, 3.0]), (1, [0.0, 0.0]), (2, []), (3, [None, 2.0]), (4, [0.1] * 7)]
    df = spark.createDataFrame(rows, "i int, v array<double>").select("i", normalize(F.col("v")).alias("p"))
    got = {x["i"]: x["p"] for x in df.collect()}
    assert got[0] == [0.25, 0.75] and got[1] == [0.5, 0.5] and got[2] == [] and got[3] == [0.0, 1.0]
    assert math.isclose(sum(got[4]), 1, rel_tol=1e-9)


def test_argmax_ties_go_to_the_earlier_type(spark):
    rows = [(0, {"A": 1.0, "B": 2.0}), (1, {"B": 1.0, "A": 1.0}), (2, {})]
    df = spark.createDataFrame(rows, SCORES).withColumn("p", normalize(fill_dense(F.col("scores"), arr("A", "B"))))
    got = df.select("i", argmax(arr("A", "B"), F.col("p")).alias("b"), distribution(arr("A", "B"), F.col("p")).alias("d")).collect()
    assert [tuple(x["b"]) for x in sorted(got)] == [("B", 2 / 3), ("A", 0.5), ("A", 0.5)]
    assert got[0]["d"] == {"A": 1 / 3, "B": 2 / 3}
    assert df.select(argmax(F.array().cast("array<string>"), F.array().cast("array<double>")).alias("b")).first()["b"] is None


def test_array_and_long_form_agree(spark):
    rows = [(i, {t: float((i * 7 + j * 3) % 5) for j, t in enumerate("ABCD")}) for i in range(50)]
    df = spark.createDataFrame(rows, SCORES)
    short = {x["i"]: (x["type_id"], round(x["confidence"], 9)) for x in score_items(df, arr(*"ABCD")).collect()}
    long = df.select(F.col("i").alias("item_id"), F.posexplode(fill_dense(F.col("scores"), arr(*"ABCD"))).alias("ord", "score")).withColumn("type_id", F.element_at(arr(*"ABCD"), F.col("ord") + 1))
    assert short == {x["item_id"]: (x["type_id"], round(x["confidence"], 9)) for x in argmax_long(normalize_long(long)).collect()}


def test_plans_of_the_array_form_have_no_exchange(spark):
    df = spark.createDataFrame([(0, {"A": 1.0})], SCORES)
    assert "Exchange" not in score_items(df, arr("A", "B"), coarse={"A": "X"}, include_scores=True)._jdf.queryExecution().executedPlan().toString()


def test_canonical_scores(spark):
    rows = [(0, {"per": 0.5, "N:P": 0.2}), (1, {"n:P": 0.1, "n:Q": 0.3, "N:P": 0.4}), (2, {"n:Z": 1.0}), (3, {})]
    df = spark.createDataFrame(rows, SCORES).select("i", canonical_scores(F.col("scores"), arr("N:P", "N:Q"), [("per", "N:P")], [("n:", "N:")]).alias("s"))
    assert {x["i"]: x["s"] for x in df.collect()} == {0: {"N:P": 0.5}, 1: {"N:P": 0.4, "N:Q": 0.3}, 2: {"n:Z": 1.0}, 3: {}}


def test_an_alias_applies_even_if_it_is_allowed(spark):
    df = spark.createDataFrame([(0, {"A": 0.5, "B": 0.2})], SCORES)
    assert df.select(canonical_scores(F.col("scores"), arr("A", "B"), [("A", "B")], []).alias("s")).first()["s"] == {"B": 0.5}
    picked = spark.createDataFrame([(["A", " B ", "A", "x"],)], "s array<string>").select(select_types(F.col("s"), arr("A", "B"), [("A", "B")], []).alias("s"))
    assert picked.first()["s"] == ["A", "B"]


def test_score_errors(spark):
    rows = [(0, {"A": 1.0, "B": 0.0}), (1, {"A": 1.0}), (2, {"A": 1.0, "B": 0.0, "C": 1.0}), (3, {"A": 2.0, "B": -1.0}), (4, {"A": 0.0, "B": 0.0}), (5, {}), (6, {"A": float("nan"), "B": 1.0}), (7, {"A": float("inf"), "B": 1.0})]
    df = spark.createDataFrame(rows, SCORES)
    got = {x["i"]: (x["d"], x["s"]) for x in df.select("i", score_errors(F.col("scores"), arr("A", "B"), True).alias("d"), score_errors(F.col("scores"), arr("A", "B"), False).alias("s")).collect()}
    assert got == {
        0: ([], []), 1: (["missing_score_key"], []), 2: (["unknown_score_key"],) * 2, 3: (["negative_score"],) * 2, 4: (["no_positive_score"],) * 2,
        5: (["missing_score_key", "no_positive_score"], ["no_positive_score"]), 6: (["non_finite_score"],) * 2, 7: (["non_finite_score"],) * 2,
    }


def test_results_in_input_order(spark):
    tasks = spark.createDataFrame([("j", 0, "a"), ("j", 1, "b"), ("j", 2, "a")], "job_id string, ord long, task_id string")
    items = spark.createDataFrame([("j", "a", 1, "second"), ("j", "a", 0, "first")], "job_id string, task_id string, idx int, text string")
    got = sorted((x["ord"], [e["text"] for e in x["entities"]]) for x in assemble_results(tasks, items, ["text"]).collect())
    assert got == [(0, ["first", "second"]), (1, []), (2, ["first", "second"])]


def test_a_thousand_types_cost_ten_times_a_hundred(spark):
    import time

    took = {}
    for n in (100, 1000):
        types = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("T"), i))
        df = spark.range(400).withColumn("types", types).withColumn("scores", F.map_from_arrays("types", F.transform("types", lambda t, i: (i * 7 % 11).cast("double")))).repartition(4).cache()
        df.count()
        score_items(df, F.col("types")).select("type_id", "confidence").write.format("noop").mode("overwrite").save()
        began = time.time()
        got = score_items(df, F.col("types")).select("type_id", "confidence").distinct().collect()
        took[n] = time.time() - began
        assert len(got) == 1 and got[0]["type_id"] == "T3"
    assert took[1000] < 60 * max(took[100], 0.05)


def test_missing_scores_and_null_maps(spark):
    rows = [(0, {"B": 2.0}), (1, {"Z": 1.0}), (2, {}), (3, None), (4, {"A": None, "B": 3.0})]
    df = spark.createDataFrame(rows, SCORES).select("i", fill_dense(F.col("scores"), arr("C", "A", "B")).alias("v"))
    assert {x["i"]: x["v"] for x in df.collect()} == {0: [0.0, 0.0, 2.0], 1: [0.0] * 3, 2: [0.0] * 3, 3: None, 4: [0.0, 0.0, 3.0]}
