import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from semtag.llm.mixing import first_words, hypergeometric, log_ratio, mix_sources, mixing_stage


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_taken_and_reruns(docs, rows):
    got = mix_sources(docs, leaf_rows=8).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for x in got:
        assert x["size"] == size(x["text"]) and 0 <= x["taken"] <= 2 * x["size"]
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
    want = targets(sizes)
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6 * (1 + want[x["source"]])
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["taken"])
    again = mix_sources(docs.repartition(5), leaf_rows=8).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty_tables(nothing, docs):
    assert mix_sources(nothing).count() == 0
    assert {x["taken"] for x in mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_stage_makes_the_mixture(spark, docs):
    mixed, made = mix_sources(docs), mixing_stage(spark, docs, "")
    assert made.columns == docs.columns
    count = lambda df, c: {x["source"]: x["n"] for x in df.groupBy("source").agg(F.sum(c).alias("n")).collect() if x["n"]}
    assert count(mixed, "taken") == count(made.withColumn("n", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), "n")
    originals = defaultdict(list)
    for x in docs.collect():
        originals[x["doc_id"]].append(x["text"])
    for x in made.collect():
        assert any((t or "").startswith(x["text"]) for t in originals[x["doc_id"]])


def test_cut_keeps_white_space(spark):
    row = spark.createDataFrame([(" a\n b\tc ", 2)], "t string, n int").select(first_words(F.col("t"), F.col("n")).alias("x")).first()
    assert row["x"] == " a\n b"


def test_draws_follow_the_distribution(spark):
    facts = spark.sql(f"select {log_ratio('double(id)', '0D')} as f, id from range(200)").collect()
    assert all(abs(x["f"] - math.lgamma(x["id"] + 1)) < 1e-8 for x in facts)
    n, k, m = 12, 20, 50
    df = spark.range(4000).selectExpr("id", f"{n}L as n", f"{k}L as k", f"{m}L as m")
    got = Counter(x["x"] for x in hypergeometric(df, "x", "n", "k", "m", "id, 1").collect())
    for x in range(n + 1):
        p = math.comb(k, x) * math.comb(m - k, n - x) / math.comb(m, n)
        assert abs(got[x] - 4000 * p) < 5 * math.sqrt(4000 * p) + 3
    edges = spark.sql("select * from values (0L, 5L, 9L), (9L, 5L, 9L), (4L, 0L, 9L), (4L, 9L, 9L), (0L, 0L, 0L) as t(n, k, m)")
    assert sorted(tuple(x) for x in hypergeometric(edges, "x", "n", "k", "m", "n, k").collect()) == [(0, 0, 0, 0), (0, 5, 9, 0), (4, 0, 9, 0), (4, 9, 9, 4), (9, 5, 9, 5)]


def test_a_shard_is_the_mixture_all_along(spark):
    texts = [(i, f"word{i} " * 5, "a" if i % 2 else "b") for i in range(1600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    docs = docs.unionAll(docs.where("source = 'b'").selectExpr("doc_id + 5000", "concat(text, 'more')", "'c'"))
    taken = [x for x in mix_sources(docs).orderBy("mix_shard", "mix_order").collect()]
    shards = defaultdict(list)
    for x in taken:
        shards[x["mix_shard"]].append(x)
    part = [x for s in shards.values() for x in s[len(s) // 2 :]]
    for source in "abc":
        share = lambda rows: sum(x["taken"] for x in rows if x["source"] == source) / sum(x["taken"] for x in rows)  # noqa: B023, E731
        assert abs(share(part) - share(taken)) < 0.05
    made = mixing_stage(spark, docs, "").select(F.spark_partition_id().alias("p"), "doc_id").collect()
    beside = sum(x == y for x, y in zip(made, made[1:]))
    twice = sum(n == 2 for n in Counter(x["doc_id"] for x in made).values())
    assert twice > 300 and beside < 0.1 * twice


def test_ratios_of_factorials_of_large_numbers(spark):
    for b, d in ((10**12, 1000), (10**12, -1000), (10**15, 500), (5, 900), (905, -900)):
        low, high = min(b, b + d), max(b, b + d)
        want = math.copysign(math.fsum(math.log(i) for i in range(low + 1, high + 1)), d)
        got = spark.sql(f"select {log_ratio(f'{b + d}D', f'{b}D')} as r").first()["r"]
        assert abs(got - want) < 1e-9 * max(1, abs(want) / 1000)


def test_a_deep_tree_in_steps_is_the_same_tree(docs, monkeypatch):
    take = lambda: sorted(((x["doc_id"] is None, x["doc_id"] or 0), x["taken"], x["mix_shard"]) for x in mix_sources(docs, leaf_rows=2).collect())
    whole = take()
    monkeypatch.setattr("semtag.llm.mixing.MOST_BITS", 3)
    assert take() == whole
