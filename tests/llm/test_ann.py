import numpy as np

from semtag.llm.ann import fit_quantiser, search

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, queries, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float32).astype(float)
    out = {}
    for q, v in queries.items():
        s = (x * np.array(v, np.float32).astype(float)).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_scores_and_ties(spark):
    r = np.random.default_rng(0)
    centre = r.standard_normal(24)
    vectors = {i: (r.standard_normal(24) + (centre * 3 if i % 3 == 0 else 0)).tolist() for i in range(900)}
    vectors |= {900 + i: vectors[3] for i in range(40)}
    df = spark.createDataFrame(list(vectors.items()), SCHEMA)
    queries = {i: v for i, v in vectors.items() if i % 20 == 0}
    got = search(df, df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k=20, row_block=256, query_block=16, rerank=240).collect()  # of all four blocks together
    want = brute(vectors, queries, 20)
    hits = 0
    for q in queries:
        mine = sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == list(range(1, 21))
        assert [(-x["score"], x["vec_id"]) for x in mine] == sorted((-x["score"], x["vec_id"]) for x in mine)
        hits += len({x["vec_id"] for x in mine} & {i for i, _ in want[q]})
        for x in mine:
            assert abs(x["score"] - float((np.array(vectors[x["vec_id"]], np.float32).astype(float) * np.array(queries[q], np.float32).astype(float)).sum())) < 1e-12
    assert hits >= 0.95 * 20 * len(queries)


def test_unusable_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (8, [3.0]), (7, []), (20, [1.0, 1.0]), (None, [9.0, 9.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = search(df, df.withColumnRenamed("vec_id", "query_id"), k=5).collect()
    found = lambda q: sorted((x["rank"], x["vec_id"], x["score"]) for x in got if x["query_id"] == q)
    assert found(0) == [(1, 20, 1.0), (2, 1, 0.5), (3, 1, 0.5)]  # a repeated row counts as often as it occurs
    assert found(6) == [(1, 8, 3.0)] and {x["query_id"] for x in got} == {0, 1, 6, 8, 20}
    assert search(df.where("false"), df.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_parallel_error_counts_more():
    x = np.random.default_rng(2).standard_normal((2000, 16)).astype(np.float32)
    book, ratio = fit_quantiser(x, rounds=6)

    def parallel(weight):
        codes = book.encode(x, ratio=weight)
        back = np.stack([book.books[i, codes[:, i]] for i in range(8)], axis=1).reshape(len(x), -1)
        return (((x - back) * x).sum(axis=1) ** 2 / (x**2).sum(axis=1)).mean()

    assert ratio > 1 and parallel(ratio) < parallel(1.0)


def test_an_id_with_several_vectors_and_a_very_common_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(7, [3.0, 3.0, 3.0]), (20, [9.0, 0.0, 0.0]), (500, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA + ", score string")
    got = search(df, df.where("vec_id in (0, 20)").withColumnRenamed("vec_id", "query_id"), k=20, rerank=3).collect()
    first = sorted((x["rank"], x["vec_id"], x["score"]) for x in got if x["query_id"] == 0)
    assert first == [(1, 7, 18.0)] + [(r, i, 14.0) for r, i in enumerate(range(1, 20), 2)]
    both = sorted((x["score"], x["rank"], x["vec_id"]) for x in got if x["query_id"] == 20)
    assert len(both) == 40 and both[-1] == (27.0, 1, 7) and both[-2] == (18.0, 1, 7)  # two queries of one id


def test_recall_where_few_of_many_are_reranked(spark):
    r = np.random.default_rng(7)
    centres = r.standard_normal((200, 64))
    x = (centres[r.integers(0, 200, 50_000)] + 0.6 * r.standard_normal((50_000, 64))).astype(np.float32)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), SCHEMA)
    got = search(df, df.where("vec_id % 500 = 0").withColumnRenamed("vec_id", "query_id")).collect()
    mine = {}
    for row in got:
        mine.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = 0
    for q, found in mine.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(mine) == 100 and hits >= 0.9 * 20 * 100


def test_recall_on_rows_of_other_kinds(spark):
    """Tight clusters, very unlike lengths, few dimensions that matter, a common offset: every neighbour is found."""
    r = np.random.default_rng(3)
    n, dims = 6000, 24
    clusters = r.standard_normal((4, dims))[r.integers(0, 4, n)] + 0.002 * r.standard_normal((n, dims))
    lengths = r.standard_normal((n, dims)) * np.exp(2 * r.standard_normal((n, 1)))
    few = r.standard_normal((n, dims)) * np.r_[np.ones(3), np.full(dims - 3, 0.01)]
    offset = r.standard_normal((n, dims)) + 50
    for x in (clusters, lengths, few, offset):
        x = x.astype(np.float32)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SCHEMA)
        got = search(df, df.where("vec_id % 200 = 0").withColumnRenamed("vec_id", "query_id"), row_block=1500).collect()
        mine = {}
        for row in got:
            mine.setdefault(row["query_id"], set()).add(row["vec_id"])
        hits = 0
        for q, found in mine.items():
            s = x.astype(float) @ x[q].astype(float)
            s[q] = -np.inf
            hits += len(found & set(np.argsort(-s, kind="stable")[:20].tolist()))
        assert len(mine) == 30 and hits >= 0.999 * 20 * 30


def test_an_id_with_more_vectors_than_are_asked_for(spark):
    rows = [(20, [5.0 + i, 1.0]) for i in range(450)] + [(i, [1.0, float(i)]) for i in range(1, 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = search(df, df.where("vec_id = 20").limit(1).withColumnRenamed("vec_id", "query_id"), k=3).collect()
    assert [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"])] == [7, 6, 5]
