import numpy as np

from semtag.llm.darts import signatures
from semtag.llm.neardup import components, near_duplicate_stage, near_duplicates


def classes(rows):
    sets = []
    for i, (_, text, *_rest) in enumerate(rows):
        w = (text or "").encode().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else {("alone", i)}))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted((d is None, d or 0) for d in g) for g in groups.values())


def test_classes_are_those_of_brute_force(docs, rows):
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, x in enumerate(got):
        text_alone = x["class_size"] == 1
        groups.setdefault(("alone", i) if text_alone else x["class_id"], []).append((x["doc_id"] is None, x["doc_id"] or 0))
    assert sorted(sorted(g) for g in groups.values()) == classes(rows)
    assert all(x["class_id"] is None or x["class_id"] <= x["doc_id"] for x in got if x["doc_id"] is not None)


def test_chains_and_families(spark):
    r = np.random.default_rng(5)
    words = [str(i) for i in range(300)]
    family, rows = words[:], []
    for i in range(60):  # a drifting chain: neighbours alike, ends not
        family = family[:]
        family[int(r.integers(0, 300))] = f"new{i}"
        rows.append((i, " ".join(family)))
    for i in range(60):  # copies of one text, each with edits of its own
        copy = [f"w{j}" for j in range(200)]
        for j in r.choice(200, int(r.integers(0, 6)), replace=False):
            copy[j] = f"e{i}_{j}"
        rows.append((1000 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for x in near_duplicates(df).collect():
        got.setdefault(x["class_id"], []).append((False, x["doc_id"]))
    assert sorted(sorted(g) for g in got.values()) == classes(rows)


def test_stage_keeps_one_of_each(spark, docs, rows):
    made = near_duplicate_stage(spark, docs, "")
    assert made.columns == docs.columns
    distinct = {(d, t) for d, t, *_ in rows if not (t or "").split()}
    multi = [g for g in classes([x for x in rows if (x[1] or "").split()])]
    assert made.count() == len(multi) + len(distinct)


def test_wordless_rows_all_stay(spark):
    df = spark.createDataFrame([(1, ""), (1, ""), (2, None), (2, None), (None, " \n"), (3, "a b"), (3, "a b"), (4, "a  b")], "doc_id long, text string")
    got = sorted(((x["doc_id"] is None, x["doc_id"] or 0), x["text"] or "") for x in near_duplicate_stage(spark, df, "").collect())
    assert got == [((False, 1), ""), ((False, 1), ""), ((False, 2), ""), ((False, 2), ""), ((False, 3), "a b"), ((True, 0), " \n")]


def test_large_buckets_are_split_into_cells(docs, rows, monkeypatch):
    monkeypatch.setattr("semtag.llm.neardup.HELD", 3)
    monkeypatch.setattr("semtag.llm.neardup.PASSING", 5)
    r = np.random.default_rng(3)
    made = []
    for i in range(40):  # copies of one text with edits of their own: some are alike, some are not
        copy = [f"w{j}" for j in range(120)]
        for j in r.choice(120, int(r.integers(0, 8)), replace=False):
            copy[j] = f"e{i}_{j}"
        made.append((i, " ".join(copy)))
    df = docs.sparkSession.createDataFrame(made, "doc_id long, text string")
    got = {}
    for x in near_duplicates(df).collect():
        got.setdefault(x["class_id"], []).append((False, x["doc_id"]))
    assert sorted(sorted(g) for g in got.values()) == classes(made)


def test_empty_table(nothing):
    assert near_duplicates(nothing).count() == 0


def test_components(spark):
    pairs = [(bytearray([a]), bytearray([b])) for a, b in [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5)]]
    got = components(spark.createDataFrame(pairs, "a binary, b binary")).collect()
    assert {(x["node"][0], x["label"][0]) for x in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7)}


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    e = r.integers(0, 2**63, 60).astype(np.uint64)
    a, b = r.random(60) * 4, r.random(60) * 4
    s = np.concatenate([signatures([e, e], 256, [a, b], seed=i) for i in range(6)], axis=1)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    assert (signatures([e, e[::-1].copy()], 64)[0] == signatures([e[::-1].copy()], 64)[0]).all()
