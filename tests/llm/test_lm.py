import math
from collections import Counter

import numpy as np

from semtag.llm import lm


def tokens(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()] + [b"\n"]


def test_base_scores_and_model(docs, rows):
    train = docs.where("doc_id % 4 != 0")
    fitted = lm.fit(train)
    got = lm.score_texts(docs, fitted).collect()
    assert len(got) == len(rows)
    c = Counter()
    for d, t, *_ in rows:
        if d is not None and d % 4:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    assert (fitted.total, fitted.distinct) == (n, v)
    want = sorted(((d is None, d or 0), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t, *_ in rows)
    mine = sorted(((x["doc_id"] is None, x["doc_id"] or 0), x["n_tokens"], x["n_known"], round(x["base_score"], 6)) for x in got)
    assert [x[:3] for x in mine] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-4 for a, b in zip(mine, want, strict=True))
    held = [x for x in got if x["doc_id"] is not None and x["doc_id"] % 4 == 0 and x["doc_id"] < 200]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_classes_agree_with_sql(spark):
    words = [b"\n", b"a", b"ab", b"abc", "é".encode(), "straße".encode()]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    from pyspark.sql import functions as F

    got = df.select("word", (F.crc32(F.substring("word", -2, 2)) % lm.CLASSES).alias("e")).collect()
    assert {bytes(x["word"]): x["e"] for x in got} == {w: lm.class_of(w) for w in words}


def plain(model, before, last):
    """Probabilities of all entries after two, by the definition."""
    q = model.vectors[last, :-1] * model.near[:-1] + model.vectors[before, :-1] * model.far[:-1]
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    of_group = softmax(model.groups[:, :-1] @ q + model.groups[:, -1])
    parts = []
    for g, p in enumerate(of_group):
        own = model.vectors[g * model.size : (g + 1) * model.size]
        parts.append(p * softmax(own[:, :-1] @ q + own[:, -1]))
    return np.concatenate(parts)


def test_probabilities_are_normalised_over_all_entries():
    r = np.random.default_rng(0)
    p = r.random(1000)
    model = lm.LogBilinear.start(p / p.sum(), 1)
    for scale in (1.0, 12.0):  # the second needs guarded sums
        model.vectors[:, :-1] *= scale
        for a, b in ((0, 1), (999, 7)):
            found = model.scorer()(np.full(1000, a), np.full(1000, b), np.arange(1000))
            want = plain(model, a, b)
            assert abs(want.sum() - 1) < 1e-5 and np.abs(found - np.log(want)).max() < 1e-3


def test_scores_are_those_of_the_definition(docs, rows):
    fitted = lm.fit(docs)
    assert fitted.model.vectors.shape[0] == len(fitted.shortlist) + lm.CLASSES > 300
    entries, count = lm.Entries(fitted.shortlist), dict(zip(fitted.known, fitted.counts.tolist(), strict=True))
    got = {}
    for x in lm.score_texts(docs, fitted).collect():
        got.setdefault(x["doc_id"], x["score"])
    for d, t, *_ in rows[::9]:
        total, before, last = 0.0, 0, 0
        for w in tokens(t):
            w = w if len(w) <= lm.LONG else lm.tokens(w + b" " * lm.LONG)[0]
            e = entries[w]
            p = plain(fitted.model, before, last)[e]
            if e >= len(fitted.shortlist):
                p *= (count.get(w, 0) + 1) / fitted.class_sizes[e - len(fitted.shortlist)]
            total += math.log10(p)
            before, last = last, e
        assert abs(got[d] - total) < 1e-3 * max(1, len(tokens(t)) / 100)


def test_the_fit_does_not_depend_on_how_the_table_is_split(docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 10_000)
    a, b = lm.fit(docs).model, lm.fit(docs.repartition(7)).model
    assert np.array_equal(a.pack(), b.pack())


def test_rare_words_use_the_join(docs, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 20)
    few = lm.score_texts(docs, lm.fit(docs)).select("doc_id", "n_known", "base_score").collect()
    monkeypatch.undo()
    many = lm.score_texts(docs, lm.fit(docs)).select("doc_id", "n_known", "base_score").collect()
    key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["n_known"])
    for a, b in zip(sorted(few, key=key), sorted(many, key=key), strict=True):
        assert (a["doc_id"], a["n_known"]) == (b["doc_id"], b["n_known"]) and abs(a["base_score"] - b["base_score"]) < 1e-6


def test_nothing_to_learn_from(docs, nothing):
    got = lm.score_texts(docs, lm.fit(nothing)).collect()
    assert {(x["base_score"], x["score"]) for x in got} == {(0.0, 0.0)}
    assert lm.score_texts(nothing, lm.fit(nothing)).count() == 0
