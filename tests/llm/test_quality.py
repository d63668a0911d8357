import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from semtag.llm.quality import BINS, FIELDS, fit_ratio, judge_quality, quality_stage, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_statistics_and_verdict(docs, labels, rows):
    small = docs.where("length(text) < 4000 or text is null")
    got = judge_quality(docs, fit_ratio(docs, labels)).collect()
    assert len(got) == len(rows)
    for x in got:
        if x["text"] is None or len(x["text"]) < 4000:
            assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == base(x["text"])
        assert not (x["base_failed"] and x["kept"])
    clean = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 400 and not x["base_failed"]]
    junk = [x for x in got if x["doc_id"] is not None and 400 <= x["doc_id"] < 500]
    assert all(x["kept"] for x in clean) and not any(x["kept"] for x in junk)
    assert small.count() < docs.count()


def test_empty_table_and_no_labels(docs, labels, nothing):
    assert judge_quality(nothing, fit_ratio(nothing, labels)).count() == 0
    assert not fit_ratio(docs, labels.where("false")).any()


def test_repeats_of_long_vocabularies():
    words = [str(i).encode() for i in range(1 << 20)] + [b"a", b"b", b"c", b"a", b"b", b"c"]
    assert repeated_words(words) == 6


def test_the_stage_keeps_columns_named_like_a_verdict(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clashing = docs.withColumn("kept", F.lit("mine")).withColumn("N_Words", F.lit(-5)).withColumn("llr", F.array(F.lit("x")))
    got = quality_stage(spark, clashing, str(tmp_path))
    assert got.schema == clashing.schema
    rows = got.collect()
    assert rows and {(x["kept"], x["N_Words"], *x["llr"]) for x in rows} == {("mine", -5, "x")}
    judged = judge_quality(docs, fit_ratio(docs, labels)).where("kept")
    assert sorted(str(x["doc_id"]) for x in rows) == sorted(str(x["doc_id"]) for x in judged.collect()) and "kept boolean" in FIELDS


def test_ratio_and_verdict_equal_a_plain_count(docs, labels, rows):
    """Hashes, counts, ratio and verdict, 3-gram by 3-gram in plain Python."""

    def bins(text):
        data, out = (text or "").encode(), []
        for i in range(len(data) - 2):
            h = data[i]
            for c in data[i + 1 : i + 3]:
                h = h * 0x01000193 % 2**32 ^ c
            out.append(h * 0x9E3779B1 % 2**32 >> 16)
        return out

    good = {d for d, q, _ in labels.collect() if q == 1 and d is not None}
    raw, target = Counter(), Counter()
    for doc_id, text, *_ in rows:
        raw.update(bins(text))
        target.update(bins(text) if doc_id in good else ())
    every = 0.5 * BINS
    log_ratio = lambda b: np.float32(math.log((target[b] + 0.5) / (sum(target.values()) + every)) - math.log((raw[b] + 0.5) / (sum(raw.values()) + every)))
    weights = {b: float(log_ratio(b)) for b in raw}
    want = {}
    for doc_id, text, *_ in rows:
        found = bins(text)
        want[doc_id, text] = sum(weights[b] for b in found) / len(found) if found else None
    for x in judge_quality(docs, fit_ratio(docs, labels)).collect():
        llr = want[x["doc_id"], x["text"]]
        assert (x["llr"] is None) == (llr is None) and (llr is None or abs(x["llr"] - llr) < 1e-5)
        assert x["kept"] == (not x["base_failed"] and llr is not None and x["llr"] >= -0.5)
