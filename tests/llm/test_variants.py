import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from semtag.llm.variants import CHANGES, bigrams, count_words, group_variants, keys_of, near_pairs, pivots, prefix


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def brute_counts(rows, least_chars=6, least_count=5):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least_chars and n >= least_count}


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        out[w] = (n, len(near), form, counts[form] if form else None)
    root = {}
    for w in out:
        end = w
        while out[end][2]:
            end = out[end][2]
        root[w] = end
    return {(w, f, root[w], n, k, m) for w, (n, k, f, m) in out.items()}


def damaged(r, word):
    at, kind = r.randrange(len(word)), r.randrange(3)
    return word[:at] + (r.choice("aeiouéÿ") if kind else "") + word[at + (kind != 2) :]


def corpus(seed=3, words=60, docs=40):
    r = random.Random(seed)
    base = ["".join(r.choice("abeinrsté") for _ in range(r.randint(5, 12))) for _ in range(words)] + ["aaaaaa", "aaaaaaa", "ababababab", "bababababa"]
    base += [damaged(r, w) for w in base for _ in range(3)] + [damaged(r, damaged(r, w)) for w in base]
    weights = [r.choice([1, 1, 6, 30, 160]) for _ in base]
    rows = [(i, " ".join(w.capitalize() if r.random() < 0.1 else w for w in r.choices(base, weights, k=300))) for i in range(docs)]
    rows.append((50, "chained " * 160 + "chainedd " * 30 + "chaineddd " * 6))
    return [*rows, rows[0], (None, "x" * 50 + ", " + "nullid " * 7), (7, None), (8, ""), (9, "ÀÀÀbcd-àààbcd " * 6)]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n int").repartition(5)
    got = group_variants(count_words(df)).collect()
    want = brute(brute_counts(rows))
    assert {(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in got} == want and len(got) == len(want)
    assert sum(f is not None for _, f, *_ in want) > 20 and any(f and f != root for _, f, root, *_ in want)


def test_no_words(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert count_words(df).count() == 0 and group_variants(count_words(df)).count() == 0
    assert group_variants(count_words(df.where("false"))).count() == 0


def test_all_pairs_of_a_small_alphabet(spark):
    words = sorted({f"{a}{b}{c}{d}xx"[: 4 + len(a)] for a in ("", "a", "b") for b in "ab" for c in "ab" for d in "ab"} | {"abcdef", "abcdefg", "bcdefg", "xabcdef"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(x["a"], x["b"]) for x in near_pairs(df).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=6, max_size=14), st.integers(0, 13), st.sampled_from(["abc", "", "x"]), st.integers(0, 99))
def test_a_pivot_of_one_lies_in_the_prefix_of_the_other(word, at, new, seed):
    """For any two words one edit apart, with the side and length that the index asks for."""
    at %= len(word)
    other = word[:at] + new[:1] + word[at + (new != "abc") :]
    if not one_edit(word, other) or min(len(word), len(other)) < 6:
        return
    r = random.Random(seed)
    frequency = {g: r.randint(1, 4) for g in [*bigrams(word), *bigrams(other)]}
    meets = lambda a, b: not {*keys_of(a, pivots(prefix(a, frequency), frequency), CHANGES)}.isdisjoint(keys_of(b, prefix(b, frequency), (0,)))
    assert meets(word, other) or meets(other, word)


@given(st.lists(st.integers(0, 12), min_size=3, max_size=7, unique=True), st.lists(st.integers(1, 9), min_size=13, max_size=13))
def test_pivots_are_the_cheapest_disjoint_two(places, costs):
    grams = [(chr(97 + i), i) for i in places]
    frequency = {chr(97 + i): costs[i] for i in range(13)}
    a, b = pivots(grams, frequency)
    assert abs(a[1] - b[1]) >= 2
    assert frequency[a[0]] + frequency[b[0]] == min(costs[i] + costs[j] for i in places for j in places if j - i >= 2)
