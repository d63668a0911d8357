"""Grouping spelling variants: a similarity join of words by pivotal grams.

A word's bigrams (each with its place) are ordered from rare to frequent, by the number of words that have
them. One edit destroys at most two bigrams, so among a word's three first ones, its prefix, one outlives it.
Of two disjoint bigrams one edit destroys at most one: two such, of least total frequency, are chosen from the prefix
by dynamic programming as the word's pivots. If two words are one edit apart, a pivot of the one whose prefix
ends earlier lies in the prefix of the other. So pivots are looked up in an index of prefixes. An edit that
changes the length by d lies after a spared bigram, which then keeps its place, or before it, which moves it by d: the
other side of the bigram is the same in both words. So the index has each prefix bigram by the word's length and
a hash of the text from there to the word's start, which holds its place, and one of that to its end; a pivot
asks for six such keys, and what is found is verified there, in the join.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, table, utf8

RUN = re.compile("[a-zÀ-ÿ]+")
#: Words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Bigrams whose counts go to every task: words of count_words have 26 + 64 letters, so more can't be.
MOST_GRAMS = 90 * 90
#: Changes of the length by one edit; base and modulus of the hashes of a word's two sides.
CHANGES, BASE, MODULUS = (0, 1, -1), 1_000_003, (1 << 62) - 57


def count_words(docs: DataFrame, least_chars: int = 6, least_count: int = 5, damage: int = 199) -> DataFrame:
    """word, n of the letter runs of whole texts, lower-cased in A-Z only, that are long and frequent enough.

    ``damage``: where it divides the crc32 of ``<doc_id>:<run>``, the run loses one code point (0: never).
    Tasks add up before they shuffle, so that a frequent word is one row a task. Null texts have no words, a null
    doc_id is empty text.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall((text or b"").lower().decode())).items():
                    if len(word) < least_chars:
                        continue
                    if damage:
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_chars:
                                continue
                    counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield told()
        yield told()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def prefix(word: str, frequency: dict[str, int], first: int = 3) -> list[tuple[str, int]]:
    """(bigram, place) of the ``first`` rarest bigrams, with all that tie with the last by frequency and text."""
    placed = sorted((frequency[g], g, i) for i, g in enumerate(bigrams(word)))
    last = placed[: first][-1][:2] if placed else None
    return [(g, i) for f, g, i in placed if (f, g) <= last]


def pivots(grams: list[tuple[str, int]], frequency: dict[str, int], number: int = 2, apart: int = 2) -> list[tuple[str, int]]:
    """``number`` of the grams, places ``apart`` or more from one another, of least total frequency; fewer if there are none.

    Dynamic programming by place: the best choice of k among the grams up to here takes this one and the best of k - 1
    among those that end before it, or goes without it.
    """
    grams = sorted(grams, key=lambda x: x[1])
    best = [[(0, ())] + [None] * number]  # after each gram, for each k: (cost, chosen)
    free = 0  # grams that lie apart before the one at hand
    for i, (gram, place) in enumerate(grams):
        while grams[free][1] <= place - apart:
            free += 1
        row = list(best[i])
        for k in range(1, number + 1):
            if (before := best[free][k - 1]) is not None:
                cost = before[0] + frequency[gram]
                if row[k] is None or cost < row[k][0]:
                    row[k] = (cost, (*before[1], i))
        best.append(row)
    chosen = next(x for x in reversed(best[-1]) if x is not None)
    return [grams[i] for i in chosen[1]]


def sides(word: str) -> tuple[list[int], list[int]]:
    """Hashes of word[:i], and of word[i:], for every i; even for the former, odd for the latter."""
    codes = [ord(c) + 1 for c in word]
    ahead = list(itertools.accumulate(codes, lambda h, c: (h * BASE + c) % MODULUS, initial=7))
    behind = list(itertools.accumulate(reversed(codes), lambda h, c: (h * BASE + c) % MODULUS, initial=7))[::-1]
    return [2 * h for h in ahead], [2 * h + 1 for h in behind]


def keys_of(word: str, grams: list[tuple[str, int]], changes: tuple[int, ...]) -> list[tuple[int, int]]:
    """(hash of the text on one side of a bigram and itself, length of the word with a change), for each side, bigram and change."""
    ahead, behind = sides(word)
    return list({(h, len(word) + d) for _, i in grams for h in (ahead[i + 2], behind[i]) for d in changes})


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: pairs of distinct words (column word, each once) that are one inserted, deleted or replaced code point apart, each pair once, a before b.

    Words have at least four code points (then three bigrams hold two disjoint ones) and few distinct bigrams
    (``MOST_GRAMS``; more raise an error). Ties are all in the prefix, so the order of equal bigrams never matters.
    """
    prepare(words.sparkSession)
    each = F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")))
    counted = words.select(each.alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).take(MOST_GRAMS + 1)
    if len(counted) > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} bigrams: too many letters")
    frequency = {r["gram"]: r["n"] for r in counted}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                grams = prefix(word, frequency)
                out += [(word, False, *k) for k in keys_of(word, grams, (0,))]
                out += [(word, True, *k) for k in keys_of(word, pivots(grams, frequency), CHANGES)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.string(), pa.bool_(), pa.int64(), pa.int32()), strict=True)], names=["word", "asks", "side", "chars"])

    cuts = words.select("word").mapInArrow(cut, "word string, asks boolean, side long, chars int").checkpoint()
    asks, index = cuts.where("asks").drop("asks"), cuts.where("not asks").drop("asks").withColumnRenamed("word", "other")
    found = asks.join(index, ["side", "chars"]).where(F.levenshtein("word", "other", 1) == 1)
    return found.select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).distinct()


def roots(forms: DataFrame, ratio: int = 5) -> DataFrame:
    """word, root from (word, form): the end of each word's chain of forms, by pointer jumping.

    Each form is ``ratio`` times as frequent as its word, so chains are short: doubling ends after a few rounds.
    """
    now, before = forms.select("word", F.col("form").alias("root")).checkpoint(), None
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("word", "root").cast("decimal(38,0)"))).first()
        if told == before:
            return now
        before = told
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        now = now.join(onward, "root", "left").select("word", F.coalesce("__next", "root").alias("root")).checkpoint()


def group_variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n plus n_near, form, form_n, root of words (word, n; each once).

    A word's form is the most frequent word near it (ties: the first in code-point order) if that is ``ratio``
    times as frequent; root follows forms to the last, and is the word itself without any. No words give no rows.
    """
    words = counts.select("word", "n").checkpoint()
    pairs = near_pairs(words)
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sized = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("__n")), "b")
    best = sized.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("__n")).alias("less"), "b")).alias("best"))
    fits = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    known = words.join(best, "word", "left").withColumn("best", fits).select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.b").alias("form"), (-F.col("best.less")).alias("form_n")).checkpoint()
    ends = roots(known.where("form is not null"), ratio)
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of all documents: word, form, root, n, n_near, form_n."""
    return group_variants(count_words(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
