"""Language-model scoring with a log-bilinear model.

The output vocabulary is a shortlist of the most frequent words, which grows with the vocabulary counted up
to a bound, plus classes of all other words, by their last letters; a word in a class has its add-one
share of the class. The model predicts the next entry from the two before: their vectors, weighted by
position, add up to a predicted vector. An entry's probability has two levels: that of its group (entries
next to each other by frequency), then its own inside the group, each a softmax of products with learnt
vectors, plus biases. Both are trained in numpy by noise-contrastive estimation on every training token:
texts are dealt to shards by a hash, so that the fit doesn't depend on how the table is split; each shard
goes over its texts in minibatches from one common start, and the shards' parameters are averaged by
tokens (again for each round). To score, batched matrix products give every token's normalised
log-probability.

Word counts of any vocabulary size stay distributed: only the most frequent words, a bounded number, go
to every task; the counts of other words meet their occurrences in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold_of, prepare, table, utf8

#: The end of a text, counted as a token; no word has white space in it.
END = b"\n"
#: Most entries of the shortlist, classes of other words, dimensions of a vector; its last place is the bias.
SHORTLIST, CLASSES, DIMS = 16_384, 128, 24
#: Words whose counts every task knows, and the bytes above which a word is named by its digest.
KNOWN, LONG = 300_000, 64
#: Distinct words that a task counts before it hands them on.
COUNTED = 500_000
NOISE, BATCH, RUN, RATE = 32, 2048, 64, 0.05
#: Training tokens of a shard, and most shards; above that many, shards get longer.
SHARD_TOKENS, SHARDS = 1 << 21, 4096
#: Parameters of one piece, when shards are averaged; tokens whose group scores are computed together.
PIECE, TOGETHER = 1 << 12, 1024


def tokens(text: bytes | None) -> list[bytes]:
    """A text's tokens in lower case, then END. A very long word is named by its digest."""
    found = [*(text or b"").lower().split(), END]
    if len(text or b"") > LONG:
        return [w if len(w) <= LONG else b"\n" + blake2b(w, digest_size=16).digest() for w in found]
    return found


def class_of(word: bytes) -> int:
    """The class of a word outside the shortlist."""
    return zlib.crc32(word[-2:]) % CLASSES


class Entries(dict):
    """Words to entries, remembered up to a bound: a word's place in the shortlist, else its class behind it."""

    def __init__(self, shortlist: list[bytes]):
        self.fixed = {w: i for i, w in enumerate(shortlist)}
        super().__init__(self.fixed)

    def __missing__(self, word: bytes) -> int:
        if len(self) > COUNTED:
            self.clear()
            self.update(self.fixed)
        self[word] = entry = self.fixed[word] if word in self.fixed else len(self.fixed) + class_of(word)
        return entry


@dataclass
class LogBilinear:
    vectors: np.ndarray  # entry, dimension; the last is the bias
    groups: np.ndarray  # group, dimension; the last is the bias
    near: np.ndarray  # weights of the last token's dimensions; none for the bias
    far: np.ndarray  # of the one before

    @property
    def size(self) -> int:
        """Entries of a group."""
        return math.isqrt(len(self.vectors) - 1) + 1

    @classmethod
    def start(cls, p: np.ndarray, seed: int) -> LogBilinear:
        """Small random vectors and the biases of the unigram model p."""
        r = np.random.default_rng(seed)
        size = math.isqrt(len(p) - 1) + 1
        vectors = (r.standard_normal((len(p), DIMS + 1)) * 0.3).astype(np.float32)
        groups = (r.standard_normal((-(-len(p) // size), DIMS + 1)) * 0.1).astype(np.float32)
        vectors[:, -1], groups[:, -1] = np.log(p), np.log(np.add.reduceat(p, np.arange(0, len(p), size)))
        weights = np.append(np.full(DIMS, 0.1, np.float32), np.float32(0))
        return cls(vectors, groups, weights, weights.copy())

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.vectors, self.groups, self.near, self.far)])

    def unpack(self, flat: np.ndarray) -> LogBilinear:
        """A model of this one's shape."""
        shapes = [x.shape for x in (self.vectors, self.groups, self.near, self.far)]
        parts = np.split(flat.astype(np.float32), np.cumsum([math.prod(x) for x in shapes])[:-1])
        return LogBilinear(*[p.reshape(x) for p, x in zip(parts, shapes, strict=True)])

    def scorer(self) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """A function of entries (one before, last, next): ln of the next one's probability, normalised over all entries."""
        one, two, size = self.vectors * self.near, self.vectors * self.far, self.size

        def log_sum(z: np.ndarray) -> np.ndarray:
            out = np.log(np.exp(z) @ np.ones(z.shape[1], np.float32))
            if (np.abs(out) < 60).all():  # no row left float32's range
                return out
            top = z.max(axis=1, keepdims=True)
            return top[:, 0] + np.log(np.exp(z - top).sum(axis=1))

        def score(before: np.ndarray, last: np.ndarray, word: np.ndarray) -> np.ndarray:
            out, group = np.empty(len(word), np.float32), word // size
            order = np.argsort(group.astype(np.int16), kind="stable")
            group, word = group[order], word[order]
            q = one[last[order]] + two[before[order]]
            q[:, -1] = 1
            found = np.empty(len(word), np.float32)
            for i in range(0, len(word), TOGETHER):
                z = q[i : i + TOGETHER] @ self.groups.T
                own = z[np.arange(len(z)), group[i : i + TOGETHER]]
                found[i : i + TOGETHER] = own - log_sum(z)
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(word) else []
            for a, b in zip(starts, [*starts[1:], len(word)], strict=True):
                first = int(group[a]) * size
                for i in range(a, b, TOGETHER):
                    j = min(b, i + TOGETHER)
                    z = q[i:j] @ self.vectors[first : first + size].T
                    own = z[np.arange(j - i), word[i:j] - first]
                    found[i:j] += own - log_sum(z)
            out[order] = found
            return out

        return np.errstate(over="ignore", divide="ignore")(score)


def _sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers (of entries: they fit in 16 bits, which sort fastest) and the sum of each one's rows."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    keys = at[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(rows[order], starts, axis=0)


class Trainer:
    """Noise-contrastive estimation with Adagrad on the rows met; a minibatch shares its noise."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, seed: int):
        self.model, self.r = model, np.random.default_rng(seed)
        by_group = np.add.reduceat(noise, np.arange(0, len(noise), model.size))
        self.levels = [(np.log(NOISE * p).astype(np.float32), np.cumsum(p)) for p in (noise, by_group)]
        self.squares = [np.ones_like(p) for p in (model.vectors, model.groups, model.near, model.far)]

    def contrast(self, level: int, q: np.ndarray, own: np.ndarray, table: np.ndarray, word: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one level: the gradients for q and for the words' rows (own), and those of the noise drawn, by number."""
        log_noise, cumulative = self.levels[level]
        drawn = np.minimum(np.searchsorted(cumulative, self.r.random(NOISE) * cumulative[-1]), len(table) - 1)
        other = table[drawn]
        right = real / (1 + np.exp((np.einsum("ij,ij->i", q, own) - log_noise[word]).clip(-30, 30)))
        wrong = -real[:, None] / (1 + np.exp((log_noise[drawn] - q @ other.T).clip(-30, 30)))
        return right[:, None] * own + wrong @ other, right[:, None] * q, drawn, wrong.T @ q

    def step(self, ids: np.ndarray, real: np.ndarray) -> None:
        """Runs of tokens (run, place); the first two of a run are context only, as are those after them where ``real`` is 0.

        A token's vector is met as the next, the last and the one before: its gradients add up before they are scattered.
        """
        m, runs, n = self.model, len(ids), ids.shape[1] - 2
        v = m.vectors[ids]
        q = (v[:, 1:-1] * m.near + v[:, :-2] * m.far).reshape(runs * n, -1)
        q[:, -1] = 1
        word, real = ids[:, 2:].reshape(-1), real.reshape(-1)
        group = word // m.size
        dq, d_own, drawn, d_drawn = self.contrast(0, q, v[:, 2:].reshape(runs * n, -1), m.vectors, word, real)
        dg, d_group, drawn_group, d_drawn_group = self.contrast(1, q, m.groups[group], m.groups, group, real)
        dq += dg
        dq[:, -1] = 0
        dq, rows = dq.reshape(runs, n, -1), np.zeros_like(v)
        rows[:, 2:] = d_own.reshape(runs, n, -1)
        rows[:, 1:-1] += dq * m.near
        rows[:, :-2] += dq * m.far
        found = [_sums(np.append(ids, drawn), np.concatenate([rows.reshape(-1, rows.shape[2]), d_drawn])), _sums(np.append(group, drawn_group), np.concatenate([d_group, d_drawn_group]))]
        found += [(slice(None), np.einsum("abj,abj->j", x, dq) / max(1, real.sum())) for x in (v[:, 1:-1], v[:, :-2])]
        for p, s, (i, g) in zip((m.vectors, m.groups, m.near, m.far), self.squares, found, strict=True):
            s[i] += g * g
            p[i] += RATE * g / np.sqrt(s[i])

    def learn(self, texts: list[np.ndarray]) -> None:
        """Go over texts (entries of their tokens) once, in runs in random order."""
        stream = np.concatenate([x for t in texts for x in ((0, 0), t)])  # every text starts after two ends
        real = np.ones(len(stream), np.float32)
        first = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        real[first] = real[first + 1] = 0
        more = -(len(stream) - 2) % RUN
        stream, real = np.pad(stream, (0, more)), np.pad(real, (0, more))
        starts = self.r.permutation(np.arange(2, len(stream), RUN))
        for i in range(0, len(starts), BATCH // RUN):
            at = starts[i : i + BATCH // RUN, None] + np.arange(-2, RUN)
            self.step(stream[at], real[at[:, 2:]])


@dataclass
class Fitted:
    vocabulary: DataFrame  # word binary, n long: every training token, END included
    total: int
    distinct: int
    known: list[bytes]
    counts: np.ndarray
    shortlist: list[bytes]
    class_sizes: np.ndarray  # for each class: tokens + distinct words + 1, or 1 at least
    model: LogBilinear


def count_words(df: DataFrame) -> DataFrame:
    """word (binary), n: how often each token occurs in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        hand = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in utf8(batch):
                counts.update(tokens(text))
                if len(counts) > COUNTED:
                    yield hand()
                    counts.clear()
        yield hand()

    return df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(vocabulary: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, most frequent first: whole steps of frequency, as many as hold at most KNOWN words.

    A step is 1/64 of a doubling, so that the steps are few; no task sorts or gathers the vocabulary.
    """
    stepped = vocabulary.withColumn("step", F.floor(F.log2("n") * 64))
    held, least = 0, None
    for r in sorted(stepped.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        held += r["words"]
        if held > KNOWN:
            break
        least = r["step"]
    if least is None:
        return [], np.zeros(0, np.int64)
    rows = stepped.where(F.col("step") >= least).select("word", "n").toArrow()
    words, counts = rows["word"].to_pylist(), rows["n"].to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    return [words[i] for i in order], np.array([counts[i] for i in order], np.int64)


def train(dealt: DataFrame, model: LogBilinear, noise: np.ndarray, seed: int) -> LogBilinear:
    """One round: every shard trains on all its texts, the results are averaged by tokens. dealt: ids, sorted in its shards."""
    shared = dealt.sparkSession.sparkContext.broadcast((model, noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, noise = shared.value
        shard = TaskContext.get().partitionId()
        trainer = Trainer(model.unpack(model.pack().copy()), noise, seed + shard)
        seen, waiting, size = 0, [], 0

        for batch in batches:
            for ids in batch.column(0).to_pylist():
                waiting.append(np.frombuffer(ids, "<i4"))
                size += len(waiting[-1])
                if size >= 32 * BATCH:
                    trainer.learn(waiting)
                    waiting, seen, size = [], seen + size, 0
        if waiting:
            trainer.learn(waiting)
            seen += size
        if seen:
            flat = trainer.model.pack()
            pieces = range(0, len(flat), PIECE)
            yield pa.RecordBatch.from_pydict({"piece": [i // PIECE for i in pieces], "shard": [shard] * len(pieces), "seen": [seen] * len(pieces), "value": [flat[i : i + PIECE].tobytes() for i in pieces]})

    def mean(pieces: pd.DataFrame) -> pd.DataFrame:
        total, n = 0.0, 0
        for _, value, seen in sorted(zip(pieces["shard"], pieces["value"], pieces["seen"], strict=True), key=lambda x: x[0]):
            total, n = total + np.frombuffer(value, np.float32).astype(float) * seen, n + seen
        return pd.DataFrame({"piece": pieces["piece"].iloc[:1], "value": [(total / n).astype(np.float32).tobytes()]})

    found = dealt.mapInArrow(run, "piece long, shard long, seen long, value binary").groupBy("piece").applyInPandas(mean, "piece long, value binary").collect()
    if not found:
        return model
    return model.unpack(np.frombuffer(b"".join(r["value"] for r in sorted(found, key=lambda r: r["piece"])), np.float32))


def deal(df: DataFrame, shortlist: list[bytes], total: int) -> DataFrame:
    """ids (int32 entries of a text's tokens) of every row, dealt to shards by a hash of doc_id and text, and sorted there."""
    shared = df.sparkSession.sparkContext.broadcast(shortlist)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Entries(shared.value)
        for batch in batches:
            ids = [np.array([entries[w] for w in tokens(t)], "<i4").tobytes() for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.binary())], names=["key", "ids"])

    shards = max(1, min(SHARDS, -(-total // SHARD_TOKENS)))
    keyed = df.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    return keyed.mapInArrow(run, "key long, ids binary").repartition(shards, "key").sortWithinPartitions("key", "ids").select("ids")


def fit(df: DataFrame, rounds: int = 1, seed: int = 3) -> Fitted:
    """Fit to all rows of df (doc_id, text; null: empty). Splitting the table otherwise changes nothing.

    Repeated rows count as often as they occur; rows alike in doc_id and text are learnt from in one shard.
    """
    prepare(df.sparkSession)
    vocabulary = count_words(df).checkpoint()
    row = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    known, counts = frequent_words(vocabulary)
    shortlist = [END, *[w for w in known[:SHORTLIST] if w != END]][:SHORTLIST]
    number = F.crc32(F.substring("word", -2, 2)) % CLASSES
    by_class = vocabulary.groupBy(number.cast("int").alias("entry")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    tokens_in, words_in = np.zeros(len(shortlist) + CLASSES), np.zeros(CLASSES)
    for r in by_class:
        tokens_in[len(shortlist) + r["entry"]], words_in[r["entry"]] = r["n"], r["words"]
    count_of = dict(zip(known[: SHORTLIST + 1], counts.tolist(), strict=False))
    for i, w in enumerate(shortlist):
        n = count_of.get(w, 0)
        tokens_in[i] = n
        tokens_in[len(shortlist) + class_of(w)] -= n
        words_in[class_of(w)] -= n > 0
    noise = (tokens_in + 1) / (tokens_in + 1).sum()
    model = LogBilinear.start(noise, seed)
    if row["total"]:
        dealt = deal(df, shortlist, row["total"])
        dealt = dealt.checkpoint() if rounds > 1 else dealt
        for i in range(rounds):
            model = train(dealt, model, noise, seed + 10_000 * i)
    return Fitted(vocabulary, int(row["total"]), int(row["distinct"]), known, counts, shortlist, tokens_in[len(shortlist) :] + words_in + 1, model)


def score_texts(df: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row: log10 probabilities of the whole text and its end.

    ``base_score``: unigrams with add-one smoothing. Null and empty texts are an end only. Repeated rows
    score alike. With nothing to learn from, both scores are 0.
    """
    spark = df.sparkSession
    prepare(spark)
    log10 = np.log10(np.e)
    shared = spark.sparkContext.broadcast((fitted.known, fitted.counts, fitted.shortlist, fitted.class_sizes, fitted.model))
    fields = "rid long, rid2 long, doc_id long, n_tokens long, n_known long, base double, score double, word binary, times int"
    columns = [f.split()[0] for f in fields.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.float64(), pa.float64(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for each of its words that isn't known here."""
        known, counts, shortlist, class_sizes, model = shared.value
        number, entries, score = {w: i for i, w in enumerate(known)}, Entries(shortlist), model.scorer()
        entry = np.array([entries[w] for w in known] or [0], np.int64)
        plus = np.log10(np.append(counts, 0) + 1.0)
        inside = np.r_[np.zeros(len(shortlist)), np.log10(class_sizes)]
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                heads, rest, ends, ats, found = list(zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)), [], [0], [], []
                for head, text in zip(heads, utf8(part), strict=True):
                    words = tokens(text)
                    at = np.array([number.get(w, -1) for w in words], np.int64)
                    e, new = entry[at], np.flatnonzero(at < 0)
                    if len(new):
                        unknown = [words[i] for i in new]
                        e[new] = [entries[w] for w in unknown]
                        rest += [(*head, None, None, None, None, w, n) for w, n in Counter(unknown).items()]
                    ats.append(at)
                    found.append(e)
                    ends.append(ends[-1] + len(e))
                at, e, first = np.concatenate(ats), np.concatenate(found), np.array(ends[:-1])
                last, before = np.r_[0, e[:-1]], np.r_[0, 0, e[:-2]][: len(e)]
                last[first], before[first] = 0, 0
                before[np.minimum(first + 1, ends[-1] - 1)[np.diff(ends) > 1]] = 0
                counted = np.where(at < 0, 0.0, plus[at])
                # a word in a class has its share of it; the count of one not known here is added by the join
                share = np.where(e < len(shortlist), 0.0, counted) - inside[e]
                model_score = np.add.reduceat(score(before, last, e) * log10 + share, first)
                sums = zip(np.diff(ends), np.add.reduceat((at >= 0).astype(np.int64), first), np.add.reduceat(counted, first), model_score, strict=True)
                out = [(*head, *x, None, None) for head, x in zip(heads, sums, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, *rest, strict=True), kinds, strict=True)], names=columns)

    rows = df.select(F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64("text", "doc_id", F.lit(1)).alias("rid2"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, fields).checkpoint()
    key = ["rid", "rid2"]
    rare = found.where("word is not null").select(*key, "word", "times").join(fitted.vocabulary, "word")
    rare = rare.groupBy(*key).agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare"), F.sum("times").alias("rare_known"))
    texts = found.where("word is null").drop("word", "times")
    copies = texts.groupBy(*key).agg(F.count("*").alias("copies"))
    per_row = copies.join(rare, key).select(*key, (F.col("rare") / F.col("copies")).alias("rare"), (F.col("rare_known") / F.col("copies")).cast("long").alias("rare_known"))
    joined = texts.join(per_row, key, "left")
    more = F.coalesce("rare", F.lit(0.0))
    scale = float(np.log10(fitted.total + fitted.distinct + 1))
    learnt = F.lit(fitted.total > 0)
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + more - F.col("n_tokens") * scale).alias("base_score"),
        F.when(learnt, F.col("score") + more).otherwise(0.0).alias("score"),
    )


def op3_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 7) == 2
    fitted = fit(docs.where(~held_out))
    scored = score_texts(docs, fitted)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(fitted.total).cast("long").alias("train_tokens"), "base_score", "score")
