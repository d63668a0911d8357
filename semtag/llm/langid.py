"""Language identification by a small byte convolutional network, trained in numpy.

Bytes are embedded, convolved by filters of several widths, max-pooled over a fixed-length window and
put through a softmax. To apply it, embedding and filters fold into one table for each filter tap, so
a convolution is a few table look-ups. A text's probabilities are the normalised geometric mean over
all its windows, which together cover every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import append_columns, fold_of, prepare, table, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Windows that go through the network together.
TOGETHER = 128
UNDETERMINED = "und"


def windows(text: bytes) -> np.ndarray:
    """All windows of a text: every run of the longest filter width lies in one; short ends are padded by 0."""
    step = WINDOW - max(WIDTHS) + 1
    data = np.frombuffer(text, np.uint8)
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


@dataclass
class ByteCNN:
    classes: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, classes: list[str], seed: int) -> ByteCNN:
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            classes,
            normal(256, EMBEDDING, scale=0.5),
            [normal(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            normal(FILTERS * len(WIDTHS), len(classes), scale=0.1),
            np.zeros(len(classes), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over windows x with class numbers y."""
        e, pooled, where, n = self.embed[x], [], [], len(x)
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            patches = np.concatenate([e[:, i : WINDOW - w + 1 + i] for i in range(w)], axis=2)
            z = patches @ f + b
            where.append(z.argmax(axis=1))
            pooled.append(np.maximum(z.max(axis=1), 0))
        h = np.concatenate(pooled, axis=1)
        p = softmax(h @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        p /= n
        dh = (p @ self.out.T) * (h > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            taps = where[k][:, :, None] + np.arange(w)  # window, filter, tap
            bytes_at = x[np.arange(n)[:, None, None], taps]
            seen = self.embed[bytes_at].reshape(n, FILTERS, w * EMBEDDING)
            d_filters.append(np.einsum("nfd,nf->df", seen, d))
            d_bias.append(d.sum(axis=0))
            back = (d[:, :, None] * f.T[None]).reshape(-1, EMBEDDING)
            np.add.at(d_embed, bytes_at.reshape(-1), back)
        return [d_embed, *d_filters, *d_bias, h.T @ p, p.sum(axis=0)]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and tap: what a byte adds to each filter."""
        return [[np.ascontiguousarray(self.embed @ f[i * EMBEDDING : (i + 1) * EMBEDDING]) for i in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]

    def log_probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pooled = []
        for w, b, taps in zip(WIDTHS, self.bias, tables, strict=True):
            n = WINDOW - w + 1
            z = np.take(taps[0], x[:, :n], axis=0)
            for i in range(1, w):
                z += np.take(taps[i], x[:, i : i + n], axis=0)
            pooled.append(np.maximum(z.max(axis=1) + b, 0))
        return np.log(np.maximum(softmax(np.concatenate(pooled, axis=1) @ self.out + self.out_bias), 1e-9))


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: list[str], epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 4) -> ByteCNN:
    """Adam on shuffled batches; the same rows in the same order give the same network."""
    net, r, t = ByteCNN.fresh(classes, seed), np.random.default_rng(seed), 0
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parameters()]
    total = max(1, epochs * -(-len(x) // batch))
    for _ in range(epochs):
        order = r.permutation(len(x))
        for i in range(0, len(x), batch):
            t += 1
            some = order[i : i + batch]
            step = rate * (1 - t / (total + 1))
            for p, g, m in zip(net.parameters(), net.gradients(x[some], y[some]), moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= step * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    return net


def fit_languages(df: DataFrame, held_out: int = 2, folds: int = 4, most_documents: int = 800, most_windows: int | None = None) -> ByteCNN | None:
    """Train on labelled rows outside the held-out fold; None if there are none.

    ``most_documents`` bounds, about evenly over languages, the rows learnt from, chosen by a hash of doc_id,
    text and language, so rows with a null doc_id or with equal ones don't stand or fall together.
    Of these rows every window of the whole text is learnt from, equal windows once, so a hot row can't fill the sample.
    ``most_windows`` (none by default) bounds the windows too: all documents' first ones by hash, then all second ones.
    """
    prepare(df.sparkSession)
    learn = df.where(fold_of(F.col("doc_id"), folds) != held_out).where("text is not null and lang is not null")
    part = F.pmod(F.xxhash64("doc_id", "text", "lang", F.lit(4)), F.lit(1_000_000))
    counts = sorted((r["lang"], r["n"], r["least"]) for r in learn.groupBy("lang").agg(F.count("*").alias("n"), F.min(part).alias("least")).collect())
    if not counts:
        return None
    each = max(1, most_documents // len(counts))
    # a language whose rows are all alike is learnt too
    share = F.create_map(*[F.lit(x) for lang, n, least in counts for x in (lang, max(least + 1, int(min(1.0, each / n) * 1_000_000)))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i, text in enumerate(utf8(batch)):
                found = sorted((xxhash.xxh3_64_intdigest(w), w) for w in map(bytes, windows(text.decode().lower().encode())))
                lang = [batch.column(0)[i].as_py()] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int64()), pa.array(lang, pa.string()), pa.array([w for _, w in found], pa.binary())], names=["turn", "lang", "bytes"])

    sample = learn.where(part < share[F.col("lang")]).select("lang", F.col("text").cast("string").alias("text"))
    cuts = sample.mapInArrow(cut, "turn long, lang string, bytes binary").groupBy("lang", "bytes").agg(F.min("turn").alias("turn"))
    if most_windows is not None:
        cuts = cuts.orderBy("turn", F.xxhash64("bytes", "lang"), "bytes", "lang").limit(most_windows)
    found = cuts.collect()
    rows = sorted((r["turn"], r["lang"], bytes(r["bytes"])) for r in found)
    if not rows:
        return None
    classes = sorted({lang for _, lang, _ in rows})
    x = np.stack([np.frombuffer(b, np.uint8) for *_, b in rows])
    return train(x, np.array([classes.index(lang) for _, lang, _ in rows]), classes)


def predict_languages(df: DataFrame, net: ByteCNN | None) -> DataFrame:
    """df with ``lang_pred`` (a learnt language, or ``und`` for a null text or one without a letter) and ``score``.

    ``score`` in [0, 1] is the text's probability of that language, 0 for ``und``; without a trained
    network all are ``und``. Equal texts get equal answers; ties go to the language first by code point.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)

    def make():
        net = shared.value
        tables = net.tables() if net else []

        def predict(batch: pa.RecordBatch) -> list:
            texts = [t.decode().lower() if t else "" for t in utf8(batch)]
            known = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t))]
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            sums = np.zeros((len(texts), len(net.classes) if net else 0))
            counts, waiting, owners, size = np.ones(len(texts)), [], [], 0

            def flush() -> None:
                x, who = np.concatenate(waiting), np.concatenate(owners)
                for i in range(0, len(x), TOGETHER):
                    np.add.at(sums, who[i : i + TOGETHER], net.log_probabilities(x[i : i + TOGETHER], tables))

            for i in known:
                found = windows(texts[i].encode())
                counts[i] = len(found)
                waiting.append(found)
                owners.append(np.full(len(found), i))
                size += len(found)
                if size >= 4096:
                    flush()
                    waiting, owners, size = [], [], 0
            if waiting:
                flush()
            if known:
                p = softmax(sums / counts[:, None])
                for i in known:
                    best = int(p[i].argmax())
                    langs[i], scores[i] = net.classes[best], float(p[i, best])
            return [langs, scores]

        return predict

    return append_columns(df, "lang_pred string, score double", make)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict_languages(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell, with a score of at least 0.3."""
    net = fit_languages(docs)
    renamed = docs.withColumnRenamed("lang_pred", "__lang_pred").withColumnRenamed("score", "__score")
    kept = predict_languages(renamed, net).where(f"lang_pred != '{UNDETERMINED}' and score >= 0.3")
    return kept.drop("lang_pred", "score").toDF(*docs.columns)
