"""Quality rules: plain document statistics, then a log-likelihood ratio of hashed n-grams.

Byte n-grams are hashed into a fixed number of bins. Over all documents they make the raw-corpus
multinomial, over trusted ones (labelled good) the target multinomial. A document's score is the mean
over its n-grams of log(target / raw); every document at or above one threshold is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import append_columns, prepare, table, utf8

BINS = 1 << 16
ORDER = 3
#: Bytes whose n-grams are hashed at once.
CHUNK = 1 << 20
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def hashed(data: np.ndarray) -> np.ndarray:
    """The bins of all n-grams of a byte array, by the position of their first byte."""
    n = len(data) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    h = data[:n].astype(np.uint32)
    for i in range(1, ORDER):
        h = h * np.uint32(0x01000193) ^ data[i : i + n]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.uint16)


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    for i in range(0, max(1, len(data) - ORDER + 1), CHUNK):
        yield hashed(data[i : i + CHUNK + ORDER - 1])


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """doc_id of documents labelled good; of more than about ``most``, a sample by hash."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__trusted")).distinct()
    share = int(min(1.0, most / max(1, good.count())) * 1_000_000)
    return good.where(F.pmod(F.xxhash64("__trusted", F.lit(2)), F.lit(1_000_000)) < share)


def fit_ratio(df: DataFrame, labels: DataFrame, most_trusted: int = 200_000, prior: float = 0.5) -> np.ndarray:
    """log(target / raw) of each bin. Raw counts cover every row; ``most_trusted`` bounds the labelled sample."""
    prepare(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            for text, good in zip(utf8(batch), batch.column(1).to_pylist(), strict=True):
                for bins in _pieces(text or b""):
                    n = np.bincount(bins, minlength=BINS)
                    raw += n
                    if good:
                        target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bin": at, "raw": raw[at], "target": target[at]})

    ids = F.broadcast(trusted_ids(labels, most_trusted))
    marked = df.join(ids, F.col("doc_id") == F.col("__trusted"), "left").select("text", F.col("__trusted").isNotNull().alias("good"))
    rows = marked.mapInArrow(count, "bin long, raw long, target long").groupBy("bin").agg(F.sum("raw"), F.sum("target")).toArrow()
    raw, target = np.full(BINS, prior), np.full(BINS, prior)
    at = rows.column(0).to_numpy()
    raw[at] += rows.column(1).to_numpy()
    target[at] += rows.column(2).to_numpy()
    if not target.sum() > prior * BINS:  # nothing is labelled good: no evidence against any document
        return np.zeros(BINS, np.float32)
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    pairs, n = ids[:-1] * len(codes) + ids[1:], len(codes)
    if n >= 1 << 20:  # three codes would not fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i : len(words) - 2 + i] |= again
    return int(inside.sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words, chars = text.split(), text.decode("utf-8", "replace")
    lines = [x for x in text.split(b"\n") if x.strip(SPACES.encode())]
    return (
        len(words),
        len(chars) - sum(map(chars.count, SPACES)),
        sum(map(chars.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def judge_quality(df: DataFrame, ratio: np.ndarray, threshold: float = -0.5, min_words: int = 50) -> DataFrame:
    """df with the columns of FIELDS for every row's whole text (null text: no words).

    ``base_failed``: fewer than ``min_words`` words, or over half of them in repeated 3-word windows.
    ``llr``: null for a text too short for one n-gram. ``kept``: not base_failed and llr >= threshold.
    Repeated rows are judged alike; the order of rows has no influence.
    """
    shared = df.sparkSession.sparkContext.broadcast(ratio)

    def make():
        weights = shared.value

        def judge(batch: pa.RecordBatch) -> list:
            rows = []
            for text in utf8(batch):
                found = statistics(text or b"")
                parts = [weights[bins] for bins in _pieces(text or b"")]
                n = sum(map(len, parts))
                llr = sum(float(p.sum(dtype=np.float64)) for p in parts) / n if n else None
                failed = found[0] < min_words or 100 * found[4] > 50 * found[0]
                rows.append((*found, failed, llr, not failed and llr is not None and llr >= threshold))
            return list(zip(*rows, strict=True)) if rows else [[]] * 8

        return judge

    return append_columns(df, FIELDS, make)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, fit_ratio(docs, table(spark, sf_dir, "labels"))).drop("text")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with all their columns, also those named as a verdict is."""
    ratio = fit_ratio(docs, table(spark, sf_dir, "labels"))
    verdict = {f.split(" ")[0] for f in FIELDS.split(", ")}
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c.lower() in verdict}
    judged = judge_quality(docs.withColumnsRenamed(own), ratio)
    return judged.where("kept").select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
