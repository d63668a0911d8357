"""Approximate nearest neighbours for the largest inner product.

Directions are product-quantised with four bits a subspace under a score-aware, anisotropic loss: the
part of the residual parallel to the vector, which shifts large inner products, weighs more than the
rest. Codes are chosen by coordinate descent over the subspaces, centres by weighted least squares. What the
centres leave is coded in 16 bits a dimension, the length is kept, and so is how far a decoded direction lies off.

Equal vectors are one. A search scans the codes of blocks of vectors for blocks of queries; only codes and queries
travel. Every block tells the rows that can be among a query's best, by what their products are at least and
at most; of all blocks' rows those that still can be are taken, and one join brings their original vectors, for exact
scores. So no fixed number of scans cuts a result off, however lengths, dimensions and clusters lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import prepare, table

CENTRES = 16


@dataclass
class Quantiser:
    books: np.ndarray  # subspace, centre, dimension in the subspace
    dims: int

    def split(self, x: np.ndarray) -> np.ndarray:
        """Vectors as (row, subspace, dimension), zeros beyond the last dimension."""
        m, _, d = self.books.shape
        out = np.zeros((len(x), m * d), np.float32)
        out[:, : self.dims] = x
        return out.reshape(len(x), m, d)

    def encode(self, x: np.ndarray, sweeps: int = 2, ratio: float = 1.0) -> np.ndarray:
        """Codes (row, subspace). ratio: weight of the parallel against the orthogonal residual."""
        parts = self.split(x)
        norms = np.maximum((parts**2).sum(axis=(1, 2)), 1e-30)
        dots = np.einsum("nmd,mcd->nmc", parts, self.books)
        own = (parts**2).sum(axis=2)
        far = own[:, :, None] - 2 * dots + (self.books**2).sum(axis=2)[None]
        codes = far.argmin(axis=2)
        rows = np.arange(len(x))
        along = own[:, :, None] - dots  # <residual, x> of each choice
        total = sum(along[rows, m, codes[:, m]] for m in range(codes.shape[1]))
        for _ in range(sweeps if ratio > 1 else 0):
            for m in range(codes.shape[1]):
                others = total - along[rows, m, codes[:, m]]
                loss = far[:, m] + (ratio - 1) * (others[:, None] + along[:, m]) ** 2 / norms[:, None]
                codes[:, m] = loss.argmin(axis=1)
                total = others + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte; an odd last one is alone."""
        even = codes if codes.shape[1] % 2 == 0 else np.pad(codes, ((0, 0), (0, 1)))
        return even[:, ::2] << 4 | even[:, 1::2]

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The vectors (row, dimension) that packed codes stand for."""
        m, _, d = self.books.shape
        codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :m]
        return self.books[np.arange(m), codes].reshape(len(packed), m * d)[:, : self.dims]


def parallel_weight(dims: int, threshold: float) -> float:
    """Weight of the parallel residual for inner products above ``threshold`` of the vector's length."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def fit_quantiser(x: np.ndarray, subspace: int = 2, rounds: int = 8, threshold: float = 0.35, seed: int = 1) -> tuple[Quantiser, float]:
    """Books fitted to the rows of x; also the weight to encode with."""
    dims, r = x.shape[1], np.random.default_rng(seed)
    m = -(-dims // subspace)
    book = Quantiser(np.zeros((m, CENTRES, subspace), np.float32), dims)
    parts = book.split(x)
    book.books = np.stack([parts[r.choice(len(x), CENTRES, replace=len(x) < CENTRES), i] for i in range(m)])
    norms, ratio = np.maximum((parts**2).sum(axis=(1, 2)), 1e-30), parallel_weight(dims, threshold)
    eye = np.eye(subspace, dtype=np.float32)
    for turn in range(rounds):
        weight = ratio if turn >= rounds // 2 else 1.0  # plain clusters first
        codes = book.encode(x, sweeps=1, ratio=weight)
        chosen = np.stack([book.books[i, codes[:, i]] for i in range(m)], axis=1)
        total = ((parts - chosen) * parts).sum(axis=(1, 2))
        for i in range(m):
            p = parts[:, i]
            rest = total - ((p - chosen[:, i]) * p).sum(axis=1) + (p**2).sum(axis=1)  # <x - rest of the choice, x>
            scaled = p * ((weight - 1) / norms)[:, None]
            for c in range(CENTRES):
                at = codes[:, i] == c
                if at.any():
                    left = at.sum() * eye + scaled[at].T @ p[at]
                    book.books[i, c] = np.linalg.solve(left, p[at].sum(axis=0) + (scaled[at] * rest[at, None]).sum(axis=0))
    return book, ratio


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and their lengths, in double precision."""
    x = x.astype(np.float64)
    greatest = np.maximum(np.abs(x).max(axis=1, initial=0), 5e-324)
    y = x / greatest[:, None]
    length = np.maximum(np.sqrt((y**2).sum(axis=1)), 1e-300)
    return y / length[:, None], np.minimum(greatest * length, 1e308)


@dataclass
class Codes:
    """Coded vectors: of the direction, packed centres and what they leave in 16 bits a dimension; the length; how far the decoded direction may lie off."""

    packed: np.ndarray
    fine: np.ndarray
    scale: np.ndarray
    error: np.ndarray
    length: np.ndarray

    def decode(self, book: Quantiser, rows: slice) -> np.ndarray:
        return book.decode(self.packed[rows]) + self.fine[rows] * self.scale[rows, None]


def encode(x: np.ndarray, book: Quantiser, ratio: float) -> Codes:
    direction, length = units(x)
    packed = book.pack(book.encode(direction.astype(np.float32), ratio=ratio))
    left = direction - book.decode(packed)
    scale = (np.maximum(np.abs(left).max(axis=1, initial=0), 1e-30) / 32767).astype(np.float32)
    fine = np.clip(np.rint(left / scale[:, None]), -32767, 32767).astype(np.int16)
    found = Codes(packed, fine, scale, np.zeros(len(x)), length)
    off = np.sqrt(((direction - found.decode(book, slice(None))) ** 2).sum(axis=1))
    found.error = (off + (x.shape[1] + 16) * 2.0**-23).astype(np.float32)  # what single precision adds to a product, too
    return found


def best(j: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a few queries' (j) candidates can be among their ``need`` best; and what these are at least."""
    order = np.lexsort((-low, j))
    counts = np.bincount(j, minlength=len(need))
    full = counts >= need
    least = least.copy()
    least[full] = np.maximum(least[full], low[order][(np.cumsum(counts) - counts + need - 1)[full]])
    return high >= least[j], least


def scan(codes: Codes, queries: np.ndarray, need: np.ndarray, book: Quantiser, together: int = 128, rows: int = 4096) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, row, least, greatest inner product with the query's direction) of the rows that can be among a query's ``need`` best, all of them.

    A product with a decoded direction is off by its error at most, so that each row has a least and a greatest product. A row
    goes if ``need`` others have at least more than it can have.
    """
    asked = units(queries)[0].astype(np.float32)
    top = float(codes.length.max(initial=1e-300))
    weight = (codes.length / top).astype(np.float32)
    starts = range(0, len(asked), together)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32))
    held, leasts = [none for _ in starts], [np.full(len(need[a : a + together]), -np.inf, np.float32) for a in starts]
    for at in range(0, len(weight), rows):
        part = slice(at, at + rows)
        x = np.ascontiguousarray((codes.decode(book, part) * weight[part, None]).T)
        slack = codes.error[part] * weight[part] + np.float32(1e-37)
        for c, a in enumerate(starts):
            few, least = need[a : a + together], leasts[c]
            high = asked[a : a + together] @ x
            high += slack
            most = int(few.max())
            if np.isneginf(least).any() and high.shape[1] >= most:
                least = np.maximum(least, np.partition(high - 2 * slack, high.shape[1] - most, axis=1)[:, high.shape[1] - most])
            j, i = np.nonzero(high >= least[:, None])
            j, i, low, high = (np.concatenate(x) for x in zip(held[c], (j, i + at, high[j, i] - 2 * slack[i], high[j, i]), strict=True))
            kept, leasts[c] = best(j, low, high, few, least)
            held[c] = (j[kept], i[kept], low[kept], high[kept])
    for a, (j, i, low, high) in zip(starts, held, strict=True):
        yield j + a, i, low.astype(np.float64) * top, high.astype(np.float64) * top


def usable(df: DataFrame, key: str) -> DataFrame:
    """id, v of the rows that take part, once each, with ``copies``; vk and vk2 stand for the vector."""
    number = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.col("embedding").isNotNull() & ~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(number, lambda x: x != 0)
    found = df.select(F.col(key).cast("long").alias("id"), "embedding").where(F.col("id").isNotNull() & fit)
    keyed = found.select("id", F.col("embedding").alias("v"), F.xxhash64("embedding").alias("vk"), F.xxhash64("embedding", F.lit(1)).alias("vk2"))
    return keyed.groupBy("id", "vk", "vk2").agg(F.first("v").alias("v"), F.count("*").alias("copies"))


def exact_scores(pairs: DataFrame) -> DataFrame:
    """query_id, qk, id, copies, score of pairs with vectors v and q of one length: inner products in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, q = (batch.column(i).combine_chunks() if isinstance(batch.column(i), pa.ChunkedArray) else batch.column(i) for i in (4, 5))
            lengths = np.asarray(v.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            products = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * q.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sums = np.add.reduceat(products, np.r_[0, np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.float64())], names=["query_id", "qk", "id", "copies", "score"])

    return pairs.select("query_id", "qk", "id", "copies", "v", "q").mapInArrow(run, "query_id long, qk long, id long, copies long, score double")


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    rerank: int = 0,
    row_block: int = 1 << 18,
    query_block: int = 1 << 14,
    fit_rows: int = 20_000,
    seed: int = 1,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows but its own, ties to the smaller id.

    vectors: vec_id, embedding; queries: query_id, embedding; other columns are ignored. Rows with a null id, and vectors
    that are null, empty, zero, or hold a null or non-finite component take no part. A row whose id is a query's is not
    its neighbour. Repeated rows are neighbours as often as they occur; ids repeated with other vectors are rows like
    any other. A query that repeats exactly is one; with another vector it is one more query of that id. A query
    meets rows of its own length. Of equal vectors only the k + 1 least ids are looked at, as no
    query can take more. Those of the most usual length are searched by codes: ``fit_rows`` bounds the sample, chosen by hash,
    that the quantiser is fitted to, all rows are encoded, and every row whose scan says that it can be
    among the query's k best is scored exactly, or among its ``rerank`` best, if these are more. Vectors of other lengths are joined with the queries of their length and compared exactly.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors, "vec_id")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("vk", "vk2").orderBy("id"))).where(F.col("__n") <= k + 1).checkpoint()
    asked = usable(queries, "query_id").select(F.col("id").alias("query_id"), F.col("vk").alias("qk"), F.col("v").alias("q")).checkpoint()
    one = rows.where("__n = 1").select("vk", "vk2", "v", F.size("v").alias("dims"))
    lengths = one.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").take(2)
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = lengths[0]["dims"], lengths[0]["n"]
    own = one.where(F.col("dims") == dims)
    most = (2**63 - 1) * min(fit_rows, n) // n  # of the hashes from 0: fine enough for any number of rows
    sample = own.where(F.xxhash64("vk", F.lit(seed)).bitwiseAND(F.lit(2**63 - 1)) <= most).select("vk", "v").toArrow()
    x = np.array(sample["v"].combine_chunks().flatten().to_numpy().reshape(-1, dims), np.float64)[np.argsort(sample["vk"].to_numpy())]
    book, ratio = fit_quantiser(units(x if len(x) else np.ones((1, dims)))[0].astype(np.float32), seed=seed)
    shared = spark.sparkContext.broadcast((book, ratio))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, ratio = shared.value
        for batch in batches:
            if len(batch):
                found = encode(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), book, ratio)
                coded = [pa.array([c.tobytes() for c in x], pa.binary()) for x in (found.packed, found.fine)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *coded, *map(pa.array, (found.scale, found.error, found.length))], names=["vk", "vk2", "packed", "fine", "scale", "error", "length"])

    # rows of a query's own id are no neighbours, so that many more have to be looked at
    of_id = rows.groupBy(F.col("id").alias("query_id")).agg(F.count("*").alias("n_own"))
    of_length = asked.where(F.size("q") == dims).join(of_id, "query_id", "left").select("query_id", "qk", "q", F.greatest(k + F.coalesce("n_own", F.lit(0)), F.lit(rerank)).alias("need")).checkpoint()
    n_queries, workers = of_length.count(), spark.sparkContext.defaultParallelism
    row_blocks = math.ceil(n / min(row_block, max(4096, 2**26 // (3 * dims))))
    query_blocks = max(1, math.ceil(n_queries / query_block), min(math.ceil(2 * workers / row_blocks), math.ceil(n_queries / 128)))
    indexed = own.select("vk", "vk2", "v").mapInArrow(index, "vk long, vk2 long, packed binary, fine binary, scale float, error float, length double")
    # every block of codes meets every block of queries once, in a cell of its own
    grid = lambda df, key, own, mine, other, theirs: df.withColumn(own, F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))
    left = grid(indexed, ["vk"], "rb", row_blocks, "qb", query_blocks).groupBy("rb", "qb")
    right = grid(of_length, ["query_id", "qk"], "qb", query_blocks, "rb", row_blocks).groupBy("rb", "qb")

    def cell(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(v) and len(q):
            read = lambda name, kind: np.frombuffer(b"".join(v[name]), kind).reshape(len(v), -1)
            codes = Codes(read("packed", np.uint8), read("fine", np.int16), *(v[c].to_numpy() for c in ("scale", "error", "length")))
            for j, i, low, high in scan(codes, np.stack(q["q"]), q["need"].to_numpy(), shared.value[0]):
                parts.append(pd.DataFrame({**{c: q[c].to_numpy()[j] for c in ("query_id", "qk", "need")}, **{c: v[c].to_numpy()[i] for c in ("vk", "vk2")}, "low": low, "high": high}))
        return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.float64 if c in ("low", "high") else np.int64) for c in ("query_id", "qk", "need", "vk", "vk2", "low", "high")})

    scans = left.cogroup(right).applyInPandas(cell, "query_id long, qk long, need long, vk long, vk2 long, low double, high double")
    of_query = Window.partitionBy("query_id", "qk")
    scans = scans.withColumn("__r", F.row_number().over(of_query.orderBy(F.desc("low"))))
    scans = scans.withColumn("__least", F.max(F.when(F.col("__r") == F.col("need"), F.col("low"))).over(of_query)).where(F.col("__least").isNull() | (F.col("high") >= F.col("__least")))
    pairs = scans.select("query_id", "qk", "vk", "vk2").join(rows.select("id", "copies", "vk", "vk2", "v"), ["vk", "vk2"]).join(of_length, ["query_id", "qk"])
    if len(lengths) > 1:
        others = rows.where(F.size("v") != dims).withColumn("dims", F.size("v"))
        pairs = pairs.select("query_id", "qk", "id", "copies", "v", "q").unionByName(others.join(asked.withColumn("dims", F.size("q")), "dims").select("query_id", "qk", "id", "copies", "v", "q"))
    found = exact_scores(pairs.where("id != query_id")).withColumn("copies", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    rank = F.row_number().over(of_query.orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op1_search(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return search(vectors, queries)
