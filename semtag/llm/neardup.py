"""Near-duplicate documents by DartMinHash, banding, and an exact check.

Texts are sets of five-word shingles. Equal sets are one node, so copies never meet in pairs. Nodes
whose DartMinHash signatures agree on a band share a bucket. Linking goes in two steps, neither of
which emits the pairs of a bucket:

1. Star: each bucket's member that shares most buckets leads it; every other member is compared with
   its leader exactly. Links make components.
2. Rest: where a bucket still holds several components, its members outside the largest are held, in
   blocks of bounded size, and all its members stream past them, in blocks too: a cell of two blocks is one
   task's work. Pairs of different components are compared exactly. So every pair that shares a bucket is
   compared or already connected.

Classes are the connected components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, prepare, release, table, utf8
from .darts import mix, signatures

SHINGLE = 5
BANDS, ROWS = 20, 4
#: Members compared with a leader by one task, or held in one cell of a bucket; members that stream past them there.
HELD, PASSING = 1024, 8192
#: Shingles whose signatures are computed together.
TOGETHER = 40_000
_FACTOR = np.uint64(0x9E3779B97F4A7C55)


class Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, known: Words) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words has one, of all its words; no words, none."""
    h = np.array([known[w] for w in (text or b"").split()], np.uint64)
    n = len(h) - SHINGLE + 1
    if n < 1:
        if len(h) == 0:
            return h
        total = np.uint64(len(h))
        for x in h:
            total = mix(np.array([total ^ x], np.uint64))[0]
        return np.array([total], np.uint64)
    s = h[:n].copy()
    for i in range(1, SHINGLE):
        s *= _FACTOR
        s += h[i : n + i]
    return np.unique(mix(s))


def fingerprint(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the sets' Jaccard similarity reaches the threshold."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def row_key() -> F.Column:
    """128 bits that stand for a row's doc_id and text."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id", F.lit(1)).alias("b"))


def sketch(df: DataFrame) -> DataFrame:
    """doc_id, rid, node (binary, null without words), n, bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, known = np.array([2 * i + 1 for i in range(ROWS)], np.uint64) * _FACTOR, Words()
        for batch in batches:
            sets, bands, waiting, size = [shingles(t, known) for t in utf8(batch)], [None] * len(batch), [], 0

            def flush() -> None:
                signed = signatures([sets[i] for i in waiting], BANDS * ROWS).reshape(-1, BANDS, ROWS)
                keys = mix((signed * weight).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                for i, k in zip(waiting, keys, strict=True):
                    bands[i] = k

            for i, s in enumerate(sets):
                if len(s):
                    waiting.append(i)
                    size += len(s)
                if waiting and (size >= TOGETHER or i == len(sets) - 1):
                    flush()
                    waiting, size = [], 0
            if waiting:
                flush()
            nodes = [fingerprint(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "rid", "node", "n", "bands"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rid"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, rid struct<a:long,b:long>, node binary, n int, bands array<long>")


def components(links: DataFrame) -> DataFrame:
    """node, label (the component's least node) of all nodes in links (a, b), by alternating large and small stars."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct().checkpoint()
    before = None
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        links = small.unionAll(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = links.select(F.col("b").alias("node")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(roots.select("node", F.col("node").alias("label")))
        before = now


def star_links(edges: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of edges (node, leader), those that reach the threshold, as a, b. A hot leader's members are spread over tasks."""
    fans = edges.groupBy("leader").agg(F.ceil(F.count("*") / HELD).cast("int").alias("salts"))
    salted = edges.join(fans, "leader").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    lead = fans.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    roles = salted.select("leader", "salt", "node", F.lit(1).alias("role")).unionAll(lead.select("leader", "salt", F.col("leader").alias("node"), F.lit(0).alias("role")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in batches:
            a, b = [], []
            for at, node, role, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = np.frombuffer(data, np.uint64)
                if role == 0:
                    leader = s
                elif similar(leader, s, threshold):
                    a.append(node)
                    b.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    together = roles.join(sets, "node").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role")
    return together.select("leader", "node", "role", "shingles").mapInArrow(run, "a binary, b binary")


def rest_links(rows: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links a, b between members of a bucket that labels leaves apart. rows: key, band, node, bands."""
    labelled = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = per_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("m"), F.count("*").alias("labels")).where("labels > 1")
    mixed = mixed.select("key", F.col("top.label").alias("largest"), F.ceil((F.col("m") - F.col("top.n")) / HELD).cast("int").alias("blocks"), F.ceil(F.col("m") / PASSING).cast("int").alias("passes"))
    members = labelled.join(mixed, "key")
    number = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = members.where("label != largest").withColumn("block", number("blocks", 0)).withColumn("pass", every("passes")).withColumn("role", F.lit(0))
    passing = members.withColumn("pass", number("passes", 1)).withColumn("block", every("blocks")).withColumn("role", F.lit(1))
    names = ["key", "block", "pass", "role", "band", "node", "label", "bands"]
    cells = held.select(*names).unionAll(passing.select(*names)).join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parents, nodes, label_of, bands, sizes, data = None, {}, [], [], [], [], []
        stacked = None

        def root(x: bytes) -> bytes:
            while parents.get(x, x) != x:
                x = parents[x]
            return x

        for batch in batches:
            a, b = [], []
            for key, block, turn, role, band, node, label, own, raw in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if cell != (key, block, turn):
                    cell, parents, nodes, label_of, bands, sizes, data, stacked = (key, block, turn), {}, [], [], [], [], [], None
                s = np.frombuffer(raw, np.uint64)
                if role == 0:
                    nodes.append(node)
                    label_of.append(label)
                    bands.append(own)
                    sizes.append(len(s))
                    data.append(s)
                    continue
                if not nodes:
                    continue
                if stacked is None:
                    stacked, lengths = np.array(bands), np.array(sizes)
                # a pair belongs to the first band that it shares
                shared = stacked == np.array(own)
                fits = (shared.argmax(axis=1) == band) & (np.minimum(lengths, len(s)) >= threshold * np.maximum(lengths, len(s)) - 1e-9)
                for i in sorted(np.flatnonzero(fits), key=lambda i: -int(shared[i].sum())):
                    x, y = root(label_of[i]), root(label)
                    if x != y and similar(data[i], s, threshold):
                        parents[x] = y
                        a.append(node)
                        b.append(nodes[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    ordered = cells.repartition("key", "block", "pass").sortWithinPartitions("key", "block", "pass", "role")
    return ordered.select(*names, "shingles").mapInArrow(run, "a binary, b binary")


def near_duplicate_rows(df: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, node of every row; node, class_id, class_size, keeper of every node)."""
    prepare(df.sparkSession)
    base = sketch(df).checkpoint()
    first = F.min(F.struct("doc_id", "rid")).alias("first")
    nodes = base.where("node is not null").groupBy("node").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = nodes.checkpoint()
    exploded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    members = exploded.groupBy("key", "band").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("m > 1")
    # buckets of the same members do once, at the first band
    kept = members.groupBy("who", "m").agg(F.min(F.struct("band", "key")).alias("at")).select("m", F.col("at.band").alias("band"), F.col("at.key").alias("key"))
    rows = exploded.join(kept, ["key", "band"]).join(nodes.select("node", "n", "bands"), "node").checkpoint()

    needed = rows.select("node").distinct().join(nodes.select("node", F.col("first.rid").alias("rid")), "node")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            found = [shingles(t, known).tobytes() for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])

    texts = df.select(row_key().alias("rid"), F.col("text").cast("string").alias("text")).join(needed, "rid").dropDuplicates(["node"])
    sets = texts.select("node", "text").mapInArrow(shingled, "node binary, shingles binary").checkpoint()

    shared = rows.groupBy("node").agg(F.sum("m").alias("shared"))
    led = rows.join(shared, "node").groupBy("key").agg(F.max(F.struct("shared", "node", "n")).alias("top"))
    led = led.select("key", F.col("top.node").alias("leader"), F.col("top.n").alias("leader_n"))
    fits = F.least("n", "leader_n") >= threshold * F.greatest("n", "leader_n") - 1e-9
    edges = rows.join(led, "key").where((F.col("node") != F.col("leader")) & fits).select("node", "leader").distinct()
    stars = star_links(edges, sets, threshold).checkpoint()
    labels = components(stars)
    release(df.sparkSession)  # of the stars' shuffles, before the cells'
    rest = rest_links(rows, labels, sets, threshold).checkpoint()
    release(df.sparkSession)
    if not rest.isEmpty():
        labels = components(stars.unionAll(rest))
    labelled = nodes.join(labels, "node", "left").select("node", "first", "copies", F.coalesce("label", "node").alias("label"))
    classes = labelled.groupBy("label").agg(F.min("first").alias("keeper"), F.sum("copies").alias("class_size"))
    classes = labelled.select("node", "label").join(classes, "label").select("node", F.col("keeper.doc_id").alias("class_id"), "class_size", F.col("keeper.rid").alias("keeper"))
    return base.select("doc_id", "rid", "node"), classes


def near_duplicates(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the class's least doc_id), class_size long: one row for each input row.

    A class is a connected component of texts whose sets of five-word shingles have a Jaccard similarity
    of ``threshold`` or more. Texts with under five words are alike only if all their words are; null
    texts and texts without words are classes of their own. Repeated rows are copies of each other. Null
    doc_ids come first and can be a class_id.
    """
    base, classes = near_duplicate_rows(df, threshold)
    found = base.join(classes, "node", "left")
    alone = F.col("node").isNull()
    return found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the least doc_id; documents without words all stay, repeated ones too."""
    base, classes = near_duplicate_rows(docs)
    keepers = classes.select(F.col("keeper").alias("__rid")).distinct()
    keepers = keepers.unionAll(base.where("node is null").select(F.col("rid").alias("__rid")).distinct())
    alone = F.when(F.coalesce(F.col("text").rlike(WORD), F.lit(False)), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    numbered = docs.withColumn("__rid", row_key()).withColumn("__alone", alone)
    return numbered.join(keepers, "__rid").dropDuplicates(["__rid", "__alone"]).select(*docs.columns)
