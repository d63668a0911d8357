"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's quota is a number of words. What it exceeds the source's own words by is a second pass, so a
pass never takes a word twice. The words of a source lie in leaves, dealt by a seeded hash of the
document, with power-of-two many leaves, so that one holds few documents. A pass's quota goes down a
binary tree: at each node the left half gets a hypergeometric draw (as many as would fall there if that
many words were drawn from the node without replacement) and the right half the rest, so the leaves'
quotas add up exactly. In a leaf, documents are permuted by a second hash and taken until the quota is
used up; the last one is taken in part. Each leaf is an output shard, of bounded size, shuffled inside by a
third hash, which takes in the pass and knows nothing of the draw.

Everything is built-in expressions. Draws come from hashes of seed, source and node: reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import prepare, table, without, word_count

#: Candidates of one hypergeometric draw; levels of the tree that one row holds.
TRIES, MOST_BITS = 32, 10


def log_ratio(a: str, b: str) -> str:
    """SQL for ln(a! / b!) of whole numbers up to 2^52.

    Stirling's series at a + 8 and b + 8, led back, written in the difference: no large terms are subtracted, so
    the error grows with |a - b| only, about 1e-15 for each.
    """
    series = lambda y: f"1 / (12 * {y}) - 1 / (360 * {y} * {y} * {y}) + 1 / (1260 * {y} * {y} * {y} * {y} * {y})"
    down = lambda x: " + ".join(f"ln(({x} + {i}) * ({x} + {i + 1}) * ({x} + {i + 2}) * ({x} + {i + 3}))" for i in (1, 5))
    led = f"({a} - {b}) * ln({a} + 8) - ({a} - {b}) + ({b} + 8.5D) * log1p(({a} - {b}) / ({b} + 8))"
    return f"({led} + ({series(f'({a} + 8)')}) - ({series(f'({b} + 8)')}) - ({down(a)}) + {down(b)})"


def log_chance(x: str) -> str:
    """SQL for the logarithm of a value's hypergeometric probability over that of __mode."""
    parts = lambda v: (v, f"(__k - {v})", f"(__n - {v})", f"(__m - __k - __n + {v})")
    return "-(" + " + ".join(log_ratio(a, b) for a, b in zip(parts(x), parts("__mode"), strict=True)) + ")"


def hypergeometric(df: DataFrame, name: str, drawn: str, inside: str, total: str, seeds: str) -> DataFrame:
    """df with ``name``: how many of ``drawn`` out of ``total`` fall among ``inside``; all are columns of whole numbers.

    By ratio of uniforms, exact but for rounding (log_ratio): candidates centre + scale * v / u, the first with u * u at most its
    probability relative to the mode's. Of TRIES candidates, each accepted with a probability over 0.6,
    none is with a probability below 1e-12; then it is the mode.
    """
    uniform = lambda which: f"((pmod(xxhash64({seeds}, i, {which}), 4503599627370496) + 0.5D) / 4503599627370496D)"
    keep = list(df.columns)
    df = df.selectExpr("*", f"double({drawn}) as __n", f"double({inside}) as __k", f"double({total}) as __m")
    df = df.selectExpr(
        "*",
        "greatest(0D, __n + __k - __m) as __low",
        "least(__n, __k) as __high",
        "double(floor((__n + 1) * (__k + 1) / (__m + 2))) as __middle",
        "__n * __k / greatest(__m, 1D) + 0.5D as __centre",
        "1.7155277699214135D * sqrt(greatest(__n * __k / greatest(__m, 1D) * (1 - __k / greatest(__m, 1D)) * (__m - __n) / greatest(__m - 1, 1D), 0D) + 0.5D) + 0.8989161620588988D as __scale",
    )
    df = df.selectExpr("*", "least(greatest(__middle, __low), __high) as __mode")
    draws = f"transform(sequence(1, {TRIES}), i -> named_struct('u', {uniform(0)}, 'v', {uniform(1)}))"
    values = f"transform({draws}, t -> named_struct('x', double(floor(__centre + __scale * (t.v - 0.5D) / t.u)), 'l', 2 * ln(t.u)))"
    df = df.selectExpr("*", f"filter({values}, t -> t.x >= __low and t.x <= __high) as __tries")
    found = f"try_element_at(filter(__tries, t -> t.l <= {log_chance('t.x')}), 1).x"
    return df.selectExpr(*keep, f"bigint(coalesce({found}, __mode)) as {name}")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """source, source_size -> also ``target``: ``share`` of all sizes by weight, at most ``cap`` times a size.

    Weights repeat over the sources by code point, null last. What a cap cuts off is shared by weight
    again until none is above: all uncapped sources end at one level per weight, which is found by
    going through the sources in the order in which a rising level would cap them. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    limit = F.col("source_size") * F.lit(cap)
    rated = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    by_limit = Window.orderBy(limit / F.col("w"), F.col("source").asc_nulls_last())
    upto, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(limit).over(upto), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0))
    )
    found = rated.withColumn("level", level).withColumn("capped", limit / F.col("w") < F.col("level"))
    # the level that holds is that of the first source that it doesn't cap
    final = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.coalesce(F.least(limit, final * F.col("w")), limit)
    return found.select("source", "source_size", target.cast("double").alias("target"))


def descend(tree: DataFrame, below: DataFrame, done: int, bits: int, seed: int) -> DataFrame:
    """tree (a row for each source and node of level ``done``, with its quota) taken down ``bits`` levels.

    below: source, at, words of the nodes ``bits`` levels further down; those without words may lack. A node's row
    holds the words of its 2^bits descendants, a bounded number.
    """
    plain, width = ["source", "source_size", "target", "whole"], 1 << bits
    empty = tree.select("source", F.explode(F.sequence(F.col("node") * width, F.col("node") * width + width - 1)).alias("at"), F.lit(0).cast("long").alias("words"))
    filled = below.select("source", "at", "words").unionAll(empty).groupBy("source", "at").agg(F.sum("words").alias("words"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])
    arrays = filled.groupBy("source", F.shiftright("at", bits).alias("node")).agg(listed.alias("words")).select(F.col("source").alias("__s"), F.col("node").alias("__n"), "words")
    tree = tree.join(arrays, tree["source"].eqNullSafe(F.col("__s")) & (F.col("node") == F.col("__n"))).select(*plain, "node", "words", "quota")
    total = lambda a: f"aggregate({a}, 0L, (x, y) -> x + y)"
    for level in range(done, done + bits):
        half = width >> (level - done + 1)
        parts = tree.selectExpr(*plain, "node", "quota", f"slice(words, 1, {half}) as left", f"slice(words, {half + 1}, {half}) as right")
        parts = parts.selectExpr("*", f"{total('left')} as k", f"{total('left')} + {total('right')} as m")
        parts = hypergeometric(parts, "to_left", "quota", "k", "m", f"source, node, {level}, {seed}")
        sides = "inline(array(struct(node * 2 as node, left as words, to_left as quota), struct(node * 2 + 1 as node, right as words, quota - to_left as quota)))"
        tree = parts.selectExpr(*plain, sides)
    return tree.drop("words")


def pass_order(mix_order: Column, again: Column) -> Column:
    """Where a document's pass lies in its shard: ``mix_order`` for the first time that it is taken, a new hash of it when again."""
    return F.when(again == 0, mix_order).otherwise(F.xxhash64(mix_order, again))


def mix_sources(df: DataFrame, seed: int = 5, leaf_rows: int = 1024, least_depth: int = 4) -> DataFrame:
    """doc columns with size, source_size, target, taken, ``mix_shard`` int and ``mix_order`` long: a sort key
    of its shard, independent of the draw. A document's second pass lies at ``pass_order(mix_order, 1)``.

    One row for each input row, also where nothing is taken. Null text: size 0, nothing taken. Null
    sources are one source, the last. Rows alike in doc_id, source and text are told apart by nothing,
    and take in any order. No row takes over twice its size; a source's words taken are its target
    rounded. Input columns of the added names are replaced.
    """
    prepare(df.sparkSession)
    added = ["size", "source_size", "target", "taken", "mix_shard", "mix_order"]
    df = without(df, *added)
    sized = df.withColumn("size", word_count(F.col("text")))
    depth = max(math.ceil(math.log2(max(1, df.count() / leaf_rows))), least_depth)
    leaves = 1 << depth
    tie = F.xxhash64("doc_id", "text", F.lit(seed))
    slim = sized.withColumn("__draw", tie).withColumn("mix_order", F.xxhash64(tie, F.lit(seed + 3))).withColumn("__leaf", F.pmod(F.xxhash64(tie, F.lit(seed + 1)), F.lit(leaves)).cast("int"))

    counts = slim.groupBy("source", "__leaf").agg(F.sum("size").alias("words")).checkpoint()  # targets and every level of the tree read it
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = F.round("target").cast("long")
    second = F.when(goal > F.col("source_size"), goal - F.col("source_size")).otherwise(goal)
    tree = targets.select("source", "source_size", "target", (goal > F.col("source_size")).cast("long").alias("whole"), F.lit(0).cast("long").alias("node"), second.alias("quota"))
    rounds = -(-depth // MOST_BITS)
    bits = [depth * (i + 1) // rounds - depth * i // rounds for i in range(rounds)]
    for i, more in enumerate(bits):
        done = sum(bits[:i])
        below = counts.groupBy("source", F.shiftright(F.col("__leaf").cast("long"), depth - done - more).alias("at")).agg(F.sum("words").alias("words"))
        tree = descend(tree, below, done, more, seed + 2)
    quotas = tree.select(F.col("source").alias("__s"), F.col("node").alias("__n"), "source_size", "target", "whole", "quota")

    joined = slim.join(quotas, slim["source"].eqNullSafe(F.col("__s")) & (F.col("__leaf") == F.col("__n")))
    before = Window.partitionBy("source", "__leaf").orderBy("__draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("quota") - F.coalesce(F.sum("size").over(before), F.lit(0))
    again = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), room))
    return joined.withColumn("__again", again).select(
        *[F.col(f"`{c}`") for c in df.columns],
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("whole") + F.col("__again")).alias("taken"),
        F.col("__leaf").alias("mix_shard"),
        "mix_order",
    )


def op5_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "mix_shard", "mix_order")


def first_words(text: Column, n: Column) -> Column:
    """A text cut after its n-th word, n >= 1, white space before and between words as it was."""
    spaced = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(spaced, F.lit(1), n.cast("int")), "")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as documents: a row for each whole pass over a document, and one cut after its last word taken."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")}
    mixed = mix_sources(docs.withColumnsRenamed(names))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    copies = F.transform(F.sequence(F.lit(0), whole), lambda i: F.when(i < whole, F.col("size")).otherwise(F.col("taken") - whole * F.col("size")))
    rows = mixed.select("*", F.posexplode(copies).alias("__pass", "__words")).where("__words > 0")
    rows = rows.withColumn("mix_order", pass_order(F.col("mix_order"), F.col("__pass")))
    text = F.when(F.col("__words") == F.col("size"), F.col("text")).otherwise(first_words(F.col("text"), F.col("__words")))
    values = {"text": text}
    if "n_chars" in names:
        values[names["n_chars"]] = F.when(F.col("__words") == F.col("size"), F.col(names["n_chars"])).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    rows = rows.select(*[values.get(names.get(c, c), F.col(names.get(c, c))).alias(c) for c in docs.columns], "mix_shard", "mix_order", "__words")
    return rows.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order", F.desc("__words")).select(*docs.columns)
