"""Greedy batches of tasks and of vocabulary types."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import use_shared_folder


def greedy_batches(sizes: np.ndarray, max_tasks: int, max_chars: int) -> np.ndarray:
    """Batch numbers of sizes in order: a batch closes when one more would break a limit; an oversized task is alone."""
    ends, out, start, batch = np.cumsum(sizes), np.empty(len(sizes), np.int64), 0, 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + max_tasks, int(np.searchsorted(ends, before + max_chars, side="right"))))
        out[start:stop] = batch
        start, batch = stop, batch + 1
    return out


def entries(runs: list[dict], max_tasks: int, max_chars: int) -> dict[int, tuple[int, int]]:
    """From the summaries of first and last runs, in order: part -> (tasks of its first run that go on with a batch begun before, that run's first own batch)."""
    out: dict[int, tuple[int, int]] = {}
    key, count, chars, batches = None, 0, 0, 0
    for run in runs:
        if (run["job_id"], run["shard"]) != key:
            key, count, chars, batches = (run["job_id"], run["shard"]), 0, 0, 0
        taken = 0
        while count and taken < len(run["head"]) and count < max_tasks and chars + run["head"][taken] <= max_chars:
            count, chars, taken = count + 1, chars + run["head"][taken], taken + 1
        if run["first"]:
            out[run["part"]] = (taken, batches)
        if taken < run["tasks"]:
            batches, count, chars = batches + run["batches"][taken], run["last_tasks"][taken], run["last_chars"][taken]
    return out


def pack_batches(tasks: DataFrame, max_tasks: int = 10, max_chars: int = 12_000, shard_tasks: int | None = None) -> DataFrame:
    """job_id, ord, shard, batch from tasks with job_id, ord, size, greedily in order of ord.

    A job of any size is packed in parallel and exactly: tasks are dealt by ranges of (job, ord). A batch that
    goes on into the next range takes fewer than ``max_tasks`` tasks there, so each range tells for each such
    entry how many batches follow and how full the last is; these few figures of the runs at a range's ends
    are put together, and then each range numbers its batches. ``shard_tasks`` cuts a long job into runs of
    that many tasks, each with batches of its own. Carry no text: sizes are enough.
    """
    spark = tasks.sparkSession
    use_shared_folder(spark)
    shard = (F.col("ord") / shard_tasks).cast("long") if shard_tasks else F.lit(0).cast("long")
    slim = tasks.select("job_id", F.col("ord").cast("long").alias("ord"), F.col("size").cast("long").alias("size"), shard.alias("shard"))
    keys = ["job_id", "shard", "ord", "size"]
    dealt = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).checkpoint()
    job = slim.schema["job_id"]

    def whole(batches: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame | None, list[tuple[int, int]]]:
        """A part's rows, and where its runs lie: the tasks of one job and shard, which lie together."""
        parts = [b for b in batches if len(b)]
        if not parts:
            return None, []
        rows = pd.concat(parts, ignore_index=True)
        ids = pd.factorize(rows["job_id"], use_na_sentinel=False)[0]
        starts = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(rows["shard"].to_numpy()) != 0)])
        return rows, list(zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True))

    def summary(run: pd.DataFrame, first: bool) -> dict:
        sizes = run["size"].to_numpy()
        n, ends = len(sizes), np.r_[0, np.cumsum(sizes)]
        at = np.arange(n)
        stops = np.maximum(at + 1, np.minimum(at + max_tasks, np.searchsorted(ends, ends[:-1] + max_chars, side="right") - 1))
        count, last = np.ones(n, np.int64), at.copy()
        for i in range(n - 1, -1, -1):
            if stops[i] < n:
                count[i], last[i] = count[stops[i]] + 1, last[stops[i]]
        head = slice(0, max_tasks)
        return {"job_id": run["job_id"].iloc[0], "shard": run["shard"].iloc[0], "part": run["part"].iloc[0], "first": first, "tasks": n, "head": sizes[head].tolist(), "batches": count[head].tolist(), "last_tasks": (n - last)[head].tolist(), "last_chars": (ends[n] - ends[last])[head].tolist()}

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, runs = whole(batches)
        if runs:
            yield pd.DataFrame([summary(rows.iloc[slice(*run)], i == 0) for i, run in enumerate([runs[0], *runs[1:][-1:]])])

    fields = T.StructType([job, *T.StructType.fromDDL("shard long, part int, first boolean, tasks long, head array<long>, batches array<long>, last_tasks array<long>, last_chars array<long>").fields])
    found = dealt.mapInPandas(summarise, fields).collect()
    entry = entries([r.asDict() for r in sorted(found, key=lambda r: (r["part"], not r["first"]))], max_tasks, max_chars)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, runs = whole(batches)
        if runs:
            sizes, numbers = rows["size"].to_numpy(), np.empty(len(rows), np.int64)
            for k, (start, stop) in enumerate(runs):
                taken, base = entry[int(rows["part"].iloc[0])] if k == 0 else (0, 0)
                numbers[start : start + taken] = base - 1
                numbers[start + taken : stop] = greedy_batches(sizes[start + taken : stop], max_tasks, max_chars) + base
            yield rows.drop(columns="part").assign(batch=numbers)

    return dealt.mapInPandas(pack, T.StructType([*slim.schema.fields, T.StructField("batch", T.LongType())]))


def table_task_sizes(tasks: DataFrame) -> DataFrame:
    """Table tasks with ``size``: the length of the whole task as ASCII JSON, from ``sampled_rows_json``."""

    @F.pandas_udf("long")
    def size(task: pd.Series, table: pd.Series, rows: pd.Series) -> pd.Series:
        dump = lambda a, b, c: len(json.dumps({"task_id": a, "table_id": b, "sampled_rows": json.loads(c)}))
        return pd.Series([dump(*x) for x in zip(task, table, rows, strict=True)])

    return tasks.withColumn("size", size("task_id", "table_id", "sampled_rows_json"))


def greedy_shards(lengths: np.ndarray, overhead: int, max_chars: int) -> np.ndarray:
    """Shard numbers of type ids: the prompt is overhead + ids + two characters between ids; a shard's first id always fits."""
    return greedy_batches(lengths + 2, len(lengths) or 1, max_chars - overhead + 2)


def shard_types(overheads: DataFrame, types: list[str], max_chars: int = 12_000) -> DataFrame:
    """overhead, shard, n_types, first_type, type_ids for each distinct prompt overhead.

    Shards depend on a batch only through its overhead, so they are found once for each. ``too_long``
    marks overheads that leave room for nothing: every id is then a shard of its own.
    """
    lengths = np.array([len(t) for t in types])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for overhead in batch["overhead"]:
                shards = greedy_shards(lengths, overhead, max_chars)
                for s in range(int(shards[-1]) + 1 if len(shards) else 0):
                    ids = [types[i] for i in np.flatnonzero(shards == s)]
                    rows.append((overhead, s, len(ids), ids[0], ids, bool(overhead >= max_chars)))
            yield pd.DataFrame(rows, columns=["overhead", "shard", "n_types", "first_type", "type_ids", "too_long"])

    return overheads.select(F.col("overhead").cast("long")).distinct().mapInPandas(pack, "overhead long, shard int, n_types int, first_type string, type_ids array<string>, too_long boolean")
