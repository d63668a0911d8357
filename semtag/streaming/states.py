"""The current state of every job, kept by a stream over its status events."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.jobs import job_state

#: What a job's changes are told as.
CHANGES = "job_id string, seq long, status string, updated_at timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(at: datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or UTC).timestamp() * 1000)


class JobStates(StatefulProcessor):
    """A job's last event by (updated_at, seq). Events that come late or twice change nothing; ``wait`` (seconds) ends jobs in processing."""

    def __init__(self, wait: float | None = None):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "micros long, seq long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        before = last
        for part in rows:
            told = zip(part["micros"].tolist(), part["seq"].tolist(), part["status"].tolist(), strict=True)
            last = max([*([tuple(last)] if last is not None else []), *told], key=lambda x: x[:2])
        if before is None or tuple(before) != tuple(last):
            self.state.update(tuple(last))
            if self.wait is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if last[2] == "processing":
                    self.handle.registerTimer(int(last[0] / 1000 + self.wait * 1000))
            yield self.row(key, last)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        if last is not None and last[2] == "processing":
            ended = (expiredTimerInfo.getExpiryTimeInMs() * 1000, last[1], "failed")
            self.state.update(ended)
            yield self.row(key, ended)

    def row(self, key: tuple, last: tuple) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "seq": [last[1]], "status": [last[2]], "updated_at": pd.to_datetime([last[0]], unit="us")})

    def close(self) -> None:
        pass


def job_state_changes(events: DataFrame, wait: float | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream of status events (job_id, seq, status, updated_at) to the changes of each job's state.

    State is one row a job, in RocksDB, dealt by job_id. Without ``wait`` it is Spark's streaming aggregate, which combines
    the events of a micro-batch before they are shuffled and runs no Python: write it in ``update`` mode (write_changes
    does); it tells one row a job and micro-batch that has events of the job. ``wait``: seconds after which a job still in
    processing is told as failed, once the events' time, less ``delay``, has passed that; this takes timers, in append mode, and
    tells one row a job and micro-batch in which it changed. A job's current state is its greatest (updated_at, seq) among the changes.
    """
    events.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    timed = events.select(F.col("job_id").cast("string").alias("job_id"), "seq", "status", F.col("updated_at").cast("timestamp").alias("updated_at"))
    if wait is None:
        return job_state(timed)
    keyed = timed.withWatermark("updated_at", delay).withColumn("micros", F.unix_micros("updated_at")).groupBy("job_id")
    return keyed.transformWithStateInPandas(JobStates(wait), CHANGES, "append", "eventTime")


def write_changes(changes: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the changes of job_state_changes, without ``wait``, to ``out/epoch=N``; an epoch that is run again overwrites only its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
