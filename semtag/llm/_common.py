"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import shared_folder

#: A word, as every operator here understands it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch: very long texts must not pile up in one Python worker.
ARROW_ROWS = 1024


def prepare(spark: SparkSession) -> None:
    """Let executors import this package, keep Arrow batches small, name a checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset, on a local master, a
    temporary one is made.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def release(spark: SparkSession) -> None:
    """Let go of frames that nothing names any more, so that Spark removes their shuffle and checkpoint files now, not whenever the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_text(value: Column) -> Column:
    """Unsigned CRC-32 of a value's text in UTF-8, of the empty text for null."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def fold_of(doc_id: Column, modulus: int) -> Column:
    return F.pmod(crc32_text(doc_id), F.lit(modulus))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add; names match as Spark matches them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def append_columns(df: DataFrame, fields: str, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """df with the columns of ``fields`` ("name type, ..."), computed batch by batch.

    ``make()`` runs once in a task and gives a function from a batch to one sequence of values for each
    field. Input columns of the added names are replaced; all others pass through as they are.
    """
    prepare(df.sparkSession)
    added = T.StructType.fromDDL(fields)
    df = without(df, *added.names)
    kinds = to_arrow_schema(added).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            new = [pa.array(v, k) for v, k in zip(compute(batch), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column's values as UTF-8."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
