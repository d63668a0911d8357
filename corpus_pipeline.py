"""A corpus pipeline of five stages; each reads what the stage before it wrote.

Language ID drops documents whose language it can't tell, quality rules drop what they reject, near-duplicate
detection keeps one document of each class, mixing repeats and cuts documents to the sources' targets,
packing lays the rest out as token sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from semtag.llm.langid import language_stage
from semtag.llm.mixing import mixing_stage
from semtag.llm.neardup import near_duplicate_stage
from semtag.llm.packing import pack_documents
from semtag.llm.quality import quality_stage
from semtag.sources.shared import shared_folder

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Trained networks, hashed signatures and draws: SQL can't express the stages; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet in the shared folder and read again; only the last one's stays there."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:  # nothing reads what the stage before wrote any more
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{i - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
