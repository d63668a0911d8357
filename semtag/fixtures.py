"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.vocab import COARSE

#: Score of the i-th coarse type (from 0) for a document, in tenths; gives many ties.
TENTHS = "cast((doc_id * 7 + {i} * 13) % 11 as int)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text tasks; a job is a source."""
    order = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), order.cast("long").alias("ord"), F.col("doc_id").cast("string").alias("task_id"), "text")


def turn_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as short text tasks of eight jobs."""
    job = (F.col("conv_id") % 8).cast("string")
    order = F.row_number().over(Window.partitionBy(job).orderBy("conv_id", "turn"))
    return table(spark, sf_dir, "conversations").select(job.alias("job_id"), order.cast("long").alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("task_id"), "text")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        F.expr("element_at(array('ner', 'tabular', 'other'), cast(event_id % 3 as int) + 1)").alias("endpoint_type"),
        F.expr("element_at(array('coarse', 'fine', 'sti', 'dpv', 'nope'), cast(event_id % 5 as int) + 1)").alias("schema"),
        F.expr("cast(event_id % 4 as int)").alias("n_tasks"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status log: a job is a user."""
    status = "case event_type when 'signup' then 'queued' when 'view' then 'processing' when 'purchase' then 'completed' when 'error' then 'failed' else 'queued' end"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        F.expr(status).alias("status"),
        F.col("ts").cast("timestamp").alias("updated_at"),
        F.concat(F.lit("result-"), "event_id").alias("result"),
        F.concat(F.lit("error-"), "event_id").alias("error"),
    )


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of one table a nation; odd rows lack a key."""
    row = F.create_map(F.lit("c_custkey"), F.col("c_custkey").cast("string"), F.lit("c_name"), F.col("c_name"), F.lit("c_mktsegment"), F.col("c_mktsegment"))
    part = F.when(F.col("c_custkey") % 2 == 1, F.map_filter(row, lambda k, _: k != "c_mktsegment")).otherwise(row)
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("nation"), "c_nationkey").alias("table_id"), F.col("c_custkey").alias("row_id"), part.alias("row"))


def coarse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, scores: the document's score of every coarse type."""
    pairs = ", ".join(f"'{t}', {TENTHS.format(i=i)} / 10D" for i, t in enumerate(COARSE))
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(f"map({pairs})").alias("scores"))


def big_vocabulary(spark: SparkSession, sf_dir: str) -> list[str]:
    """Sorted ids made of all part names and brands; their number does not grow with the table."""
    named = table(spark, sf_dir, "part").select(F.expr("concat('V:', replace(p_name, ' ', '_'), '#', p_brand)").alias("t")).distinct()
    return sorted(r["t"] for r in named.collect())


def names_vocabulary(spark: SparkSession, sf_dir: str) -> list[str]:
    named = table(spark, sf_dir, "part").select(F.expr("concat('dpv:', replace(p_name, ' ', '_'))").alias("t")).distinct()
    return sorted(r["t"] for r in named.collect())


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three collected replies for each batch of five documents, some of them at fault by batch number.

    job_id, batch_id, attempt, raw_text. The one entity of a document is its first ASCII word.
    """
    tenths = lambda n: f"concat(cast({n} div 10 as string), '.', cast({n} % 10 as string))"
    scores = "concat('{', " + ", ', ', ".join(f"""'"{t}": ', {tenths(TENTHS.format(i=i))}""" for i, t in enumerate(COARSE)) + """, if(fault = 5, ', "NER:NONE": 1.0', ''), '}')"""
    base = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "doc_id div 5 as batch_id", "regexp_extract(text, '[A-Za-z]+', 0) as word", "explode(array(0, 1, 2)) as attempt")
    base = base.selectExpr("*", "case when attempt = 0 then cast(batch_id % 8 as int) when attempt = 1 and batch_id % 16 = 0 then 5 when attempt = 2 and batch_id % 32 = 0 then 5 else 7 end as fault")
    base = base.selectExpr("*", "instr(text, word) - 1 as start")
    base = base.selectExpr(
        "*",
        "case when fault = 4 then start else start + length(word) + if(fault = 2, 1000000, 0) end as stop",
        "case when fault = 3 then concat(word, 'x') else word end as said",
        f"{scores} as scores",
    )
    entity = """concat('{"start": ', start, ', "end": ', stop, ', "text": "', said, '", "scores": ', scores, '}')"""
    base = base.selectExpr("*", f"""concat('{{"task_id": "', if(fault = 1 and doc_id % 5 = 0, 'who', cast(doc_id as string)), '", "entities": [', if(word = '', '', {entity}), ']}}') as task""")
    base = base.where("not (fault = 0 and doc_id % 5 = 0)")
    grouped = base.groupBy("batch_id", "attempt", "fault").agg(F.expr("array_join(transform(array_sort(collect_list(struct(doc_id, task))), x -> x.task), ', ')").alias("body"))
    return grouped.selectExpr("concat('job', batch_id % 20) as job_id", "batch_id", "attempt", "case when fault = 6 then 'Sorry, I can not.' else concat('Here you are: [', body, '] Anything else?') end as raw_text")


def reply_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches that the replies belong to: job_id, batch_id, tasks."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id div 5 as batch_id", "doc_id as ord", "cast(doc_id as string) as task_id", "text")
    listed = F.array_sort(F.collect_list(F.struct("ord", "task_id", "text")))
    return docs.groupBy("batch_id").agg(listed.alias("tasks")).selectExpr("concat('job', batch_id % 20) as job_id", "batch_id", "tasks")


def jsonld_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of JSON-LD files (path, doc), with every form of id and label, and files to reject."""
    iri = """case p_partkey % 6 when 0 then concat('https://w3id.org/dpv#T', p_partkey div 2) when 1 then concat('https://w3id.org/dpv/pd#T', p_partkey div 2)
        when 2 then concat('https://w3id.org/dpv/#T', p_partkey div 2) when 3 then concat('http://w3id.org/dpv/legal/eu#T', p_partkey) when 4 then concat('_:b', p_partkey) else concat('https://example.org/x#T', p_partkey) end"""
    label = """case p_partkey % 4
        when 0 then concat('"http://www.w3.org/2004/02/skos/core#prefLabel": [{"@language": "fr", "@value": "le ', p_name, '"}, {"@language": "en", "@value": "', p_name, '"}], ')
        when 1 then concat('"http://www.w3.org/2000/01/rdf-schema#label": [{"@language": "fr", "@value": "le ', p_name, '"}], ')
        when 2 then concat('"http://www.w3.org/2000/01/rdf-schema#label": {"@value": "', p_name, '"}, ') else '' end"""
    path = "concat(element_at(array('2.2/a', '2.2/b', '2.2/c-owl', '2.1/d', '2.2/e', '2.2/f', '2.2/g'), cast(p_partkey % 7 as int) + 1), lpad(p_partkey div 100, 9, '0'), if(p_partkey % 7 = 5, '.ttl', '.jsonld'))"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{path} as path", f"""concat('{{', {label}, '"@id": "', {iri}, '"}}') as entry""")
    grouped = rows.groupBy("path").agg(F.expr("array_join(transform(array_sort(collect_list(struct(p_partkey, entry))), x -> x.entry), ', ')").alias("body"))
    return grouped.selectExpr("path", "if(path like '2.2/e%', concat('{\"@graph\": [', body, ']}'), concat('[', body, ']')) as doc")
