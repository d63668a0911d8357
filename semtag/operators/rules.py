"""Annotators without a model: value patterns for columns, term lists for texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .vocab import STI_TO_COARSE

#: Patterns in order of precedence; ASCII, without look-around, so that other engines read them alike.
PATTERNS = [
    ("ext:uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("ext:email", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"),
    ("ext:ipv4", r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"),
    ("ext:ipv6", r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"),
    ("ext:url", r"^https?://\S+$"),
    ("ext:duration", r"^P([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T[0-9HMS.]+)?$"),
    ("xsd:dateTime", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"),
    ("xsd:date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("ext:percentage", r"^[+-]?[0-9]+(\.[0-9]+)? ?%$"),
    ("xsd:boolean", r"^(true|false)$"),
    ("xsd:integer", r"^[+-]?[0-9]+$"),
    ("xsd:decimal", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"),
    ("ext:phone", r"^(\+[0-9][0-9 ()-]{6,}|[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,5})$"),
    ("xsd:anyURI", r"^[a-z][a-z0-9+.-]*:\S+$"),
]
#: Column names that tell a type which values alone don't.
HEADERS = [
    ("ext:lat", ["lat", "latitude"]),
    ("ext:lon", ["lon", "lng", "longitude"]),
    ("ext:postalCode", ["postal_code", "postcode", "zip", "zip_code"]),
    ("ext:countryCode", ["country_code"]),
    ("ext:currencyCode", ["currency", "currency_code"]),
]


#: What every value that any pattern fits has; most values don't, and need no pattern tried.
_ANY = r"[0-9@:-]|^P|^true$|^false$"


def cell_type(column: Column, value: Column) -> Column:
    """The first type whose header and pattern fit a trimmed value, else LIT:STRING."""
    found = F.when(F.lit(False), F.lit(""))
    for t, names in HEADERS:
        found = found.when(F.lower(column).isin(names), t)
    found = found.when(~value.rlike(_ANY), "LIT:STRING")
    for t, pattern in PATTERNS:
        found = found.when(value.rlike(pattern), t)
    return found.otherwise("LIT:STRING")


def profile_columns(cells: DataFrame) -> DataFrame:
    """table_id, column, type_id, confidence, coarse_type_id from cells (table_id, column, value): one shuffle of counts."""
    trimmed = cells.select("table_id", "column", strip(F.col("value")).alias("value")).where("value is not null")
    counts = trimmed.groupBy("table_id", "column", cell_type(F.col("column"), F.col("value")).alias("t")).agg(F.count("*").alias("n"))
    return _best_types(counts)


def _best_types(counts: DataFrame) -> DataFrame:
    """table_id, column, t, n -> the most frequent type of each column, ties to the earlier type, with its share."""
    order = F.array_position(F.array(*map(F.lit, STI_TO_COARSE)), F.col("t"))
    best = counts.groupBy("table_id", "column").agg(F.max(F.struct("n", (-order).alias("o"), "t")).alias("b"), F.sum("n").alias("all"))
    coarse = F.create_map(*[F.lit(x) for kv in STI_TO_COARSE.items() for x in kv])
    return best.select("table_id", "column", F.col("b.t").alias("type_id"), (F.col("b.n") / F.col("all")).alias("confidence"), F.try_element_at(coarse, F.col("b.t")).alias("coarse_type_id"))


def profile_wide(df: DataFrame, table_id: str, columns: list[str] | None = None, chunk: int = 16) -> DataFrame:
    """What profile_columns tells, of the columns of one wide table, without making cells.

    One aggregation of a count for each column and type, ``chunk`` columns a pass over the table: a row leaves a task
    for each chunk, whatever the table's size. Columns are cast to text; a column of nulls has no type and no row.
    """
    columns = df.columns if columns is None else columns
    types = [*[t for t, _ in HEADERS], *[t for t, _ in PATTERNS], "LIT:STRING"]
    parts = []
    for i in range(0, len(columns), chunk):
        some = columns[i : i + chunk]
        text = df.select(*[strip(F.col(f"`{c}`").cast("string")).alias(f"v{k}") for k, c in enumerate(some)])
        typed = text.select(*[F.when(F.col(f"v{k}").isNotNull(), cell_type(F.lit(c), F.col(f"v{k}"))).alias(f"t{k}") for k, c in enumerate(some)])
        counted = typed.agg(*[F.count_if(F.col(f"t{k}") == t).alias(f"n{k}_{j}") for k in range(len(some)) for j, t in enumerate(types)])
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("t"), F.col(f"n{k}_{j}").alias("n")) for k, c in enumerate(some) for j, t in enumerate(types)])
        parts.append(counted.select(F.explode(rows).alias("r")).select(F.lit(table_id).alias("table_id"), "r.*").where("n > 0"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return _best_types(out)


def unpivot_cells(df: DataFrame, table_id: str, columns: list[str]) -> DataFrame:
    """A wide table's columns as cells (table_id, column, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(F.lit(table_id).alias("table_id"), cells.alias("c")).select("table_id", "c.column", "c.value")


def token_spans(docs: DataFrame, id_col: str, text_col: str, wanted: frozenset[str] | None = None, lengths: tuple[int, ...] = (1,)) -> DataFrame:
    """id, start, end, text of every run of space-separated tokens of the ``lengths``, or of the runs ``wanted``, in one pass over each text. Offsets are code points.

    With ``wanted``, a token is looked up among the terms' first ones, which tells the lengths to try there: overlapping runs are all found.
    """
    heads: dict[str, list[int]] = {}
    for term in wanted or ():
        parts = term.split(" ")
        heads.setdefault(parts[0], []).append(len(parts))
    heads = {head: sorted(set(sizes)) for head, sizes in heads.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, found = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                tokens, at = text.split(" "), 0
                for k, token in enumerate(tokens):
                    for size in lengths if wanted is None else heads.get(token, ()):
                        if k + size <= len(tokens):
                            run_text = token if size == 1 else " ".join(tokens[k : k + size])
                            if wanted is None or run_text in wanted:
                                rows.append(i)
                                starts.append(at)
                                found.append(run_text)
                    at += len(token) + 1
            ends = [s + len(t) for s, t in zip(starts, found, strict=True)]
            ids = batch.column(0).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string())], names=[id_col, "start", "end", "text"])

    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL("start int, end int, text string").fields])
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def match_gazetteer(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_terms: int = 100_000, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """id, start, end, text, type_id, score of every run of space-separated tokens that is a term. Offsets are code points.

    A term may have several tokens, with single spaces between; terms that overlap are all found. While there are at most
    ``broadcast_terms`` of at most ``broadcast_bytes``, the terms go to every task, and only hits leave it; more are met in a
    join of all runs of the terms' lengths. A term with several types gives a row for each.
    """
    held = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes"), F.collect_set(F.size(F.split("term", " "))).alias("lengths")).first()
    small = held["n"] <= broadcast_terms and held["bytes"] <= broadcast_bytes
    wanted = frozenset(r["term"] for r in terms.where("term is not null").select("term").distinct().collect()) if small else None
    spans = token_spans(docs, id_col, text_col, wanted, tuple(sorted(n for n in held["lengths"] if n > 0)))
    return spans.join(F.broadcast(terms) if small else terms, spans["text"] == terms["term"]).select(id_col, "start", "end", "text", "type_id", F.lit(1.0).alias("score"))
