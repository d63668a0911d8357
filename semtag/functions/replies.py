"""Strict parsing of model replies.

What expressions over variants can prove valid stays in the JVM. Only the other rows, faulty ones and those that
lax rules may still allow, go to a strict parser in Python workers.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scores import let

ITEM = "struct<start:int,end:int,text:string,column:string,scores:map<string,double>>"
PARSED = f"struct<error_code:string,error_detail:string,tasks:array<struct<task_id:string,table_id:string,items:array<{ITEM}>>>>"
#: An escaped half of a surrogate pair without the other half.
HALVES = r"(?i)\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f])|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f]"
SELECTED = "struct<error_code:string,error_detail:string,items:array<string>>"


class Invalid(ValueError):
    def __init__(self, code: str, detail: str):
        super().__init__(detail)
        self.code = code


def first_json(text: str | None) -> object:
    """The value that starts at the first bracket or brace; what follows it is ignored, a repeated key keeps its last value."""
    text = (text or "").strip()
    if not text:
        raise Invalid("empty_response", "the response is empty")
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        raise Invalid("no_json", "no JSON object or array found")
    try:
        return json.JSONDecoder().raw_decode(text[min(starts) :])[0]
    except (ValueError, RecursionError) as e:
        raise Invalid("bad_json", str(e)) from e


def whole(text: str) -> str:
    """A text with halves of surrogate pairs, which UTF-8 can't hold, replaced by U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _field(row: object, name: str, kind: type) -> object:
    """A required field, numbers also from numeric text and booleans, whole numbers also from whole floats."""
    if not isinstance(row, dict) or name not in row:
        raise Invalid("bad_shape", f"missing {name}")
    return _value(row[name], name, kind)


def _value(value: object, name: str, kind: type) -> object:
    if kind in (str, list, dict):
        if not isinstance(value, kind):
            raise Invalid("bad_shape", f"{whole(name)} has the wrong type")
        return whole(value) if kind is str else value
    if isinstance(value, (int, float, str)):
        try:
            number = float(value) if kind is float or not isinstance(value, (int, bool)) else int(value)
        except (ValueError, OverflowError) as e:
            raise Invalid("bad_shape", f"{name} is no number") from e
        if kind is float:
            if not math.isfinite(number):
                raise Invalid("non_finite_score", f"{name} is not finite")
            return number
        if number == int(number) if math.isfinite(number) else False:
            if abs(number) < 2**31:
                return int(number)
    raise Invalid("bad_shape", f"{name} is no number")


def _scores(row: dict) -> list[tuple[str, float]]:
    return [(whole(k), _value(v, f"score of {whole(k)}", float)) for k, v in _field(row, "scores", dict).items()]


def parse_tasks(text: str | None, tables: bool) -> list[dict]:
    root = _value(first_json(text), "the reply", list)
    out = []
    for task in root:
        task_id = _field(task, "task_id", str)
        if tables:
            table_id = _field(task, "table_id", str)
            items = [(None, None, None, _field(c, "column", str), _scores(c)) for c in _field(task, "columns", list)]
        else:
            table_id = None
            items = [(_field(e, "start", int), _field(e, "end", int), _field(e, "text", str), None, _scores(e)) for e in _field(task, "entities", list)]
        out.append({"task_id": task_id, "table_id": table_id, "items": [dict(zip(("start", "end", "text", "column", "scores"), i, strict=True)) for i in items]})
    return out


def _parse(df: DataFrame, raw: str, name: str, kind: str, fields: list[str], parse: Callable[[str | None], object], proven: Column | None = None) -> DataFrame:
    """df with a struct column ``name`` of ``kind``: error_code, error_detail, then what parse gives.

    Where ``proven``, an expression for that value, isn't null, it stands and the row's text never leaves the JVM; only
    the other rows are parsed, one by one. The function counts as non-deterministic, so that it runs once.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(f"{name} {kind}")).types[0]

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for unproven, text in zip(texts.field(0).to_pylist(), texts.field(1).to_pylist(), strict=True):
            try:
                rows.append(dict(zip(fields, (None, None, parse(text)), strict=True)) if unproven else None)
            except Invalid as e:
                rows.append(dict(zip(fields, (e.code, str(e), None), strict=True)))
        return pa.array(rows, arrow)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    strict = F.arrow_udf(run, kind).asNondeterministic()
    if proven is None:
        return df.withColumn(name, strict(F.struct(F.lit(True).alias("unproven"), F.col(raw).alias("text"))))
    held = df.withColumn("__proven", proven)
    unproven = F.col("__proven").isNull()
    held = held.withColumn("__strict", strict(F.struct(unproven.alias("unproven"), F.when(unproven, F.col(raw)).alias("text"))))
    none = F.lit(None).cast("string")
    native = F.struct(none.alias("error_code"), none.alias("error_detail"), F.col("__proven").alias(fields[-1])).cast(kind)
    return held.withColumn(name, F.when(unproven, F.col("__strict")).otherwise(native)).drop("__proven", "__strict")


def _root(raw: Column) -> Column:
    """The JSON array that starts at a reply's first bracket or brace, as a variant; null if it starts with another value or isn't plain JSON.

    Like the strict parser it takes the first value and ignores what follows. Repeated keys, words like NaN and
    halves of surrogate pairs give null: these the strict parser reads in its own way.
    """
    text = F.substr(raw, F.greatest(F.regexp_instr(raw, F.lit(r"[\[{]")), F.lit(1)))
    return F.when(text.startswith("[") & ~text.rlike(HALVES), F.try_parse_json(text))


def _is(value: Column, *kinds: str) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).isin(*kinds), F.lit(False))


def _whole(value: Column) -> Column:
    return _is(value, "BIGINT") & F.coalesce(F.abs(F.try_variant_get(value, "$", "long")) < 2**31, F.lit(False))


def proven_tasks(raw: Column, tables: bool) -> Column:
    """The tasks of a reply whose every required field is there and of its plain type; null for any other reply, valid or not."""
    fields = "column:variant" if tables else "start:variant,end:variant,text:variant"
    listed, ids = ("columns", ["task_id", "table_id"]) if tables else ("entities", ["task_id"])
    shape = f"array<struct<{''.join(f'{i}:variant,' for i in ids)}{listed}:array<struct<{fields},scores:map<string,variant>>>>>"
    number = lambda v: _is(v, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & (F.abs(F.try_variant_get(v, "$", "double")) < float("inf"))
    plain = (lambda e: _is(e["column"], "STRING")) if tables else (lambda e: _whole(e["start"]) & _whole(e["end"]) & _is(e["text"], "STRING"))
    item_ok = lambda e: F.coalesce(plain(e) & F.forall(F.map_values(e["scores"]), number), F.lit(False))
    task_ok = lambda t: F.coalesce(F.forall(F.array(*[t[i] for i in ids]), lambda v: _is(v, "STRING")) & F.forall(t[listed], item_ok), F.lit(False))
    text = lambda v: F.try_variant_get(v, "$", "string")
    none = lambda kind: F.lit(None).cast(kind)

    def item(e: Column) -> Column:
        whole = lambda n: none("int") if tables else F.try_variant_get(e[n], "$", "int")
        scores = F.transform_values(e["scores"], lambda _, v: F.try_variant_get(v, "$", "double"))
        return F.struct(whole("start").alias("start"), whole("end").alias("end"), (none("string") if tables else text(e["text"])).alias("text"), (text(e["column"]) if tables else none("string")).alias("column"), scores.alias("scores"))

    def task(t: Column) -> Column:
        return F.struct(text(t["task_id"]).alias("task_id"), (text(t["table_id"]) if tables else none("string")).alias("table_id"), F.transform(t[listed], item).alias("items"))

    rows = F.try_variant_get(_root(raw), "$", shape)
    return let(rows, lambda r: F.when(F.forall(r, task_ok), F.transform(r, task)))


def proven_selection(raw: Column) -> Column:
    """The items of a selection of texts only; null for any other."""
    return let(F.try_variant_get(_root(raw), "$", "array<variant>"), lambda r: F.when(F.forall(r, lambda v: _is(v, "STRING")), F.transform(r, lambda v: F.try_variant_get(v, "$", "string"))))


def _selection(text: str | None) -> list[str]:
    return [_value(x, "a selected type", str) for x in _value(first_json(text), "the selection", list)]


def _compact(text: str | None) -> str:
    return whole(json.dumps(first_json(text), separators=(",", ":"), sort_keys=True, ensure_ascii=False))


def parse_text_replies(df: DataFrame, raw: str = "raw_text", name: str = "reply") -> DataFrame:
    return _parse(df, raw, name, PARSED, ["error_code", "error_detail", "tasks"], lambda t: parse_tasks(t, False), proven_tasks(F.col(raw), False))


def parse_table_replies(df: DataFrame, raw: str = "raw_text", name: str = "reply") -> DataFrame:
    return _parse(df, raw, name, PARSED, ["error_code", "error_detail", "tasks"], lambda t: parse_tasks(t, True), proven_tasks(F.col(raw), True))


def parse_selection_replies(df: DataFrame, raw: str = "raw_text", name: str = "reply") -> DataFrame:
    return _parse(df, raw, name, SELECTED, ["error_code", "error_detail", "items"], _selection, proven_selection(F.col(raw)))


def extract_json(df: DataFrame, raw: str = "raw_text", name: str = "reply") -> DataFrame:
    """The reply's JSON value, written compactly with sorted keys, or an error code."""
    return _parse(df, raw, name, "struct<error_code:string,error_detail:string,value:string>", ["error_code", "error_detail", "value"], _compact)
