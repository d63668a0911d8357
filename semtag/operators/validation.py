"""Validation of parsed replies, on the batch row: its tasks are an array column, so nothing is joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scores import Pairs, canonical_scores, score_errors


def _codes(*checks: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]), lambda c: c.isNotNull())


def task_set_errors(expected: Column, replied: Column) -> Column:
    """Error codes for task ids that lack or that nobody asked for; repeated ids are fine."""
    return _codes((F.size(F.array_except(expected, replied)) > 0, "missing_task"), (F.size(F.array_except(replied, expected)) > 0, "unknown_task"))


def span_errors(text: Column, start: Column, end: Column, said: Column) -> Column:
    """bad_offsets, else text_mismatch, else none; code points from 0, the end excluded, no empty spans."""
    bad = (start < 0) | (end > F.length(text)) | (start >= end)
    return _codes((bad, "bad_offsets"), (~bad & (F.substring(text, F.greatest(start, F.lit(0)) + 1, F.greatest(end - start, F.lit(0))) != said), "text_mismatch"))


def column_errors(expected: Column, replied: Column) -> Column:
    names = F.array_distinct(replied)
    mismatch = (F.size(F.array_except(expected, names)) > 0) | (F.size(F.array_except(names, expected)) > 0)
    return _codes((mismatch, "column_mismatch"), (F.size(replied) != F.size(names), "duplicate_column"))


def _last(tasks: Column, task_id: Column) -> Column:
    return F.try_element_at(F.filter(tasks, lambda t: t["task_id"] == task_id), F.lit(-1))


def canonical_tasks(parsed: Column, types: Column, aliases: Pairs, prefixes: Pairs) -> Column:
    """Parsed tasks with canonical score keys."""
    item = lambda i: i.withField("scores", canonical_scores(i["scores"], types, aliases, prefixes))
    return F.transform(parsed, lambda t: t.withField("items", F.transform(t["items"], item)))


def text_reply_errors(tasks: Column, parsed: Column, types: Column, dense: bool | Column) -> Column:
    """All error codes of a text reply whose score keys are canonical. tasks: array<struct<task_id,text>>."""
    ids = task_set_errors(F.transform(tasks, lambda t: t["task_id"]), F.transform(parsed, lambda t: t["task_id"]))
    spans = lambda t: F.flatten(F.transform(t["items"], lambda i: span_errors(_last(tasks, t["task_id"])["text"], i["start"], i["end"], i["text"])))
    scores = lambda t: F.flatten(F.transform(t["items"], lambda i: score_errors(i["scores"], types, dense)))
    return F.array_distinct(F.concat(ids, F.flatten(F.transform(parsed, spans)), F.flatten(F.transform(parsed, scores))))


def table_reply_errors(tasks: Column, parsed: Column, types: Column, dense: bool | Column) -> Column:
    """All error codes of a table reply. tasks: array<struct<task_id,table_id,columns>>."""
    ids = task_set_errors(F.transform(tasks, lambda t: t["task_id"]), F.transform(parsed, lambda t: t["task_id"]))
    task = lambda t: _last(tasks, t["task_id"])
    table = lambda t: _codes((t["table_id"] != task(t)["table_id"], "table_mismatch"))
    columns = lambda t: column_errors(task(t)["columns"], F.transform(t["items"], lambda i: i["column"]))
    scores = lambda t: F.flatten(F.transform(t["items"], lambda i: score_errors(i["scores"], types, dense)))
    each = F.flatten(F.transform(parsed, lambda t: F.concat(table(t), F.when(task(t).isNotNull(), columns(t)).otherwise(F.array().cast("array<string>")), scores(t))))
    return F.array_distinct(F.concat(ids, each))
