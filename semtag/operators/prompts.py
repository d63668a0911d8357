"""Prompts of a batch, as columns of the batch row."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ascii_json_string
from .vocab import Vocabulary

_TEXT_SHAPE = '[{"task_id": "<id>", "entities": [{"start": <int>, "end": <int>, "text": "<cut of the text>", "scores": {"<type>": <number>}}]}]'
_TABLE_SHAPE = '[{"task_id": "<id>", "table_id": "<id>", "columns": [{"column": "<name>", "scores": {"<type>": <number>}}]}]'
_DENSE = "Score every allowed type with a number of at least 0."
_SPARSE = "Score the types that fit with a number of at least 0; a type left out counts as 0."


def _dump(rows: pd.Series) -> pd.Series:
    return rows.map(lambda r: json.dumps(json.loads(r)), na_action="ignore")


def ascii_json(rows: Column) -> Column:
    """JSON text, written again in ASCII."""
    return F.pandas_udf(_dump, "string")(rows)


def tasks_json(tasks: Column) -> Column:
    """tasks (array<struct<task_id,text>>) as a JSON array in ASCII, by expressions."""
    one = lambda t: F.concat(F.lit('{"task_id": '), ascii_json_string(t["task_id"]), F.lit(', "text": '), ascii_json_string(t["text"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(tasks, one), ", "), F.lit("]"))


def _render(parts: list[str], types: Column, payload: Column) -> Column:
    head, tail = F.lit("\n".join(parts) + _TYPES), F.lit(_TASKS)
    return F.concat(head, F.array_join(types, ", "), tail, payload)


_TYPES, _TASKS = "\nAllowed types: ", "\nTasks:\n"


def _frame(parts: list[str], types: tuple[str, ...]) -> str:
    return "\n".join(parts) + _TYPES + ", ".join(types) + _TASKS


def _text_parts(v: Vocabulary) -> list[str]:
    return [
        v.text_intro,
        f"Vocabulary: {v.name}",
        "Answer with nothing but a JSON array, one object for each task:",
        _TEXT_SHAPE,
        "Offsets count characters from 0; the end is excluded; the cut must equal the text there.",
        _DENSE if v.dense else _SPARSE,
        "At least one score of an entity is above 0.",
    ]


def _table_parts(v: Vocabulary) -> list[str]:
    return [
        v.table_intro,
        f"Vocabulary: {v.name}",
        "Answer with nothing but a JSON array, one object for each task:",
        _TABLE_SHAPE,
        "Give each column that occurs in any sampled row once.",
        _DENSE if v.dense else _SPARSE,
        "At least one score of a column is above 0.",
    ]


def _selection_parts(v: Vocabulary, mode: str) -> list[str]:
    if mode not in ("text", "table"):
        raise ValueError(f"mode must be text or table, not {mode}")
    return [
        v.text_intro if mode == "text" else v.table_intro,
        f"Vocabulary: {v.name}",
        f"Which of the allowed types could occur in these {mode} tasks? When in doubt, include a type.",
        'Answer with nothing but a JSON array of types: ["<type>"]',
    ]


def text_frame(v: Vocabulary) -> str:
    """What a text prompt with all types says before its tasks."""
    return _frame(_text_parts(v), v.types)


def table_frame(v: Vocabulary) -> str:
    return _frame(_table_parts(v), v.types)


def selection_frame(v: Vocabulary, mode: str) -> str:
    return _frame(_selection_parts(v, mode), v.types)


def text_prompt(v: Vocabulary, types: Column, tasks: Column) -> Column:
    """tasks: array<struct<task_id,text>> in order."""
    return _render(_text_parts(v), types, tasks_json(tasks))


def table_prompt(v: Vocabulary, types: Column, tasks_json: Column) -> Column:
    """tasks_json: JSON array of {task_id, table_id, sampled_rows}, as ascii_json gives it."""
    return _render(_table_parts(v), types, tasks_json)


def selection_prompt(v: Vocabulary, types: Column, tasks_json: Column, mode: str) -> Column:
    """tasks_json: JSON array of the tasks, as ascii_json or tasks_json gives it."""
    return _render(_selection_parts(v, mode), types, tasks_json)


def retry_prompt(prompt: Column, error: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nYour last answer was not valid: "), error, F.lit(". Answer with valid JSON only."))
