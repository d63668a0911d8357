"""Text expressions: lines, trimming, JSON sizes, IRI shortening."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every line end that Python's splitlines knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strings(values: Iterable[str]) -> Column:
    """A constant array of texts, as one literal however long it is."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def ascii_json_length(text: Column) -> Column:
    """Length of a text inside an ASCII-escaped JSON string, quotes not counted."""
    wide = F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "#" * 12)
    short = F.regexp_replace(wide, r'["\\\n\r\t\x08\x0c]', "##")
    return F.length(F.regexp_replace(short, "[^ -~]", "######"))


def ascii_json_string(text: Column) -> Column:
    """A text as a JSON string in ASCII, quotes included; ``null`` for a null. Characters beyond the basic plane become surrogate pairs."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    code = lambda c: F.ascii(c)
    pair = lambda n: F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
    short = lambda c: F.try_element_at(F.create_map(*[F.lit(x) for kv in _SHORT.items() for x in kv]), c)
    other = lambda c: F.when(code(c) < 0x10000, unit(code(c))).otherwise(pair(code(c)))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)[ !#-\[\]-~]+|."), F.lit(0))
    escaped = F.transform(parts, lambda c: F.coalesce(short(c), F.when(code(c).between(32, 126), c), other(c)))
    plain = F.when(text.rlike(r"^[ !#-\[\]-~]*\z"), text).otherwise(F.array_join(escaped, ""))
    return F.when(text.isNull(), "null").otherwise(F.concat(F.lit('"'), plain, F.lit('"')))


#: JSON's short escapes.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def text_task_size(task_id: Column, text: Column) -> Column:
    """Length of {"task_id": ..., "text": ...} as ASCII JSON."""
    return ascii_json_length(task_id) + ascii_json_length(text) + 27


#: Hosts and paths under which vocabulary terms are shortened.
IRI_BASE = r"^https?://w3id\.org/dpv"


def shorten_iri(iri: Column) -> Column:
    """``.../dpv#X`` and ``.../dpv/#X`` to ``dpv:X``, ``.../dpv/ns#X`` to ``dpv-ns:X``, ``.../dpv/x`` to ``dpv:x``; others unchanged."""
    rest = F.regexp_extract(iri, IRI_BASE + r"/(.*)$", 1)
    space, name = F.regexp_extract(rest, r"^([^#]*)#", 1), F.regexp_extract(rest, r"^[^#]*#(.*)$", 1)
    return (
        F.when(iri.rlike(IRI_BASE + "#"), F.concat(F.lit("dpv:"), F.regexp_extract(iri, IRI_BASE + "#(.*)$", 1)))
        .when(~iri.rlike(IRI_BASE + "/"), iri)
        .when(rest.startswith("#"), F.concat(F.lit("dpv:"), name))
        .when(rest.contains("#"), F.concat(F.lit("dpv-"), space, F.lit(":"), name))
        .otherwise(F.concat(F.lit("dpv:"), rest))
    )
