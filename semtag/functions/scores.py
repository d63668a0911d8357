"""Score expressions over arrays and maps: no row is exploded, nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Pairs = list[tuple[str, str]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it, also inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fill_dense(scores: Column, types: Column) -> Column:
    """Scores of the distinct ``types``, in their order, 0 where a map has none; null for a null map.

    Scores and types are sorted together, so that a type follows its score: no look-up goes through a map.
    """
    none, row = F.lit(None).cast("int"), lambda key, place, score: F.struct(key.alias("key"), place.alias("place"), score.alias("score"))
    told = F.transform(F.map_entries(scores), lambda e: row(e["key"], none, e["value"].cast("double")))
    asked = F.transform(types, lambda t, i: row(t, i, F.lit(None).cast("double")))
    found = lambda both, e, i: F.when((i > 0) & (F.get(both, i - 1)["key"] == e["key"]), F.get(both, i - 1)["score"])
    placed = let(F.array_sort(F.concat(told, asked)), lambda both: F.filter(F.transform(both, lambda e, i: F.struct(e["place"].alias("place"), F.coalesce(found(both, e, i), F.lit(0.0)).alias("score"))), lambda e: e["place"].isNotNull()))
    return F.transform(F.array_sort(placed), lambda e: e["score"])


def normalize(values: Column) -> Column:
    """Values over their sum; uniform if the sum isn't positive; null values count as 0."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    share = lambda s: F.transform(s["v"], lambda x: F.when(s["total"] > 0, F.coalesce(x, F.lit(0.0)) / s["total"]).otherwise(F.lit(1.0) / F.size(s["v"])))
    return let(values, lambda v: let(F.struct(v.alias("v"), total(v).alias("total")), share))


def argmax(types: Column, posterior: Column) -> Column:
    """struct(type_id, confidence) of the greatest posterior, ties to the earlier type; null for no types."""
    ranked = F.transform(F.arrays_zip(types.alias("t"), posterior.alias("p")), lambda e, i: F.struct(e["p"].alias("p"), (-i).alias("i"), e["t"].alias("t")))
    return let(F.array_max(ranked), lambda best: F.when(best.isNotNull(), F.struct(best["t"].alias("type_id"), best["p"].alias("confidence"))))


def distribution(types: Column, posterior: Column) -> Column:
    return F.map_from_arrays(types, posterior)


def _merged(entries: Column) -> Column:
    """Entries (key, value) with each key once, with its greatest value, sorted by key."""
    last_of_run = lambda es: F.filter(es, lambda e, i: F.coalesce(F.get(es, i + 1)["key"] != e["key"], F.lit(True)))
    return let(F.array_sort(entries), last_of_run)


def _known(entries: Column, name: str, types: Column) -> Column:
    """Entries (key, value, as) with ``known``: whether their text ``name`` is among the types. No two entries share a text but null.

    Texts and types are sorted together, so that a text that is known follows its type: the time grows with their number, but for a sort.
    """
    none = F.lit(None)
    row = lambda text, own, key, value, new: F.struct(text.alias("text"), own.alias("own"), key.cast("string").alias("key"), value.cast("double").alias("value"), new.cast("string").alias("as"))
    both = F.concat(F.transform(types, lambda t: row(t, F.lit(0), none, none, none)), F.transform(entries, lambda e: row(e[name], F.lit(1), e["key"], e["value"], e["as"])))
    follows = lambda es, e, i: F.coalesce((i > 0) & (F.get(es, i - 1)["own"] == 0) & (F.get(es, i - 1)["text"] == e["text"]), F.lit(False))
    told = lambda es: F.transform(es, lambda e, i: F.struct(e["own"].alias("own"), e["key"].alias("key"), e["value"].alias("value"), e["as"].alias("as"), follows(es, e, i).alias("known")))
    return F.filter(let(F.array_sort(both), told), lambda e: e["own"] == 1)


def canonical_scores(scores: Column, types: Column, aliases: Pairs, prefixes: Pairs) -> Column:
    """A score map under canonical ids; keys that meet keep the greater score; unresolved keys stay.

    Aliases apply first, in order, even to allowed keys; prefixes then, in order, only to others. Equal keys are merged after
    each step, as they would fare alike.
    """
    if not aliases and not prefixes:
        return scores
    entries = F.transform(F.map_entries(scores), lambda e: _pair(e["key"], e))
    for alias, canonical in aliases:
        entries = _aliased(entries, types, alias, canonical)
    entries = _merged(entries)
    for old, new in prefixes:
        entries = _merged(_rewritten(entries, types, old, new))
    return F.map_from_entries(entries)


def _pair(key: Column, entry: Column) -> Column:
    return F.struct(key.alias("key"), entry["value"].cast("double").alias("value"))


def _aliased(entries: Column, types: Column, alias: str, canonical: str) -> Column:
    renamed = lambda es: F.transform(es, lambda e: _pair(F.when(e["key"] == alias, canonical).otherwise(e["key"]), e))
    return let(entries, lambda es: F.when(F.array_contains(types, F.lit(canonical)), renamed(es)).otherwise(es))


def _rewritten(entries: Column, types: Column, old: str, new: str) -> Column:
    """Entries of which those with the prefix, not allowed as they are but allowed with the new one, have that; as keys differ, so do rewritten ones."""
    row = lambda e, other: F.struct(e["key"].alias("key"), e["value"].alias("value"), other.alias("as"))
    plain = F.transform(entries, lambda e: row(e, F.lit(None).cast("string")))
    asks = lambda e: F.when(~e["known"] & e["key"].startswith(old), F.concat(F.lit(new), F.substr(e["key"], F.lit(len(old) + 1))))
    asked = F.transform(_known(plain, "key", types), lambda e: row(e, asks(e)))
    return F.transform(_known(asked, "as", types), lambda e: _pair(F.when(e["known"], e["as"]).otherwise(e["key"]), e))


def score_errors(scores: Column, types: Column, dense: bool | Column) -> Column:
    """Error codes of a score map, in order; empty if it is valid.

    Unlike a plain comparison, which lets NaN pass, non-finite scores are an error of their own.
    """
    keys, values = F.map_keys(scores), F.map_values(scores)
    dense = F.lit(dense) if isinstance(dense, bool) else dense
    checks = [
        (dense & (F.size(F.array_except(types, keys)) > 0), "missing_score_key"),
        (F.size(F.array_except(keys, types)) > 0, "unknown_score_key"),
        (F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "non_finite_score"),
        (F.exists(values, lambda v: v < 0), "negative_score"),
        (~F.exists(values, lambda v: v > 0), "no_positive_score"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]), lambda c: c.isNotNull())


def resolve_type(value: Column, types: Column, aliases: Pairs, prefixes: Pairs) -> Column:
    """A selected type's canonical id, null if there is none: allowed first, then aliases, then prefixes."""
    found = F.when(F.array_contains(types, value), value)
    for alias, canonical in aliases:
        found = F.coalesce(found, F.when((value == alias) & F.array_contains(types, F.lit(canonical)), F.lit(canonical)))
    for old, new in prefixes:
        rewritten = F.concat(F.lit(new), F.substr(value, F.lit(len(old) + 1)))
        found = F.coalesce(found, F.when(value.startswith(old) & F.array_contains(types, rewritten), rewritten))
    return found


def select_types(items: Column, types: Column, aliases: Pairs, prefixes: Pairs) -> Column:
    """Resolved, trimmed, distinct ids of a type selection, unresolvable ones dropped, in reply order."""
    from .text import strip

    return F.array_distinct(F.filter(F.transform(items, lambda x: resolve_type(strip(x), types, aliases, prefixes)), lambda x: x.isNotNull()))
