"""Model output: JSON repair, validation, coercion of dirty scalars, merging of properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CONFIDENCE, PAYLOAD


def repaired(raw: Column) -> Column:
    """The JSON of a model's answer: without code fences, else from the first brace to the last."""
    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.startswith(F.ltrim(c), F.lit("{")), c)
    return F.coalesce(ok(bare), ok(braces))


def payload(raw: Column) -> Column:
    """The answer as a struct; null if there is no JSON in it."""
    return F.from_json(repaired(raw), PAYLOAD)


def problem(raw: Column, json: Column | None = None, x: Column | None = None) -> Column:
    """Why an answer can't be used: ``empty``, ``not json``, ``incomplete``; null if it can. ``json`` and ``x``: the repaired and the read answer, where they are known."""
    json, x = repaired(raw) if json is None else json, payload(raw) if x is None else x
    missing = x["entities"].isNull() & x["assertions"].isNull() & x["conditions"].isNull()
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "empty").when(json.isNull(), "not json").when(missing, "incomplete")


def coerced(value: Column) -> Column:
    """The first number of a dirty scalar."""
    return F.replace(F.regexp_extract(value, r"(-?\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def confidence(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.lower(label)], F.lit(CONFIDENCE["low"]))
