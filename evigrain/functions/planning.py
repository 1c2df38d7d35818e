"""Rule-based reading of a query: kind, language, region, years, numbers with units, key stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import query_language, words

# Words that decide the kind of a query, in order of precedence.
COMPARE = (("сравн", " vs ", "против", "compare", "comparison", "versus", "российск", "и зарубеж"), ("сравн", "vs", "compare", "versus", "против", "зарубеж"))
KINDS = {
    "gap": ("пробел", "нет данных", "отсутству", "gap", "не изучен", "чего не хватает", "без числовых"),
    "aggregate": ("сколько", "динамик", "распределение по", "по годам", "how many", "count", "ведущих", "производителей"),
    "review": ("обзор", "методы", "review", "какие", "существуют", "способы", "технологии", "overview", "what methods"),
}
HOME = ("росси", "рф", "отечествен", "российск")
ABROAD = ("зарубеж", "мировой", "мировы", "иностран", "foreign", "world", "global", "за рубежом")
UNITS = r"мг/л|мг/дм3|мг/дм³|м3/ч|м³/ч|%|°c|мкм|г/т|л/с|т/сут|°с"


def has_any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def query_kind(c: Column) -> Column:
    q = F.lower(c)
    out = F.when(has_any(q, COMPARE[0]) & has_any(q, COMPARE[1]), "compare")
    for kind, parts in KINDS.items():
        out = out.when(has_any(q, parts), kind)
    return out.otherwise("lookup")


def query_region(c: Column) -> Column:
    q = F.lower(c)
    home, abroad = has_any(q, HOME), has_any(q, ABROAD)
    return F.when(home & abroad, "global").when(home, "RU").when(abroad, "foreign")


def query_years(c: Column, this_year: Column | int) -> Column:
    """First and last year named; "the last N years" counts back from ``this_year``."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1), lambda y: y.cast("int"))
    last = F.regexp_extract(F.lower(c), r"(?U)за последн\w*\s+(\d+)\s+(?:лет|год)", 1)
    now = F.lit(this_year) if isinstance(this_year, int) else this_year
    begin = F.when(last != "", now - last.try_cast("int")).otherwise(F.array_min(found))
    return F.struct(begin.alias("year_from"), F.array_max(found).alias("year_to"))


def query_numbers(c: Column) -> Column:
    """Numbers with a unit: array of (value, unit); numbers without one are left out."""
    q = F.lower(c)
    pattern = rf"(\d+(?:[.,]\d+)?)\s*({UNITS})"
    pairs = F.arrays_zip(F.regexp_extract_all(q, F.lit(pattern), 1).alias("n"), F.regexp_extract_all(q, F.lit(pattern), 2).alias("u"))
    return F.transform(pairs, lambda p: F.struct(F.replace(p["n"], F.lit(","), F.lit(".")).cast("double").alias("value"), F.replace(p["u"], F.lit("°с"), F.lit("°c")).alias("unit")))


def key_stems(c: Column) -> Column:
    """Stems of a query's longer words: 6 signs of words of 7 or more, 5 of words of 5 or 6."""
    long = F.filter(words(c), lambda w: F.length(w) >= 5)
    return F.array_distinct(F.transform(long, lambda w: F.when(F.length(w) >= 7, F.left(w, F.lit(6))).otherwise(F.left(w, F.lit(5)))))


def plan(c: Column, this_year: Column | int) -> Column:
    """The whole intent as a struct."""
    return F.struct(query_kind(c).alias("kind"), query_language(c).alias("language"), query_region(c).alias("region"), query_years(c, this_year).alias("years"), query_numbers(c).alias("numbers"), key_stems(c).alias("stems"))
