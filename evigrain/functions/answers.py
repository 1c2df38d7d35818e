"""Answers without a model: numbers marked in text, templates by kind of query, sentences on domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units that make a number checkable, longer ones before what they contain.
UNITS = (
    "мг/дм³", "мг/дм3", "мг/л", "г/дм³", "г/л", "г/т", "кг/т", "кВт·ч/м³", "кВт·ч", "м³/ч", "м³/сут", "л/ч", "А/м²", "А/дм²", "₽/м³", "руб./м³", "руб/м³", "$/м³", "USD/m3",
    "°C", "°С", "°", "м³", "мкм", "нм", "мм", "см", "мг", "кВт", "МВт", "ppm", "%", "м",
)
#: What an answer has, by kind of query: headings, and how many tokens it may take.
SHAPES = {
    "compare": (("Сравнение", "Различия", "Вывод"), 1400),
    "gap": (("Что известно", "Пробелы"), 1000),
    "aggregate": (("Показатели", "Источники"), 1000),
    "review": (("Обзор", "Методы", "Вывод"), 1600),
    "lookup": (("Ответ",), 700),
}
_ESCAPED = "|".join("".join(f"[{c}]" if c in ".$" else c for c in u) for u in UNITS)
_AMOUNT = r"[≤≥<>~≈]?\s?\d[\d\s.,]*(?:\s?[–—-]\s?\d[\d.,]*)?"
MARKED = rf"(?i)(pH\s?{_AMOUNT}|{_AMOUNT}\s?(?:{_ESCAPED}))"


def numbers_marked(c: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """A text with each number that has a unit (or is a pH) marked, ranges and comparators with it."""
    return F.regexp_replace(c, MARKED, f"{before}$1{after}")


def has_checkable_number(c: Column) -> Column:
    return c.rlike(MARKED)


def shape(kind: Column) -> Column:
    """Headings and token budget of an answer to a kind of query."""
    out = None
    for k, (heads, budget) in SHAPES.items():
        own = F.struct(F.array(*map(F.lit, heads)).alias("headings"), F.lit(budget).alias("max_tokens"))
        out = F.when(kind == k, own) if out is None else out.when(kind == k, own)
    heads, budget = SHAPES["lookup"]
    return out.otherwise(F.struct(F.array(*map(F.lit, heads)).alias("headings"), F.lit(budget).alias("max_tokens")))


def template(kind: Column, quotes: Column) -> Column:
    """An answer of the citations alone: the kind's first heading, then a line for each quote with its number; or that nothing was found."""
    lines = F.transform(quotes, lambda q, i: F.concat(F.lit("- "), q, F.lit(" ["), (i + 1).cast("string"), F.lit("]")))
    found = F.concat(F.lit("## "), F.get(shape(kind)["headings"], F.lit(0)), F.lit("\n"), F.array_join(lines, "\n"))
    return F.when(F.size(quotes) > 0, found).otherwise("Подтверждённых данных не найдено.")


def short_label(c: Column, size: int = 60) -> Column:
    """A label on one line, cut with an ellipsis beyond ``size`` signs."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.left(flat, F.lit(size - 1))), F.lit("…"))).otherwise(flat)


def domain_sentence(domain: Column, processes: Column, most: int = 5) -> Column:
    """A sentence on a domain from the names of its processes (an array): how many, and the first of them."""
    few = F.slice(F.array_sort(F.array_distinct(processes)), 1, most)
    return F.concat(domain, F.lit(": "), F.size(F.array_distinct(processes)).cast("string"), F.lit(" — "), F.array_join(few, ", "))
