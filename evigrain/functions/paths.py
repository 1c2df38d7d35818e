"""Metadata from a file's place in the corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sections, journals and words that tell sources apart.
SECTIONS = {"обзоры": "Обзоры", "статьи": "Статьи", "доклады": "Доклады", "журналы": "Журналы", "материалы конференций": "Материалы конференций"}
JOURNALS = {"цветные металлы": "Цветные металлы", "горная промышленность": "Горная промышленность", "горный журнал": "Горный журнал", "обогащение руд": "Обогащение руд"}
FOREIGN = ("copper", "alta", "new caledonia", "ausimm", "mill operators", "handbook", "flotation", "corrosion atlas", "mitsui", "cru", "gfms", "icsg", "antaike", "barclays", "brook hunt", "metal bulletin", "bme")
MARKET = ("источники данных", "cru", "gfms", "mitsui", "icsg", "antaike", "barclays", "brook hunt", "metal bulletin", "bme", "market")
DEFAULT_SECTION, FIRST_YEAR, LAST_YEAR = "Материалы конференций", 1950, 2026


def _first_of(parts: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return table[F.get(F.filter(parts, lambda p: p.isin(*names)), 0)]


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def year(path: Column) -> Column:
    """A year from a folder that begins with one, from within a folder, from the file's name, or its two digits."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    within = lambda c: F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"((?:19|20)\d{2})"), 1), lambda y: y.cast("int")), lambda y: y.between(FIRST_YEAR, LAST_YEAR))
    begins = F.filter(F.transform(parts, lambda p: F.regexp_extract(F.trim(p), r"^((?:19|20)\d{2})", 1).try_cast("int")), lambda y: y.isNotNull())
    inside = F.flatten(F.transform(parts, within))
    short = F.regexp_extract(name, r"_(\d{2})(?:[._]|$)", 1).try_cast("int")
    short = F.when(short <= LAST_YEAR - 2000, short + 2000).when(short >= 95, short + 1900)
    return F.coalesce(F.get(begins, 0), F.get(inside, 0), F.get(within(name), 0), short)


def metadata(path: Column) -> Column:
    """section, journal, year, source_type, geography_hint and wave of a path, as a struct."""
    low = F.lower(path)
    parts = F.split(low, "/")
    ext = F.regexp_extract(low, r"(\.[^./]+)$", 1)
    section = F.coalesce(_first_of(parts, SECTIONS), F.lit(DEFAULT_SECTION))
    y = year(path)
    kind = (
        F.when(section == "Обзоры", "review")
        .when(section.isin("Статьи", "Журналы"), "article")
        .when(section == "Доклады", F.when(ext.isin(".pptx", ".ppt"), "presentation").otherwise("report"))
        .when(_has(low, MARKET) | ext.isin(".xls", ".xlsx"), "market_report")
        .when(_has(low, ("handbook", "atlas")), "book")
        .otherwise("proceedings")
    )
    hint = F.when(section != DEFAULT_SECTION, "RU").when(_has(low, FOREIGN), "foreign").otherwise("global")
    wave = F.when(section.isin("Обзоры", "Статьи", "Доклады"), 1).when(section == "Журналы", F.when(y.between(2015, 2025), 2).otherwise(4)).when(kind == "market_report", 4).otherwise(3)
    journal = F.when(section == "Журналы", _first_of(parts, JOURNALS))
    return F.struct(section.alias("section"), journal.alias("journal"), y.alias("year"), kind.alias("source_type"), hint.alias("geography_hint"), wave.alias("wave"))
