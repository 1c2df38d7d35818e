"""Countries and regions named in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names a country, in Russian and English, and its class.
MARKERS: list[tuple[str, str, str]] = [
    (r"\bНорильск\w*", "Россия", "RU"),
    (r"\bМончегорск\w*", "Россия", "RU"),
    (r"Кольск\w*\s+ГМК|\bКГМК\b|Кольская\s+горно", "Россия", "RU"),
    (r"\bТалнах\w*", "Россия", "RU"),
    (r"\bКайеркан\w*", "Россия", "RU"),
    (r"\bЗаполярн\w*", "Россия", "RU"),
    (r"\bНадеждинск\w*|Надеждинский\s+металлург", "Россия", "RU"),
    (r"\bГипроникел\w*", "Россия", "RU"),
    (r"\bПеченг\w*", "Россия", "RU"),
    (r"\bМурманск\w*", "Россия", "RU"),
    (r"\bКрасноярск\w*", "Россия", "RU"),
    (r"\bХараелах\w*", "Россия", "RU"),
    (r"\bОктябрьск\w*\s+месторожд", "Россия", "RU"),
    (r"\bРоссия\b|\bРоссийск\w+|\bРФ\b|\bСССР\b", "Россия", "RU"),
    (r"\bКазахстан\w*", "Казахстан", "foreign"),
    (r"\bЧили\b|\bChile\b|El\s+Soldado|Chuquicamata|Escondida|Collahuasi", "Чили", "foreign"),
    (r"\bАвстрали\w*|\bAustralia\b|Kalgoorlie|Olympic\s+Dam", "Австралия", "foreign"),
    (r"Нов\w*\s+Каледони\w*|New\s+Caledonia|Doniambo|\bGoro\b|Koniambo", "Новая Каледония", "foreign"),
    (r"\bУэльв\w*|\bHuelva\b|Las\s+Cruces|\bИспани\w*|\bSpain\b|Atlantic\s+Copper", "Испания", "foreign"),
    (r"\bКанад\w*|\bCanada\b|\bSudbury\b|Thompson|Voisey", "Канада", "foreign"),
    (r"\bЮАР\b|South\s+Africa|Rustenburg|Stillfontein|Beatrix|Bushveld", "ЮАР", "foreign"),
    (r"\bФинлянди\w*|\bFinland\b|Харьявалт\w*|Harjavalta|\bKevitsa\b", "Финляндия", "foreign"),
    (r"\bМонголи\w*|\bMongolia\b|Oyu\s+Tolgoi", "Монголия", "foreign"),
    (r"\bКуб[аеы]\b|\bCuba\b|Punta\s+Gorda|Moa\b", "Куба", "foreign"),
    (r"Cerro\s+Matoso|\bКолумби\w*|\bColombia\b", "Колумбия", "foreign"),
    (r"Sandouville|\bФранци\w*|\bFrance\b", "Франция", "foreign"),
    (r"\bНорвеги\w*|\bNorway\b|Kristiansand|\bNikkelverk\b", "Норвегия", "foreign"),
    (r"\bКитай\b|\bChina\b|\bКитайск\w+", "Китай", "foreign"),
    (r"\bИндонези\w*|\bIndonesia\b", "Индонезия", "foreign"),
    (r"\bЗамби\w*|\bZambia\b", "Замбия", "foreign"),
    (r"\bКонго\b|\bDRC\b|Демократическая\s+Республика\s+Конго", "Конго", "foreign"),
    (r"\bБразили\w*|\bBrazil\b", "Бразилия", "foreign"),
    (r"\bПеру\b|\bPeru\b", "Перу", "foreign"),
    (r"\bСША\b|\bUSA\b|United\s+States|\bШтат\w+", "США", "foreign"),
    (r"\bШвеци\w*|\bSweden\b|Rönnskär|Ronnskar|Boliden", "Швеция", "foreign"),
    (r"\bГермани\w*|\bGermany\b|Aurubis", "Германия", "foreign"),
    (r"\bЯпони\w*|\bJapan\b|Sumitomo", "Япония", "foreign"),
]
WORLD = r"\bв\s+мире\b|\bмиров\w+|\bglobal\b|\bworldwide\b|\binternational\b|\bмеждународн\w+"
FLAGS = "(?Uiu)"


def countries(c: Column, markers: list[tuple[str, str, str]] = MARKERS) -> Column:
    """The countries named in a text, each once, in the order of their first markers, whichever of them is found."""
    by_name: dict[str, list[str]] = {}
    for p, name, _ in markers:
        by_name.setdefault(name, []).append(f"(?:{p})")
    hits = [F.when(c.rlike(FLAGS + "|".join(ps)), F.lit(name)) for name, ps in by_name.items()]
    return F.array_compact(F.array(*hits))


def region(c: Column, hint: Column | None = None, markers: list[tuple[str, str, str]] = MARKERS) -> Column:
    """``RU``, ``foreign`` or ``global`` (both classes); else the hint; else ``global`` for a word of the world."""
    any_of = {k: "|".join(f"(?:{p})" for p, _, cls in markers if cls == k) for k in ("RU", "foreign")}
    ru, foreign = (c.rlike(FLAGS + any_of[k]) for k in ("RU", "foreign"))
    hint = F.lit(None).cast("string") if hint is None else hint
    return (
        F.when(ru & foreign, "global")
        .when(ru, "RU")
        .when(foreign, "foreign")
        .when(hint.isin("RU", "foreign", "global"), hint)
        .when(c.rlike(FLAGS + WORLD), "global")
    )
