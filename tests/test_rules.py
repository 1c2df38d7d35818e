"""Known answers of the extraction rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evigrain.functions import geography, numbers, paths, payloads, planning, text, units
from evigrain.operators import chunking, conditions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "value"),
    [("17,25", 17.25), ("8.04", 8.04), ("3 400", 3400), ("61\u00a0200", 61200), ("7,310.4", 7310.4), ("7.310,4", 7310.4), ("46", 46), ("0,018", 0.018), ("-2,75", -2.75), ("−31", -31), ("+4", 4)],
)
def test_parse_number(spark, raw, value):
    assert one(spark, numbers.parse_number(F.lit(raw))) == pytest.approx(value)
    assert conditions.number(raw) == pytest.approx(value)


LESS = {"<=": ("≤", "не выше", "не превышает", "до", "no more than", "max"), "<": ("<", "ниже", "under", "lower than"), ">=": ("≥", "не ниже", "от", "minimum"), ">": (">", "больше", "exceeds", "greater than"), "=": ("=", "составляет", "равна"), "approx": ("~", "примерно", "около", "circa", "approx.")}


@pytest.mark.parametrize(("op", "word"), [(op, w) for op, ws in LESS.items() for w in ws])
@pytest.mark.parametrize(("raw", "value", "unit"), [("4,8", 4.8, "г/л"), ("2 150", 2150, "кг/ч"), ("77", 77, None)])
def test_comparators(op, word, raw, value, unit):
    sentence = f"Расход воды {word} {raw} {unit or ''}, затем слив"
    (name, *found, start, end, quote, _), *rest = conditions.find_conditions(sentence)
    assert (name, *found) == ("Расход воды", op, value, None, unit) and not rest
    assert quote == sentence[start:end] and quote.startswith(word) and quote.endswith(unit or raw)


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("подача пульпы 3,5–4,75 м³/ч", [("range", 3.5, 4.75, "м³/ч")]),
        ("выдержка 12 - 18 мм", [("range", 12, 18, "мм")]),
        ("нагрев от 640 до 655 °C", [("range", 640, 655, "°C")]),
        ("heated from 15 to 35 K slowly", [("range", 15, 35, "K")]),
        ("влажность между 6 и 9 %", [("range", 6, 9, "%")]),
        ("spacing between 2 and 3 ММ", [("range", 2, 3, "ММ")]),
        ("давление 6,2±0,4 МПа", [("approx", 6.2, 0.4, "МПа")]),
        ("толщина 14 +/- 2", [("approx", 14, 2, None)]),
        ("раствор с pH 8–9,5", [("range", 8, 9.5, None)]),
        ("доведён до рН = 6", [("=", 6, None, None)]),
        ("при рН ≥ 11 осадок", [(">=", 11, None, None)]),
        ("выход металла 71,4 %", [("=", 71.4, None, "%")]),
        ("на электродах 240 А/м2 весь день", [("=", 240, None, "А/м2")]),
        ("раствор 0,25 М кислоты", [("=", 0.25, None, "М")]),
        ("с 11–13 по 20 число", []),
        ("глава 4, рисунок 17", []),
        ("13 мгновений", []),
        ("от 5 до 7±1 %", [(">=", 5, None, None), ("approx", 7, 1, "%")]),
        ("не более 10–20 мг/л", [("range", 10, 20, "мг/л")]),
        ("доля 3 % масс, ещё 9 %", [("=", 3, None, "% масс"), ("=", 9, None, "%")]),
        ("", []),
    ],
)
def test_conditions(sentence, want):
    assert [tuple(c[1:5]) for c in conditions.find_conditions(sentence)] == want


def test_condition_names_and_kinds(spark):
    rows = [(1, "Мутность стока, по норме — не выше 250 мг/дм³"), (2, "объект в зоне: суровый климат и cold climate"), (3, None), (4, "запуск в 1998 году"), (5, "закалка 900±15 К"), (6, "без чисел"), (7, "corrosive environment, 30 кПа")]
    out = conditions.extract_conditions(spark.createDataFrame(rows, "k int, text string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.k, []).append(r)
        assert r.quote == rows[r.k - 1][1][r.start : r.end]
    assert got[1][0].param == "норме" and (got[1][0].unit_canonical, got[1][0].value_canonical) == ("мг/л", 250)
    assert [r.qualitative for r in got[2]] == ["холодный климат"] * 2 and got[2][0].op is None
    assert set(got) == {1, 2, 5, 7}
    assert got[5][0].value_canonical == pytest.approx(626.85) and got[5][0].value2_canonical == 15
    assert [r.qualitative for r in got[7]] == ["коррозионная среда", None]


@pytest.mark.parametrize(
    ("value", "unit", "want", "label"),
    [(40, "мг/дм3", 40, "мг/л"), (12, "ppm", 12, "мг/л"), (2, "кА/м2", 2000, "А/м²"), (300.15, "K", 27, "°C"), (31, "°С", 31, "°C"), (750, "кПа", 0.75, "МПа"), (3, "бар", 0.3, "МПа"), (640, "кг/сут", 0.64, "т/сут"), (45, "мкм", 0.045, "мм"), (11, "кВт*ч/т", 11, "кВт·ч/т"), (9, "вёдер", 9, "вёдер"), (8, "млн-1", 8, "мг/л"), (2, "л/с", 7.2, "м³/ч"), (5, "А/дм2", 500, "А/м²")],
)
def test_units(spark, value, unit, want, label):
    got = one(spark, F.struct(units.canonical_value(F.lit(float(value)), F.lit(unit)).alias("v"), units.canonical_unit(F.lit(unit)).alias("u")))
    assert (got.v, got.u) == (pytest.approx(want), label)


def test_numbers_stand_in_text(spark):
    t = F.lit("осадок 740 мг/л и 18,5 % от массы; всего 2 360 или 85; sold 4,120 boxes")
    for v, there in ((740.0, True), (18.5, True), (2360.0, True), (4.12, True), (4120.0, True), (741.0, False), (58.0, False)):
        assert one(spark, numbers.number_in_text(F.lit(v), t)) is there
    assert one(spark, numbers.raw_in_text(F.lit("18,5"), t)) and not one(spark, numbers.raw_in_text(F.lit("631"), t))


@pytest.mark.parametrize(
    ("sentence", "region", "country"),
    [("опыты прошли в Мончегорске", "RU", "Россия"), ("плавка меди в Harjavalta", "foreign", "Финляндия"), ("отвалы, Bushveld complex", "foreign", "ЮАР"), ("Талнах и рудники Перу", "global", "Перу"), ("описание стенда", None, None), ("новинки, worldwide", "global", None)],
)
def test_geography(spark, sentence, region, country):
    assert one(spark, geography.region(F.lit(sentence))) == region
    found = one(spark, geography.countries(F.lit(sentence)))
    assert (country in found) if country else found == []
    assert one(spark, geography.region(F.lit("описание стенда"), F.lit("RU"))) == "RU"


def test_countries_in_the_order_of_their_first_markers(spark):
    markers = [("one", "A", "RU"), ("two", "B", "foreign"), ("three|x+", "A", "RU")]
    assert one(spark, geography.countries(F.lit("two, then three"), markers)) == ["A", "B"]
    assert one(spark, geography.countries(F.lit("one, xx and three"), markers)) == ["A"]


def test_planning(spark):
    p = one(spark, planning.plan(F.lit("сравнение отечественных и зарубежных схем за последние 8 лет, 45 мг/л"), 2030))
    assert (p.kind, p.region, p.years.year_from) == ("compare", "global", 2022)
    assert [(n.value, n.unit) for n in p.numbers] == [(45.0, "мг/л")]
    assert one(spark, planning.query_kind(F.lit("перечислить способы"))) == "review"
    assert one(spark, planning.query_years(F.lit("отчёты 2003 и 2019"), 2026)).year_to == 2019


def test_text(spark):
    assert one(spark, text.slug(F.lit("Щелочная Промывка, 2-я!"))) == "schelochnaya_promyvka_2_ya"
    assert one(spark, text.script_language(F.lit("этот абзац написан целиком по-русски"))) == "ru"
    assert one(spark, text.script_language(F.lit("this paragraph holds english words only"))) == "en"
    for a, b, same in (("кобальта", "кобальт", True), ("соль", "соли", True), ("соль", "сода", False), ("filter", "filtering", False), ("reagent", "reagents", True)):
        assert one(spark, text.same_word(F.lit(a), F.lit(b))) is same
    assert one(spark, text.plain_citations(F.lit("y【12】z"))) == "y[12]z"
    assert one(spark, text.grounded(F.lit("some  Words"), F.lit("there are some words in it"))) and not one(spark, text.grounded(F.lit("absent"), F.lit("there are words")))


def test_paths(spark):
    cases = {
        "Журналы/Обогащение руд/2009/NR_07.pdf": ("Журналы", "Обогащение руд", 2009, "article", "RU", 4),
        "Доклады/plan_b.pptx": ("Доклады", None, None, "presentation", "RU", 1),
        "Материалы конференций/Forum 2016/y.pdf": ("Материалы конференций", None, 2016, "proceedings", "global", 3),
        "Материалы конференций/CRU/z_08.xls": ("Материалы конференций", None, 2008, "market_report", "foreign", 4),
    }
    for p, want in cases.items():
        assert tuple(one(spark, paths.metadata(F.lit(p)))) == want


def test_payloads(spark):
    raw = 'Answer:\n```json\n{"entities": [{"name": "Cobalt", "type": "Material"}]}\n``` end'
    assert one(spark, payloads.payload(F.lit(raw))).entities[0].name == "Cobalt"
    assert [one(spark, payloads.problem(F.lit(x))) for x in ("", "nothing", '{"y": 2}', raw)] == ["empty", "not json", "incomplete", None]
    assert one(spark, payloads.coerced(F.lit("примерно 7,25 г"))) == 7.25


def test_chunks(spark):
    para = "Вторая проба показала рост выхода. " * 40
    doc = [("a", k, f"Вестник завода\n{k}\n\nРАЗДЕЛ {k}\n\n{para}\n\n{para}") for k in range(1, 6)] + [("b", 1, "мало"), ("c", 1, None)]
    pages = spark.createDataFrame(doc, "doc_id string, page_no int, text string")
    assert {(r.doc_id, r.line, r.n_pages) for r in chunking.repeated_lines(pages).collect()} >= {("a", "Вестник завода", 5)}
    clean = chunking.strip_repeated(pages)
    assert all("Вестник" not in r.text for r in clean.collect()) and clean.count() == 7
    chunks = chunking.chunk_documents(clean).orderBy("seq").collect()
    assert [c.seq for c in chunks] == list(range(len(chunks))) and {c.doc_id for c in chunks} == {"a"}
    s = chunking.Sizes()
    assert all(s.least <= len(c.text) <= s.most for c in chunks)
    assert all(b.text.startswith(a.text[-s.overlap :].strip()) for a, b in zip(chunks[:-1], chunks[1:], strict=True))
    assert [c.section_title for c in chunks][0] == "РАЗДЕЛ 1" and chunks[-1].page_to == 5
    assert chunking.chunk_documents(pages.limit(0)).collect() == []
    with pytest.raises(ValueError, match="fit"):
        chunking.Sizes(target=4000)


def test_chunk_borders():
    """Every chunk but the last is full: its next block wouldn't have fit."""
    import random

    rnd = random.Random(2)
    for _ in range(50):
        found = [(k, " ".join(rnd.choice(["ab", "cde.", "f;"]) for _ in range(rnd.choice([3, 60, 500, 3000]))), rnd.choice([None, f"T{k}"])) for k in range(rnd.randint(1, 30))]
        parts = [x for _, t, _ in found for x in (t[a:b] for a, b in chunking.cuts(t, 3500))]
        assert all(len(x) <= 3500 for x in parts) and "".join(parts).replace(" ", "") == "".join(t for _, t, _ in found).replace(" ", "")
        made = chunking.chunks(found)
        joined = "".join(c[0] for c in made).replace(" ", "").replace("\n", "")
        assert all(x.replace(" ", "") in joined for x in parts[3:])


def test_chunks_by_lines(spark):
    text = "\n".join(f"line {k} " + "w" * (k % 90) for k in range(400)) + "\r\n\n  end of it \n"
    lines = [x.strip() for x in text.replace("\r", "\n").split("\n") if x.strip()]
    size = [max(1, len(x) // 4) for x in lines]
    want, first, fresh = [], 0, 0
    while fresh < len(lines):
        last = max(j for j in range(fresh, len(lines)) if j == fresh or sum(size[first : j + 1]) <= 900)
        want.append("\n".join(lines[first : last + 1]))
        back = next((k for k in range(last, first - 1, -1) if sum(size[k : last + 1]) >= 100), first)
        first, fresh = back, last + 1
    got = chunking.chunk_by_lines(spark.createDataFrame([(1, text), (2, None), (3, "tiny")], "doc_id long, text string")).orderBy("seq").collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, x) for x in want if len(x) > 40] and len(want) > 5


def test_strings_in_texts(spark, monkeypatch):
    """All strings in one pass or in many: the pairs that comparing each with each finds; no plan has a nested loop."""
    import random

    from evigrain.functions import matching
    from evigrain.operators import lookup

    pick = random.Random(5)
    texts = [(k, "".join(pick.choice("abё ") for _ in range(pick.randrange(60)))) for k in range(200)] + [(200, None), (201, "")]
    strings = ["a", "ab", "bab", " ", "ёё", "aab b", "zz", "", None]
    want = {(k, s) for k, x in texts if x for s in strings if s and s in x}
    docs = spark.createDataFrame(texts, "k long, x string")
    asked = spark.createDataFrame([(s,) for s in strings], "s string")
    for signs in (matching.PASS_SIGNS, 4):
        monkeypatch.setattr(matching, "PASS_SIGNS", signs)
        found = [tuple(r) for r in matching.holding(docs, ["k"], "x", asked, "s").collect()]
        assert sorted(found) == sorted(want)
    assert matching.holding(docs, ["k"], "x", asked.where("s = 'none'"), "s").count() == 0
    forms = spark.createDataFrame([("c1", "abab"), ("c2", "babёab"), ("c3", "ba"), ("c0", "abab")], "concept_id string, form string")
    terms = [(x[:7],) for _, x in texts if x] + [("abab",), ("abёa",), ("xababx",), ("babё",)]
    got = {r.term: (r.concept_id, r.tier) for r in lookup.term_match(spark.createDataFrame(terms, "term string"), forms).collect()}
    assert (got["abab"], got["babё"], got["xababx"]) == (("c0", "exact"), ("c2", "part"), ("c0", "part"))
    plan = lookup.term_match(docs.select(F.col("x").alias("term")), forms)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_chunks_leave_in_small_batches():
    import tracemalloc

    import pyarrow as pa

    page = pa.struct([("page_no", pa.int32()), ("blocks", pa.list_(pa.struct([("text", pa.string()), ("title", pa.string())])))])
    docs = [[{"page_no": 1, "blocks": [{"text": f"{k} {j} " + "word " * 600, "title": None} for j in range(20)]}] for k in range(400)]
    batch = pa.record_batch([pa.array([str(k) for k in range(400)]), pa.array(docs, pa.list_(page))], ["doc_id", "pages"])
    del docs
    tracemalloc.start()
    made = [(b.num_rows, b.column(0).to_pylist()) for b in chunking.chunk_batches(iter([batch]))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [k for _, keys in made for k in keys] == [str(k) for k in range(400)]
    assert max(n for n, _ in made) < 60 and most < batch.nbytes / 2
