"""The service's requests over a small lake, and the lookups behind them."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evigrain.engine import Engine
from evigrain.operators import lookup
from evigrain.operators.ranking import Gate
from evigrain.plans import build

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def engine(spark):
    docs = [("d1", "nickel recovery by flotation", "A", 2010, "en", "public"), ("d2", "nickel flotation reagents and recovery", "B", 2020, "en", "internal"), ("d3", "copper smelting", "A", 2015, "ru", "public")]
    nodes = [("p1", "Process", "flotation"), ("p2", "Process", "smelting"), ("x1", "Expert", "Ann"), ("x2", "Expert", "Bob"), ("u1", "Publication", "on flotation"), ("u2", "Publication", "on smelting")]
    edges = [("x1", "u1", "authored_by"), ("x2", "u1", "authored_by"), ("x2", "u2", "authored_by"), ("p1", "u1", "described_in"), ("p2", "u2", "described_in")]
    return Engine(
        {
            "documents": spark.createDataFrame(docs, "doc_id string, text string, section string, year int, lang string, sensitivity string"),
            "chunks": spark.createDataFrame([("d1", k, f"d1_c{k}", f"part {k}") for k in range(3)], "doc_id string, seq int, chunk_id string, text string"),
            "vectors": spark.createDataFrame([("d1", [1.0, 0.0], "l"), ("d2", [0.9, 0.1], "l"), ("d3", [0.0, 1.0], "m")], "vec_id string, embedding array<double>, label string"),
            "nodes": spark.createDataFrame(nodes, "id string, type string, name string"),
            "edges": spark.createDataFrame([(f"{a}-{b}", a, b, t) for a, b, t in edges], "edge_id string, src string, dst string, type string"),
            "conditions": spark.createDataFrame([("p1", "temperature", "<=", 60.0, "°C"), ("p2", "temperature", ">=", 900.0, "°C"), ("p1", "pH", "=", 9.0, None)], "process_id string, param string, op string, value double, unit string"),
            "audit": spark.createDataFrame([(k, "search" if k % 2 else "export") for k in range(10)], "id long, action string"),
            "subscriptions": spark.createDataFrame([(1, "nickel", 5), (2, "copper", 1)], "sub_id int, topic string, cursor int"),
        },
        Gate(semantic=0.6, strong=0.95, concept=0.5),
    )


def asked(spark, text, vec):
    return spark.createDataFrame([(1, text, vec, None)], "query_id long, query string, query_vec array<double>, label string")


def test_search_filters_every_branch(spark, engine):
    q = asked(spark, "nickel recovery", [1.0, 0.0])
    found = lambda **k: {r.chunk_id for r in engine.search(q, **k).collect()}
    assert found() == {"d1", "d2"}
    assert found(role="partner") == {"d1"}
    assert found(filters={"section": "B"}) == {"d2"} and found(filters={"year_to": 2012, "section": "all"}) == {"d1"}
    assert found(filters={"year_from": 2030}) == set()
    assert engine.answer_text(engine.search(q, role="partner")).first().markdown.startswith("[1] nickel recovery")


def test_search_is_honest(spark, engine):
    assert engine.search(asked(spark, "penguins", [-1.0, 0.2])).count() == 0


def test_unknown_filters_raise():
    with pytest.raises(ValueError, match="unknown"):
        lookup.predicate({"colour": "red"})


def test_nodes_and_overview(spark, engine):
    near = {r.id: r.distance for r in engine.node(spark.createDataFrame([("p1",)], "start string"), 2).collect()}
    assert near == {"p1": 0, "u1": 1, "x1": 2, "x2": 2}
    anchors, own = engine.overview(2)
    assert {r.id for r in anchors.collect()} == {"u1", "u2"} and own.count() == 0
    assert [r.id for r in engine.find_concepts("Process", "S").collect()] == ["p2"] or engine.find_concepts("Process", "smelt").first().id == "p2"


def test_documents_and_roles(spark, engine):
    ids = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    got = {r.doc_id: r.chunks for r in engine.document(ids, "partner", most=2).collect()}
    assert set(got) == {"d1"} and [c.seq for c in got["d1"]] == [0, 1]
    caps = engine.capabilities(spark.createDataFrame([("partner",), ("admin",)], "role string"))
    assert {r.capability for r in caps.where("role = 'partner'").collect()} == {"search"} and caps.where("role = 'admin'").count() > 3


def test_experts_stats_compare(engine):
    assert [(r.expert, r.n_works) for r in engine.experts().collect()] == [("x2", 2), ("x1", 1)]
    assert [r.expert for r in engine.experts("bob").collect()] == ["x2"]
    stats = {(r.facet, r.value): r.n for r in engine.stats().collect()}
    assert stats[("node", "Expert")] == 2 and stats[("lang", "en")] == 2 and stats[("section", "A")] == 2
    rows = {r.param: (r.p1, r.p2) for r in engine.compare("p1", "p2").collect()}
    assert rows["temperature"] == ("<= 60.0 °C", ">= 900.0 °C") and rows["pH"][0] == "= 9.0"
    assert engine.health().first().documents == 3


def test_subscriptions_and_audit(spark, engine):
    items = spark.createDataFrame([("nickel", 4), ("nickel", 9), ("copper", 3)], "topic string, at int")
    assert {(r.sub_id, r["at"]) for r in engine.updates(items).collect()} == {(1, 9), (2, 3)}
    later = Engine({"subscriptions": engine.advanced(items)})
    assert later.updates(items).count() == 0
    assert [r.id for r in engine.audit_log("search", limit=2, offset=1).collect()] == [7, 5]


def test_edits_and_reviews(spark, engine):
    edits = spark.createDataFrame([("p1-u1", T0, "supersedes")], "edge_id string, edited_at timestamp, type string")
    assert [r.type for r in engine.edit_edges(edits).where("edge_id = 'p1-u1'").orderBy("version").collect()] == ["described_in", "supersedes"]
    verdicts = spark.createDataFrame([("p1", "disputed", T0), ("p1", "confirmed", T0 + timedelta(1)), ("p2", "odd", T0)], "id string, status string, at timestamp")
    got = {r.id: r.review_status for r in engine.review(verdicts).collect()}
    assert got["p1"] == "confirmed" and got["p2"] == "auto"


def test_intents_topics_gaps(spark):
    intents = spark.createDataFrame([(1, ["gold"], []), (2, ["gold"], ["nickel"]), (3, [], ["nickel"])], "query_id int, foreign array<string>, domain array<string>")
    assert {r.query_id for r in lookup.off_topic(intents).where("rejected").collect()} == {1}
    c = spark.createDataFrame([("c1", "flotation of ores"), ("c2", "smelting")], "concept_id string, label string")
    q = spark.createDataFrame([(1, "flotations?")], "query_id int, query string")
    assert [r.concept_id for r in lookup.adjacent_topics(c, q).collect()] == ["c1"]
    n = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "query_id int, n_numbers int")
    a = spark.createDataFrame([(1, ["d"]), (3, [])], "query_id int, docs array<string>")
    assert {r.query_id for r in lookup.gaps(n, a).collect()} == {3}


def test_sentences_need_their_numbers(spark):
    a = spark.createDataFrame([(1, "Recovery is 92,5 %. It was 80 % [2]. Fine.\n| 7 |", "recovery 92.5 %")], "query_id int, answer string, evidence string")
    out = lookup.supported_sentences(a).first()
    assert out.answer == "Recovery is 92,5 %. Fine. | 7 |" and out.n_dropped == 1


def test_files_to_chunks(spark):
    text = ("Никель извлекают флотацией при температуре 60 °C. " * 60).encode()
    files = spark.createDataFrame([("Обзоры/2014/a.txt", ".txt", text), ("Статьи/b.txt", ".txt", text), ("Доклады/c.txt", ".txt", b"short")], "path string, ext string, content binary")
    known = spark.createDataFrame([], "sha256 string, doc_no long")
    docs, chunks = build.documents(files, known)
    got = {r.path: r for r in docs.collect()}
    assert set(got) == {"Обзоры/2014/a.txt", "Доклады/c.txt"}  # the copy is dropped
    first = got["Обзоры/2014/a.txt"]
    assert (first.section, first.year, first.lang, first.wave) == ("Обзоры", 2014, "ru", 1) and first.n_chunks == chunks.where(F.col("doc_id") == first.doc_id).count() > 0


def test_scans_read_only_what_they_need(spark):
    from evigrain.plans import catalog

    plan = catalog.QUERIES["expert_ranking"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan
    plan = catalog.QUERIES["conditions_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_discount:double>" in plan and "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in plan
    plan = catalog.QUERIES["search_filters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan and "GreaterThanOrEqual(quality,1)" in plan


def test_broken_files_cost_themselves_alone(spark):
    """Corrupt members, a bomb, documents without a body, bad string numbers: a status, never an exception."""
    import io
    import zipfile

    from evigrain.sources import files

    def pack(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in members.items():
                z.writestr(name.replace("__", "/").replace("_", "."), body)
        return out.getvalue()

    good = pack(a_txt="first " * 500, b_txt="second")
    at = good.index(b"a.txt") + 5
    corrupt = good[: at + 4] + bytes(x ^ 0xA5 for x in good[at + 4 : at + 12]) + good[at + 12 :]
    empty = pack(word__document_xml="<document/>")
    sheet = pack(xl__workbook_xml='<w><s:sheet xmlns:s="s" name="S"/></w>', xl__sharedStrings_xml="<s/>", xl__worksheets__sheet1_xml='<x xmlns="q"><row><c t="s"><v>7</v></c></row></x>')
    rows = [("x/corrupt.zip", corrupt), ("x/cut.zip", good[:40]), ("x/empty.docx", empty), ("x/sheet.xlsx", sheet), ("x/no.docx", b"PK"), ("x/none.docx", None), ("x/nested.zip", pack(in_zip=corrupt, c_md="third"))]
    held = files.classify(spark.createDataFrame([(p, b) for p, b in rows], "path string, content binary"))
    out = {r.path: r for r in files.expand(held).collect()}
    assert out["x/corrupt.zip/a.txt"].error.startswith("failed") and out["x/corrupt.zip/b.txt"].content == b"second"
    assert out["x/cut.zip"].error.startswith("failed") and out["x/nested.zip/c.md"].content == b"third"
    assert out["x/nested.zip/in.zip/a.txt"].error.startswith("failed")
    got = {r.path: (r.status, r.text) for r in files.pages(held.where("ext in ('.docx', '.xlsx')")).collect()}
    assert got["x/empty.docx"] == ("ok", "") and got["x/sheet.xlsx"] == ("ok", "# sheet: S\n7")
    assert got["x/no.docx"][0] == got["x/none.docx"][0] == "failed"


def test_archives_are_measured_as_they_are_read(monkeypatch):
    import io
    import zipfile

    from evigrain.sources import files

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "x" * 5000)
        z.writestr("b.txt", "y" * 100_000)
    found = list(files._members("p", out.getvalue(), files._Room(50_000)))
    assert [(p, s) for p, _, s in found] == [("p/a.txt", "ok"), ("p", "too large")]


def test_upload_export_and_subscriptions(spark):
    import json

    from evigrain.engine import Engine

    para = "Новый отчёт о работе печи за год. " * 12
    files = spark.createDataFrame([("in/a.txt", para.encode()), ("in/b.txt", b""), ("in/c.rtf", b"x"), ("in/old.txt", b"old")], "path string, content binary")
    import hashlib

    known = spark.createDataFrame([(hashlib.sha256(b"old").hexdigest(), 41)], "sha256 string, doc_no long")
    texts = spark.createDataFrame([(1, "первый текст"), (2, "второй текст")], "doc_id long, text string")
    subs = spark.createDataFrame([(1, "печь", None), (2, "руда", None)], "sub_id long, topic string, cursor timestamp")
    e = Engine({"manifest": known, "documents": texts, "subscriptions": subs, "answer_cache": texts})
    docs, chunks, jobs = e.upload(files)
    assert {r.path: r.status for r in jobs.collect()} == {"in/a.txt": "done", "in/b.txt": "empty", "in/c.rtf": "unsupported", "in/old.txt": "cached"}
    made = docs.collect()
    assert [(r.path, r.doc_no, r.uploaded) for r in made] == [("in/a.txt", 42, True)] and {r.doc_id for r in chunks.collect()} == {"d000042"}
    cited = spark.createDataFrame([(7, 1, 1, "d1", 0.1, 0.5), (7, 2, 2, "d2", 0.05, 0.4)], "query_id long, citation int, chunk_id long, doc_id string, rrf double, cos double")
    bodies = {f: e.export(cited, f).first().body for f in ("markdown", "json", "jsonld")}
    assert bodies["markdown"].split("\n")[1] == "[2] второй текст (d2)"
    assert [c["doc_id"] for c in json.loads(bodies["json"])["citations"]] == ["d1", "d2"]
    assert json.loads(bodies["jsonld"])["wasDerivedFrom"][0]["quote"] == "первый текст"
    with pytest.raises(ValueError, match="form"):
        e.export(cited, "pdf")
    changes = spark.createDataFrame([(1, "delete", 1, None), (2, "put", 1, "шлак"), (2, "put", 2, "штейн"), (3, "put", 1, "новая")], "sub_id long, action string, at int, topic string")
    got = {r.sub_id: (r.topic, str(r.cursor)) for r in e.subscribe(changes).collect()}
    assert got[2][0] == "штейн" and got[3] == ("новая", "1970-01-01 00:00:00") and set(got) == {2, 3}
    assert e.cache_cleared().count() == 0


def test_search_finds_documents_by_name(spark):
    from evigrain.engine import Engine
    from evigrain.operators.ranking import Gate

    rows = [(k, f"common words number {k}", f"file_{k}.pdf") for k in range(30)] + [(99, "nothing of the kind", "Autoclave-leaching.report.pdf")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    vectors = spark.createDataFrame([(k, [1.0, float(k)], 0) for k in range(30)] + [(99, [-1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(1, "autoclave leaching", [1.0, 0.0], None)], "query_id long, query string, query_vec array<double>, label int")
    found = Engine({"documents": docs, "vectors": vectors}, Gate(semantic=0.9, strong=0.95, concept=0.9, named=1.0)).search(q).collect()
    assert [r.chunk_id for r in found if "name" in r.sources] == [99]
    assert 99 not in {r.chunk_id for r in Engine({"documents": docs.drop("name"), "vectors": vectors}, Gate(semantic=0.9, strong=0.95, concept=0.9)).search(q).collect()}


def test_written_postings_give_the_scores_of_a_scan(spark, tmp_path):
    from evigrain.operators import ranking

    docs = spark.createDataFrame([(1, "a b a c"), (2, "b b"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b"), (2, "zzz")], "query_id long, query string")
    ranking.postings(docs, "text", "doc_id").write.parquet(str(tmp_path / "postings"))
    kept = spark.read.parquet(str(tmp_path / "postings"))
    key = lambda df: sorted((r.query_id, r.doc_id, r.n_terms, round(r.score, 9)) for r in df.collect())
    assert key(ranking.score_postings(kept, ranking.query_terms(q))) == key(ranking.bm25(docs, q)) != []


def test_number_evidence_and_long_texts(spark):
    from evigrain.operators import ranking

    texts = spark.createDataFrame([("k", "1 " * 200_000 + "x" * 400 + " 2,5 3,5 4,5"), ("m", "no digits"), ("n", "7"), ("o", None)], "chunk_id string, text string")
    got = {r.chunk_id: r for r in ranking.numeric_excerpts(texts).collect()}
    assert set(got) == {"k"} and got["k"].start == 0 and got["k"].weight == 131
    plan = ranking.numeric_excerpts(texts)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
