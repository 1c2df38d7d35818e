"""Graph, state, quality, sources, sinks and streams on small tables."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evigrain import sinks
from evigrain.operators import graph, quality, ranking, reach, state
from evigrain.sources import files
from evigrain.streaming import incremental

EDGES = "edge_id string, src string, dst string, type string, props map<string,string>"


def edges(spark, *pairs):
    return spark.createDataFrame([(f"{a}{b}", a, b, "about", {}) for a, b in pairs], EDGES)


def test_edges_are_cleaned_and_parallel_ones_kept(spark):
    raw = spark.createDataFrame([("1", "a", "b", "about", {"v": "92.5"}), ("2", "a", "b", "about", {"v": "925"}), ("3", "a", "b", "about", {"v": "925"}), ("4", "a", "a", "about", {}), ("5", "", "b", "about", {}), ("6", "a", "c", "odd", {})], EDGES)
    got = {(r.edge_id, r.type) for r in graph.clean_edges(raw).collect()}
    assert got == {("1", "about"), ("2", "about"), ("6", "related")}


def test_nodes_merge(spark):
    rows = [("n", "x", None, ["b"], 0.5, 2), ("n", "y", "z", ["a"], 0.9, 1)]
    n = graph.merge_nodes(spark.createDataFrame(rows, "id string, name string, name_en string, aliases array<string>, confidence double, ord int"), "ord").first()
    assert (n.name, n.name_en, n.aliases, n.confidence) == ("y", "z", ["a", "b"], 0.9)
    old = spark.createDataFrame([("n", {"a": "1", "b": "2"}, ["x"], 0.5), ("m", {}, [], 0.1)], "id string, props map<string,string>, docs array<string>, confidence double")
    new = spark.createDataFrame([("n", {"b": "3", "c": None}, ["y"], 0.4), ("k", {"q": "1"}, None, 0.2)], old.schema)
    got = {r.id: r for r in graph.merge_fragment(old, new).collect()}
    assert got["n"].props == {"a": "1", "b": "3"} and got["n"].docs == ["x", "y"] and got["n"].confidence == 0.5
    assert set(got) == {"n", "m", "k"}


def test_hops_grow_with_depth(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"))
    starts = spark.createDataFrame([("a",), ("z",)], "start string")
    by_depth = [{(r.start, r.id): r.distance for r in reach.within_hops(e, starts, k).collect()} for k in range(4)]
    assert by_depth[3] == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 2, ("z", "z"): 0}
    assert all(set(x.items()) <= set(y.items()) for x, y in zip(by_depth[:-1], by_depth[1:], strict=True))


def test_visible_and_capped(spark):
    e = edges(spark, ("a", "b"), ("b", "c"))
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    kept, own = graph.visible(n, e, spark.createDataFrame([("a",)], "id string"))
    assert {r.id for r in kept.collect()} == {"b", "c"} and [r.edge_id for r in own.collect()] == ["bc"]
    kept, own = graph.capped(n.withColumn("anchor", F.col("id") == "c"), e, 2)
    assert {r.id for r in kept.collect()} == {"c", "b"} and own.count() == 1


def test_contradictions(spark):
    c = [(1, "s", "p", "<=", 5.0, None), (2, "s", "p", ">=", 7.0, None), (3, "s", "p", "range", 4.0, 8.0), (4, "s", "p", "approx", 6.0, 0.5), (5, "t", "p", "=", 1.0, None)]
    got = graph.contradictions(spark.createDataFrame(c, "id int, subject string, param string, op string, value double, value2 double"))
    assert {(r.a, r.b) for r in got.collect()} == {(1, 2), (1, 4), (2, 4)}


def test_versions(spark):
    t0 = datetime(2024, 1, 1)
    base = spark.createDataFrame([("e", 1.0, "x")], "edge_id string, value double, note string")
    edits = spark.createDataFrame([("e", t0, 2.0, None), ("e", t0 + timedelta(1), None, "y")], "edge_id string, edited_at timestamp, value double, note string")
    every = graph.revise(base, edits)
    last = graph.current(every).first()
    assert every.count() == 3 and (last.version, last.value, last.note) == (3, 2.0, "y")
    up = graph.upsert(base, spark.createDataFrame([("e", 9.0, "z"), ("f", 1.0, "w")], base.schema), "edge_id")
    assert {r.edge_id: r.value for r in up.collect()} == {"e": 9.0, "f": 1.0}


def test_gate_is_honest_and_monotone(spark):
    rows = [(1, "a", "d1", 10.0, 0.9, ["lexical", "vector"]), (1, "b", "d1", 0.5, 0.1, ["lexical"]), (1, "c", "d2", None, 0.45, ["concept"]), (1, "d", "d3", None, 0.1, ["name"]), (2, "e", "d4", None, 0.2, ["vector"])]
    c = spark.createDataFrame(rows, "query_id int, chunk_id string, doc_id string, lex double, cos double, sources array<string>")
    loose = {r.chunk_id for r in ranking.signals(c, ranking.GATES["qwen3-0.6b"]).where("kept").collect()}
    strict = {r.chunk_id for r in ranking.signals(c, ranking.GATES["yandex-256"]).where("kept").collect()}
    assert loose == {"a", "c", "d"} and strict <= loose
    placed = ranking.fuse(ranking.signals(c, ranking.GATES["qwen3-0.6b"]).where("kept")).orderBy("place").collect()
    assert placed[0].chunk_id == "a"


def test_promotion(spark):
    r = spark.createDataFrame([(1, f"c{k}", k, k in (6, 9, 11)) for k in range(1, 13)], "query_id int, chunk_id string, place int, named boolean")
    got = [x.chunk_id for x in ranking.promote(r, F.col("named")).orderBy("citation").collect()]
    assert got == ["c1", "c2", "c3", "c4", "c9", "c11"]  # the named one in the last place gives way
    kept = [x.chunk_id for x in ranking.promote(r, F.col("named"), fixed=True).orderBy("citation").collect()]
    assert kept == ["c1", "c2", "c3", "c6", "c9", "c11"]


def test_citations_by_places_among_all_chunks(spark):
    # the second chunk of d1 takes a place: at 6 places for all chunks d6 is outside, and promoted if it is named
    r = spark.createDataFrame([(1, f"c{k}", k, f"d{max(k - 1, 1)}") for k in range(1, 9)], "query_id int, chunk_id string, place int, doc_id string")
    rows = lambda anew, named: [(x.chunk_id, x.promoted) for x in ranking.promote(ranking.best_per_document(r, anew), named).orderBy("citation").collect()]
    assert rows(False, F.lit(False)) == [(f"c{k}", False) for k in (1, 3, 4, 5, 6)]
    assert rows(False, F.col("doc_id") == "d6") == [("c1", False), ("c3", False), ("c4", False), ("c5", False), ("c7", True)]
    assert rows(True, F.lit(False)) == [(f"c{k}", False) for k in (1, 3, 4, 5, 6, 7)]


def test_state(spark):
    seen = {(r, s): spark.range(1).select(state.may_see(F.lit(r), F.lit(s)).alias("x")).first().x for r in ("partner", "analyst") for s in ("public", "internal")}
    assert seen[("partner", "internal")] is False and all(v for k, v in seen.items() if k != ("partner", "internal"))
    key = lambda q, f, v: spark.range(1).select(state.cache_key(F.lit(q), F.create_map(*[F.lit(x) for kv in f for x in kv]), F.lit("r"), F.lit(v)).alias("x")).first().x
    assert key(" A  b", [("x", "1"), ("y", "2")], "v1") == key("a b", [("y", "2"), ("x", "1")], "v1") != key("a b", [("x", "1"), ("y", "2")], "v2")
    f = spark.createDataFrame([("s1", "b"), ("s1", "a"), ("s2", "c")], "sha256 string, path string")
    first = state.first_by_content(f)
    assert {(r.sha256, r.path, r.copies) for r in first.collect()} == {("s1", "a", 2), ("s2", "c", 1)}
    known = spark.createDataFrame([("s1", 41)], "sha256 string, doc_no long")
    assert [(r.sha256, r.doc_id) for r in state.new_ids(first, known).collect()] == [("s2", "d000042")]


def test_quality(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (2, None, 50.0), (3, "y", None)], "k int, a string, b double")
    rules = [quality.Constraint("a", "required"), quality.Constraint("b", "at_most", 10.0, "warning"), quality.Constraint("a", "one_of", ("x",))]
    out = {(r.path, r.message): (r.n, r.examples) for r in quality.report(quality.violations(df, "k", rules)).collect()}
    assert out == {("a", "required"): (1, [2]), ("b", "at_most 10.0"): (1, [2]), ("a", "one_of x"): (1, [3])}
    res = spark.createDataFrame([(1, "d1"), (3, "d9")], "query_id int, doc_id string")
    want = spark.createDataFrame([(1, ["d1", "d2"], False), (2, [], True), (3, [], True)], "query_id int, docs array<string>, expect_empty boolean")
    got = {r.query_id: r for r in quality.retrieval_scores(res, want).collect()}
    assert (got[1].hit, got[1].recall, got[2].honest, got[3].honest) == (1, 0.5, 1, 0)


def office(kind):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        if kind == "docx":
            z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
        elif kind == "pptx":
            for k in (2, 1):
                z.writestr(f"ppt/slides/slide{k}.xml", f'<p:s xmlns:p="u" xmlns:a="v"><a:p><a:t>slide {k}</a:t></a:p></p:s>')
        else:
            z.writestr("xl/workbook.xml", '<w xmlns="u"><sheets><sheet name="S"/></sheets></w>')
            z.writestr("xl/sharedStrings.xml", '<s xmlns="u"><si><t>head</t></si></s>')
            z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="u"><row><c t="s"><v>0</v></c><c><v>5</v></c></row></w>')
    return b.getvalue()


def test_files(spark, tmp_path):
    outer, inner = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep text")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.txt", "inside")
        z.writestr("n.zip", inner.getvalue())
    (tmp_path / "sub").mkdir()
    for name, raw in {"a.docx": office("docx"), "b.pptx": office("pptx"), "c.xlsx": office("xlsx"), "sub/d.zip": outer.getvalue(), "e.part2.rar": b"x", "f.doc": b"x", "g.docx": b"broken", "h.xyz": b"x"}.items():
        (tmp_path / name).write_bytes(raw)
    found = files.scan(spark, str(tmp_path))
    status = {r.filename: r.status for r in found.select("filename", "status").collect()}
    assert status == {"a.docx": "ok", "b.pptx": "ok", "c.xlsx": "ok", "d.zip": "archive", "e.part2.rar": "skipped", "f.doc": "ok", "g.docx": "ok", "h.xyz": "skipped"}
    got = {}
    for r in files.pages(files.expand(found)).collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.page_no, r.text, r.status))
    assert got["a.docx"] == [(1, "One two\na | b", "ok")]
    assert sorted(got["b.pptx"]) == [(1, "slide 1", "ok"), (2, "slide 2", "ok")]
    assert got["c.xlsx"] == [(1, "# sheet: S\nhead\t5", "ok")]
    assert got["in.txt"] == [(1, "inside", "ok")] and got["deep.txt"] == [(1, "deep text", "ok")]
    assert got["f.doc"][0][2] == "unsupported" and got["g.docx"][0][2] == "failed"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_table(df, str(tmp_path / "t"))
    out = sinks.upsert_table(spark.createDataFrame([(2, "c"), (3, "d")], df.schema), str(tmp_path / "t"), str(tmp_path / "t2"), "k")
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    sinks.append_new(df, str(tmp_path / "t2"), "k")
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 3
    assert sinks.markdown_table(df, ["k", "v"], "k").first().markdown.splitlines()[2:] == ["| 1 | a |", "| 2 | b |"]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_streaming_ingest_and_subscriptions(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    stream = lambda: spark.readStream.schema("sha256 string, path string").json(str(src))
    for k, rows in enumerate([[("s1", "a"), ("s1", "b")], [("s1", "c"), ("s2", "d")]]):
        spark.createDataFrame(rows, "sha256 string, path string").coalesce(1).write.mode("append").json(str(src))
        incremental.ingest(stream(), table, str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.sha256, r.path) for r in spark.read.parquet(table).collect()} == {("s1", "a"), ("s2", "d")}
    items = spark.createDataFrame([("x", 1), ("x", 5), ("y", 9)], "topic string, at int")
    items.write.parquet(str(tmp_path / "items"))
    subs = spark.createDataFrame([(1, "x", 2)], "sub_id int, topic string, cursor int")
    live = spark.readStream.schema(items.schema).parquet(str(tmp_path / "items"))
    incremental.notify(live, subs, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination(60)
    assert [(r.sub_id, r.at) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 5)]


def test_streaming_sessions_equal_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("u", t0 + timedelta(minutes=m)) for m in (0, 10, 45, 60, 300)] + [("v", t0)]
    spark.createDataFrame(rows, "user_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    batch = {tuple(r) for r in incremental.sessions(spark.read.parquet(str(tmp_path / "e"))).collect()}
    live = incremental.sessions(spark.readStream.schema("user_id string, ts timestamp").parquet(str(tmp_path / "e")))
    q = live.writeStream.format("memory").queryName("sess").outputMode("complete" if False else "append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from sess").collect()} <= batch and len(batch) == 4


def test_job_states(spark, tmp_path):
    rows = [("j", "queued", 1), ("j", "building", 2), ("j", "chunking", 3), ("k", "done", 1), ("k", "queued", 2)]
    spark.createDataFrame(rows, "job_id string, stage string, at int").coalesce(1).write.parquet(str(tmp_path / "e"))
    live = incremental.job_states(spark.readStream.schema("job_id string, stage string, at int").parquet(str(tmp_path / "e")))
    q = live.writeStream.format("memory").queryName("jobs").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.job_id, r.stage) for r in spark.sql("select * from jobs").collect()} == {("j", "building"), ("k", "done")}


def test_volumes_and_broken_members(spark, tmp_path):
    """Three volumes make one archive; a corrupt member, a lost volume and a broken archive fail alone."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(6):
            z.writestr(f"doc{k}.txt", f"text of {k}. " * 400)
        z.writestr("empty.txt", "")
    body = bytearray(raw.getvalue())
    at = body.find(b"doc3.txt") + 12  # within the compressed text
    body[at : at + 8] = b"\xff" * 8
    size = len(body) // 3 + 1
    for k in range(3):
        (tmp_path / f"a.zip.00{k + 1}").write_bytes(body[k * size : (k + 1) * size])
        if k != 1:
            (tmp_path / f"lost.zip.00{k + 1}").write_bytes(body[k * size : (k + 1) * size])
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    (tmp_path / "plain.txt").write_text("plain")
    found = files.expand(files.scan(spark, str(tmp_path)))
    rows = {r.path.split("/", 3)[-1].replace(str(tmp_path).lstrip("/") + "/", "").rpartition("//")[2]: r for r in found.collect()}
    rows = {k.split(f"{tmp_path.name}/")[-1]: r for k, r in rows.items()}
    assert {k: r.status.split(":")[0] for k, r in rows.items()} == {**{f"a.zip/doc{k}.txt": "ok" for k in range(6) if k != 3}, "a.zip/doc3.txt": "failed", "a.zip/empty.txt": "ok", "lost.zip": "failed", "bad.zip": "failed", "plain.txt": "ok"}
    assert rows["lost.zip"].status == "failed: volume 2 is missing" and rows["a.zip/doc3.txt"].content is None
    read = {r.path.split(f"{tmp_path.name}/")[-1]: (r.text, r.status) for r in files.pages(found).collect()}
    assert read["a.zip/doc3.txt"] == (None, "failed") and read["a.zip/doc5.txt"] == ("text of 5. " * 400, "ok") and read["plain.txt"] == ("plain", "ok") and read["a.zip/empty.txt"] == ("", "ok")
    from evigrain.plans import build

    new = build.manifest(found, spark.createDataFrame([], "sha256 string, doc_no long"))
    assert sorted(r.path.split(f"{tmp_path.name}/")[-1] for r in new.collect()) == ["a.zip/doc0.txt", "a.zip/doc1.txt", "a.zip/doc2.txt", "a.zip/doc4.txt", "a.zip/doc5.txt", "a.zip/empty.txt", "plain.txt"]


def test_opposed_conditions_equal_their_pairs(spark):
    """Counts and furthest opponents against all pairs: ties, swapped ends, nulls, one group over many pieces."""
    import random

    from evigrain.operators import graph

    pick = random.Random(11)
    ops = ["=", "<", ">", "range", "approx"]
    rows = []
    for k in range(240):
        a = float(pick.randrange(12))
        op = pick.choice(ops)
        rows.append((k, "s0" if k % 3 else f"s{k % 5}", "p", op, a, {"range": a + pick.randrange(3), "approx": 1.0}.get(op)))
    rows += [(900, None, "p", "=", 1.0, None), (901, "s0", None, "=", 1.0, None), (902, "s0", "p", "=", None, None), (903, "s0", "p", "range", 9.0, 4.0)]
    df = spark.createDataFrame(rows, "id long, subject string, param string, op string, value double, value2 double")
    spans = {r.id: r for r in graph._spans(df).collect() if None not in (r.subject, r.param, r.lo, r.hi)}
    at = {i: (min(r.lo, r.hi), max(r.lo, r.hi)) for i, r in spans.items()}
    for tolerance in (0.0, 1.0):
        want = {}
        for i, (lo, hi) in at.items():
            others = [(j, *at[j]) for j in at if spans[j].subject == spans[i].subject]
            below = sorted((h, j) for j, _, h in others if lo > h + tolerance)
            above = sorted((-x, j) for j, x, _ in others if x > hi + tolerance)
            if below or above:
                want[i] = (len(below) + len(above), below[0][1] if below else None, above[0][1] if above else None)
        got = {r.id: (r.n_opponents, r.below, r.above) for r in graph.opposed(df, tolerance).collect()}
        assert got == want
    assert graph.opposed(df.where("id < 0")).count() == 0


def test_tasks_grow_with_the_edges(spark, monkeypatch):
    from evigrain.plans import catalog
    from evigrain.sources.tables import ROWS, tasks_for

    assert tasks_for(spark, 9 * ROWS + 1) == 10 and tasks_for(spark, 0) == spark.sparkContext.defaultParallelism
    rows = [(f"a{i % 50}", f"b{i % 30}", "about", {}, f"e{i:04}") for i in range(400)]
    raw = spark.createDataFrame(rows, "src string, dst string, type string, props map<string,string>, edge_id string")
    dealt = graph.clean_edges(raw, 9)
    assert dealt.rdd.getNumPartitions() == 9
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, graph.clean_edges(raw).collect()))
    monkeypatch.setattr(catalog, "tasks_for", lambda spark, rows: 23)
    assert catalog.all_edges(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 23


def test_degrees_count_both_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("c", "b")], "src string, dst string")
    assert {tuple(r) for r in graph.degrees(edges).collect()} == {("a", 4), ("b", 3), ("c", 1)}
