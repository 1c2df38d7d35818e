"""Triples, shapes and searches from many nodes: known answers and plain versions."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from evigrain.operators import reach, shapes, triples
from evigrain.operators.shapes import Rule, Shape
from evigrain.operators.triples import Field

NODES = "id string, type string, name string, score double, aliases array<string>, props map<string,string>, s string, kind string"


@pytest.fixture(scope="module")
def made(spark):
    rows = [
        ("m:1", "Material", 'Ni "99"\\x\n', 0.5, ["a", "", None, "b"], {"value": "12.50", "year": "1999", "unit": "kg"}, "x", "y"),
        ("m 2+*~", "Material", "", None, None, {"value": "has fallen", "year": "1999.5"}, None, None),
        ("m:3", None, "n", 2.0, [], None, None, None), ("", "Material", "lost", 1.0, [], None, None, None), (None, "Material", "lost", 1.0, [], None, None, None),
    ]
    fields = [Field("label", "name"), Field("confidence", "score", "double"), Field("value", "value", "double"), Field("year", "year", "integer", "Material"), Field("unit", "unit")]
    return triples.node_triples(spark.createDataFrame(rows, NODES), fields, (Field("alias", "aliases"),))


def test_triples_keep_dirty_numbers_as_strings(made):
    got = {(r.s, r.p, r.o, r.kind) for r in made.collect()}
    assert got == {
        ("node/m%3A1", "type", "Material", "class"), ("node/m%3A1", "label", 'Ni "99"\\x\n', "string"), ("node/m%3A1", "confidence", "0.5", "double"), ("node/m%3A1", "value", "12.5", "double"), ("node/m%3A1", "year", "1999", "integer"), ("node/m%3A1", "unit", "kg", "string"), ("node/m%3A1", "alias", "a", "string"), ("node/m%3A1", "alias", "b", "string"),
        ("node/m%202%2B%2A~", "type", "Material", "class"), ("node/m%202%2B%2A~", "value", "has fallen", "string"), ("node/m%202%2B%2A~", "year", "1999.5", "string"),
        ("node/m%3A3", "label", "n", "string"), ("node/m%3A3", "confidence", "2.0", "double"),
    }


def test_ntriples_are_written(made, tmp_path):
    triples.write_ntriples(made, str(tmp_path / "out"))
    lines = {x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()}
    b = triples.BASE
    assert f'<{b}node/m%3A1> <http://www.w3.org/2000/01/rdf-schema#label> "Ni \\"99\\"\\\\x\\n" .' in lines
    assert f'<{b}node/m%3A1> <{b}ontology#value> "12.5"^^<http://www.w3.org/2001/XMLSchema#double> .' in lines
    assert f"<{b}node/m%3A1> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{b}ontology#Material> ." in lines
    assert len(lines) == made.count()


def test_edges_become_links_and_facts(spark):
    rows = [("e1", "a", "b", "about", "d1", "0.7"), ("e2", "a", "b", "about", None, "high"), ("e3", "a", "c", None, "", None), ("e4", None, "c", "about", "d", None), ("e5", "a", "", "about", "d", None)]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, type string, source_doc string, confidence string")
    fields = [Field("source_doc", "source_doc"), Field("confidence", "confidence", "double")]
    got = sorted((r.s, r.p, r.o, r.kind) for r in triples.edge_triples(edges, fields).collect())
    assert got[-2:] == [("node/a", "about", "node/b", "iri"), ("node/a", "related", "node/c", "iri")]
    assert ("fact/e1", "confidence", "0.7", "double") in got and ("fact/e2", "confidence", "high", "string") in got
    assert sum(p == "source_doc" for _, p, _, _ in got) == 1 and len(got) == 2 + 3 * 4 + 3
    assert {p for _, p, _, _ in map(tuple, triples.fact_triples(edges, fields, {"type", "confidence"}).collect())} == {"type", "confidence"}


def plain_check(rows, wanted):
    of, classes = defaultdict(list), defaultdict(set)
    for s, p, o, kind in set(rows):
        of[s, p].append((o, kind))
        if p == "type":
            classes[s].add(o)
    out = set()
    for shape in wanted:
        for s in [x for x in classes if shape.target in classes[x]]:
            for r in shape.rules:
                own, say = of[s, r.path], lambda m, n, v, r=r, s=s, shape=shape: out.add((shape.name, s, r.path, r.message or m, r.severity, n, v))
                if len(own) < r.at_least:
                    say(f"at least {r.at_least}", len(own), None)
                if r.at_most is not None and len(own) > r.at_most:
                    say(f"at most {r.at_most}", len(own), None)
                number = lambda o, k: float(o) if k in ("double", "integer") else None
                tests = [(r.datatype, f"datatype {r.datatype}", lambda o, k, r=r: k != r.datatype), (r.far, f"class {r.far}", lambda o, k, r=r: k != "iri" or min(classes[o], default="") != r.far), (r.one_of, f"one of {','.join(r.one_of)}", lambda o, k, r=r: o not in r.one_of)]
                tests += [(r.low is not None, f"at least {r.low or 0:g}", lambda o, k, r=r: number(o, k) is None or number(o, k) < r.low), (r.high is not None, f"at most {r.high or 0:g}", lambda o, k, r=r: number(o, k) is None or number(o, k) > r.high)]
                for on, told, bad in tests:
                    if on and (broken := [o for o, k in own if bad(o, k)]):
                        say(told, len(broken), min(broken))
    return out


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_shapes(spark, hot):
    rnd = random.Random(7)
    rows = [(f"n{i}", "type", rnd.choice("ABC"), "class") for i in range(60)] + [("n1", "type", "A", "class"), ("n1", "type", "B", "class")]
    for i in range(70):
        for p in ("knows", "size", "mode", "other"):
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                o, k = {"knows": (f"n{rnd.choice([0, 0, 0, rnd.randrange(80)])}", "iri"), "size": rnd.choice([("5", "integer"), ("-2.5", "double"), ("big", "string"), ("900.0", "double")]), "mode": (rnd.choice(["rule", "llm", "x"]), "string"), "other": ("z", "string")}[p]
                rows.append((f"n{i}", p, o, k))
    rows.append(("n2", "knows", "n1", "string"))
    wanted = [
        Shape("a", "A", (Rule("knows", 1, 2, far="B"), Rule("size", 1, datatype="double", low=0, high=100, severity="warning"), Rule("mode", 0, 1, one_of=("rule", "llm"), message="a mode"))),
        Shape("b", "B", (Rule("knows", far="A"), Rule("size", 2, high=10), Rule("absent", 1))),
        Shape("none", "Z", (Rule("knows", 1),)),
    ]
    got = shapes.check(spark.createDataFrame(rows, "s string, p string, o string, kind string").distinct(), wanted, hot)
    found = {tuple(r) for r in got.collect()}
    assert found == plain_check(rows, wanted)
    told = {(r.shape, r.path, r.message): (r.subjects, r.results, r.examples) for r in shapes.report(got).collect()}
    own = sorted((f, v) for s, f, p, m, _, _, v in found if (s, p, m) == ("a", "size", "datatype double"))
    assert told["a", "size", "datatype double"][0] == len(own) and told["a", "size", "datatype double"][2] == "; ".join(f"{f} ({v})" for f, v in own[:3])
    assert sum(x for x, _, _ in told.values()) == len(found)
    table = shapes.markdown(shapes.report(got)).first()[0].split("\n")
    assert len(table) == 2 + len(told) and shapes.check(got.limit(0).selectExpr("focus AS s", "path AS p", "value AS o", "severity AS kind"), wanted).count() == 0


def plain_hops(edges, starts, hops):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = set()
    for s in starts:
        seen, now = {s: 0}, {s}
        for k in range(1, hops + 1):
            now = {y for x in now for y in near[x]} - set(seen)
            seen |= dict.fromkeys(now, k)
        out |= {(s, x, k) for x, k in seen.items()}
    return out


@pytest.mark.parametrize(("n", "small"), [(1, 0), (64, 1 << 20), (65, 0), (200, 1 << 20)])
def test_many_sources_reach_what_single_ones_do(spark, monkeypatch, n, small):
    monkeypatch.setattr(reach, "SMALL", small)
    rnd = random.Random(n)
    edges = [(f"v{rnd.randrange(150)}", f"v{rnd.choice([0, rnd.randrange(150)])}") for _ in range(160)] + [("v3", "v3")]
    starts = rnd.sample([f"v{i}" for i in range(260)], n)
    table = spark.createDataFrame([*edges, ("v1", None), (None, "v2")], "src string, dst string").repartition(3)
    asked = spark.createDataFrame([(s,) for s in [*starts, starts[0], None]], "start string").repartition(2)
    for hops in (0, 1, 4):
        got = [tuple(r) for r in reach.within_hops(table, asked, hops).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_hops(edges, starts, hops)


def test_plan_of_a_hop_does_not_grow(spark):
    table = spark.createDataFrame([(f"v{i}", f"v{i + 1}") for i in range(40)], "src string, dst string")
    starts = spark.createDataFrame([("v0",)], "start string")

    def joins(hops):
        plan = reach.within_hops(table, starts, hops)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Join"), plan.count("LogicalRDD") + plan.count("LocalRelation")

    assert joins(2) == joins(8) == (1, 0)
    assert reach.within_hops(table, starts, 30).count() == 31


def test_searches_from_the_other_end(spark):
    nodes = spark.createDataFrame([("p1", "Process"), ("p2", "Process"), ("p3", "Process"), ("m1", "Material"), ("m2", "Material"), ("d1", "Publication"), ("x1", "Experiment")], "id string, type string")
    edges = spark.createDataFrame([("p1", "m1", "uses"), ("p2", "m1", "uses"), ("m2", "p3", "gives"), ("p1", "d1", "told"), ("x1", "q", "by"), ("q", "r", "by"), ("r", "p3", "by"), ("p3", "d1", "seen")], "src string, dst string, type string")
    found = lambda e: sorted(map(tuple, reach.unevidenced(nodes, e, ("uses", "gives"), ("Publication", "Experiment"), "Process", "Material").collect()))
    assert found(edges) == [("p2", "m1")]
    assert found(edges.where("type <> 'seen'")) == [("p2", "m1"), ("p3", "m2")]
    assert [r.id for r in reach.without(nodes.select("id"), edges, 0, nodes.where("type <> 'Process'")).orderBy("id").collect()] == ["p1", "p2", "p3"]
    entities = spark.createDataFrame([("p1", ["own", None]), ("p2", []), ("zz", ["own"]), (None, ["lost"])], "id string, docs array<string>")
    published = spark.createDataFrame([("d1", "doc-1")], "id string, doc_id string")
    assert sorted(map(tuple, reach.linked_documents(entities, edges, published, 1).collect())) == [("p1", "doc-1"), ("p1", "own"), ("zz", "own")]
    assert sorted(map(tuple, reach.linked_documents(entities, edges, published, 3).collect())) == [("p1", "doc-1"), ("p1", "own"), ("p2", "doc-1"), ("zz", "own")]
    star = spark.createDataFrame([("c", f"s{i:02}") for i in range(30)] + [("s00", "t0")], "src string, dst string")
    said = spark.createDataFrame([(f"s{i:02}",) for i in range(30)] + [("t0",)], "id string")
    asked = spark.createDataFrame([("c",), ("t0",)], "id string")
    got = defaultdict(list)
    for r in reach.linked_assertions(asked, star, said, 5).orderBy("entity", "distance", "id").collect():
        got[r.entity].append((r.id, r.distance))
    assert got == {"c": [(f"s{i:02}", 1) for i in range(5)], "t0": [("s00", 1)]}
    assert reach.near_kinds(star, said.where("id = 't0'").select("id", F.lit(63).alias("kind")), 2).where("id = 'c'").first().kinds == -(1 << 63)


def test_nearest_assertions_make_no_pairs_beyond_the_list(spark, monkeypatch):
    # 40 entities and 60 assertions around a hub (2,400 pairs), and a random graph; one of the assertions is an entity
    rnd = random.Random(11)
    hub = [*((f"e{i:02}", "hub") for i in range(40)), *(("hub", f"t{i:02}") for i in range(60)), ("e00", "t59"), ("t59", "e00"), ("e01", "e01"), (None, "e02")]
    loose = [(f"n{rnd.randrange(50)}", f"n{rnd.randrange(50)}") for _ in range(150)]
    said = [f"t{i:02}" for i in range(60)] + [f"n{i}" for i in range(0, 50, 3)] + ["e03"]
    asked = [f"e{i:02}" for i in range(40)] + [f"n{i}" for i in range(50)]
    table = spark.createDataFrame([*hub, *loose], "src string, dst string").repartition(3)
    ids = lambda x: spark.createDataFrame([(i,) for i in [*x, x[0], None]], "id string")
    want = set()
    hops = plain_hops([e for e in [*hub, *loose] if None not in e], asked, 2)
    for a in asked:
        want |= {(a, t, d) for d, t in sorted((d, t) for s, t, d in hops if s == a and d and t in said)[:4]}
    monkeypatch.setattr(reach, "within_hops", None)  # it makes a row for each pair
    for small in (0, 500_000):
        near = reach.nearest(table, ids(asked), ids(said), 2, 5, small)
        assert near.count() <= 5 * len(asked) and near.groupBy("id").count().agg(F.max("count")).first()[0] == 5
    assert {tuple(r) for r in reach.linked_assertions(ids(asked), table, ids(said), 4).collect()} == want


def test_search_for_targets_goes_nowhere_else(spark, monkeypatch):
    # a hub with many leaves beside the one way from s to the target t; what lies past the target isn't sought
    ends = [("s", "hub"), ("hub", "t"), ("t", "past"), *(("hub", f"leaf{i}") for i in range(50)), ("u", "s"), ("t", "s2")]
    edges = spark.createDataFrame(ends, "src string, dst string")
    starts, targets = spark.createDataFrame([("s",), ("u",), ("t",), (None,)], "start string"), spark.createDataFrame([("t",), ("t",), ("s2",), (None,)], "id string")
    for hops in (1, 2, 3):
        whole = {tuple(r) for r in reach.within_hops(edges, starts, hops).where("id IN ('t', 's2')").collect()}
        assert sorted(tuple(r) for r in reach.within_hops(edges, starts, hops, targets).collect()) == sorted(whole)
    made, bits = [], reach.bits_by_hop
    monkeypatch.setattr(reach, "bits_by_hop", lambda *a, **k: made.append(bits(*a, **k)) or made[-1])
    docs = spark.createDataFrame([("t", 7)], "id string, doc_id long")
    assert [tuple(r) for r in reach.linked_documents(spark.createDataFrame([("s", [])], "id string, docs array<long>"), edges, docs).collect()] == [("s", 7)]
    assert sorted(r.id for r in made[-1].collect()) == ["hub", "s", "t"]


def test_answers_are_read_once(spark):
    from evigrain.plans import build

    raw = '```json\n{"entities": [{"name": "a", "type": "Material"}, {"name": "b", "type": "Process"}], "relations": [{"src": "b", "dst": "a", "type": "uses_material"}]}\n```'
    nodes, edges, bad = build.payload_graph(spark.createDataFrame([("1", "d", "", raw), ("2", "d", "", "no")], "chunk_id string, doc_id string, text string, payload string"))
    assert (nodes.count(), edges.count(), [tuple(r) for r in bad.collect()]) == (2, 1, [("2", "not json")])
    assert all("from_json" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (nodes, edges, bad))


def test_repeated_texts_keep_their_own_conditions(spark):
    from evigrain.operators import conditions

    texts = ["не более 5 мм; около 7 %", "без чисел 3", "от 1 до 2 мм"]
    rows = spark.createDataFrame([(i, texts[i % 3]) for i in range(60)], "id long, text string").repartition(2)
    got = sorted((r.id, r.start, r.op, r.value) for r in conditions.extract_conditions(rows).collect())
    assert got == sorted((i, x[5], x[1], x[2]) for i in range(60) for x in conditions.find_conditions(texts[i % 3]))


def test_report_checks_once(spark):
    rows = spark.createDataFrame([("node/a", "type", "A", "class")], "s string, p string, o string, kind string")
    told = shapes.report(shapes.check(rows, [Shape("a", "A", (Rule("to", 1),))]))
    assert "bit_or(" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.path, r.subjects, r.results, r.examples) for r in told.collect()] == [("to", 1, 1, "node/a")]


def test_triples_are_made_by_compiled_expressions(spark):
    # lambdas are interpreted for every row; rows that break nothing are filtered before the arrays of broken rules
    edges = spark.createDataFrame([("e", "a", "b", "t", 0.5, None), ("f", "a", "c", "t", None, "m")], "edge_id string, src string, dst string, type string, confidence double, method string")
    facts = triples.fact_triples(edges, [Field("confidence", "confidence", "double"), Field("method", "method")], {"type", "confidence", "method"})
    assert "lambda" not in facts._jdf.queryExecution().optimizedPlan().toString()
    want = [("fact/e", "confidence", "0.5", "double"), ("fact/e", "type", "Fact", "class"), ("fact/f", "method", "m", "string"), ("fact/f", "type", "Fact", "class")]
    assert sorted(map(tuple, facts.collect())) == want
    found = shapes.check(facts, [Shape("fact", "Fact", (Rule("method", 1, one_of=("x",)), Rule("confidence", 1, 1, high=0.2)))])
    got = sorted((r.focus, r.path, r.message, r.n, r.value) for r in found.collect())
    assert got == [("fact/e", "confidence", "at most 0.2", 1, "0.5"), ("fact/e", "method", "at least 1", 0, None), ("fact/f", "confidence", "at least 1", 0, None), ("fact/f", "method", "one of x", 1, "m")]


@pytest.mark.parametrize("few", [0, 1000])
def test_subjects_described_in_one_row_answer_as_their_triples_do(spark, few):
    rnd = random.Random(11)
    rows = []
    for i in range(80):
        ends = sorted({f"n{rnd.choice([0, 0, 1, rnd.randrange(90)])}" for _ in range(rnd.choice([0, 1, 2, 5]))})
        rows.append((f"n{i}", rnd.choice(["A", "B", "C", None]), rnd.choice([None, 1.5, -2.0, 300.0]), rnd.choice([None, "", "7", "7.5", "big", "1e3", "NaN"]), rnd.choice([None, 1, 2**53 + 1]), rnd.choice([None, "rule", "x"]), rnd.choice([None, ends, ends])))
    rows += [(None, "A", 1.0, "1", 1, "x", ["n1"]), ("", "A", None, None, None, None, None), ("a b:c*~", "A", 300.0, "big", 9, "x", ["a b:c*~", "n zero"])]
    nodes = spark.createDataFrame(rows, "id string, type string, size double, text string, whole long, mode string, knows array<string>")
    fields = [Field("size", "size", "double"), Field("text", "text", "integer"), Field("whole", "whole", "integer", "A"), Field("mode", "mode")]
    wanted = [
        Shape("a", "A", (Rule("knows", 1, 2, far="B"), Rule("size", 1, 1, datatype="double", low=0, high=100), Rule("text", datatype="integer", low=1), Rule("whole", 1, high=5), Rule("absent", 1))),
        Shape("b", "B", (Rule("knows", far="A", one_of=("node/n0",), severity="warning"), Rule("mode", 1, one_of=("rule",), message="a mode"), Rule("text", 1, low=10))),
        Shape("c", "C", (Rule("knows", datatype="string", low=3), Rule("size", 0, 0))),
        Shape("none", "Z", (Rule("knows", 1),)),
    ]
    said = triples.node_triples(nodes, fields).unionByName(triples.link_triples(nodes.selectExpr("id AS src", "'knows' AS type", "explode(knows) AS dst")))
    want = {tuple(r) for r in shapes.check(said.distinct(), wanted).collect()}
    table = triples.described(nodes, fields, ("knows",))
    got = [tuple(r) for r in shapes.check_described(table, wanted, lambda x: triples.named("node", x), few=few).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert shapes.check_described(table.limit(0), wanted, lambda x: triples.named("node", x)).count() == 0


def test_facts_are_judged_where_they_are_read(spark):
    lines = [("e", "Fact", 3.0, None), ("e", "Fact", 3.0, None), ("f", "Fact", 0.5, "x"), ("f", "Fact", 2.0, "x"), ("f", "Fact", 4.0, "x"), ("g", "Fact", 0.5, "m")]
    facts = triples.described(spark.createDataFrame(lines, "id string, type string, confidence double, method string"), [Field("confidence", "confidence", "double"), Field("method", "method")])
    wanted = [Shape("fact", "Fact", (Rule("method", 1, one_of=("m",)), Rule("confidence", high=1)))]
    once = shapes.check_described(facts, wanted, lambda x: triples.named("fact", x))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString() and once.count() == 4 + 5
    # lines that come again count once, other values of a line each
    got = sorted((r.focus, r.path, r.message, r.n, r.value) for r in shapes.check_described(facts, wanted, lambda x: triples.named("fact", x), 3).collect())
    assert got == [("fact/e", "confidence", "at most 1", 1, "3.0"), ("fact/e", "method", "at least 1", 0, None), ("fact/f", "confidence", "at most 1", 2, "2.0"), ("fact/f", "method", "one of m", 1, "x")]


def test_report_finds_examples_without_sorting_what_is_broken(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), f"node/{rnd.randrange(10**6)}", rnd.choice("pq"), rnd.choice(["m", "é"]), "violation", 1, rnd.choice([None, "v"])) for _ in range(40000)]
    kinds = "shape string, focus string, path string, message string, severity string, n long, value string"
    rows = list({r[:5]: r for r in rows}.values())
    told = shapes.report(spark.createDataFrame(rows, kinds).repartition(2), 4)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow")
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[2], r[3]), []).append(r[1] + (f" ({r[6]})" if r[6] else ""))
    want = {k: (len(v), "; ".join(sorted(sorted(v, key=lambda x: x.split(" ")[0])[:4]))) for k, v in groups.items()}
    assert {(r.shape, r.path, r.message): (r.subjects, r.examples) for r in told.collect()} == want
