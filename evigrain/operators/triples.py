"""The property graph as typed triples, and N-Triples text.

A triple is a row s, p, o, kind: ``s`` names a node ("node/...") or a fact ("fact/...", an edge with its provenance),
``p`` is a short name, ``kind`` is how ``o`` is read: iri, class, string, double or integer. Every row of nodes and
edges makes its triples in one projection, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = "https://example.org/evidence/"
RDF, RDFS, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2001/XMLSchema#"
#: Short names that other vocabularies define.
COMMON = {"type": RDF + "type", "predicate": RDF + "predicate", "label": RDFS + "label"}
#: Columns whose values are numbers as they are; the text of others (a float has fewer digits than its double) is read.
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "double")
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Field:
    """A property ``name`` from a column (or a key of ``props``), for nodes of one ``type`` only if given.

    ``kind``: string, double or integer. Text that isn't a number stays a string, so that shapes see it.
    """

    name: str
    column: str
    kind: str = "string"
    type: str | None = None

    def said(self, columns: dict[str, str]) -> tuple[Column, Column, Column, Column]:
        """Whether there is a value, the value as text, its kind, and its number (null for text that is none)."""
        own = columns.get(self.column)
        value = F.col(self.column) if own else F.col("props")[self.column]
        there, kind = value.isNotNull(), "double" if self.kind == "double" else "long"
        if own in _NUMBERS and self.kind != "string":
            number = value.cast("double")
            whole = (number == F.floor(number)) if kind == "long" and own == "double" else F.lit(True)
            text = number.cast(kind).cast("string") if own == "double" or kind == "double" else value.cast(kind).cast("string")
            plain = F.when(whole, text).otherwise(value.cast("string")) if kind == "long" else text
        else:
            text = value.cast("string")
            there, number, whole, plain = there & (text != ""), text.try_cast("double"), F.lit(True), text
            if self.kind != "string":
                whole = text.rlike(_NUMBER)
                if kind == "long":
                    whole = whole & (number == F.floor(number))
                plain = F.when(whole, number.cast(kind).cast("string")).otherwise(text)
        there = there & (F.col("type") == self.type) if self.type else there
        return there, plain, F.when(whole, self.kind).otherwise("string"), number

    def triple(self, subject: Column, columns: dict[str, str]) -> Column:
        there, plain, kind, _ = self.said(columns)
        return F.when(there, _triple(subject, self.name, plain, kind))

    def value(self, columns: dict[str, str]) -> Column:
        """The value without its subject: there, o, kind, number. Each part is of its own, so that a rule makes no more than it compares."""
        there, plain, kind, number = self.said(columns)
        return F.struct(F.coalesce(there, F.lit(False)).alias("there"), plain.alias("o"), kind.alias("kind"), number.alias("number"))


def _triple(s: Column, p: str | Column, o: Column, kind: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(s.alias("s"), lit(p).alias("p"), o.alias("o"), lit(kind).alias("kind"))


def percent(text: Column) -> Column:
    """Percent-encoding of all but unreserved signs."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def named(kind: str, key: Column) -> Column:
    """The subject of a node or fact."""
    return F.concat(F.lit(f"{kind}/"), percent(key))


def _exploded(df: DataFrame, *arrays: Column) -> DataFrame:
    # nulls go after the explode: array_compact is a lambda, which is interpreted
    return df.select(F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("x")).where("x IS NOT NULL").select("x.*")


def node_triples(nodes: DataFrame, fields: list[Field], lists: tuple[Field, ...] = ()) -> DataFrame:
    """Triples of nodes (id, type, and the fields' columns or ``props``); ``lists`` are array columns, a triple for each item.

    Nodes without an id make none; a null type makes no class. Nulls and empty texts make no triple.
    """
    rows, columns = nodes.where(F.coalesce("id", F.lit("")) != ""), dict(nodes.dtypes)
    rows, s = rows.withColumn("_s", named("node", F.col("id"))), F.col("_s")
    plain = F.array(F.when(F.col("type").isNotNull(), _triple(s, "type", F.col("type"), "class")), *[f.triple(s, columns) for f in fields])

    def each(f: Field) -> Column:
        return F.transform(F.coalesce(f.column, F.array().cast("array<string>")), lambda x: F.when(F.coalesce(x, F.lit("")) != "", _triple(s, f.name, x, f.kind)))

    many = [each(f) for f in lists]
    return _exploded(rows, plain, *many)


def described(rows: DataFrame, fields: list[Field], links: tuple[str, ...] = ()) -> DataFrame:
    """Nodes or facts with all they say in one row: id, type, a column (there, o, kind, number) for each field, and ``links``: arrays of far ids.

    The same values as :func:`node_triples` and :func:`fact_triples`, without a row for each; ids are those of the rows.
    """
    columns = dict(rows.dtypes)
    return rows.where(F.coalesce("id", F.lit("")) != "").select("id", "type", *[f.value(columns).alias(f.name) for f in fields], *links)


def link_triples(edges: DataFrame) -> DataFrame:
    """Each distinct (src, type, dst) as a triple. Edges with an empty end make none; a null type is ``related``."""
    rows = edges.where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "")).select("src", F.coalesce("type", F.lit("related")).alias("p"), "dst").distinct()
    return rows.select(named("node", F.col("src")).alias("s"), "p", named("node", F.col("dst")).alias("o"), F.lit("iri").alias("kind"))


def fact_triples(edges: DataFrame, fields: list[Field], only: set[str] | None = None) -> DataFrame:
    """Each edge (edge_id, src, dst, type, fields) as a fact that carries its provenance; ``edge_id`` is unique.

    ``only``: the names that are wanted. Edges with an empty end make none; a null type is ``related``.
    """
    columns = dict(edges.dtypes)
    rows = edges.where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "")).withColumn("type", F.coalesce("type", F.lit("related")))
    rows = rows.withColumn("_fact", named("fact", F.col("edge_id")))
    fact, wanted = F.col("_fact"), lambda name: only is None or name in only
    fixed = {"type": (F.lit("Fact"), "class"), "factSubject": (named("node", F.col("src")), "iri"), "factObject": (named("node", F.col("dst")), "iri"), "predicate": (F.col("type"), "class")}
    made = [_triple(fact, k, o, kind) for k, (o, kind) in fixed.items() if wanted(k)]
    return _exploded(rows, F.array(*made, *[f.triple(fact, columns) for f in fields if wanted(f.name)]))


def edge_triples(edges: DataFrame, fields: list[Field]) -> DataFrame:
    """:func:`link_triples` and :func:`fact_triples` of the same edges."""
    return link_triples(edges).unionByName(fact_triples(edges, fields))


def line(triples: DataFrame) -> Column:
    """A triple as a line of N-Triples."""
    signs = F.col("o")
    for raw, told in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        signs = F.replace(signs, F.lit(raw), F.lit(told))
    iri = lambda *c: F.concat(F.lit("<"), *c, F.lit(">"))
    p = iri(F.concat(F.lit(BASE + "ontology#"), percent(F.col("p"))))
    for short, full in COMMON.items():
        p = F.when(F.col("p") == short, f"<{full}>").otherwise(p)
    told = F.when(F.col("kind") == "iri", iri(F.lit(BASE), F.col("o"))).when(F.col("kind") == "class", iri(F.lit(BASE + "ontology#"), percent(F.col("o"))))
    told = told.when(F.col("kind") == "string", F.concat(F.lit('"'), signs, F.lit('"'))).otherwise(F.concat(F.lit('"'), signs, F.lit(f'"^^<{XSD}'), F.col("kind"), F.lit(">")))
    return F.concat_ws(" ", iri(F.lit(BASE), F.col("s")), p, told, F.lit("."))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """N-Triples text files, one line a triple, as many files as there are partitions."""
    triples.select(line(triples).alias("value")).write.text(path)
