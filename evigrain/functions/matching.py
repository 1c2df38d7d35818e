"""Concepts in text: registry forms matched word by word, but for inflection; strings found in texts as they stand."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .text import same_word, words

#: Signs of strings that one pass over the texts looks for.
PASS_SIGNS = 4_000_000


def forms(registry: DataFrame) -> DataFrame:
    """Surface forms of a registry (concept_id, label_ru, label_en, aliases): concept_id, form."""
    every = F.array_distinct(F.array_compact(F.concat(F.array("label_ru", "label_en"), F.coalesce("aliases", F.array().cast("array<string>")))))
    return registry.select("concept_id", F.explode(every).alias("form")).where("form <> ''")


def concepts_in(docs: DataFrame, surface: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (key, concept_id) where every word of a form has a word of the text that equals it but for inflection.

    Words meet by their first 3 signs, so the theta condition runs on small buckets; the registry is broadcast
    by its checked size.
    """
    from ..operators.ranking import small

    split = surface.withColumn("_w", F.array_distinct(words(F.col("form")))).where(F.size("_w") > 0)
    asked = small(split.select("concept_id", "form", F.size("_w").alias("_n"), F.explode("_w").alias("asked")).withColumn("_p", F.left("asked", F.lit(3))))
    own = docs.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("word")).withColumn("_p", F.left("word", F.lit(3)))
    hits = own.join(asked, "_p").where(same_word(F.col("word"), F.col("asked")))
    whole = hits.groupBy(key, "concept_id", "form", "_n").agg(F.countDistinct("asked").alias("_k")).where("_k = _n")
    return whole.select(key, "concept_id").distinct()


def holding(texts: DataFrame, keys: list[str], text: str, strings: DataFrame, name: str) -> DataFrame:
    """Rows (keys, name) of texts that hold one of the ``strings`` as it stands, each once a text.

    A text is read once for all strings, by an automaton in each task, so nothing is compared in pairs and no text
    leaves its scan. More than ``PASS_SIGNS`` signs of strings take a pass for each so many. The strings (a
    registry, not a corpus) pass through the driver. An empty or null string is in no text, and a null text holds none.
    """
    asked = strings.select(F.col(name).alias("s")).where("s <> ''").distinct()
    passes = max(1, -(-(asked.agg(F.sum(F.length("s"))).first()[0] or 0) // PASS_SIGNS))
    rows = texts.select(*keys, F.col(text).alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], StructField(name, StringType())])
    out = None
    for i in range(passes):
        part = [r.s for r in asked.where(F.pmod(F.xxhash64("s"), F.lit(passes)) == i).collect()]
        found = rows.mapInArrow(_finder(part), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(strings: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, s in enumerate(strings):
            machine.add_word(s, k)
        machine.make_automaton()
        for b in batches:
            rows, found = [], []
            for r, x in enumerate(b.column(b.num_columns - 1).to_pylist() if strings else []):
                hits = {k for _, k in machine.iter(x)} if x else ()
                rows += [r] * len(hits)
                found += [strings[k] for k in hits]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:-1]), pa.array(found, pa.string())], [*b.schema.names[:-1], "s"])

    return find


def passages_in(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Pairs (key, item) of texts that hold a passage (item, passage) as it stands.

    Texts and passages meet by the longest word from inside the passage (whole, wherever the passage begins),
    and only such pairs are compared; passages of fewer than three words are looked for all at once (:func:`holding`).
    """
    from ..operators.ranking import small

    own = words(F.col("passage"))
    inner = F.array_min(F.transform(F.slice(own, F.lit(2), F.greatest(F.size(own) - 2, F.lit(0))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    asked = passages.select(item, "passage", F.when(F.size(own) >= 3, inner["w"]).alias("_w"))
    near = docs.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("_w"))
    near = near.join(small(asked.where("_w is not null").select(item, "_w")), "_w").select(key, item)
    met = docs.select(key, text).join(small(near), key).join(small(asked.select(item, "passage")), item)
    few = asked.where("_w is null").select(item, "passage")
    short = holding(docs, [key], text, few, "passage").join(small(few), "passage")
    return met.where(F.contains(F.col(text), F.col("passage"))).select(key, item).union(short.select(key, item))
