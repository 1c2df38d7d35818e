"""Documents to chunks.

A document's blocks (paragraphs and tables) are found, cleaned and marked as headings by column expressions.
Where chunks begin and end is a matter of lengths alone: the blocks lie one after another in one text, each
with the place of its end, and a chunk is a slice of that text, from some signs before its first block to the
last end within reach, found by bisection. Only these borders are set in Python, over Arrow batches; a
document's pages are an array in its row, and its chunks too, so there is one shuffle, by document.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contents_page, count_of, script_language, token_estimate


@dataclass(frozen=True)
class Sizes:
    """Sizes in characters (fixed values of the data model)."""

    target: int = 3500
    overlap: int = 350
    most: int = 4200
    least: int = 120
    heading: int = 90

    def __post_init__(self):
        if self.target + self.overlap + len(GAP) > self.most:
            raise ValueError("a block of the target size and the overlap must fit a chunk")


GAP = "\n\n"
_LINE = re.compile("\n")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")


def is_heading(line: Column, most: int = 90) -> Column:
    """A numbered line, or a short one that is mostly capitals and doesn't end like a sentence."""
    letters, capitals = count_of(line, "[A-Za-zА-Яа-яЁё]"), count_of(line, r"\p{Lu}")
    titled = (letters > 0) & (2 * capitals > letters) & ~line.rlike("[.,;:]$") & (F.size(F.split(line, r"\s+")) <= 10)
    usable = F.length(line).between(1, most) & ~line.rlike(r"\.{4,}\s*\d*\s*$")
    return usable & (line.rlike(r"^\d+(?:\.\d+){0,3}\.?\s+\S") | titled)


def blocks(text: Column, heading: int = 90) -> Column:
    """The blocks of a page: text with wrapped lines joined (tables keep theirs), and the heading or null."""

    def ends_off(c: Column) -> Column:
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    def block(c: Column) -> Column:
        line = ends_off(F.substring_index(c, "\n", 1))
        joined = F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n[ \t]*", " "), r"[ \t]{2,}", " ")
        return F.struct(F.when(F.contains(c, F.lit("\t")), c).otherwise(joined).alias("text"), F.when(is_heading(line, heading), line).alias("title"))

    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), ends_off)
    return F.transform(F.filter(parts, lambda x: x != ""), block)


def cuts(text: str, limit: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit``: to the last end of a line (in a table) or sentence within reach, else anywhere."""
    gaps = [] if len(text) <= limit else [m.span() for m in (_LINE if "\n" in text else _SENTENCE).finditer(text)]
    ends = [a for a, _ in gaps] + [len(text)]
    out, at = [], 0
    while at < len(text):
        k = bisect_right(ends, at + limit) - 1
        fits = k >= 0 and ends[k] > at
        end = ends[k] if fits else at + limit
        out.append((at, end))
        at = end if not fits or k == len(gaps) else gaps[k][1]
    return [(a, b) for a, b in out if not text[a:b].isspace()]


def slices(spans: list[tuple[int, int]], sizes: Sizes) -> Iterator[tuple[int, int, int, int]]:
    """For spans of a text in order: start and end of each chunk, and its first and last own span."""
    ends = [b for _, b in spans]
    at, tail = 0, 0
    while at < len(spans):
        start = max(spans[at][0] - tail, 0)
        last = max(at, bisect_right(ends, start + sizes.target) - 1)
        if ends[last] - start >= sizes.least:
            yield start, ends[last], at, last
            tail = min(sizes.overlap, ends[last] - start) + len(GAP)
        at = last + 1


def chunks(found: list[tuple[int, str, str | None]], sizes: Sizes = Sizes()) -> list[tuple[str, int, int, str | None]]:
    """Chunks of a document's blocks (page, text, heading): text, first and last page, heading above.

    Each chunk starts with the end of the one before.
    """
    parts, pages, titles, title = [], [], [], None
    for page, text, heading in found:
        title = heading or title
        for a, b in cuts(text, sizes.target):
            parts.append(text[a:b].rstrip())
            pages.append(page)
            titles.append(title)
    starts = [*accumulate((len(p) + len(GAP) for p in parts), initial=0)]
    whole = GAP.join(parts)
    spans = [(a, a + len(p)) for a, p in zip(starts, parts, strict=False)]
    out = [(whole[a:b].strip(), i, j) for a, b, i, j in slices(spans, sizes)]
    return [(text, min(pages[i : j + 1]), max(pages[i : j + 1]), next((x for x in titles[i : j + 1] if x), None)) for text, i, j in out if len(text) >= sizes.least]


def repeated_lines(pages: DataFrame, share: float = 0.4, least: int = 3) -> DataFrame:
    """Lines of 3 to 80 signs on ``share`` of a document's pages, of ``least`` at least: doc_id, line, n_pages.

    ``pages``: doc_id, page_no, text. Documents of fewer than 4 pages have none.
    """
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages >= 4")
    lines = pages.select("doc_id", "page_no", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line"))
    lines = lines.where(F.length("line").between(3, 80)).groupBy("doc_id", "line").agg(F.countDistinct("page_no").alias("n_pages"))
    return lines.join(total, "doc_id").where(F.col("n_pages") >= F.greatest(F.lit(least), F.floor(share * F.col("pages")))).select("doc_id", "line", "n_pages")


def strip_repeated(pages: DataFrame) -> DataFrame:
    """Pages without running headers and bare page numbers."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("k", "raw")).withColumn("line", F.trim("raw"))
    lines = lines.where(~F.col("line").rlike(r"^[-–—\s]*\d{1,4}[-–—\s]*$"))
    kept = lines.join(repeated_lines(pages).select("doc_id", "line"), ["doc_id", "line"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "raw"))), lambda x: x["raw"]), "\n")
    kept = kept.groupBy("doc_id", "page_no").agg(text.alias("text"))
    return pages.select("doc_id", "page_no").join(kept, ["doc_id", "page_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


_CHUNK = pa.struct([("text", pa.string()), ("page_from", pa.int32()), ("page_to", pa.int32()), ("section_title", pa.string())])
#: Signs of chunks that go back to Spark together.
BATCH = 1 << 20


def _chunk_rows(keys: list[str | None], own: list[list[dict]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(keys, pa.string()), pa.array(own, pa.list_(_CHUNK))], ["doc_id", "chunks"])


def chunk_batches(batches: Iterator[pa.RecordBatch], sizes: Sizes = Sizes()) -> Iterator[pa.RecordBatch]:
    """Batches of documents (doc_id, pages) to batches of their chunks, a document at a time.

    A batch has thousands of documents, and their texts as Python objects would take many times its size.
    """
    for b in batches:
        keys, own, size = [], [], 0
        for key, doc in zip(b.column(0), b.column(1), strict=True):
            found = chunks([(p["page_no"], x["text"], x["title"]) for p in doc.as_py() for x in p["blocks"]], sizes)
            keys.append(key.as_py())
            own.append([dict(zip(("text", "page_from", "page_to", "section_title"), c, strict=True)) for c in found])
            size += sum(len(c[0]) for c in found)
            if size >= BATCH:
                yield _chunk_rows(keys, own)
                keys, own, size = [], [], 0
        yield _chunk_rows(keys, own)


def chunk_documents(pages: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of documents given as pages (doc_id, page_no, text): the columns of the chunk table.

    Tables of contents are dropped; ``seq`` counts what is left.
    """
    found = pages.select("doc_id", "page_no", blocks(F.col("text"), sizes.heading).alias("blocks"))
    docs = found.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("page_no", "blocks"))).alias("pages"))

    made = docs.mapInArrow(lambda batches: chunk_batches(batches, sizes), "doc_id string, chunks array<struct<text string, page_from int, page_to int, section_title string>>")
    kept = made.select("doc_id", F.posexplode(F.filter("chunks", lambda c: ~contents_page(c["text"]))).alias("seq", "c"))
    text = F.col("c.text")
    return kept.select(F.format_string("%s_c%04d", "doc_id", "seq").alias("chunk_id"), "doc_id", "seq", text.alias("text"), token_estimate(text).alias("n_tokens"), "c.page_from", "c.page_to", script_language(text).alias("lang"), "c.section_title")


def chunk_by_lines(docs: DataFrame, target: int = 900, overlap: int = 100, least: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The other chunker: lines to chunks of about ``target`` tokens (4 signs each): key, seq, text.

    A chunk begins with the last lines of the one before that have ``overlap`` tokens together; chunks of
    ``least`` signs or fewer are dropped. Lengths decide alone, so borders are set over an array of running
    sums and the texts are cut from the array of lines.
    """
    line = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\r", "\n"), r"[ \t\u00a0]+", " ")
    lines = F.filter(F.transform(F.split(line, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select(key, lines.alias("lines")).withColumn("sizes", F.transform("lines", lambda x: F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for sizes in b.column(2).to_pylist():
                sums, at, start, own = [*accumulate(sizes, initial=0)], 0, 0, []
                while at < len(sizes):
                    last = max(at, bisect_right(sums, sums[start] + target) - 2)
                    own.append([start + 1, last - start + 1])  # as ``slice`` counts
                    start, at = max(start, bisect_right(sums, sums[last + 1] - overlap) - 1), last + 1
                found.append(own)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.list_(pa.list_(pa.int32())))], [key, "lines", "borders"])

    kind = dict(docs.dtypes)[key]
    made = rows.mapInArrow(borders, f"`{key}` {kind}, lines array<string>, borders array<array<int>>")
    texts = F.transform("borders", lambda x: F.array_join(F.slice("lines", x[0], x[1]), "\n"))
    return made.select(key, F.posexplode(F.filter(texts, lambda x: F.length(x) > least)).alias("seq", "text"))
