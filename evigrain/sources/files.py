"""Files, archives and office documents as DataFrames.

Spark lists and reads the files (``binaryFile``, any store it can open); archives and office documents, which
are zip files, are opened in Arrow batches from the bytes. Formats that need an outside tool (rar, 7z, old
binary office files, scanned pages) come out with a status, not an error.
"""

from __future__ import annotations

import bisect
import io
import itertools
import lzma
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is read, what holds other files, and limits.
READ = (".pdf", ".docx", ".docm", ".doc", ".pptx", ".xlsx", ".xls", ".txt", ".md", ".html", ".htm")
HELD = (".zip", ".rar", ".7z")
SKIPPED = (".DS_Store", "Thumbs.db")
MOST_BYTES, MOST_DEPTH, THIN_PAGE = 2 * 1024**3, 3, 50
#: Extensions of the pieces of one archive: its bytes, cut.
VOLUME = r"^\.\d{3}$"
FILES = "path string, modificationTime timestamp, length long, content binary"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder tree: path, filename, ext, length, content, status (``ok``, ``archive`` or ``skipped``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return classify(files)


def classify(files: DataFrame) -> DataFrame:
    """Adds filename, ext, part and status. All volumes of an archive cut in numbered pieces (.001, .002) are ``archive``; of another split archive the first is."""
    name = F.substring_index("path", "/", -1)
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
    part = F.coalesce(F.regexp_extract(F.lower("filename"), r"\.part(\d+)\.rar$", 1).try_cast("int"), F.regexp_extract("filename", r"\.(\d{3})$", 1).try_cast("int"))
    status = (
        F.when(F.col("filename").isin(*SKIPPED), "skipped")
        .when(F.col("ext").rlike(VOLUME), "archive")
        .when(F.coalesce(F.col("part"), F.lit(1)) != 1, "skipped")
        .when(F.col("ext").isin(*HELD) | F.col("part").isNotNull(), "archive")
        .when(F.col("ext").isin(*READ), "ok")
        .otherwise("skipped")
    )
    return files.withColumn("filename", name).withColumns({"ext": ext, "part": part}).withColumn("status", status)


#: What reading a broken archive or document raises.
BROKEN = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError, NotImplementedError, ElementTree.ParseError, ValueError, LookupError)


class _Room:
    """Bytes an archive may still unpack to, whatever sizes it declares."""

    def __init__(self, left: int):
        self.left = left

    def read(self, z: zipfile.ZipFile, member: zipfile.ZipInfo) -> bytes | None:
        with z.open(member) as f:
            body = f.read(self.left + 1)
        self.left -= len(body)
        return body if self.left >= 0 else None


class _Joined(io.RawIOBase):
    """The volumes of an archive as one run of bytes: what is read is copied, no more."""

    def __init__(self, volumes: list[bytes]):
        super().__init__()
        self.volumes, self.at = [memoryview(v) for v in volumes], 0
        self.starts = [0, *itertools.accumulate(map(len, volumes))]

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        base = {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.starts[-1]}[whence]
        if base + offset < 0:
            raise OSError("before the beginning")
        self.at = base + offset
        return self.at

    def readinto(self, buffer) -> int:
        k = bisect.bisect_right(self.starts, self.at) - 1
        if k >= len(self.volumes):
            return 0
        piece = self.volumes[k][self.at - self.starts[k] :][: len(buffer)]
        buffer[: len(piece)] = piece
        self.at += len(piece)
        return len(piece)


def _members(path: str, raw: bytes | io.IOBase, room: _Room, depth: int = 1) -> Iterator[tuple[str, bytes | None, str]]:
    """Files in a zip archive, nested ones too: path in the archive, bytes, status. A broken member costs itself alone."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw) if isinstance(raw, bytes) else raw)
        members = [i for i in z.infolist() if not i.is_dir()]
    except BROKEN as e:
        yield path, None, f"failed: {type(e).__name__}"
        return
    for i in members:
        own = f"{path}/{i.filename}"
        try:
            body = room.read(z, i)
        except BROKEN as e:
            yield own, None, f"failed: {type(e).__name__}"
            continue
        if body is None:
            yield path, None, "too large"
            return
        if i.filename.lower().endswith(".zip") and depth < MOST_DEPTH:
            yield from _members(own, body, room, depth + 1)
        else:
            yield own, body, "ok"


_MEMBERS = "path string, content binary, origin string, error string"


def _batches(found: Iterator[tuple[str, bytes | None, str]]) -> Iterator[pa.RecordBatch]:
    for m, body, state in found:
        yield pa.record_batch([pa.array([m]), pa.array([body], pa.binary()), pa.array(["archive"]), pa.array([state])], [x.split(" ")[0] for x in _MEMBERS.split(", ")])


def _volumes(key: tuple, table: pa.Table) -> pa.Table:
    """What the volumes of one archive hold; all of them are needed, each once."""
    path, table = key[0].as_py(), table.sort_by("part")
    parts = table["part"].to_pylist()
    if parts != list(range(1, len(parts) + 1)):
        lost = next((k for k in range(1, max(parts) + 1) if k not in parts), None)
        found = iter([(path, None, f"failed: volume {lost} is missing" if lost else "failed: a volume stands twice")])
    else:
        found = _members(path, io.BufferedReader(_Joined([x or b"" for x in table["content"].to_pylist()])), _Room(MOST_BYTES))
    return pa.Table.from_batches(list(_batches(found)), pa.schema([("path", pa.string()), ("content", pa.binary()), ("origin", pa.string()), ("error", pa.string())]))


def expand(files: DataFrame) -> DataFrame:
    """Files of :func:`classify` with archives replaced by what they hold (path, content, origin, error), classified anew.

    A member that can't be read has no content, and its ``status`` says so ("failed: ...", "too large"). Numbered volumes
    are one archive, named without the number; a missing one fails it. An archive's volumes meet in one task, at most
    ``MOST_BYTES`` of what they hold come out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _batches(_members(path, raw or b"", _Room(MOST_BYTES)))

    plain = files.where("status = 'ok'").select("path", "content", F.lit("direct").alias("origin"), F.lit("ok").alias("error"))
    held = files.where("status = 'archive'")
    cut = F.col("ext").rlike(VOLUME)
    whole = held.where(~cut).select("path", "content").mapInArrow(work, _MEMBERS)
    volumes = held.where(cut).select(F.regexp_replace("path", r"\.\d{3}$", "").alias("_base"), "part", "content").groupBy("_base").applyInArrow(_volumes, _MEMBERS)
    out = classify(plain.unionByName(whole).unionByName(volumes))
    return out.withColumn("status", F.when(F.col("error") == "ok", F.col("status")).otherwise(F.col("error")))


def _paragraphs(node: ElementTree.Element, tag: str) -> list[str]:
    return ["".join(x.text or "" for x in p.iter() if x.tag.endswith("}t")) for p in node.iter() if p.tag.endswith(tag)]


def docx_pages(raw: bytes) -> list[tuple[int, str]]:
    """One page: paragraphs, and table rows with cells joined by `` | ``."""
    body = next(iter(ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))), ())
    out = []
    for x in body:
        if x.tag.endswith("}tbl"):
            for row in (r for r in x.iter() if r.tag.endswith("}tr")):
                out.append(" | ".join(" ".join(filter(None, _paragraphs(c, "}p"))) for c in row if c.tag.endswith("}tc")))
        elif x.tag.endswith("}p"):
            out.append("".join(t.text or "" for t in x.iter() if t.tag.endswith("}t")))
    return [(1, "\n".join(s for s in out if s.strip()))]


def pptx_pages(raw: bytes) -> list[tuple[int, str]]:
    """A page for each slide."""
    z = zipfile.ZipFile(io.BytesIO(raw) if isinstance(raw, bytes) else raw)
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return [(k, "\n".join(s for s in _paragraphs(ElementTree.fromstring(z.read(n)), "}p") if s.strip())) for k, n in slides]


def xlsx_pages(raw: bytes) -> list[tuple[int, str]]:
    """A page for each sheet: its name, then a line for each row, cells joined by tabs."""
    z = zipfile.ZipFile(io.BytesIO(raw) if isinstance(raw, bytes) else raw)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]
    sheets = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    pages = []
    for k, (_, n) in enumerate(sheets):
        lines = [f"# sheet: {titles[k] if k < len(titles) else n}"]
        for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if r.tag.endswith("}row")):
            cells = []
            for c in row:
                text = next((x.text or "" for x in c.iter() if x.tag.endswith(("}v", "}t"))), "")
                known = c.get("t") == "s" and text.isdigit() and int(text) < len(shared)
                cells.append(shared[int(text)] if known else text)
            if any(cells):
                lines.append("\t".join(cells))
        pages.append((k + 1, "\n".join(lines)))
    return pages


def _plain(raw: bytes) -> list[tuple[int, str]]:
    return [(1, raw.decode("utf-8", errors="replace"))]


READERS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {".docx": docx_pages, ".docm": docx_pages, ".pptx": pptx_pages, ".xlsx": xlsx_pages, ".txt": _plain, ".md": _plain}


def pages(files: DataFrame, readers: dict[str, Callable[[bytes], list[tuple[int, str]]]] | None = None) -> DataFrame:
    """Pages of files: path, page_no, text, thin (little text: a scan), status (``ok``, ``failed`` or ``unsupported``).

    A reader for another format (PDF, say) is passed in ``readers``; a file that can't be read has one row, and so has
    one that :func:`expand` could not take out of its archive (``failed``).
    """
    known = READERS | (readers or {})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, ext, raw, lost in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    found, state = ([(0, None)], "failed") if lost else (known[ext](raw or b""), "ok") if ext in known else ([(0, None)], "unsupported")
                except BROKEN:
                    found, state = [(0, None)], "failed"
                yield pa.record_batch([pa.array([path] * len(found)), pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.string()), pa.array([state] * len(found))], ["path", "page_no", "text", "status"])

    lost = (F.col("error") != "ok") if "error" in files.columns else F.lit(False)
    out = files.select("path", "ext", "content", lost.alias("lost")).mapInArrow(work, "path string, page_no int, text string, status string")
    return out.withColumn("thin", is_thin(F.col("text")))


def is_thin(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < THIN_PAGE
