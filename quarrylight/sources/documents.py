"""Documents as bytes to text: format dispatch, decoding, cleaning; errors become a column, not a failure."""

from __future__ import annotations

import csv
import io
import os
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MOST_BYTES, MOST_CHARS, MOST_PAGES, MOST_ROWS, MOST_COLUMNS = 25_000_000, 200_000, 500, 20_000, 256
ARCHIVE_ENTRIES, ARCHIVE_BYTES = 2_000, 100_000_000
#: Tried in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "utf-16", "gb18030", "latin-1")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class DocumentError(ValueError):
    """A document that cannot be read."""


def decode(raw: bytes) -> str:
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise DocumentError("no known encoding")


def clean(text: str) -> str:
    """Line ends unified, control characters dropped, blank runs made one, bounded."""
    text = re.sub(r"\r\n?", "\n", text)
    text = re.sub(r"[\x00-\x08\x0b\x0e-\x1f]", "", text)
    lines = [line.rstrip(" \t") for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n ")[:MOST_CHARS]


def joined(parts, separator: str = "\n") -> str:
    """Parts until the budget of characters is used."""
    out, used = [], 0
    for part in parts:
        if used >= MOST_CHARS:
            break
        out.append(part[: MOST_CHARS - used])
        used += len(part) + len(separator)
    return separator.join(out)


def _archive(raw: bytes) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise DocumentError("no archive") from e
    entries = archive.infolist()
    if len(entries) > ARCHIVE_ENTRIES or sum(e.file_size for e in entries) > ARCHIVE_BYTES:
        raise DocumentError("archive is too large")
    return archive


def _xml(archive: zipfile.ZipFile, name: str):
    data = archive.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise DocumentError("document types are refused")
    return ElementTree.fromstring(data)


def read_csv(raw: bytes) -> str:
    rows = ([c.strip() for c in row] for row in csv.reader(io.StringIO(decode(raw))))
    return joined(" | ".join(c for c in row if c) for row in rows if any(row))


def read_docx(raw: bytes) -> str:
    """Paragraphs with text, then table rows as ``a | b``."""
    body = _xml(_archive(raw), "word/document.xml").find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    parts = [t for p in body.findall(f"{_W}p") if (t := text(p))]
    for row in body.iter(f"{_W}tr"):
        cells = [text(c) for c in row.findall(f"{_W}tc")]
        if any(cells):
            parts.append(" | ".join(c for c in cells if c))
    return joined(parts)


def read_xlsx(raw: bytes) -> str:
    """Per sheet a heading and its rows, cells joined by `` | ``."""
    archive = _archive(raw)
    names = archive.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(archive, "xl/sharedStrings.xml").findall(f"{_S}si")]
    titles = [s.get("name") for s in _xml(archive, "xl/workbook.xml").iter(f"{_S}sheet")]
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    parts = []
    for title, name in zip(titles, sheets, strict=False):
        parts.append(f"# Sheet: {title}")
        for n, row in enumerate(_xml(archive, name).iter(f"{_S}row")):
            if n >= MOST_ROWS:
                break
            cells = []
            for c in list(row.findall(f"{_S}c"))[:MOST_COLUMNS]:
                v = c.find(f"{_S}v")
                value = "" if v is None else (v.text or "")
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells.append(value.strip())
            if any(cells):
                parts.append(" | ".join(c for c in cells if c))
    return joined(parts)


def read_pdf(raw: bytes) -> str:
    """Pages joined with form feeds, where a PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise DocumentError("no PDF library is installed") from e
    return joined((page.extract_text() or "" for page in list(PdfReader(io.BytesIO(raw)).pages)[:MOST_PAGES]), "\f")


READERS = {".csv": read_csv, ".docx": read_docx, ".xlsx": read_xlsx, ".pdf": read_pdf, ".txt": decode, ".md": decode, ".markdown": decode}


def parse_document(name: str, raw: bytes) -> tuple[str, str]:
    """(title, text) of a file; the title is its stem."""
    if not raw:
        raise DocumentError("empty file")
    if len(raw) > MOST_BYTES:
        raise DocumentError("file is too large")
    title, ext = os.path.splitext(os.path.basename(name))
    reader = READERS.get(ext.lower())
    if reader is None:
        raise DocumentError(f"unsupported format {ext!r}")
    text = clean(reader(raw))
    if not text:
        raise DocumentError("no text")
    return title, text


def parsed(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files to ``path``, ``title``, ``text`` and ``parse_error`` (null where it worked)."""

    def run(batches):
        for pdf in batches:
            out = []
            for name, raw in zip(pdf[path], pdf[content], strict=True):
                try:
                    out.append((name, *parse_document(name, bytes(raw or b"")), None))
                except (DocumentError, KeyError, IndexError, csv.Error, ElementTree.ParseError) as e:
                    out.append((name, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "title", "text", "parse_error"])

    return files.select(path, content).mapInPandas(run, "path string, title string, text string, parse_error string")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder, parsed where they are read."""
    return parsed(spark.read.format("binaryFile").load(folder))
