"""HTML tables and JATS articles to rows and text, as generators of a table function."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What HTML allows a cell to span.
MOST_COLUMNS_SPANNED, MOST_ROWS_SPANNED = 1000, 65534
#: Cells that leave a task in one batch.
BATCH = 20_000


class _Tables(HTMLParser):
    """Outer tables with their cells; nested tables are text of the cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.depth, self.cell, self.caption, self.head = [], 0, None, None, False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append({"caption": "", "rows": []})
        if self.depth != 1:
            return
        if tag == "caption":
            self.caption = []
        elif tag == "thead":
            self.head = True
        elif tag == "tr":
            self.tables[-1]["rows"].append({"head": self.head, "cells": []})
        elif tag in ("td", "th") and self.tables[-1]["rows"]:
            span = lambda k, most: max(1, min(most, int(attrs.get(k) or 1))) if (attrs.get(k) or "1").isdecimal() else 1
            self.cell = {"th": tag == "th", "text": [], "rows": span("rowspan", MOST_ROWS_SPANNED), "cols": span("colspan", MOST_COLUMNS_SPANNED)}
            self.tables[-1]["rows"][-1]["cells"].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.cell = None
        elif self.depth == 1:
            if tag == "caption" and self.caption is not None:
                self.tables[-1]["caption"] = " ".join("".join(self.caption).split())
                self.caption = None
            elif tag == "thead":
                self.head = False
            elif tag in ("td", "th"):
                self.cell = None

    def handle_data(self, data):
        if self.depth and self.caption is not None:
            self.caption.append(data)
        elif self.depth and self.cell is not None:
            self.cell["text"].append(data)


def _grid(rows: list) -> list:
    """Cells at their columns: row spans repeat, a data cell over several columns fills the first and marks the row."""
    out, hanging = [], {}
    for row in rows:
        line, ambiguous, cells = {}, False, iter(row["cells"])
        for c, (text, left) in list(hanging.items()):
            line[c] = text
            hanging[c] = (text, left - 1)
            if left == 1:
                del hanging[c]
        column = 0
        for cell in cells:
            while column in line:
                column += 1
            text = " ".join("".join(cell["text"]).split())
            for k in range(cell["cols"]):
                mine = text if k == 0 or cell["th"] else ""
                ambiguous |= k > 0 and not cell["th"]
                line[column + k] = mine
                if cell["rows"] > 1:
                    hanging[column + k] = (mine, cell["rows"] - 1)
            column += cell["cols"]
        width = max(line, default=-1) + 1
        all_heads = bool(row["cells"]) and all(c["th"] for c in row["cells"])
        out.append({"cells": [line.get(c, "") for c in range(width)], "head": row["head"] or all_heads, "ambiguous": ambiguous})
    return out


def extract_tables(html: str) -> list[dict]:
    """All tables with caption, headers and rows, without repeated ones.

    Header rows are those of a ``thead`` or of header cells alone, else a first row without digits;
    several header rows are joined per column.
    """
    parser = _Tables()
    parser.feed(html or "")
    out, seen = [], set()
    for table in parser.tables:
        grid = _grid(table["rows"])
        n = 0
        while n < len(grid) and grid[n]["head"]:
            n += 1
        if n == 0 and len(grid) > 1 and not re.search(r"\d", " ".join(grid[0]["cells"])):
            n = 1
        if not n or n == len(grid):
            continue
        width = max(len(r["cells"]) for r in grid)
        heads = []
        for c in range(width):
            parts = [r["cells"][c] for r in grid[:n] if c < len(r["cells"]) and r["cells"][c]]
            heads.append(" ".join(dict.fromkeys(parts)))
        body = [{**r, "cells": r["cells"] + [""] * (width - len(r["cells"]))} for r in grid[n:] if any(r["cells"])]
        key = (table["caption"], tuple(heads), tuple(tuple(r["cells"]) for r in body))
        if body and key not in seen:
            seen.add(key)
            out.append({"caption": table["caption"], "headers": heads, "rows": body})
    return out


CELLS = "table_no int, row_no int, column_no int, caption string, header string, cell string, ambiguous boolean"


def cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per cell of each table of each page."""

    names = ["key", *(x.split()[0] for x in CELLS.split(", "))]

    def found(batches):
        for pdf in batches:
            for k, text in zip(pdf["key"], pdf["html"], strict=True):
                for t, table in enumerate(extract_tables(text)):
                    for r, row in enumerate(table["rows"]):
                        for c, (h, v) in enumerate(zip(table["headers"], row["cells"], strict=True)):
                            yield k, t, r, c, table["caption"], h, v, row["ambiguous"]

    def run(batches):
        rows = found(batches)
        while out := list(islice(rows, BATCH)):
            yield pd.DataFrame(out, columns=names)

    kind = pages.schema[key].dataType.simpleString()
    out = pages.where(F.col(html).contains("<table")).select(F.col(key).alias("key"), F.col(html).alias("html"))
    return out.mapInPandas(run, f"key {kind}, {CELLS}").withColumnRenamed("key", key)


def linearised(table_cells: DataFrame, key: str) -> DataFrame:
    """Rows as ``header: cell | ...`` with their character offsets in the text of all rows of the document."""
    line = F.array_join(
        F.transform(
            F.filter(F.array_sort(F.collect_list(F.struct("column_no", "header", "cell"))), lambda x: x["cell"] != ""),
            lambda x: F.when(x["header"] == "", x["cell"]).otherwise(F.concat(x["header"], F.lit(": "), x["cell"])),
        ),
        " | ",
    )
    rows = table_cells.groupBy(key, "table_no", "row_no").agg(line.alias("line"))
    w = Window.partitionBy(key).orderBy("table_no", "row_no")
    stop = F.sum(F.length("line") + 1).over(w) - 1
    return rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("line"))


def jats(raw: str) -> dict | None:
    """Text and Methods spans of an article in XML; documents with entities or document types are refused."""
    if re.search(r"<!(ENTITY|DOCTYPE[^>]*\[)", raw):
        return None
    try:
        root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", raw))
    except ElementTree.ParseError:
        return None
    parts, methods, at = [], [], 0
    inline = lambda node: " ".join("".join(node.itertext()).split())

    def walk(node, in_methods):
        nonlocal at
        for child in node:
            tag = child.tag.rpartition("}")[2]
            if tag in ("title", "p", "article-title"):
                text = inline(child)
                if text:
                    if in_methods and tag == "p":
                        methods.append((at, at + len(text)))
                    parts.append(text)
                    at += len(text) + 2
            elif tag not in ("table-wrap", "fig", "ref-list"):
                head = next((inline(c) for c in child if c.tag.rpartition("}")[2] == "title"), "")
                named = tag == "sec" and (child.get("sec-type") or "").lower().find("method") >= 0 or bool(re.search(r"(?i)\b(methods?|experimental)\b", head))
                walk(child, in_methods or named)

    walk(root, False)
    return {"text": "\n\n".join(parts), "methods": methods} if parts else None


def full_text_accessed(text, headings):
    """Whether a page's text is an article: long, with two section headings or more."""
    return (F.length(text) >= 4000) & (F.regexp_count(headings, F.lit(r"(?i)<h[1-6][^>]*>")) >= 2)
