"""DOCX bodies as Markdown: headings, paragraphs, lists and tables in their order in the file.

The body is XML in a zip, so the standard library is enough. Text boxes, notes, headers and footers
are not part of the body. A file without a body raises, which ``files.documents`` turns into an error row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BREAKS = {"cr": "\n", "tab": "\t", "noBreakHyphen": "-"}


def _styles(z: zipfile.ZipFile) -> dict[str | None, str]:
    """Lower-cased names of paragraph styles by id; that of the default style under None."""
    if "word/styles.xml" not in z.namelist():
        return {}
    out: dict[str | None, str] = {}
    for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
        name = s.find(f"{W}name")
        if s.get(f"{W}type") != "paragraph" or name is None:
            continue
        out[s.get(f"{W}styleId")] = name.get(f"{W}val", "").lower()
        if s.get(f"{W}default") in ("1", "true", "on"):
            out[None] = name.get(f"{W}val", "").lower()
    return out


def _pieces(node: ElementTree.Element) -> Iterator[str]:
    for x in node:
        kind = x.tag.removeprefix(W)
        if kind in ("r", "hyperlink"):
            yield from _pieces(x)
        elif kind == "t":
            yield x.text or ""
        elif kind == "br":
            yield "\n" if x.get(f"{W}type", "textWrapping") == "textWrapping" else ""
        else:
            yield BREAKS.get(kind, "")


def _text(paragraph: ElementTree.Element) -> str:
    return "".join(_pieces(paragraph))


def _prefix(style: str) -> str:
    """What stands before a paragraph of this style: heading marks (level 3 where the name has no digit), a list's dash, or nothing."""
    if "heading" in style or "标题" in style:
        level = re.search(r"\d", style)
        # a level of 0 leaves only the blank
        return "#" * (min(int(level[0]), 6) if level else 3) + " "
    return "- " if style.startswith("list") or "列表" in style else ""


def _value(properties: ElementTree.Element | None, name: str, default: str) -> str | None:
    """The value of a property, ``default`` where it has none, None where it is not there."""
    x = None if properties is None else properties.find(f"{W}{name}")
    return None if x is None else x.get(f"{W}val", default)


def _rows(table: ElementTree.Element) -> list[list[str]]:
    """Cells by grid column; a cell over several columns or rows stands in each of them."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{W}tc"):
            p = tc.find(f"{W}tcPr")
            above = rows[-1] if rows and _value(p, "vMerge", "continue") == "continue" else []
            body = above[len(row)] if len(row) < len(above) else "\n".join(map(_text, tc.findall(f"{W}p"))).strip()
            row += [body] * max(1, int(_value(p, "gridSpan", "1") or 1))
        rows.append(row)
    return rows


def _table(rows: list[list[str]]) -> str:
    """Rows cut or filled to the header's width, line ends in cells as blanks (as ``files.table_to_markdown``)."""
    width = len(rows[0])
    lines = [[*r[:width], *[""] * (width - len(r))] for r in rows]
    lines.insert(1, ["---"] * width)
    return "\n".join("| " + " | ".join(c.replace("\n", " ") for c in r) + " |" for r in lines)


def markdown(body: bytes) -> str:
    """Blocks of the file's body, parted by blank lines; empty paragraphs and tables without rows are left out."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        styles = _styles(z)
        root = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    blocks = []
    for x in () if root is None else root:
        if x.tag == f"{W}p" and (line := _text(x).strip()):
            style = _value(x.find(f"{W}pPr"), "pStyle", "")
            blocks.append(_prefix(styles.get(style, styles.get(None, ""))) + line)
        elif x.tag == f"{W}tbl" and (rows := _rows(x)):
            blocks.append(_table(rows))
    return "\n\n".join(blocks)


def markdown_column(body: Column) -> Column:
    """``markdown`` of a column of bytes; null stays null, a broken file fails."""

    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else markdown(bytes(b)) for b in bodies], dtype="object")

    return F.pandas_udf(run, "string")(body)
