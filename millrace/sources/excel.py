"""Sheets of xlsx workbooks as rows of text.

A workbook is a zip of XML parts; it is read where it lies, one workbook a task, rows as they come.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: number formats of dates and times that need no definition
_DATES = frozenset([*range(14, 23), *range(45, 48)])


def _column(ref: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """The runs of a string; phonetic hints are no part of it."""
    return "".join(t.text or "" for child in node if child.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([child] if child.tag == f"{_MAIN}t" else child.iter(f"{_MAIN}t")))


class Workbook:
    def __init__(self, content: bytes):
        if not content.startswith(b"PK"):
            raise ValueError("not an xlsx workbook (older xls files must be saved as xlsx)")
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target") for r in links}
        self.sheets = [(s.get("name"), "xl/" + target[s.get(f"{_REL}id")].removeprefix("/xl/")) for s in book.iter(f"{_MAIN}sheet")]
        about = book.find(f"{_MAIN}workbookPr")
        self.epoch = datetime(1904, 1, 1) if about is not None and about.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self.strings = [_text(si) for si in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode") or "") for f in styles.iter(f"{_MAIN}numFmt")}
            xfs = styles.find(f"{_MAIN}cellXfs")
            ids = [int(x.get("numFmtId") or 0) for x in (xfs if xfs is not None else [])]
            self.dates = [i in _DATES or bool(re.search(r"[ymdhs]", own.get(i, ""), re.I)) for i in ids]

    def rows(self, sheet: str | int = 0) -> Iterator[list[str | None]]:
        """Rows from the first on; rows that are left out are empty ones."""
        path = self.sheets[sheet][1] if isinstance(sheet, int) else dict(self.sheets)[sheet]
        at = 0
        with self.zip.open(path) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{_MAIN}row":
                    continue
                here = int(node.get("r") or at + 1) - 1
                for _ in range(here - at):
                    yield []
                at, out = here + 1, []
                for cell in node.iter(f"{_MAIN}c"):
                    k = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (k + 1 - len(out))
                    out[k] = self._value(cell)
                yield out
                node.clear()

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            held = cell.find(f"{_MAIN}is")
            return None if held is None else _text(held)
        v = cell.find(f"{_MAIN}v")
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "true" if v.text == "1" else "false"
        style = int(cell.get("s") or 0)
        if kind == "n" and style < len(self.dates) and self.dates[style]:
            moment = self.epoch + timedelta(seconds=round(float(v.text) * 86400))
            return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
        return v.text.removesuffix(".0") if kind == "n" else v.text


def table(content: bytes, sheet: str | int = 0, header_row: int | None = 0, skip_footer: int = 0) -> Iterator[list[str | None]]:
    """The header (where there is one), then the rows under it; empty rows go, and the last ``skip_footer`` ones."""
    held: list[list[str | None]] = []
    for i, row in enumerate(Workbook(content).rows(sheet)):
        if header_row is not None and i == header_row:
            yield row
        elif i > (-1 if header_row is None else header_row) and any(v not in (None, "") for v in row):
            held.append(row)
            if len(held) > skip_footer:
                yield held.pop(0)
