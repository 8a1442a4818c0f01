"""Sheets of xlsx workbooks with the standard library: a zip of XML files, read on the driver."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree

from tablewright.package import StepError

# Names of the format, and its built-in numbers of date and time formats.
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


class Workbook:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        rels = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        book = self._xml("xl/workbook.xml")
        self.sheets = {s.get("name"): "xl/" + rels[s.get(_REL)].removeprefix("/xl/") for s in book.iter(f"{_NS}sheet")}
        self.epoch = dt.datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_NS}workbookPr")) else dt.datetime(1899, 12, 30)
        self.strings = self._strings()
        self.dates = self._date_styles()

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        return ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in self._xml("xl/sharedStrings.xml")]

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        styles = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_NS}numFmt") if date_format(f.get("formatCode", ""))}
        cells = next(styles.iter(f"{_NS}cellXfs"), [])
        return {k for k, x in enumerate(cells) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def sheet(self, which: str | int) -> list[list[str | None]]:
        """Rows of a sheet by name or number (from 1), cells as text."""
        which = sheet_name(list(self.sheets), which)
        rows: list[list[str | None]] = []
        for row in self._xml(self.sheets[which]).iter(f"{_NS}row"):
            at = int(row.get("r", len(rows) + 1))
            while len(rows) < at - 1:
                rows.append([])
            cells: list[str | None] = []
            for c in row.iter(f"{_NS}c"):
                k = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (k - len(cells))
                cells.append(self._cell(c))
            rows.append(cells)
        return rows

    def _cell(self, c) -> str | None:
        kind, value = c.get("t", "n"), c.find(f"{_NS}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
        if value is None or value.text is None:
            return None
        if kind == "s":
            return self.strings[int(value.text)]
        if kind == "b":
            return "True" if value.text == "1" else "False"
        if kind != "n":
            return value.text
        return number_cell(float(value.text), self.epoch if int(c.get("s", 0)) in self.dates else None)


def number_cell(number: float, epoch: dt.datetime | None) -> str:
    """A number's text; with an epoch, that of the time so many days after it."""
    if epoch is not None:
        when = epoch + dt.timedelta(days=number)
        return str((when + dt.timedelta(microseconds=500)).replace(microsecond=0))
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def date_format(code: str) -> bool:
    """Whether a number format's code shows dates or times."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code.lower())))


def sheet_name(names: list[str], which: str | int) -> str:
    """A sheet's name, from its name or number (from 1)."""
    if isinstance(which, int) or str(which).isdigit() and str(which) not in names:
        if not 1 <= int(which) <= len(names):
            raise StepError(f"There is no sheet {which}; the workbook has {len(names)}")
        return names[int(which) - 1]
    if which not in names:
        raise StepError(f"There is no sheet {which!r}; there are {names}")
    return which


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheet_names(book: Workbook, sheet, by_regex: bool, separator: str | None) -> list[str | int] | None:
    """The sheets that a pattern, a range like 1-3 or a separated list means; None for a plain name or number."""
    if by_regex:
        found = [n for n in book.sheets if re.match(str(sheet), n)]
    elif isinstance(sheet, str) and (re.match(r"\d+-\d+$", sheet) or (separator and separator in sheet)):
        found = []
        for part in sheet.split(separator) if separator else [sheet]:
            m = re.match(r"(\d+)-(\d+)$", part)
            found += range(int(m[1]), int(m[2]) + 1) if m else [int(part) if part.isdigit() else part]
    else:
        return None
    if not found:
        raise StepError("No sheets found with the given parameters")
    return found
