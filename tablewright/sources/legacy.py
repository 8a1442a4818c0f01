"""Sheets of older workbooks: the binary format of 1997 to 2003, and the XML format of 2003.

Both are read on the driver, as xlsx files are, and give cells as text.
"""

from __future__ import annotations

import datetime as dt
import struct
from xml.etree import ElementTree

from tablewright.package import StepError
from tablewright.sources.workbook import DATE_FORMATS, date_format, number_cell, sheet_name

# The container's signature and marks, and the numbers of the records that matter.
_SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
_LAST_SECTOR = 0xFFFFFFFA
EOF, DATEMODE, CONTINUE, BOUNDSHEET, MULRK, XF, SST, LABELSST = 0x0A, 0x22, 0x3C, 0x85, 0xBD, 0xE0, 0xFC, 0xFD
FORMULA, NUMBER, LABEL, BOOLERR, STRING, RK, FORMAT = 0x06, 0x203, 0x204, 0x205, 0x207, 0x27E, 0x41E
_SS = "{urn:schemas-microsoft-com:office:spreadsheet}"


def _unpack(form: str, data: bytes, at: int = 0):
    return struct.unpack_from("<" + form, data, at)


class _Container:
    """Streams of a compound file: sectors chained by an allocation table."""

    def __init__(self, data: bytes):
        if data[:8] != _SIGNATURE:
            raise StepError("This is no binary workbook")
        self.data, self.size = data, 1 << _unpack("H", data, 30)[0]
        self.small = 1 << _unpack("H", data, 32)[0]
        directory, self.cutoff, small_table = _unpack("I", data, 48)[0], _unpack("I", data, 56)[0], _unpack("I", data, 60)[0]
        listed = list(_unpack("109I", data, 76))
        more = _unpack("I", data, 68)[0]
        while more < _LAST_SECTOR:
            *several, more = _unpack(f"{self.size // 4}I", self._sector(more))
            listed += several
        self.table = [n for s in listed if s < _LAST_SECTOR for n in _unpack(f"{self.size // 4}I", self._sector(s))]
        entries = self._chain(directory)
        self.entries = [entries[k : k + 128] for k in range(0, len(entries), 128)]
        root = next(e for e in self.entries if e[66] == 5)
        self.small_stream = self._chain(_unpack("I", root, 116)[0])
        kept = self._chain(small_table)
        self.small_table = _unpack(f"{len(kept) // 4}I", kept)

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    def _chain(self, n: int) -> bytes:
        out = []
        while n < _LAST_SECTOR:
            out.append(self._sector(n))
            n = self.table[n]
        return b"".join(out)

    def stream(self, *names: str) -> bytes:
        for e in self.entries:
            name = e[: max(0, _unpack("H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            if e[66] == 2 and name in names:
                n, length = _unpack("II", e, 116)
                if length >= self.cutoff:
                    return self._chain(n)[:length]
                out = []
                while n < _LAST_SECTOR:
                    out.append(self.small_stream[n * self.small : (n + 1) * self.small])
                    n = self.small_table[n]
                return b"".join(out)[:length]
        raise StepError(f"The workbook has no stream {' or '.join(names)}")


class _Strings:
    """Text in a record and those that continue it: characters go on after a new width byte."""

    def __init__(self, chunks: list[bytes]):
        self.chunks, self.k, self.at = chunks, 0, 0

    def _take(self, n: int) -> bytes:
        out = b""
        while n > 0:
            if self.at == len(self.chunks[self.k]):
                self.k, self.at = self.k + 1, 0
            got = self.chunks[self.k][self.at : self.at + n]
            self.at += len(got)
            n -= len(got)
            out += got
        return out

    def read(self, form: str = "H") -> str:
        (count,) = struct.unpack("<" + form, self._take(struct.calcsize("<" + form)))
        flags = self._take(1)[0]
        runs = _unpack("H", self._take(2))[0] if flags & 8 else 0
        extra = _unpack("I", self._take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, ""
        while count:
            if self.at == len(self.chunks[self.k]):
                self.k, self.at = self.k + 1, 1
                wide = self.chunks[self.k][0] & 1
            n = min(count, (len(self.chunks[self.k]) - self.at) // (2 if wide else 1))
            out += self._take(2 * n).decode("utf-16-le", "replace") if wide else self._take(n).decode("latin-1")
            count -= n
        self._take(4 * runs + extra)
        return out


class BinaryWorkbook:
    """The sheets of an xls file (of version 8)."""

    def __init__(self, data: bytes):
        self.data = _Container(data).stream("Workbook", "Book")
        self.sheets: dict[str, int] = {}
        self.strings: list[str] = []
        self.epoch = dt.datetime(1899, 12, 30)
        formats, styles, shared = {}, [], []
        last = None
        for kind, body in self._records(0):
            if kind == BOUNDSHEET:
                self.sheets[_Strings([body[6:]]).read("B")] = _unpack("I", body)[0]
            elif kind == DATEMODE and _unpack("H", body)[0]:
                self.epoch = dt.datetime(1904, 1, 1)
            elif kind == FORMAT:
                formats[_unpack("H", body)[0]] = _Strings([body[2:]]).read()
            elif kind == XF:
                styles.append(_unpack("H", body, 2)[0])
            elif kind == SST or kind == CONTINUE and last == SST:
                shared.append(body)
            last = SST if kind == CONTINUE and last == SST else kind
        if shared:
            count = _unpack("I", shared[0], 4)[0]
            text = _Strings([shared[0][8:], *shared[1:]])
            self.strings = [text.read() for _ in range(count)]
        self.dates = {k for k, f in enumerate(styles) if f in DATE_FORMATS or date_format(formats.get(f, ""))}

    def _records(self, at: int):
        """(kind, body) of a part of the stream, up to its end mark."""
        while at + 4 <= len(self.data):
            kind, size = _unpack("HH", self.data, at)
            if kind == EOF:
                return
            yield kind, self.data[at + 4 : at + 4 + size]
            at += 4 + size

    def _number(self, value: float, style: int) -> str:
        return number_cell(value, self.epoch if style in self.dates else None)

    def sheet(self, which: str | int) -> list[list[str | None]]:
        cells: dict[tuple[int, int], str | None] = {}
        waiting = None
        for kind, body in self._records(self.sheets[sheet_name(list(self.sheets), which)]):
            if kind == STRING and waiting:
                cells[waiting] = _Strings([body]).read()
            if kind not in (NUMBER, RK, MULRK, LABELSST, LABEL, BOOLERR, FORMULA):
                continue
            row, column, style = _unpack("HHH", body)
            waiting = None
            if kind == NUMBER:
                cells[row, column] = self._number(_unpack("d", body, 6)[0], style)
            elif kind == RK:
                cells[row, column] = self._number(_short_number(_unpack("I", body, 6)[0]), style)
            elif kind == MULRK:
                for k in range((len(body) - 6) // 6):
                    style, packed = _unpack("HI", body, 4 + 6 * k)
                    cells[row, column + k] = self._number(_short_number(packed), style)
            elif kind == LABELSST:
                cells[row, column] = self.strings[_unpack("I", body, 6)[0]]
            elif kind == LABEL:
                cells[row, column] = _Strings([body[6:]]).read()
            elif kind == BOOLERR:
                cells[row, column] = None if body[7] else str(bool(body[6]))
            elif body[12:14] != b"\xff\xff":
                cells[row, column] = self._number(_unpack("d", body, 6)[0], style)
            elif body[6] == 0:
                waiting = (row, column)
            elif body[6] == 1:
                cells[row, column] = str(bool(body[8]))
        rows: list[list[str | None]] = []
        for row, column in sorted(cells):
            rows += [[] for _ in range(row + 1 - len(rows))]
            rows[row] += [None] * (column - len(rows[row]))
            rows[row].append(cells[row, column])
        return rows


def _short_number(packed: int) -> float:
    """A number in 30 bits: a whole one or the beginning of a double, either of them in hundredths."""
    if packed & 2:
        whole = packed >> 2
        value = float(whole - (1 << 30) if whole >= 1 << 29 else whole)
    else:
        (value,) = struct.unpack("<d", struct.pack("<Q", (packed & 0xFFFFFFFC) << 32))
    return value / 100 if packed & 1 else value


class XmlWorkbook:
    """The sheets of an XML spreadsheet."""

    def __init__(self, data: bytes):
        self.sheets = {s.get(f"{_SS}Name"): s for s in ElementTree.fromstring(data).iter(f"{_SS}Worksheet")}

    def sheet(self, which: str | int) -> list[list[str | None]]:
        rows: list[list[str | None]] = []
        for row in self.sheets[sheet_name(list(self.sheets), which)].iter(f"{_SS}Row"):
            rows += [[] for _ in range(int(row.get(f"{_SS}Index", len(rows) + 1)) - 1 - len(rows))]
            cells: list[str | None] = []
            for c in row.iter(f"{_SS}Cell"):
                cells += [None] * (int(c.get(f"{_SS}Index", len(cells) + 1)) - 1 - len(cells))
                value = c.find(f"{_SS}Data")
                cells.append(None if value is None else _xml_cell(value))
            rows.append(cells)
        return rows


def _xml_cell(value) -> str:
    text, kind = "".join(value.itertext()), value.get(f"{_SS}Type", "String")
    if kind == "Number":
        return number_cell(float(text), None)
    if kind == "Boolean":
        return str(text == "1")
    return text.split(".")[0].replace("T", " ") if kind == "DateTime" else text
