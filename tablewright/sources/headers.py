"""Where a text file's header and data begin, and what the columns are called."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.regex import matches_start
from tablewright.package import ROW_ID, StepError


@dataclass(frozen=True)
class Skips:
    """Rows to pass over: by number, by how they begin, by pattern, or because they are blank."""

    numbers: frozenset[int]
    prefixes: tuple[str, ...]
    patterns: tuple[str, ...]

    @classmethod
    def of(cls, rules) -> Skips:
        rules = rules or []
        listed = [r.get("value") if isinstance(r, dict) and r.get("type") != "regex" else r for r in rules]
        return cls(
            frozenset(r for r in listed if isinstance(r, int)),
            tuple(r for r in listed if isinstance(r, str)),
            tuple(r["value"] for r in rules if isinstance(r, dict) and r.get("type") == "regex"),
        )

    def __bool__(self) -> bool:
        return bool(self.numbers or self.prefixes or self.patterns)

    def hit(self, number: int, line: str) -> bool:
        return number in self.numbers or any((line.startswith(p) if p else not line.strip()) for p in self.prefixes) or any(re.match(p, line) for p in self.patterns)

    def column(self, line: Column, number: Column) -> Column:
        out = number.isin(*self.numbers) if self.numbers else F.lit(False)
        for p in self.prefixes:
            out = out | (line.startswith(p) if p else F.trim(line) == "")
        for p in self.patterns:
            out = out | line.rlike(matches_start(p))
        return out


def header_rows(spec) -> tuple[int, int] | None:
    """(first, last) header row, counted from 1; None without headers."""
    if spec is None or spec is False or spec == 0:
        return None
    if isinstance(spec, (list, tuple)):
        return int(spec[0]), int(spec[-1])
    return int(spec), int(spec)


@dataclass(frozen=True)
class Layout:
    names: list[str | None]
    first_data: int
    """Lines before this one (from 0) are no data."""


def lay_out(lines: list[str], cells: Callable[[str], list[str]], headers, skips: Skips, joiner: str = " ", repeats: bool = False) -> Layout:
    """Names from the header rows (rows that are skipped aren't counted) and where data begins."""
    span = header_rows(headers)
    seen, at, rows = 0, 0, []
    for at, line in enumerate(lines):
        if skips.hit(at + 1, line):
            continue
        seen += 1
        if span is None:
            return Layout([f"col{k + 1}" for k in range(len(cells(line)))], at)
        if seen >= span[0]:
            rows.append(cells(line))
        if seen == span[1]:
            break
    if span is None:
        return Layout([], 0)
    if not rows:
        raise StepError("The file has no header row")
    width = len(rows[0])
    names = []
    for k in range(max(len(r) for r in rows)):
        parts = [r[k] for r in rows if k < len(r)]
        if not repeats:
            parts = [p for n, p in enumerate(parts) if n == 0 or p != parts[n - 1] or not p]
        names.append(joiner.join(parts) if k < width or any(parts) else "")
    return Layout(names, at + 1)


def settle_names(names: list[str], deduplicate: bool, ignore_blank: bool = True) -> list[str | None]:
    """Final names; None where a blank header says that the column is to be left out."""
    blank = [not n.strip() for n in names]
    count = Counter(n for n, b in zip(names, blank, strict=True) if not b)
    twice = sorted(n for n, c in count.items() if c > 1)
    if twice and not deduplicate:
        raise StepError(f"Found duplicate headers: {twice}. Set deduplicate_headers to number them")
    seen: Counter = Counter()
    out: list[str | None] = []
    for n, b in zip(names, blank, strict=True):
        if b:
            out.append(None)
        elif count[n] > 1:
            seen[n] += 1
            out.append(f"{n} ({seen[n]})")
        else:
            out.append(n)
    return out if ignore_blank else [n if n is not None else f"col{k + 1}" for k, n in enumerate(out)]


def captured(lines: list[str], rules: list[dict] | None, join: bool, joiner: str) -> list[tuple[str, str]]:
    """Constant columns (name, value) from lines before the data, by the first group of a pattern."""
    found: dict[str, list[str]] = {}
    for line in lines:
        for rule in rules or []:
            m = re.match(rule["regex"], line)
            if m and m.groups():
                found.setdefault(rule["column_name"], []).append(m[1])
    if join:
        return [(n, joiner.join(v)) for n, v in found.items()]
    return [(n, x) for n, v in found.items() for x in v]


def after(first: int) -> Column:
    """Lines from ``first`` on; only the first split's ids are that small."""
    return F.col(ROW_ID) >= first
