"""The boolean and math languages, compiled to one Column each.

A boolean is meant for WHERE and CASE, where null counts as false; comparisons are left
bare so that Catalyst can push them to the scan. Types are checked when the expression
meets a table's schema: an order between unlike types is an error before any row is read,
and equality between unlike types is false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.regex import matches_start
from tablewright.package import ROW_ID, Resource, StepError, logical_type, quoted

NULL_WORDS = ("null", "NULL", "None", "NONE")
ROW_WORDS = ("ROW_NUMBER", "LINE_NUMBER")
#: Loosest first.
CONNECTIVES = ("||", "or", "OR", "&&", "and", "AND")

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<field>\{[^}]*\})
  | (?P<regex>re'[^']*')
  | (?P<string>'[^']*')
  | (?P<date>\d+(?:[/:-]\d+)+(?:[ T]\d+(?::\d+)+(?:\.\d+)?)?)
  | (?P<number>[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)
  | (?P<compare>>=|<=|!=|==|>|<)
  | (?P<connective>&&|\|\||\b(?:AND|and|OR|or)\b)
  | (?P<word>[A-Za-z_]+)
  | (?P<paren>[()])
    )""",
    re.X,
)
_MATH = re.compile(r"\s*(?:(?P<field>\{[^}]*\})|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<operator>[-+*/^])|(?P<paren>[()]))")


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    args: tuple[Node, ...] = ()

    def rows_needed(self) -> bool:
        """Whether row numbers occur in it."""
        return self.kind == "row" or any(a.rows_needed() for a in self.args)

    def fields(self) -> set[str]:
        own = {self.value} if self.kind == "field" else set()
        return own.union(*(a.fields() for a in self.args))


class _Tokens:
    def __init__(self, text: str, pattern: re.Pattern):
        self.text, self.items, self.at = text, [], 0
        end = len(text.rstrip())
        at = 0
        while at < end:
            m = pattern.match(text, at)
            if not m:
                raise StepError(f"Cannot read {text[at:].strip()!r} in expression {text!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self) -> tuple[str | None, str | None]:
        return self.items[self.at] if self.at < len(self.items) else (None, None)

    def take(self) -> tuple[str | None, str | None]:
        self.at += 1
        return self.items[self.at - 1] if self.at <= len(self.items) else (None, None)

    def fail(self) -> StepError:
        return StepError(f"Unexpected {self.peek()[1] or 'end'!r} in expression {self.text!r}")


def parse_boolean(text: str | None) -> Node | None:
    """The tree of a boolean expression; None if there is none."""
    if not text or not text.strip():
        return None
    tokens = _Tokens(text, _TOKEN)
    node = _connected(tokens, 0)
    if tokens.peek()[0]:
        raise tokens.fail()
    return node


def _connected(tokens: _Tokens, level: int) -> Node:
    if level == len(CONNECTIVES):
        if tokens.peek() == ("paren", "("):
            tokens.take()
            inside = _connected(tokens, 0)
            if tokens.take() != ("paren", ")"):
                raise tokens.fail()
            return inside
        left = _term(tokens)
        if tokens.peek()[0] != "compare":
            raise tokens.fail()
        op = tokens.take()[1]
        return Node("compare", op, (left, _term(tokens)))
    node = _connected(tokens, level + 1)
    while tokens.peek() == ("connective", CONNECTIVES[level]):
        tokens.take()
        node = Node("or" if level < 3 else "and", None, (node, _connected(tokens, level + 1)))
    return node


def _term(tokens: _Tokens) -> Node:
    kind, text = tokens.peek()
    if kind == "field":
        node = Node("field", text[1:-1])
    elif kind == "regex":
        node = Node("regex", text[3:-1])
    elif kind == "string":
        node = Node("string", text[1:-1])
    elif kind == "date":
        from dateutil import parser

        try:
            node = Node("date", parser.parse(text))
        except (ValueError, OverflowError):
            raise StepError(f"{text!r} is not a date") from None
    elif kind == "number":
        node = Node("number", Decimal(text))
    elif kind == "word" and text in NULL_WORDS:
        node = Node("null")
    elif kind == "word" and text in ROW_WORDS:
        node = Node("row")
    else:
        raise tokens.fail()
    tokens.take()
    return node


def parse_math(text: str) -> Node:
    tokens = _Tokens(text, _MATH)
    node = _math(tokens, 0)
    if tokens.peek()[0]:
        raise tokens.fail()
    return node


def _math(tokens: _Tokens, level: int) -> Node:
    if level == 3:
        kind, text = tokens.take()
        if kind == "field":
            return Node("field", text[1:-1])
        if kind == "number":
            return Node("number", Decimal(text))
        if (kind, text) == ("operator", "-") and tokens.peek()[0] == "number":
            return Node("number", -Decimal(tokens.take()[1]))
        if (kind, text) == ("paren", "("):
            node = _math(tokens, 0)
            if tokens.take() == ("paren", ")"):
                return node
        tokens.at -= 1
        raise tokens.fail()
    node = _math(tokens, level + 1)
    while tokens.peek()[0] == "operator" and tokens.peek()[1] in ("+-", "*/", "^")[level]:
        op = tokens.take()[1]
        node = Node("math", op, (node, _math(tokens, level + 1)))
    return node


class Scope:
    """What the names in an expression stand for: a table's columns, or newer versions of them."""

    def __init__(self, res: Resource, newer: dict[str, tuple[Column, T.DataType]] | None = None):
        self.res, self.newer = res, newer or {}

    def raw(self, name: str) -> tuple[Column, T.DataType]:
        if name in self.newer:
            return self.newer[name]
        self.res.field(name)
        return quoted(name), self.res.dtype(name)

    def value(self, name: str) -> tuple[Column, T.DataType]:
        """The column with missing values as null."""
        col, kind = self.raw(name)
        if isinstance(kind, T.StringType) and self.res.missing:
            col = F.when(~col.isin(*self.res.missing), col)
        return col, kind


_CLASS = {"integer": "number", "number": "number", "date": "time", "datetime": "time", "string": "string", "boolean": "boolean"}


def boolean_column(node: Node, scope: Scope) -> Column:
    if node.kind in ("and", "or"):
        a, b = (boolean_column(x, scope) for x in node.args)
        return a & b if node.kind == "and" else a | b
    return _compare(node.value, *node.args, scope)


def _typed(node: Node, scope: Scope) -> str:
    if node.kind == "field":
        return _CLASS.get(logical_type(scope.raw(node.value)[1]), "other")
    return {"number": "number", "row": "number", "string": "string", "date": "time", "null": "null", "regex": "regex"}[node.kind]


def _compare(op: str, a: Node, b: Node, scope: Scope) -> Column:
    ta, tb = _typed(a, scope), _typed(b, scope)
    if "regex" in (ta, tb):
        return _regex(op, a, b, ta, tb, scope)
    equality = op in ("==", "!=")
    if "null" in (ta, tb):
        other = b if ta == "null" else a
        gone = F.lit(other.kind == "null") if other.kind != "field" else _is_missing(other.value, scope)
        return F.lit(False) if not equality else gone if op == "==" else ~gone
    if ta != tb or (ta == "other" and not equality):
        if not equality:
            raise StepError(f"'{op}' between {ta} and {tb} in an expression")
        if a.kind == b.kind == "field":  # unlike values differ, two nulls don't
            same = _is_missing(a.value, scope) & _is_missing(b.value, scope)
            return same if op == "==" else ~same
        return F.lit(op == "!=")
    x, y = _operands(a, b, scope)
    if op == "==":
        return x.eqNullSafe(y) if a.kind == b.kind == "field" else x == y
    if op == "!=":
        if a.kind == b.kind == "field":
            return ~x.eqNullSafe(y)
        col = x if a.kind == "field" else y
        return (x != y) | col.isNull() if "field" in (a.kind, b.kind) else x != y
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _is_missing(name: str, scope: Scope) -> Column:
    col, kind = scope.raw(name)
    if isinstance(kind, T.StringType) and scope.res.missing:
        return col.isNull() | col.isin(*scope.res.missing)
    return col.isNull()


def _operands(a: Node, b: Node, scope: Scope) -> tuple[Column, Column]:
    """Both sides; literals take the type of the column they meet, so that scans can use them."""
    fields = [n for n in (a, b) if n.kind == "field"]
    kinds = [scope.raw(n.value)[1] for n in fields]
    # a text that isn't itself a missing value never equals one: the bare column will do
    literal = next((n for n in (a, b) if n.kind == "string"), None)
    bare = literal is not None and literal.value not in scope.res.missing
    as_date = any(isinstance(k, T.DateType) for k in kinds)

    def side(n: Node) -> Column:
        if n.kind == "field":
            col, kind = scope.raw(n.value) if bare else scope.value(n.value)
            return col.cast("date") if as_date and not isinstance(kind, T.DateType) else col
        if n.kind == "row":
            return F.col(ROW_ID)
        if n.kind == "date":
            return F.lit(n.value.date()) if as_date else F.to_timestamp_ntz(F.lit(str(n.value.replace(tzinfo=None))))
        if n.kind == "number":
            if any(isinstance(k, (T.DoubleType, T.FloatType)) for k in kinds):
                return F.lit(float(n.value))
            return F.lit(int(n.value)) if n.value == n.value.to_integral_value() and abs(n.value) < 2**31 else decimal_literal(n.value)
        return F.lit(n.value)

    return side(a), side(b)


def _regex(op: str, a: Node, b: Node, ta: str, tb: str, scope: Scope) -> Column:
    if op not in ("==", "!="):
        raise StepError("Regular expressions can only be compared with == or !=")
    pattern, other, kind = (a, b, tb) if ta == "regex" else (b, a, ta)
    if kind == "regex" or kind not in ("string", "null"):
        raise StepError(f"A regular expression can only be compared with a string, not {kind}")
    if other.kind != "field":
        hit = bool(other.kind == "string" and re.match(pattern.value, other.value))
        return F.lit(hit == (op == "=="))
    col, _ = scope.value(other.value)
    hit = col.rlike(matches_start(pattern.value))
    return hit if op == "==" else ~hit | col.isNull()


def decimal_literal(value: Decimal) -> Column:
    sign, digits, exponent = value.as_tuple()
    scale = max(0, -exponent)
    precision = max(len(digits) + max(0, exponent), scale, 1)
    return F.lit(format(value, "f")).cast(T.DecimalType(min(38, precision), scale))


#: Numbers are held with 18 decimals; wide operands keep 19 digits before the point.
_WIDE = T.DecimalType(37, 18)
_RESULT = T.DecimalType(38, 18)
MOST_FACTORS = 32


def math_column(node: Node, scope: Scope) -> Column:
    """Exact in decimals, with 18 digits after the point; in doubles where a field holds doubles.

    Products keep all their digits where the operands' types leave room for them, and 18
    decimals otherwise, as quotients and powers by whole numbers do; powers by others are
    doubles. Null in, null out; division by zero and numbers of 10^19 and more (of 10^16
    and more, times a constant of up to three digits) raise errors.
    """
    col, kind = _math_column(node, scope)
    if isinstance(kind, (T.DoubleType, T.FloatType)) and not _doubles(node, scope):
        return col.cast(_RESULT)
    return col


def _doubles(node: Node, scope: Scope) -> bool:
    return any(isinstance(scope.raw(f)[1], (T.DoubleType, T.FloatType)) for f in node.fields())


def _math_column(node: Node, scope: Scope) -> tuple[Column, T.DataType]:
    if node.kind == "number":
        value = node.value
        scale = max(0, -value.as_tuple().exponent)
        precision = max(len(value.as_tuple().digits) + max(0, value.as_tuple().exponent), scale, 1)
        return decimal_literal(value), T.DecimalType(min(38, precision), scale)
    if node.kind == "field":
        col, kind = scope.value(node.value)
        if not isinstance(kind, T.NumericType):
            raise StepError(f"Math needs numbers: the field {node.value!r} is {logical_type(kind)}")
        return (col.cast("decimal(19,0)"), T.DecimalType(19, 0)) if isinstance(kind, T.IntegralType) else (col, kind)
    (a, ka), (b, kb) = (_math_column(x, scope) for x in node.args)
    if isinstance(ka, T.DecimalType) and isinstance(kb, T.DecimalType):
        made = _exact(node.value, a, ka, b, kb, node.args[1])
        if made is not None:
            return made
    x, y = a.cast("double"), b.cast("double")
    return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "^": lambda: F.pow(x, y)}[node.value](), T.DoubleType()


def _exact(op: str, a: Column, ka: T.DecimalType, b: Column, kb: T.DecimalType, right: Node) -> tuple[Column, T.DataType] | None:
    """The operation in decimals; None if it has to be in doubles."""
    if op in "+-":
        scale = max(ka.scale, kb.scale)
        precision = max(ka.precision - ka.scale, kb.precision - kb.scale) + scale + 1
        if precision > 38:  # Spark would give up digits after the point for digits before it
            a, b, scale, precision = a.cast(_WIDE), b.cast(_WIDE), 18, 38
        kind = T.DecimalType(precision, scale)
        return (a + b if op == "+" else a - b).cast(kind), kind
    if op == "*":
        return _product(a, ka, b, kb)
    if op == "/":
        if ka.precision - ka.scale + kb.scale <= 20:  # then Spark's own quotient has 18 decimals
            return (a / b).cast(_RESULT), _RESULT
        return _quotient(a.cast(_RESULT), b.cast(_RESULT)), _RESULT
    n = right.value if right.kind == "number" else None
    if n is None or n != n.to_integral_value() or abs(n) > MOST_FACTORS:
        return None
    out: tuple[Column, T.DataType] = (F.when(a.isNotNull(), F.lit(1).cast("decimal(1,0)")), T.DecimalType(1, 0))
    for digit in bin(abs(int(n)))[2:]:
        out = _product(*out, *out)
        out = _product(*out, a, ka) if digit == "1" else out
    return out if n >= 0 else (_quotient(F.lit(1).cast(_RESULT), out[0].cast(_RESULT)), _RESULT)


def _product(a: Column, ka: T.DecimalType, b: Column, kb: T.DecimalType) -> tuple[Column, T.DataType]:
    if ka.precision + kb.precision + 1 <= 38:
        kind = T.DecimalType(ka.precision + kb.precision + 1, ka.scale + kb.scale)
        return (a * b).cast(kind), kind
    for x, kx, y, ky in ((a, ka, b, kb), (b, kb, a, ka)):
        if ky.precision <= 3 and kx.precision > 35:  # a few digits leave the other side 16 before the point
            return (x.cast(T.DecimalType(37 - ky.precision, 18)) * y).cast(_RESULT), _RESULT
    return _wide_product(a.cast(_RESULT), b.cast(_RESULT)), _RESULT


def _bound(columns: list[Column], fn) -> Column:
    """fn(columns), each of them computed once, however often fn uses it."""
    held = F.array(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]))
    return F.element_at(F.transform(held, lambda h: fn(*[h[f"c{k}"] for k in range(len(columns))])), 1)


def _wide_product(a: Column, b: Column) -> Column:
    """The product of two decimal(38,18): whole parts and fractions multiply apart, as one product of that type keeps 6 decimals only."""

    def multiply(a: Column, b: Column) -> Column:
        whole = lambda x: F.floor(x).cast("decimal(19,0)")
        rest = lambda x: (x.cast(_WIDE) - whole(x)).cast("decimal(18,18)")
        parts = [whole(a) * whole(b), whole(a) * rest(b), rest(a) * whole(b), rest(a) * rest(b)]
        total = parts[0].cast(_WIDE)
        for p in parts[1:]:
            total = (total + p.cast(_WIDE)).cast(_WIDE)
        return total

    return _bound([a, b], multiply).cast(_RESULT)


def _quotient(a: Column, b: Column) -> Column:
    """The quotient of two decimal(38,18), in two steps: Spark's has 6 decimals, what it leaves gives the next 12."""

    def divide(a: Column, b: Column) -> Column:
        first = (a / b).cast(_WIDE)
        left = (a.cast(_WIDE) - _wide_product(first, b).cast(_WIDE)).cast(_WIDE)
        more = ((left * F.lit(10**12).cast("decimal(13,0)")).cast(_RESULT) / b).cast("decimal(24,6)")
        return (first + (more * F.lit(Decimal("0.000000000001"))).cast(_WIDE)).cast(_WIDE)

    return _bound([a, b], divide).cast(_RESULT)
