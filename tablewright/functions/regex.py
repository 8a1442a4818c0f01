"""Python's regular expressions in Java's dialect.

Patterns are validated by Python's own compiler, then rewritten: group names become
plain groups (their numbers come from Python), classes lose Java's nested-class syntax,
stray braces are escaped, and flags make ``.``, ``$`` and ``\\d \\w \\s \\b`` mean what
they mean in Python.
"""

from __future__ import annotations

import re

from tablewright.package import StepError


def compiled(pattern: str) -> re.Pattern:
    try:
        return re.compile(pattern)
    except re.error as e:
        raise StepError(f"Invalid regular expression {pattern!r}: {e}") from None


def to_java(pattern: str) -> str:
    groups = compiled(pattern).groupindex
    out, i, n = [], 0, len(pattern)
    unicode_classes = ascii_only = False
    while i < n:
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            unicode_classes |= pair[1:] in set("dwsbDWSB")
            out.append("\\z" if pair == "\\Z" else pair)
            i += 2
        elif c == "[":
            j, body = _class_body(pattern, i)
            unicode_classes |= bool(re.search(r"\\[dwsDWS]", body))
            out.append(body)
            i = j
        elif c == "(" and (m := re.compile(r"\(\?P<(\w+)>").match(pattern, i)):
            out.append("(")
            i = m.end()
        elif c == "(" and (m := re.compile(r"\(\?P=(\w+)\)").match(pattern, i)):
            out.append(f"(?:\\{groups[m[1]]})")
            i = m.end()
        elif c == "(" and (m := re.compile(r"\(\?#[^)]*\)").match(pattern, i)):
            i = m.end()
        elif c == "(" and (m := re.compile(r"\(\?([aiLmsux]+)\)").match(pattern, i)):
            ascii_only |= "a" in m[1]
            flags = "".join(f for f in m[1] if f in "imsx")
            out.append(f"(?{flags}{'u' * ('i' in flags and not ascii_only)})" if flags else "")
            i = m.end()
        elif c == "{":
            m = re.compile(r"\{(\d*)(,?)(\d*)\}").match(pattern, i)
            if m and (m[1] or m[3]):
                out.append(f"{{{m[1] or 0}{m[2]}{m[3]}}}")
                i = m.end()
            else:
                out.append("\\{")
                i += 1
        else:
            out.append("\\}" if c == "}" else c)
            i += 1
    return "(?d)" + ("(?U)" if unicode_classes and not ascii_only else "") + "".join(out)


def _class_body(pattern: str, i: int) -> tuple[int, str]:
    """The class that begins at i, in Java's syntax, and the place after it."""
    out, j = ["["], i + 1
    if pattern[j] == "^":
        out.append("^")
        j += 1
    first = True
    while first or pattern[j] != "]":
        c = pattern[j]
        if c == "\\":
            out.append(pattern[j : j + 2])
            j += 2
        else:
            out.append("\\" + c if c in "[]&~" or c == "^" else c)
            j += 1
        first = False
    return j + 1, "".join([*out, "]"])


def matches_start(pattern: str) -> str:
    """A pattern whose search succeeds where Python's match() does."""
    java = to_java(pattern)
    flags = re.match(r"(\(\?[dU]\))*", java)[0]
    return f"{flags}\\A(?:{java[len(flags):]})"


def replacement(text: str, pattern: str) -> str:
    """The replacement template of Python's sub() as Java's."""
    names = compiled(pattern).groupindex
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and (m := re.compile(r"\\g<(\w+)>").match(text, i)):
            out.append(f"${{g}}".replace("{g}", str(names.get(m[1], m[1]))))
            i = m.end()
            if i < len(text) and text[i].isdigit():  # Java would read on
                out.append("\\" + text[i])
                i += 1
        elif c == "\\" and (m := re.compile(r"\\([1-9]\d?)").match(text, i)):
            out.append(f"${m[1]}")
            i = m.end()
        elif c == "\\" and i + 1 < len(text):
            known = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\", "f": "\f", "v": "\v", "a": "\a"}
            out.append(known.get(text[i + 1], "\\\\" + text[i + 1]))
            i += 2
        else:
            out.append("\\" + c if c in "$\\" else c)
            i += 1
    return "".join(out)


#: What float() accepts, white space around it included.
PYTHON_FLOAT = r"(?d)(?i)\A\s*[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?(?:e[+-]?\d+(?:_\d+)*)?|\.\d+(?:_\d+)*(?:e[+-]?\d+(?:_\d+)*)?|inf(?:inity)?|nan)\s*\z"
