"""Regex dialect helpers.

Users write rules in the dialect of Python's ``re``.  Spark evaluates ``java.util.regex``.
``to_java`` rewrites the few constructs that differ, so that one rule text means the
same in both.  All patterns end up as literals, which Spark compiles once per task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes that agree with Python's str classes, written without the brackets.
_WORD = r"\p{L}\p{N}_"
_DIGIT = r"\p{Nd}"
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_OUTSIDE = {
    "w": f"[{_WORD}]", "W": f"[^{_WORD}]", "d": f"[{_DIGIT}]", "D": f"[^{_DIGIT}]",
    "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]", "Z": r"\z",
}
_INSIDE = {
    "w": _WORD, "W": f"[^{_WORD}]", "d": _DIGIT, "D": f"[^{_DIGIT}]",
    "s": _SPACE, "S": f"[^{_SPACE}]",
}
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_NAMED_GROUP = re.compile(r"\(\?P<(\w+)>")
_NAMED_REF = re.compile(r"\(\?P=(\w+)\)")


def to_java(pattern: str) -> str:
    """Rewrite a Python pattern as the Java pattern with the same meaning."""
    return rewrite(pattern, _OUTSIDE, _INSIDE)


def rewrite(pattern: str, outside: dict[str, str], inside: dict[str, str]) -> str:
    """Walk a pattern and replace class escapes, named groups and loose braces."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            table = inside if in_class else outside
            out.append(table.get(pattern[i + 1], pattern[i : i + 2]))
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
            elif ch in "[&":
                ch = "\\" + ch
            out.append(ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":  # a leading ] is a literal
                out.append(r"\]")
                i += 1
            continue
        if ch == "(":
            named = _NAMED_GROUP.match(pattern, i) or _NAMED_REF.match(pattern, i)
            if named:
                # Java group names take no underscore; the name carries no meaning here.
                name = "g" + re.sub(r"[^A-Za-z0-9]", "Z", named.group(1))
                out.append(f"(?<{name}>" if named.re is _NAMED_GROUP else rf"\k<{name}>")
                i = named.end()
                continue
        if ch == "{":
            q = _QUANTIFIER.match(pattern, i)
            if q and (q.group(1) or (q.group(2) and q.group(3))):
                out.append("{" + (q.group(1) or "0") + q.group(2) + q.group(3) + "}")
                i = q.end()
            else:
                out.append(r"\{")
                i += 1
            continue
        out.append(r"\}" if ch == "}" else ch)
        i += 1
    return "".join(out)


def flags(ignore_case: bool = True, multiline: bool = False) -> str:
    """Inline flags: ``d`` makes only \\n a line end, ``U`` gives a Unicode \\b and case folding."""
    return "(?" + ("i" if ignore_case else "") + ("m" if multiline else "") + "dU)"


def java_rule(pattern: str) -> str:
    """A detection rule: case-insensitive and multiline."""
    return flags(multiline=True) + to_java(pattern)


def escape_literal(value: str) -> str:
    """A literal as a Java pattern, also inside a class."""
    return "".join(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}" for c in value)


def any_of(patterns: list[str], ignore_case: bool = True) -> str:
    """One Java alternation that finds what any of ``patterns`` finds."""
    return flags(ignore_case) + "(?:" + "|".join(f"(?:{to_java(p)})" for p in patterns) + ")"


# characters by how seldom they stand in ordinary text, most telling first
_TELLING = "{}()[]<>|&;=@#$%^~!*+?\"':,\\/`-._"


def required_runs(parsed) -> list[str]:
    """Lowercase ASCII runs that every match of a parsed pattern must contain."""
    runs, run = [], ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        if name == "AT":  # zero width: neighbours stay neighbours
            continue
        runs, run = runs + [run], ""
        if name == "SUBPATTERN":
            runs += required_runs(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            runs += required_runs(arg[2])
    return [r for r in runs + [run] if r]


def guard(patterns: list[str]) -> str | None:
    """A cheap test that is true wherever one of ``patterns`` may be found.

    Each pattern gives one telling character, or one word, that its matches must hold.  Code
    patterns backtrack over long words; the guard is one linear pass.  None if a pattern has
    nothing that is required.
    """
    chars, words = "", []
    for p in patterns:
        runs = required_runs(re._parser.parse(p, re.IGNORECASE))
        telling = [c for c in _TELLING if any(c in r for r in runs)]
        if telling:
            chars += telling[0] if telling[0] not in chars else ""
        elif runs:
            words.append(max(runs, key=len))
        else:
            return None
    cls = ["[" + "".join("\\" + c for c in chars) + "]"] if chars else []
    return flags() + "|".join(cls + [re.escape(w) for w in dict.fromkeys(words)])


MARKS = _TELLING.replace("_", "")  # characters that no bare word or key holds


def needs_mark(pattern: str) -> bool:
    """Every match of the pattern holds one of ``MARKS``, so a text without any has none."""
    return any(c in MARKS for run in required_runs(re._parser.parse(pattern, re.IGNORECASE)) for c in run)


def has_mark(col: Column) -> Column:
    return col.rlike("[" + "".join("\\" + c for c in MARKS) + "]")


def hits(col: Column, patterns: list[str] | str, ignore_case: bool = True) -> Column:
    """True where at least one pattern is found.  The pattern is a foldable literal."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    full = col.rlike(any_of(patterns, ignore_case))
    cheap = guard(patterns) if len(patterns) > 3 else None
    return full if cheap is None else col.rlike(cheap) & full


def line_hits(col: Column, patterns: list[str]) -> Column:
    """``hits`` for long text: a substring test for the required word of each pattern goes first.

    Lines can be long and shared by many matches; a substring test is many times faster than a
    case-insensitive alternation.  Letters that fold to ASCII in a regex skip the test.
    """
    runs = [max(required_runs(re._parser.parse(p, re.IGNORECASE)), key=len, default="") for p in patterns]
    full = col.rlike(any_of(patterns))
    if "" in runs:
        return full
    words = list(dict.fromkeys(runs))
    some = let(F.lower(col), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in words]))
    return (some | contains_any(col, ["ſ", "ı", "İ"])) & full


def group(col: Column, pattern: str, idx: int = 1, ignore_case: bool = True) -> Column:
    """Group ``idx`` of the first match, NULL when there is no match or the group is empty."""
    found = F.regexp_extract(col, flags(ignore_case) + to_java(pattern), idx)
    return F.when(found != "", found)


def contains_any(col: Column, needles: list[str]) -> Column:
    """True where at least one literal is a substring."""
    if len(needles) > 3:
        return col.rlike("|".join(re.escape(n) for n in needles))
    return reduce(lambda a, b: a | b, [col.contains(n) for n in needles])


def escape(col: Column) -> Column:
    """Escape a literal the way ``re.escape`` does."""
    special = r"([\s\-\[\]{}()*+?.,\\^$|#&~])"
    return F.regexp_replace(col, special, r"\\$1")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Catalyst may inline an alias into every place that reads it; a lambda variable
    cannot be inlined, so an expensive value (the lines of a file) is built once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
