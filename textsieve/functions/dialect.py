"""Regex dialects.

Rules are written in Python `re` syntax (see :mod:`patterns`).  Spark evaluates
them with `java.util.regex`, the DuckDB oracle with RE2.  The shorthand classes
differ between the three engines, so both translators spell them out:

* ``\\s`` -> the exact Python ``str.isspace`` set (Java and RE2 are ASCII-only).
* ``\\d`` -> ``\\p{Nd}`` and ``\\w`` -> ``[\\p{L}\\p{N}_]`` (Python is Unicode).
* ``\\b`` is kept.  Java 17's ``\\b`` is already Unicode-aware; RE2's is ASCII,
  so the oracle runs word-boundary patterns on :func:`re2_word_view`, which
  maps every non-ASCII letter/digit to ``_`` (same length, same word class).
* flags: Java gets ``(?d)`` so only ``\\n`` ends a line (as in Python).
"""
from __future__ import annotations

# whitespace characters of Python's str.isspace(), as class members
_WS_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
              (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
              (0x3000, 0x3000)]


def _java_cp(cp: int) -> str:
    return "\\x{%X}" % cp


def _re2_cp(cp: int) -> str:
    return "\\x{%X}" % cp


def _ws_members(cp_fmt) -> str:
    # listed one by one: Java builds a bitmap for single Latin-1 members,
    # which is several times faster than a chain of range predicates
    return "".join(cp_fmt(cp) for lo, hi in _WS_RANGES for cp in range(lo, hi + 1))


JAVA_WS = _ws_members(_java_cp)
RE2_WS = _ws_members(_re2_cp)
WORD_MEMBERS = r"\p{L}\p{N}_"


def _translate(pattern: str, ws: str) -> str:
    out = []
    i, n = 0, len(pattern)
    in_class = False
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            e = pattern[i + 1]
            if e == "s":
                out.append(ws if in_class else f"[{ws}]")
            elif e == "S":
                if in_class:
                    raise ValueError(f"\\S inside a class is not supported: {pattern}")
                out.append(f"[^{ws}]")
            elif e == "d":
                out.append(r"\p{Nd}")
            elif e == "w":
                out.append(WORD_MEMBERS if in_class else f"[{WORD_MEMBERS}]")
            elif e == "W":
                if in_class:
                    raise ValueError(f"\\W inside a class is not supported: {pattern}")
                out.append(f"[^{WORD_MEMBERS}]")
            else:
                out.append(c + e)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            i += 1
            # a leading ']' or '^]' is literal
            if i < n and pattern[i] == "^":
                out.append("^")
                i += 1
            if i < n and pattern[i] == "]":
                out.append(r"\]")
                i += 1
            continue
        if c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


# Python whitespace that Java's \s lacks.  Spark-side text is passed through
# fold_ws() before any regex, which maps these (length-preserving) to \x0B, so
# patterns can use Java's fast builtin \s / \S with Python's meaning.
PY_ONLY_WS = "".join(chr(cp) for lo, hi in _WS_RANGES for cp in range(lo, hi + 1)
                     if chr(cp) not in " \t\n\x0b\x0c\r")


PY_ONLY_WS_RANGE = r"[\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{3000}]"      # holds them all, with few tests a character
PY_ONLY_WS_CLASS = "[" + "".join(_java_cp(lo) if lo == hi else f"{_java_cp(lo)}-{_java_cp(hi)}" for lo, hi in
                                 [(0x1C, 0x1F), *_WS_RANGES[2:]]) + "]"


def _translate_java(pattern: str) -> str:
    out = []
    i, n = 0, len(pattern)
    in_class = False
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            e = pattern[i + 1]
            if e == "d":
                out.append(r"\p{Nd}")
            elif e == "w":
                out.append(WORD_MEMBERS if in_class else f"[{WORD_MEMBERS}]")
            elif e == "W":
                if in_class:
                    raise ValueError(f"\\W inside a class is not supported: {pattern}")
                out.append(f"[^{WORD_MEMBERS}]")
            else:
                out.append(c + e)          # \s, \S, \b and escapes stay native
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            i += 1
            if i < n and pattern[i] == "^":
                out.append("^")
                i += 1
            if i < n and pattern[i] == "]":
                out.append(r"\]")
                i += 1
            continue
        if c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def fold_ws(col):
    """Spark column: Python-only whitespace -> \x0B (same length).

    Most texts hold none, and a search is many times faster than translating every character."""
    from pyspark.sql import functions as F
    ascii_only = F.octet_length(col) == F.length(col)
    may = F.when(ascii_only, col.contains("\x1c") | col.contains("\x1d") | col.contains("\x1e") | col.contains("\x1f")).otherwise(
        col.rlike(PY_ONLY_WS_RANGE) & col.rlike(PY_ONLY_WS_CLASS))
    return F.when(may, F.translate(col, PY_ONLY_WS, "\x0b" * len(PY_ONLY_WS))).otherwise(col)


def java(pattern: str, flags: str = "") -> str:
    """Python-syntax regex -> Java regex with the same matches on fold_ws() text.

    flags: any of I (ignore case), M (multiline), S (dotall).
    """
    f = "d"
    if "I" in flags:
        f += "iu"
    if "M" in flags:
        f += "m"
    if "S" in flags:
        f += "s"
    return f"(?{f})" + _translate_java(pattern)


def re2(pattern: str, flags: str = "") -> str:
    """Python-syntax regex -> RE2 (DuckDB).  No lookaround/backrefs allowed."""
    f = ""
    if "I" in flags:
        f += "i"
    if "M" in flags:
        f += "m"
    if "S" in flags:
        f += "s"
    body = _translate(pattern, RE2_WS)
    return (f"(?{f})" if f else "") + body


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL string literal (Spark and DuckDB)."""
    return "'" + s.replace("'", "''") + "'"


def re2_word_view(expr: str) -> str:
    """DuckDB expression: same text with non-ASCII letters/digits replaced by
    '_' so RE2's ASCII word boundaries agree with Unicode ones."""
    return ("regexp_replace(" + expr + r", '[^\P{L}\x00-\x7F]|[^\P{Nd}\x00-\x7F]', '_', 'g')")
