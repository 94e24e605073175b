"""Text normalization as column expressions.

Only NFKC has no Spark builtin; it runs in an Arrow UDF whose input is null for
pure-ASCII rows (ASCII is NFKC-stable), so those rows cost no Python work.
"""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from textsieve.functions import dialect as D
from textsieve.functions import patterns as P

WS = r"\s"   # on fold_ws() text this is Python's whitespace
NON_ASCII = r"[^\x00-\x7F]"


@pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_array(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else
                 [None if t is None else unicodedata.normalize("NFKC", t) for t in a])


def _safe_latin1() -> str:
    """Latin-1 characters whose NFKC and lower case are themselves (single
    characters, no format characters, no homoglyphs).  The set holds no
    combining marks, so any string made only of ASCII and these characters is
    NFKC-stable as a whole.  Rule-built, listed one by one (Java bitmap)."""
    hg = {k for k, _ in P.HOMOGLYPHS}
    cps = [cp for cp in range(0x80, 0x100)
           if unicodedata.normalize("NFKC", chr(cp)) == chr(cp) and len(chr(cp).lower()) == 1
           and unicodedata.category(chr(cp)) not in ("Cf", "Cs", "Mn", "Mc", "Me") and chr(cp) not in hg]
    return "".join("\\x{%X}" % cp for cp in cps)


UNSAFE = "[^" + "".join(f"\\x{{{cp:X}}}" for cp in range(0x80)) + _safe_latin1() + "]"


def nfkc(text: Column) -> Column:
    """NFKC; rows of ASCII and safe Latin-1 characters skip Python (stable)."""
    needs = (F.octet_length(text) > F.length(text)) & text.rlike(UNSAFE)
    return F.coalesce(_nfkc(F.when(needs, text)), text)


def nfkc_each(arr: Column) -> Column:
    """NFKC of every element; arrays of NFKC-stable text skip Python."""
    needs = F.exists(arr, lambda x: x.rlike(NON_ASCII) & x.rlike(UNSAFE))
    return F.coalesce(_nfkc_array(F.when(needs, arr)), arr)


_HG_FROM = "".join(k for k, _ in P.HOMOGLYPHS)
_HG_TO = "".join(v for _, v in P.HOMOGLYPHS)


def fold_chars(text: Column) -> Column:
    """Drop zero-width characters and fold homoglyphs, in one translate."""
    return F.translate(text, _HG_FROM + P.ZERO_WIDTH_CHARS, _HG_TO)


# Whitespace that sits inside a run of >= 3 single letters ("i g n o r e").
# Equivalent to removing \s inside every match of the spaced-letter rule.
COLLAPSE_SPACED = (r"(?d)(?<=\b[a-z]" + WS + r"[a-z])" + WS + r"(?=[a-z]\b)|(?<=\b[a-z])" + WS
                   + r"(?=[a-z]" + WS + r"[a-z]\b)")
# same, but only plain spaces are dropped (the document normalizer)
COLLAPSE_SPACED_SPACES = (r"(?d)(?<=\b[a-z]" + WS + r"[a-z]) (?=[a-z]\b)|(?<=\b[a-z]) (?=[a-z]"
                          + WS + r"[a-z]\b)")
# Necessary conditions, sought by one character of a list (Java tests a list by a bitmap, ranges one by one).
# A letter between blanks: the middle of every run of spaced letters.
LONE_LETTER = r"[ \t\n\x0B\f\r][a-zA-Z][ \t\n\x0B\f\r]"
# A digit or @ beside a character that may be of a word and is no digit: in or at the end of every leet mix.
_NO_LETTER = "".join(f"\\x{{{cp:X}}}" for cp in range(0x80) if not (chr(cp).isalpha() or chr(cp) == "_"))
LEET_EDGE = f"[0123456789@](?:(?<=[^{_NO_LETTER}].)|(?<!@)(?=[^{_NO_LETTER}]))"
STRIP = r"(?d)^" + WS + r"+|" + WS + r"+\z"


def normalize_tail(folded_lower: Column) -> Column:
    """Steps after lower-casing: spaced letters, blanks, punctuation, strip."""
    t = F.regexp_replace(D.fold_ws(folded_lower), COLLAPSE_SPACED, "")
    t = F.regexp_replace(t, "[ \\t]+", " ")
    t = F.regexp_replace(t, "([!?.]){2,}", "$1")
    return F.regexp_replace(t, STRIP, "")


def normalize(text: Column, nfkc_done: Column | None = None) -> Column:
    """Prompt normalizer: NFKC, zero-width, homoglyphs, lower, spaced letters,
    space/tab runs, repeated punctuation, strip."""
    base = nfkc_done if nfkc_done is not None else nfkc(text)
    return normalize_tail(F.lower(fold_chars(base)))


def normalize_native(text: Column) -> Column:
    """Same as :func:`normalize` for text whose NFKC form is already known."""
    return normalize_tail(F.lower(fold_chars(text)))


def leet(norm: Column) -> Column:
    for a, b in zip(P.LEET_FROM, P.LEET_TO):          # no letter put in is one that is replaced
        norm = F.replace(norm, F.lit(a), F.lit(b))
    return norm


def py_words(text: Column) -> Column:
    """Python ``str.split()``."""
    return F.filter(F.split(text, WS + "+", -1), lambda x: x != "")


# What a leet mix and a run of spaced letters hold, for RE2
LEET_PROBE = f"[0123456789@][^{_NO_LETTER}]|[^{_NO_LETTER}][0123456789@]"
EVASION_LITERALS = [*_HG_FROM, *P.ZERO_WIDTH_CHARS]
EVASION_PATTERNS = [LEET_PROBE, LONE_LETTER]


def evasion_counts(raw: Column, has=None) -> Column:
    """``has``: a function of :mod:`textsieve.functions.probes` that already knows what the text holds."""
    def held(chars):                                  # few texts hold any
        if has:
            any_of = has(chars)
        else:
            any_of = F.lit(False)
            for ch in chars:
                any_of = any_of | raw.contains(ch)
        return F.when(~any_of, 0).otherwise(F.length(raw) - F.length(F.translate(raw, chars, "")))
    homo, zw = held(_HG_FROM), held(P.ZERO_WIDTH_CHARS)
    may_mix = (has([LEET_PROBE]) & raw.rlike(LEET_EDGE)) if has else raw.rlike(LEET_EDGE)
    leet_mix = F.when(~may_mix, 0).otherwise(F.regexp_count(raw, F.lit(D.java(P.LEET_MIX))))
    spaced = F.when(~(has([LONE_LETTER]) if has else raw.rlike(LONE_LETTER)), 0).otherwise(F.regexp_count(raw, F.lit(D.java(P.SPACED_LETTERS))))
    return F.struct(homo.cast("int").alias("homoglyph"), zw.cast("int").alias("zero_width"),
                    leet_mix.cast("int").alias("leet_mix"), spaced.cast("int").alias("spaced_letters"))
