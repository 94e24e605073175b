"""Which of a fixed list of literals and patterns a text holds, sought all at once.

Spark has no search for many literals: ``contains`` reads the whole text for each of them, and a rule set holds
hundreds.  Here one pass (RE2's automaton, through Arrow) tells which texts hold any literal; only those few are searched
for each.  Patterns are necessary conditions of slower Java regexes and must mean the same in RE2 (classes spelled out,
no lookaround); one that names literals is sought only in the texts that hold any of them, others take a pass each."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsieve.functions import dialect as D


def necessary(pattern: str, flags: str = "") -> str:
    """RE2 pattern that is found wherever the Java form of a Python-syntax one is: the same without its word boundaries,
    which RE2 knows for ASCII only.  Without regard to case Java also takes the Turkish i's for an i."""
    return D.re2(pattern.replace(r"\b", ""), flags) + (r"|[\x{130}\x{131}]" if "I" in flags else "")


class Probes:
    """``held`` gives the places in the list of what a text holds (null for null), ``has`` asks it for some of them."""

    def __init__(self, literals: Iterable[str], patterns: Iterable[str] = (), guarded: dict[str, Iterable[str]] | None = None):
        """``guarded``: patterns with the literals of which one is in every match."""
        self.literals = tuple(dict.fromkeys(literals))
        places = {x: i for i, x in enumerate(self.literals)}
        self.patterns = (*((p, None) for p in dict.fromkeys(patterns)),
                         *((p, tuple(places[x] for x in needles)) for p, needles in (guarded or {}).items()))
        self.place = {x: i for i, x in enumerate([*self.literals, *(p for p, _needles in self.patterns)])}

    def held(self, text: Column) -> Column:
        return F.arrow_udf(_finder(self.literals, self.patterns), T.ArrayType(T.IntegerType()))(text)

    def has(self, held: Column) -> Callable[[Iterable[str]], Column]:
        """A function from some of the list to whether the text holds any of them."""
        def any_of(wanted):
            c = F.lit(False)
            for x in wanted:
                c = c | F.array_contains(held, self.place[x])
            return c
        return any_of

    def has_sql(self, held_sql: str, wanted: Iterable[str]) -> str:
        return " OR ".join(f"array_contains({held_sql}, {self.place[x]})" for x in wanted)


GROUP = 10


def _matching(texts: pa.Array, pattern: str) -> np.ndarray:
    hit = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
    return np.flatnonzero(hit.to_numpy(zero_copy_only=False))


def _finder(literals, patterns):
    def any_of(some):
        return "|".join(re.escape(x) for x in some)
    groups = [(start, any_of(literals[start:start + GROUP]), [x.encode() for x in literals[start:start + GROUP]])
              for start in range(0, len(literals), GROUP)]

    def find(texts: pa.Array) -> pa.Array:
        found = [None if null else [] for null in texts.is_null().to_pylist()]
        holders = _matching(texts, any_of(literals)) if literals else ()
        if len(holders):
            held = texts.take(pa.array(holders))
            for start, pattern, group in groups:
                rows = _matching(held, pattern)
                if len(rows):
                    for i, t in zip(holders[rows].tolist(), held.take(pa.array(rows)).cast(pa.binary()).to_pylist()):
                        found[i].extend(k for k, x in enumerate(group, start) if x in t)
        holding = [[] for _ in literals]
        for i, places in enumerate(found):
            for k in places or ():
                holding[k].append(i)
        for k, (pattern, needles) in enumerate(patterns, len(literals)):
            if needles is None:
                rows, some = None, texts
            else:
                rows = sorted({i for n in needles for i in holding[n]})
                if not rows:
                    continue
                some = texts.take(pa.array(rows))
            for i in _matching(some, pattern).tolist():
                found[i if rows is None else rows[i]].append(k)
        return pa.array(found, pa.list_(pa.int32()))
    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return find
