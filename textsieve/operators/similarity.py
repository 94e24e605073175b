"""Similarity to canonical injection templates.

R11 ``template_similarity``: each document is cut into sentence/line chunks; a
chunk is the vector of its counts of character 3-, 4- and 5-grams (lower-cased,
blanks folded, one blank at each end), and its similarity the best cosine to a
template.  The templates' grams are a constant of fixed size, so the equi-join of a
chunk's grams with them happens beside the row, in an Arrow function that also cuts the
chunks: an interpreted expression walks through the text for each of them.  Dot products
come from a table of the templates' grams, and with the number of a chunk's grams they bound
its cosine; only chunks that may be their text's best, or reach the threshold, have
their grams sorted and counted.  Dot products and squares are sums of whole numbers, and
neither texts nor grams are shuffled.

X2 ``embedding_similarity``: the same with vectors from any embedding backend,
a column function from texts to vectors.

R12 ``vector_similarity``: precomputed embeddings against a table of template vectors
(inlined by a scalar subquery: no join).
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.functions import dialect as D
from textsieve.functions import normalize as N
from textsieve.functions import patterns as P
from textsieve.functions.arrays import bound
from textsieve.functions.barrier import computed_once
from textsieve.functions.spans import regex_spans

NGRAMS = (3, 4, 5)
BLOCK_CHARS = 1 << 19
_ORD_SEMANTIC = 6000
SLACK = 1e-9                    # rounding of a bound
# P.CHUNK_SPLIT, beginning with a character that is sought at once: a stop and the blanks behind it, or line ends
_CHUNK_END = re.compile(r"[.!?\n](?:(?<=\n)\n*|(?<!\n)\s+)")
# blanks of Java's \s, and the ASCII blanks that it lacks
_BLANKS, _SEPARATORS = re.compile(r"[ \t\n\x0B\f\r]+"), re.compile(r"[\x1C-\x1F]")


def grams_of(text: str) -> Counter:
    """Counts of the grams of a padded text."""
    return Counter(text[i:i + n] for n in NGRAMS for i in range(len(text) - n + 1))


def padded(text: str) -> str:
    return f" {' '.join(text.lower().split())} "


def _blocks(texts: list[str]):
    """Slices of the texts with about BLOCK_CHARS characters, so that memory is bounded by it and the longest text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]


def dots_and_squares(texts: list[str], counts: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
    """Dot products of the gram counts of each text with those of each template, and the sum of squared counts of
    each text: whole numbers.  A gram of a text is one number (the text's place, then the ranks of its characters
    among those that occur), so equal ones stand together after a sort."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    seen = np.unique(codes)
    base = len(seen) + 1                                          # rank 0: characters of templates that do not occur
    if len(texts) * base ** NGRAMS[-1] >= 1 << 62:               # no room in 64 bits: fewer texts, or one by counting
        if len(texts) > 1:
            half = len(texts) // 2
            parts = [dots_and_squares(t, counts) for t in (texts[:half], texts[half:])]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        own = grams_of(texts[0])
        return (np.array([[sum(k * c[g] for g, k in own.items() if g in c) for c in counts]], np.int64),
                np.array([sum(k * k for k in own.values())], np.int64))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    place = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))      # characters up to the end of the text
    ranks = np.searchsorted(seen, codes) + 1
    dots, squares = np.zeros((len(texts), len(counts)), np.int64), np.zeros(len(texts), np.int64)
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        key = place[at]
        for k in range(n):
            key = key * base + ranks[at + k]
        key, times = np.unique(key, return_counts=True)
        owner, gram = key // base ** n, key % base ** n
        squares += np.bincount(owner, times * times, len(texts)).astype(np.int64)
        for j, c in enumerate(counts):
            mine = [g for g in c if len(g) == n]
            if not mine:
                continue
            its = np.searchsorted(seen, letters := np.array([[ord(x) for x in g] for g in mine], np.uint32))
            its = np.where(np.take(seen, its, mode="clip") == letters, its + 1, 0)
            keys, weights = its @ base ** np.arange(n - 1, -1, -1), np.array([c[g] for g in mine])
            keys, weights = keys[its.all(axis=1)], weights[its.all(axis=1)]
            if len(keys):
                order = np.argsort(keys)
                keys, weights = keys[order], weights[order]
                slot = np.searchsorted(keys, gram)
                hit = np.flatnonzero(np.take(keys, slot, mode="clip") == gram)
                dots[:, j] += np.bincount(owner[hit], times[hit] * weights[slot[hit]], len(texts)).astype(np.int64)
    return dots, squares


def best_cosines(texts: list[str], counts: list[Counter]) -> np.ndarray:
    """Best cosine of each padded text to the templates."""
    norms = np.sqrt(np.array([sum(k * k for k in c.values()) for c in counts], np.float64))
    out = [np.zeros(0)]
    for block in _blocks(texts):
        dots, squares = dots_and_squares(block, counts)
        # a text with a gram has a square of 1 at least
        out.append((dots / (np.sqrt(np.maximum(squares, 1).astype(np.float64))[:, None] * norms)).max(axis=1))
    return np.concatenate(out)


class GramIndex:
    """The templates' grams, found in texts through a table of the 3-grams; longer ones are sought only where their
    beginning is found."""

    def __init__(self, templates: tuple[str, ...]):
        self.counts = [grams_of(padded(t)) for t in templates]
        self.norms = np.sqrt(np.array([sum(k * k for k in c.values()) for c in self.counts], np.float64))
        letters = sorted({x for c in self.counts for g in c for x in g})
        self.base = len(letters) + 1                              # rank 0: characters of no template
        self.rank = np.zeros(ord(letters[-1]) + 2 if letters else 1, np.int64)
        self.rank[[ord(x) for x in letters]] = np.arange(1, self.base)
        self.keys, self.weights = [], []
        for n in NGRAMS:
            grams = sorted({g for c in self.counts for g in c if len(g) == n})
            keys = np.array([[self.rank[ord(x)] for x in g] for g in grams], np.int64).reshape(-1, n) @ self.base ** np.arange(n - 1, -1, -1)
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.weights.append(np.array([[c[g] for c in self.counts] for g in grams], np.int64).reshape(-1, len(self.counts))[order])
        self.first = None                                         # place + 1 of a 3-gram by its key
        if self.base ** NGRAMS[0] <= 1 << 22:
            self.first = np.zeros(self.base ** NGRAMS[0], np.int32)
            self.first[self.keys[0]] = np.arange(1, len(self.keys[0]) + 1)

    def _found(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``keys`` are grams of the k-th length, and which."""
        if k == 0 and self.first is not None:
            place = self.first[keys]
            at = np.flatnonzero(place)
            return at, place[at] - 1
        if not len(self.keys[k]):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        slot = np.searchsorted(self.keys[k], keys)
        at = np.flatnonzero(np.take(self.keys[k], slot, mode="clip") == keys)
        return at, slot[at]

    def dots(self, texts: list[str]) -> np.ndarray:
        """Dot products of the gram counts of each padded text with those of each template.  No gram of a template has
        two blanks, so none lies across two texts."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ranks = np.take(self.rank, codes, mode="clip")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        out = np.zeros((len(texts), len(self.counts)), np.int64)
        n = NGRAMS[0]
        at = np.arange(max(len(codes) - n + 1, 0))
        keys = np.zeros(len(at), np.int64)
        for k in range(n):
            keys = keys * self.base + ranks[k:len(at) + k]
        for k, n in enumerate(NGRAMS):
            if k:
                inside = at + n - 1 < len(codes)
                at, keys = at[inside], keys[inside]
                keys = keys * self.base + ranks[at + n - 1]
            hit, which = self._found(k, keys)
            at, keys = at[hit], keys[hit]
            if len(at):
                owner = np.searchsorted(ends, at, side="right")
                starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                out[owner[starts]] += np.add.reduceat(self.weights[k][which], starts, axis=0)
        return out

    def best(self, texts: list[str], owner: np.ndarray, threshold: float) -> np.ndarray:
        """Best cosine of each text to the templates where it may reach ``threshold`` or be the greatest of its owner, 0
        elsewhere; ``owner`` rises.  A text's squares add up to the number of its grams at least, which bounds its cosine."""
        if not texts:
            return np.zeros(0)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        grams = np.maximum(sum(np.maximum(lengths - n + 1, 0) for n in NGRAMS), 1)
        bound = (self.dots(texts) / (np.sqrt(grams.astype(np.float64))[:, None] * self.norms)).max(axis=1)
        firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(texts))))
        greatest = np.maximum.reduceat(bound, firsts)
        cosines = np.zeros(len(texts))
        tops = np.flatnonzero((bound == greatest[group]) & (bound > 0))
        tops = tops[np.concatenate(([True], group[tops][1:] != group[tops][:-1]))] if len(tops) else tops     # one of each owner
        cosines[tops] = best_cosines([texts[i] for i in tops], self.counts)
        known = np.maximum.reduceat(cosines, firsts)
        rest = (bound > 0) & (bound >= np.minimum(known[group], threshold) - SLACK)
        rest[tops] = False
        rest = np.flatnonzero(rest)
        cosines[rest] = best_cosines([texts[i] for i in rest], self.counts)
        return cosines


@lru_cache(maxsize=8)
def gram_index(templates: tuple[str, ...]) -> GramIndex:
    return GramIndex(templates)


def chunks_of(text: str) -> list[tuple[int, int, str]]:
    """Sentence/line chunks (start, end, padded text) of a text, as :func:`chunk_spans` has them."""
    out, start = [], 0
    plain = text.isascii() and not _SEPARATORS.search(text)

    def add(start, end):
        chunk = text[start:end]
        if plain:
            words = chunk.lower().split()
            if words:
                out.append((start, end, f" {' '.join(words)} "))
        elif chunk.strip():
            out.append((start, end, f" {_BLANKS.sub(' ', chunk.lower()).strip(' ')} "))
    for m in _CHUNK_END.finditer(text):
        end = m.start() + (text[m.start()] != "\n")
        add(start, end)
        start = m.end()
    add(start, len(text))
    return out


def _similarity_udf(templates: tuple[str, ...], threshold: float):
    def flush(index, held, out):
        owner = np.fromiter((i for i, *_ in held), np.int64, len(held))
        for (i, start, end, _text), cosine in zip(held, index.best([x[3] for x in held], owner, threshold).tolist()):
            if cosine > out[i][0]:
                out[i][0] = cosine
            if cosine >= threshold:
                out[i][1].append((start, end, cosine))

    def similar(texts: pa.Array) -> pa.Array:
        index, out, held, size = gram_index(templates), [], [], 0
        for i, text in enumerate(texts):
            text = text.as_py()
            out.append([0.0, []])
            if text and size and size + len(text) > BLOCK_CHARS:
                flush(index, held, out)
                held, size = [], 0
            if text:
                held.extend((i, *chunk) for chunk in chunks_of(text))
                size += len(text)
        flush(index, held, out)
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.float64()), pa.array(
            [[{"start": s, "end": e, "similarity": c} for s, e, c in x[1]] for x in out],
            pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("similarity", pa.float64())])))], names=["max_similarity", "hits"])
    similar.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(similar, "max_similarity double, hits array<struct<start:int,end:int,similarity:double>>")


def chunk_spans(text: Column) -> Column:
    """Sentence/line chunks with original offsets (blank chunks dropped).  The text is evaluated once, not for each chunk."""
    return bound(text, lambda t: bound(bound(D.fold_ws(t), lambda f: regex_spans(f, D.java(P.CHUNK_SPLIT))),
                                       lambda seps: _chunks(t, seps)))


def _chunks(text: Column, seps: Column) -> Column:
    starts = F.concat(F.array(F.lit(0)), F.transform(seps, lambda s: s["end"]))
    ends = F.concat(F.transform(seps, lambda s: s["start"]), F.array(F.length(text)))
    pairs = F.arrays_zip(starts.alias("start"), ends.alias("end"))
    chunks = F.transform(pairs, lambda p: F.struct(
        p["start"].cast("int").alias("start"), p["end"].cast("int").alias("end"),
        text.substr(p["start"] + 1, p["end"] - p["start"]).alias("text")))
    return F.filter(chunks, lambda c: (c["end"] > c["start"])
                    & (F.regexp_replace(D.fold_ws(c["text"]), N.STRIP, "") != ""))


def _findings(scored: Column, threshold: float) -> Column:
    """struct(max_similarity, findings array<rag finding>, n_hits) of scored chunks."""
    hits = F.filter(scored, lambda c: c["similarity"] >= threshold)
    return F.struct(
        F.coalesce(F.array_max(F.transform(scored, lambda c: c["similarity"])), F.lit(0.0)).alias("max_similarity"),
        _as_findings(hits).alias("findings"))


def _as_findings(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), F.lit(_ORD_SEMANTIC).alias("ord"), h["end"].alias("end"),
        F.lit("semantic_injection").alias("signature_id"),
        F.rint(F.lit(30) + h["similarity"] * 20).cast("int").alias("severity"), F.lit(False).alias("dampened")))


def with_template_similarity(df: DataFrame, text_col: str = "text", out: str = "_sim", templates=None,
                             threshold: float = P.SEMANTIC_SIMILARITY_THRESHOLD) -> DataFrame:
    """Adds ``out``: struct(max_similarity, findings) for rag_scan (0.0 and none for null, empty and blank text)."""
    df = df.withColumn("_best", _similarity_udf(tuple(templates or P.CANONICAL_INJECTION_TEMPLATES), threshold)(F.col(text_col)))
    return df.withColumn(out, computed_once(F.struct(
        F.col("_best.max_similarity").alias("max_similarity"), _as_findings(F.col("_best.hits")).alias("findings")))).drop("_best")


def with_embedding_similarity(df: DataFrame, embed: Callable[[Column], Column], text_col: str = "text", out: str = "_sim",
                              templates=None, threshold: float = P.SEMANTIC_SIMILARITY_THRESHOLD) -> DataFrame:
    """The same with the vectors of a backend: ``embed`` maps a column of array<string> to one of array<array<double>>.

    A chunk without a vector, or with a zero one, has similarity 0."""
    chunks = F.coalesce(chunk_spans(F.col(text_col)), F.array().cast("array<struct<start:int,end:int,text:string>>"))
    texts = F.array(*[F.lit(t) for t in (templates or P.CANONICAL_INJECTION_TEMPLATES)])
    df = df.withColumn("_chunks", computed_once(chunks))
    df = df.withColumns({"_vectors": embed(F.transform("_chunks", lambda c: c["text"])), "_templates": embed(texts)})

    def product(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))

    def cosine(a, b):
        return F.coalesce(F.try_divide(product(a, b), F.sqrt(product(a, a)) * F.sqrt(product(b, b))), F.lit(0.0))

    scored = F.zip_with("_chunks", "_vectors", lambda c, v: F.struct(
        c["start"].alias("start"), c["end"].alias("end"),
        F.coalesce(F.array_max(F.transform(F.col("_templates"), lambda t: cosine(v, t))), F.lit(0.0)).alias("similarity")))
    df = df.withColumn("_scored", computed_once(scored))
    return df.withColumn(out, computed_once(_findings(F.col("_scored"), threshold))).drop(
        "_chunks", "_scored", "_vectors", "_templates")


def vector_similarity(spark: SparkSession, embeddings: DataFrame, templates: DataFrame,
                      threshold: float = P.SEMANTIC_SIMILARITY_THRESHOLD) -> DataFrame:
    """Best cosine of every embedding to the rows of ``templates`` (vec_id, embedding), a small table of known
    bad vectors that a scalar subquery puts beside each row."""
    return spark.sql(f"""
      WITH tpl AS (
        SELECT (SELECT sort_array(collect_list(struct(vec_id, transform(embedding, x -> CAST(x AS DOUBLE)) AS v)))
                FROM {{templates}}) AS t, e.*
        FROM {{embeddings}} e),
      scored AS (
        SELECT vec_id, label, transform(t, x -> struct(
            x.vec_id AS template_id,
            coalesce(try_divide(
              aggregate(zip_with(transform(embedding, y -> CAST(y AS DOUBLE)), x.v, (a, b) -> a * b), 0D, (s, y) -> s + y),
              sqrt(aggregate(embedding, 0D, (s, y) -> s + CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))
                 * sqrt(aggregate(x.v, 0D, (s, y) -> s + y * y))), 0D) AS cos)) AS sims
        FROM tpl)
      SELECT vec_id, label,
             array_max(transform(sims, s -> s.cos)) AS best_similarity,
             element_at(array_sort(sims, (l, r) -> CASE WHEN l.cos > r.cos THEN -1
                   WHEN l.cos < r.cos THEN 1 ELSE CAST(l.template_id - r.template_id AS INT) END), 1).template_id
               AS best_template
      FROM scored""", embeddings=embeddings, templates=templates).withColumn("is_hit", F.col("best_similarity") >= threshold)
