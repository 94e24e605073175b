"""Language identification with hyperdimensional n-gram profiles.

Every letter (and the word boundary) owns a pseudo-random vector of +1/-1.  The
vector of an n-gram binds its letters: the vector of the letter at distance d
from the end is rotated d places and all are multiplied component by component.
A text is the bundle (sum) of the vectors of its n-grams, a language the bundle
of its training texts, and a text gets the language whose bundle has the
largest cosine with its own.

Scale: both passes are map-only.  Training leaves one vector per language and
task, summed in integers (so in any order the same) by one small aggregation;
what reaches the driver is languages x ``dim`` numbers.

Edge cases: null text and text without a letter give ``und`` and score 0; so
does every text when nothing could be learned.  Equal cosines go to the
smallest language by code point.  Repeated rows and ids are predicted each.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsieve.llm.common import table, values

DIM, NGRAM, SEED = 1024, 3, 20231
UNKNOWN = "und"
_BLOCK_GRAMS, _BLOCK_DOCS, _BLOCK_CODES = 4096, 64, 1 << 18
_BITS = np.uint64(21)


class Encoder:
    """Text -> n-gram counts -> hypervector."""

    def __init__(self, dim: int = DIM, n: int = NGRAM, seed: int = SEED):
        self.dim, self.n, self.seed = dim, n, seed
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.vectors: dict[int, np.ndarray] = {}

    def grams(self, text: str | None) -> np.ndarray:
        """Packed n-grams of the lower-cased text; each run of other characters is one boundary (0)."""
        if not text:
            return np.empty(0, np.uint64)
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = self.letter[cp]
        if not ok.any():
            return np.empty(0, np.uint64)
        seq = np.where(ok, cp, 0)
        seq = seq[ok | np.concatenate(([False], ok[:-1]))]
        seq = np.concatenate(([0], seq, [0])).astype(np.uint64)
        if len(seq) > 2 and seq[-2] == 0:
            seq = seq[:-1]
        if len(seq) < self.n:
            seq = np.concatenate((seq, np.zeros(self.n - len(seq), np.uint64)))
        out = np.zeros(len(seq) - self.n + 1, np.uint64)
        for j in range(self.n):
            out = (out << _BITS) | seq[j:len(seq) - self.n + 1 + j]
        return out

    def _letter_vector(self, cp: int) -> np.ndarray:
        v = self.vectors.get(cp)
        if v is None:
            if len(self.vectors) >= 1 << 14:
                self.vectors.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, cp])).integers(0, 2, self.dim)
            v = self.vectors[cp] = (bits * 2 - 1).astype(np.int8)
        return v

    def gram_matrix(self, grams: np.ndarray) -> np.ndarray:
        """One row per packed n-gram: the product of its rotated letter vectors."""
        out = np.ones((len(grams), self.dim), np.int8)
        for j in range(self.n):
            letters, at = np.unique((grams >> (_BITS * np.uint64(j))) & np.uint64((1 << 21) - 1), return_inverse=True)
            own = np.stack([np.roll(self._letter_vector(int(c)), j) for c in letters])
            out *= own[at]
        return out

    def bundle(self, owner: np.ndarray, grams: np.ndarray, n_owners: int) -> np.ndarray:
        """Sum of the gram vectors of each owner (rows 0..n_owners-1), exact in float64."""
        out = np.zeros((n_owners, self.dim))
        if len(grams) == 0:
            return out
        distinct, at = np.unique(grams, return_inverse=True)
        for lo in range(0, len(distinct), _BLOCK_GRAMS):
            part = distinct[lo:lo + _BLOCK_GRAMS]
            here = (at >= lo) & (at < lo + len(part)) if len(distinct) > _BLOCK_GRAMS else slice(None)
            counts = np.bincount(owner[here] * len(part) + (at[here] - lo), minlength=n_owners * len(part))
            out += counts.reshape(n_owners, -1).astype(np.float32) @ self.gram_matrix(part).astype(np.float32)
        return out


def _blocks(rows: Iterator, encoder: Encoder):
    """Gather (key, text) rows into blocks: keys, owner of each gram, grams."""
    keys, grams, size = [], [], 0
    for key, text in rows:
        g = encoder.grams(text)
        keys.append(key)
        grams.append(g)
        size += len(g)
        if len(keys) >= _BLOCK_DOCS or size >= _BLOCK_CODES:
            yield keys, np.repeat(np.arange(len(keys)), [len(g) for g in grams]), np.concatenate(grams)
            keys, grams, size = [], [], 0
    if keys:
        yield keys, np.repeat(np.arange(len(keys)), [len(g) for g in grams]), np.concatenate(grams)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          dim: int = DIM, n: int = NGRAM) -> dict[str, np.ndarray]:
    """Language -> bundled vector over all labelled rows (null text or language is skipped)."""
    def bundle_part(batches):
        encoder, total = Encoder(dim, n), {}
        rows = (x for b in batches for x in zip(values(b.column(0)), values(b.column(1))))
        for keys, owner, grams in _blocks(rows, encoder):
            names = sorted(set(keys))
            lang = np.array([names.index(k) for k in keys])
            for name, v in zip(names, encoder.bundle(lang[owner], grams, len(names))):
                total[name] = total.get(name, 0) + np.rint(v).astype(np.int64)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tolist()], pa.list_(pa.int64()))],
                                             names=["lang", "v"])

    parts = (labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
             .where("lang IS NOT NULL AND text IS NOT NULL")
             .mapInArrow(bundle_part, "lang string, v array<bigint>"))
    sums = (parts.select("lang", F.posexplode("v").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v")))
    out: dict[str, np.ndarray] = {}
    for lang, i, v in sums.collect():        # languages x dim numbers
        out.setdefault(lang, np.zeros(dim))[i] = v
    return {k: v for k, v in out.items() if np.any(v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
            keep: dict[str, Column] | None = None, dim: int = DIM, n: int = NGRAM) -> DataFrame:
    """id, the columns of ``keep`` (boolean expressions over ``docs``), lang_pred, score."""
    names = sorted(prototypes)
    unit = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else None
    keep = keep or {}
    kept = list(keep)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                      *[c.cast("boolean").alias(k) for k, c in keep.items()])
    ddl = "doc_id bigint" + "".join(f", {k} boolean" for k in keep) + ", lang_pred string, score double"

    def run(batches):
        encoder = Encoder(dim, n)
        for b in batches:
            lang, score = [], []
            for keys, owner, grams in _blocks(((None, t) for t in values(b.column(1))), encoder):
                known = np.bincount(owner, minlength=len(keys)) > 0
                if unit is None:
                    known[:] = False
                    cos = np.zeros((len(keys), 1))
                else:
                    v = encoder.bundle(owner, grams, len(keys))
                    cos = v @ unit.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                best = cos.argmax(axis=1)
                lang += [names[i] if ok else UNKNOWN for i, ok in zip(best, known)]
                score += [float(min(1.0, max(0.0, cos[r, i]))) if ok else 0.0
                          for r, (i, ok) in enumerate(zip(best, known))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[b.column(2 + i) for i in range(len(kept))], pa.array(lang, pa.string()),
                 pa.array(score, pa.float64())], names=["doc_id", *kept, "lang_pred", "score"])

    return src.mapInArrow(run, ddl)


def op1_language_id(spark, sf_dir):
    """Learn from the rows outside the held-out quarter, predict every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    known = docs.where(~F.coalesce(held_out, F.lit(False)))
    return predict(docs, train(known), keep={"held_out": F.coalesce(held_out, F.lit(False))})


QUERIES = {"op1_language_id": op1_language_id}
