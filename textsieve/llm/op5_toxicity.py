"""Toxicity with a classifier chain.

Categories are predicted one after the other.  The model of each category is a
linear (logistic) model on the words of the text and on the probabilities that
the models of the earlier categories give.  In training those probabilities are
out-of-fold: each fold's come from a model that did not see the fold, so a later
model learns how far to trust them on new text.  A category's final model is
fitted on all rows.

Words are runs of letters and digits of the lower-cased text; each and its first
3, 4 and 5 characters (compounds begin alike) are hashed into ``DIM`` slots, and
a slot counts as present or not.  Fits minimise the mean
logistic loss plus an L1 penalty (coordinate Newton steps over a working set that
takes in the slots that violate optimality most), so only telling words keep a
weight and long clean texts gather no noise.

Only the fit is bounded: at most ``FIT_ROWS`` labelled rows, those with the
smallest hash of their id (documented sample).  Each fold model is fitted in a task
of its own; scoring is map-only over every whole text.  What reaches the driver is
the weights that are not zero.

Edge cases: rows without a label for a category do not train it; a category with
one class only (or no labelled row) predicts its share (0 without rows) and no
words; null or empty text has no words and gets what the intercept says;
repeated rows are scored each; null ids are never used in the fit, and of
several rows with one id that with the least hash of its text is.
"""
from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsieve.llm.common import cut, table, values

DIM = 1 << 18
FIT_ROWS = 20_000
FOLDS = 3
PREFIXES = (3, 4, 5)
PENALTY, WORKING = 0.014, 256      # the penalty is divided by the square root of the rows
CUTOFF = 0.5
_OWNER_BITS = 40           # of a posting; the slot is above
_WORD = re.compile(r"\w+")


class Slots(dict):
    """word -> slots of the word and of its first characters; emptied when full."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 1 << 17:
            self.clear()
        parts = [word] + [word[:n] + "~" for n in PREFIXES if len(word) >= n]
        slots = self[word] = tuple(xxhash.xxh3_64_intdigest(p) % DIM for p in parts)
        return slots


def slots_of(text: str | None, slots: Slots) -> set[int]:
    return set(chain.from_iterable(map(slots.__getitem__, set(_WORD.findall(text.lower()))))) if text else set()


def postings(parts, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots in three texts or more, start and end of each one's texts in owner, owner) from parts (slots, owners)
    of ``slots`` slots in all; rarer words cannot earn their penalty.  Holds 8 bytes a slot, then 4."""
    key, at = np.empty(slots, np.int64), 0
    for slot, owner in parts:
        own = key[at:at + len(slot)]
        own[:] = slot
        own <<= _OWNER_BITS
        own |= owner
        at += len(slot)
    key.sort()
    owner = np.empty(slots, np.int32)
    often = np.zeros(DIM, np.int64)
    for lo in range(0, slots, 1 << 20):
        part = key[lo:lo + (1 << 20)]
        owner[lo:lo + (1 << 20)] = part & ((1 << _OWNER_BITS) - 1)
        often += np.bincount(part >> _OWNER_BITS, minlength=DIM)
    del key
    end = np.cumsum(often)
    used = np.flatnonzero(often >= 3)
    return used, end[used] - often[used], end[used], owner


def fit_logistic(slots: np.ndarray, lengths: np.ndarray, extra: np.ndarray, y: np.ndarray, **options):
    """`fit_postings` for texts whose slots follow each other; ``lengths`` says how many each text has."""
    owner = np.repeat(np.arange(len(y)), lengths)
    return fit_postings(*postings([(slots, owner)], len(slots)), extra, y, **options)


def fit_postings(used: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, extra: np.ndarray,
                 y: np.ndarray, penalty: float = PENALTY, rounds: int = 12, passes: int = 10):
    """(intercept, slots with weight, their weights, weights of extra); slot ``used[j]`` is in the texts
    ``owner[start[j]:end[j]]``."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        floor = 1e-6
        return float(np.log(max(share, floor) / max(1 - share, floor))), np.empty(0, np.int64), np.empty(0), \
            np.zeros(extra.shape[1])
    n, k = len(y), extra.shape[1]
    penalty = penalty / np.sqrt(n)
    w, base = np.zeros(len(used)), np.zeros(1 + k)
    dense = np.column_stack((np.ones(n), extra))
    base[0] = np.log(share / (1 - share))
    score = dense @ base
    active = np.empty(0, np.int64)
    for _ in range(rounds):
        residual = probability(score) - y
        slope = np.array([residual[owner[i:j]].sum() for i, j in zip(start, end)]) / n if len(start) else np.empty(0)
        outside = np.abs(slope) - penalty
        outside[active] = 0
        new = np.argsort(-outside, kind="stable")[:WORKING]
        new = new[outside[new] > penalty * 0.01]
        active = np.concatenate((active, new))
        moved = 0.0
        for _ in range(passes):
            p = probability(score)          # Newton step of intercept and earlier probabilities together
            curve = dense.T @ (dense * (p * (1 - p))[:, None]) + 1e-6 * np.eye(1 + k)
            step = np.clip(np.linalg.solve(curve, dense.T @ (y - p)), -2.0, 2.0)
            base += step
            score += dense @ step
            moved = float(np.abs(step).max())
            for j in active:
                at = owner[start[j]:end[j]]
                p = probability(score[at])
                curve = (p * (1 - p)).sum() / n + 1e-6
                goal = w[j] - (p - y[at]).sum() / n / curve
                goal = np.sign(goal) * max(abs(goal) - penalty / curve, 0.0)
                step = min(max(goal - w[j], -1.0), 1.0)
                if step:
                    w[j] += step
                    score[at] += step
                    moved = max(moved, abs(step))
            if moved < 1e-3:
                break
        if not len(new) and moved < 1e-3:
            break
    on = np.flatnonzero(w)
    return float(base[0]), used[on], w[on], base[1:]


def probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


class Link:
    """The fitted model of one category of the chain."""

    def __init__(self, category: str, intercept: float, weights: dict[int, float], earlier: list[float]):
        self.category, self.intercept, self.weights, self.earlier = category, intercept, weights, earlier

    def predict(self, slots, before: list[float]) -> float:
        get = self.weights.get
        s = self.intercept + sum(get(i, 0.0) for i in slots) + sum(w * p for w, p in zip(self.earlier, before))
        return float(probability(np.array(s)))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id",
              text_col: str = "text", fit_rows: int = FIT_ROWS, folds: int = FOLDS) -> list[Link]:
    """categories: name -> 0/1 expression over ``labels``, in the order of the chain."""
    names = list(categories)
    chosen = (labels.select(F.col(id_col).cast("bigint").alias("id"), *[c.cast("double").alias(f"y{i}") for i, c in
                                                                       enumerate(categories.values())])
              .where("id IS NOT NULL").groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
              .withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(fit_rows))

    def slots(batches):
        cache = Slots()
        for b in batches:
            sets = [slots_of(t, cache) for t in values(b.column(b.schema.get_field_index("text")))]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.fromiter(chain.from_iterable(map(sorted, sets)), np.int32, ends[-1])
            yield b.drop_columns(["text"]).append_column("slots", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))

    ys = ", ".join(f"y{i} double" for i in range(len(names)))
    # the sample is bounded by fit_rows, so it may be broadcast; of rows with one id that with the least hash of its text counts
    rows = cut(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
               .join(F.broadcast(chosen), "id")
               .select("id", "h", F.xxhash64("text").alias("t"), *[f"y{i}" for i in range(len(names))], "text")
               .mapInArrow(slots, f"id bigint, h bigint, t bigint, {ys}, slots array<int>")
               .groupBy("id").agg(F.min_by(F.struct("h", *[f"y{i}" for i in range(len(names))], "slots"), "t").alias("row"))
               .select("id", "row.*").withColumn("fold", F.pmod("h", F.lit(folds)).cast("int")))
    links: list[Link] = []
    earlier = rows.select("id")
    for i, name in enumerate(names):
        known = tuple(f"p{j}" for j in range(i))
        data = rows.select("id", "fold", "slots", F.col(f"y{i}").alias("y")).join(earlier, "id")
        # job j < folds is fitted without fold j, for the probabilities that later categories learn from; the last one on all rows
        first_job = 0 if i + 1 < len(names) else folds
        jobs = (data.where("y IS NOT NULL AND NOT isnan(y)")
                .withColumn("job", F.explode(F.filter(F.sequence(F.lit(first_job), F.lit(folds)), lambda j: j != F.col("fold")))))

        def fit(key, table):
            ids = table.column("id").to_numpy()
            order = np.argsort(ids)                               # sums in one order: reruns agree
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            extra = np.column_stack([np.empty((len(ids), 0))] + [table.column(c).to_numpy()[order] for c in known])

            def parts():
                at = 0
                for c in table.column("slots").chunks:
                    yield c.flatten().to_numpy(), np.repeat(place[at:at + len(c)], c.value_lengths().to_numpy())
                    at += len(c)

            n = sum(len(c.flatten()) for c in table.column("slots").chunks)
            b, at, w, e = fit_postings(*postings(parts(), n), extra, table.column("y").to_numpy()[order])
            out = [(-1, b), *((-2 - j, x) for j, x in enumerate(e)), *zip(at.tolist(), w.tolist())]
            return pa.table({"job": pa.array([key[0].as_py()] * len(out), pa.int32()), "k": pa.array([r[0] for r in out], pa.int64()),
                             "v": pa.array([float(r[1]) for r in out], pa.float64())})

        found: dict[int, dict[int, float]] = {j: {} for j in range(folds + 1)}
        for r in jobs.groupBy("job").applyInArrow(fit, "job int, k bigint, v double").collect():     # weights that are not zero
            found[r.job][r.k] = r.v
        fitted = [Link(name, w.pop(-1, float(np.log(1e-6))), {k: v for k, v in w.items() if k >= 0},
                       [w.get(-2 - j, 0.0) for j in range(i)]) for w in found.values()]
        links.append(fitted[folds])
        if i + 1 < len(names):
            earlier = cut(data.select("id", "fold", "slots", *known)
                          .mapInArrow(_out_of_fold(fitted[:folds], known), ", ".join(["id bigint", *(f"p{j} double" for j in range(i + 1))])))
    return links


def _out_of_fold(fitted: list[Link], known: tuple[str, ...]):
    """(id, earlier probabilities, and that of the model that did not see the row's fold)."""
    def run(batches):
        dense = []
        for m in fitted:
            weights = np.zeros(DIM)
            weights[list(m.weights)] = list(m.weights.values())
            dense.append(weights)
        for b in batches:
            column, fold = b.column(2), b.column(1).to_numpy()
            owner = np.repeat(np.arange(len(fold)), column.value_lengths().to_numpy())
            flat, before = column.flatten().to_numpy(), [b.column(3 + j) for j in range(len(known))]
            score = np.zeros(len(fold))
            for k, m in enumerate(fitted):
                s = m.intercept + np.bincount(owner, dense[k][flat], minlength=len(fold))
                s += sum(w * p.to_numpy() for w, p in zip(m.earlier, before))
                score = np.where(fold == k, s, score)
            yield pa.RecordBatch.from_arrays([b.column(0), *before, pa.array(probability(score))],
                                             names=["id", *known, f"p{len(known)}"])

    return run


def predict_chain(docs: DataFrame, chain: list[Link], id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``keep``, and p_<category> for every category of the chain."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    fields = [src.schema["doc_id"], *[src.schema[c] for c in keep]]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) \
        + "".join(f", `p_{m.category}` double" for m in chain)

    def run(batches):
        cache = Slots()
        for b in batches:
            out = [[] for _ in chain]
            for text in values(b.column(1)):
                slots, before = slots_of(text, cache), []
                for i, m in enumerate(chain):
                    before.append(m.predict(slots, before))
                    out[i].append(before[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[b.column(2 + i) for i in range(len(keep))], *[pa.array(o, pa.float64()) for o in out]],
                names=["doc_id", *keep, *[f"p_{m.category}" for m in chain]])

    return src.mapInArrow(run, ddl)


def label_categories() -> dict[str, Column]:
    """Chain order: poor quality first, then toxic, which may use it."""
    return {"poor": 1 - F.col("quality"), "toxic": F.col("toxic")}


def toxicity_chain(spark, sf_dir, docs: DataFrame | None = None) -> list[Link]:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return fit_chain(docs, table(spark, sf_dir, "labels"), label_categories())


def op5_toxicity(spark, sf_dir):
    """Probability of every category for every document, and whether it is rejected as toxic."""
    docs = table(spark, sf_dir, "documents")
    scored = predict_chain(docs, toxicity_chain(spark, sf_dir, docs))
    return scored.withColumn("toxic", F.col("p_toxic") >= CUTOFF)


QUERIES = {"op5_toxicity": op5_toxicity}
