"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Vectors are scaled to length 1.  In a tile (two blocks of vectors) each block is
quantised to int8 with the block's own step: u = step * q + e, and |e| is known
for every vector.  One matrix product of the integers (exact: they are added in
float32 only while sums stay below 2**24) gives all q.q' of the tile, and

    |u.u' - step * step' * q.q'| <= |e| * (1 + |e'|) + |e'|

so only pairs whose upper bound reaches the threshold are recomputed, in double
precision from the given components.  No link is lost and none below the
threshold is kept.

Scale: equal vectors are folded first.  Each vector belongs to the cell of its
nearest pivot (pivots: ``PIVOTS`` at most, a documented bounded sample), a cell
is cut into blocks of about ``BLOCK`` vectors, and a pair of cells whose angles
prove that no pair can reach the threshold is skipped:
angle(pivots) - radius - radius' > arccos(threshold).  The pivots only decide
what is compared with what, not the result.

All pairs are met in rounds.  A round holds as many blocks as fit in ``HELD_BYTES``;
every task gets them as a broadcast and meets its own blocks with them, so no vector is
copied for the blocks it meets, on disk or in a shuffle: what is stored grows with the
vectors, and only products grow with their square.  A task emits one row for each of its
vectors linked in the round (its links and a held vector it is connected to) and one for
each linked held vector, never pairs.

Edge cases: vectors that are null, zero, or hold null or non-finite components
link with nothing; vectors of different lengths are never compared; rows without
id get null component and kept false; repeated ids share a component.
"""
from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsieve.llm.common import cut, table
from textsieve.llm.graph import component_ids

THRESHOLD = 0.95
PIVOTS, BLOCK = 256, 2048
HELD_BYTES = 32 << 20           # vectors of a round as doubles
_SLACK = 1e-9                   # rounding of the bounds themselves (float64)
_EXACT_DIM = 1024               # 127 * 127 * 1024 < 2**24


def quantise(unit: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 values, step, and for every row the length of what quantisation lost."""
    step = float(np.abs(unit).max()) / 127 or 1.0
    q = np.rint(unit / step).astype(np.int8)
    return q, step, np.linalg.norm(unit - step * q.astype(np.float64), axis=1) + _SLACK


def integer_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All q.q' of two int8 blocks, exactly."""
    if a.shape[1] <= _EXACT_DIM:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((integer_product(a[:, d:d + _EXACT_DIM], b[:, d:d + _EXACT_DIM]).astype(np.float64)
                for d in range(0, a.shape[1], _EXACT_DIM)), np.zeros((len(a), len(b))))


class Side:
    """Vectors of a block, made ready for tile products."""

    def __init__(self, vectors: np.ndarray):
        self.v = vectors.astype(np.float64)
        self.norm = np.linalg.norm(self.v, axis=1)
        self.q, self.step, self.err = quantise(self.v / np.linalg.norm(self.v, axis=1, keepdims=True))
        self.worst = float(self.err.max())


def links_of(a: Side, b: Side | None, threshold: float):
    """Index pairs (i, j) with cosine >= threshold between the rows of a and b (b None: inside a, i < j),
    in pieces of bounded size."""
    other = a if b is None else b
    for lo in range(0, len(a.v), 256):
        hi = min(lo + 256, len(a.v))
        least = (threshold - a.err[lo:hi] * (1 + other.worst) - other.worst) / (a.step * other.step) - 1e-3
        start = lo if b is None else 0
        i, j = np.nonzero(integer_product(a.q[lo:hi], other.q[start:]) >= least[:, None])
        i, j = i + lo, j + start
        if b is None:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 15):
            x, y = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
            cos = np.einsum("ij,ij->i", a.v[x], other.v[y]) / (a.norm[x] * other.norm[y])
            keep = cos >= threshold
            if keep.any():
                yield x[keep], y[keep]


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float):
    return links_of(Side(a), None if b is None else Side(b), threshold)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Divided by their largest component first, so that lengths neither overflow nor vanish."""
    v = vectors.astype(np.float64)
    return v / np.abs(v).max(axis=1, keepdims=True) + 0.0


class Held:
    """The blocks that a round holds, and what a task finds out about their vectors."""

    def __init__(self, threshold: float, blocks: np.ndarray, cells: np.ndarray, bounds: np.ndarray, rows, copies, vectors):
        self.threshold, self.blocks, self.cells, self.bounds = threshold, blocks, cells, bounds
        self.rows, self.copies = rows, copies
        self.sides = [Side(scaled(vectors[lo:hi])) for lo, hi in zip(bounds, bounds[1:])]

    def begin(self):
        self.label, self.links = np.arange(len(self.rows)), np.zeros(len(self.rows), np.int64)

    def _join(self, i, j):
        label = self.label
        while True:                                   # join the labels of linked rows
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while (label[label] != label).any():
                label = label[label]
        self.label = label

    def met(self, block: int, near: set[int], rows, copies, vectors):
        """Links a block with the held blocks from itself on: (rows, a held row each is connected to, links)."""
        side = None
        first, links = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
        joins, size = [], 0
        for k, (its, cell) in enumerate(zip(self.blocks, self.cells)):
            if its < block or cell not in near:
                continue
            lo = self.bounds[k]
            if its != block and side is None:
                side = Side(scaled(vectors))
            for i, j in links_of(self.sides[k] if its == block else side, None if its == block else self.sides[k], self.threshold):
                if its == block:
                    i, j = i + lo, j + lo
                    np.add.at(self.links, i, self.copies[j])
                    np.add.at(self.links, j, self.copies[i])
                    joins.append((i, j))
                else:
                    j = j + lo
                    np.add.at(links, i, self.copies[j])
                    np.add.at(self.links, j, copies[i])
                    some, at = np.unique(i, return_index=True)
                    new = first[some] < 0
                    first[some[new]] = j[at[new]]
                    joins.append((first[i], j))
                size += len(i)
                if size >= 1 << 16:
                    self._join(*(np.concatenate(x) for x in zip(*joins)))
                    joins, size = [], 0
        if joins:
            self._join(*(np.concatenate(x) for x in zip(*joins)))
        at = np.flatnonzero(links)
        return rows[at], self.rows[first[at]], links[at]

    def end(self):
        at = np.flatnonzero(self.links)
        return self.rows[at], self.rows[self.label[at]], self.links[at]


_LAST: dict[str, Held] = {}                           # of each worker process, the round's blocks


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, block: int = BLOCK, max_pivots: int = PIVOTS,
                    held_bytes: int = HELD_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    # float components are kept as they come: half the bytes of doubles, and scaled where they are used
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    usable = (F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)),
                                                  F.lit(False)) & F.exists("v", lambda x: x != 0))
    rows = cut(vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
               .withColumn("row", F.monotonically_increasing_id()))
    # scaled by the largest component first, so that lengths neither overflow nor vanish
    named = cut(rows.where(F.col("id").isNotNull() & usable).withColumn("v", F.col("v").cast("array<double>"))
                .withColumn("big", F.array_max(F.transform("v", F.abs)))
                .select("row", "id", F.transform("v", lambda x: x / F.col("big") + 0.0).alias("v"))
                .select("row", "id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("dim")))
    folded = cut(named.groupBy("h1", "h2").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("dim").alias("dim")))
    verified = _verified(rows.select("row", "v"), folded, threshold, block, max_pivots, held_bytes)
    copies = (named.select("row", "h1", "h2").join(folded.where("copies > 1")
              .select("h1", "h2", F.col("row").alias("b")), ["h1", "h2"]).select(F.col("row").alias("a"), "b"))
    parts = component_ids(named, verified.select("a", "b").unionByName(copies))
    degree = (folded.join(verified.groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links")), "row", "left")
              .select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).where("n_links > 0"))
    linked = named.select("row", "h1", "h2").join(degree, ["h1", "h2"]).select("row", "n_links")
    component = F.coalesce("component_id", "id")
    return (rows.select("row", "id").join(linked, "row", "left").join(parts, "row", "left")
            .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")))


def _verified(rows: DataFrame, folded: DataFrame, threshold: float, block: int, max_pivots: int, held_bytes: int) -> DataFrame:
    out = None
    for dim, n in sorted((r.dim, r.n) for r in folded.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        for part in _verified_dim(rows, folded.where(F.col("dim") == dim), dim, n, threshold, block, max_pivots, held_bytes):
            out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "a bigint, b bigint, links bigint")


def _verified_dim(rows: DataFrame, folded: DataFrame, dim: int, n: int, threshold: float, block: int, max_pivots: int,
                  held_bytes: int):
    """What each round finds, as tables."""
    spark = rows.sparkSession
    kind = rows.schema["v"].dataType.simpleString()
    k = max(1, min(max_pivots, n // block))
    sample = [r.row for r in folded.select("row", F.xxhash64("row").alias("h")).orderBy("h").limit(k).collect()]
    pivots = scaled(np.array([r.v for r in rows.where(F.col("row").isin(sample)).collect()], np.float64))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = scaled(_matrix(b.column(2), dim))
            cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
            cell = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(x)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle)],
                                             names=["row", "copies", "v", "cell", "angle"])

    cells = cut(folded.select("row", "copies").join(rows, "row").select("row", "copies", "v")
                .mapInArrow(assign, f"row bigint, copies bigint, v {kind}, cell int, angle double"))
    stats = {r.cell: (r.r, -(-r.n // block)) for r in
             cells.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()}
    reach = math.acos(threshold) + 1e-6
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    near = {a: {b for b in stats if a == b or between[a, b] - stats[a][0] - stats[b][0] <= reach} for a in stats}
    first, blocks = {}, 0                                                 # blocks are numbered through the cells
    for c in sorted(stats):
        first[c], blocks = blocks, blocks + stats[c][1]
    numbers = spark.createDataFrame([(c, first[c], stats[c][1]) for c in stats], "cell int, first int, blocks int")     # at most max_pivots rows
    number = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).cast("int")
    parts = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 16))
    dealt = cut(cells.join(F.broadcast(numbers), "cell").select(number.alias("block"), "cell", "row", "copies", "v")
                .repartition(parts, "block").sortWithinPartitions("block"))
    per_round = max(1, held_bytes // (8 * dim * block))
    for lo in range(0, blocks, per_round):
        yield _round(dealt.where(F.col("block") < lo + per_round), lo, dim, near, threshold)


def _round(dealt: DataFrame, lo: int, dim: int, near: dict, threshold: float) -> DataFrame:
    """Links of all blocks with the blocks from ``lo`` on, which every task holds."""
    spark = dealt.sparkSession
    own = dealt.where(F.col("block") >= lo).toArrow().sort_by([("block", "ascending"), ("row", "ascending")]).combine_chunks()
    block, cell, row, copies = (own.column(k).to_numpy() for k in range(4))
    if not len(block):
        return spark.createDataFrame([], "a bigint, b bigint, links bigint")
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    token, held = uuid.uuid4().hex, spark.sparkContext.broadcast(
        (block[starts], cell[starts], np.append(starts, len(block)), row, copies, _matrix(own.column(4).combine_chunks(), dim)))

    def verify(batches):
        mine = _LAST.get(token)
        if mine is None:
            _LAST.clear()
            mine = _LAST[token] = Held(threshold, *held.value)
        mine.begin()
        key, kept = None, []

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b", "links"])

        def flush():
            return batch(mine.met(key[0], near[key[1]], *(np.concatenate(c) for c in zip(*kept))))

        for b in batches:
            names = np.stack([b.column(i).to_numpy() for i in range(2)], axis=1)
            x = _matrix(b.column(4), dim)
            rest = [b.column(i).to_numpy() for i in (2, 3)]
            edges = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for at, to in zip([0, *edges], [*edges, len(names)]):
                if at == to:
                    continue
                if tuple(names[at].tolist()) != key:
                    if kept:
                        yield flush()
                    key, kept = tuple(names[at].tolist()), []
                kept.append((rest[0][at:to], rest[1][at:to], x[at:to]))
        if kept:
            yield flush()
        yield batch(mine.end())

    found = cut(dealt.mapInArrow(verify, "a bigint, b bigint, links bigint"))
    held.destroy()
    return found


def op7_embedding_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_embedding_neardup": op7_embedding_neardup}
