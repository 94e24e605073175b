"""Embedding near-dedup against all pairs in double precision."""
import math

import numpy as np

from textsieve.llm import op7_vectors as V


def brute(rows, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            linked = False
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                linked = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold
            degree[a] += linked
            degree[b] += linked
            if linked or ok[a] and ok[b] and rows[a][0] == rows[b][0]:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, degree[k], least.get(find(k)) if i is not None else None, i is not None and least[find(k)] == i)
                   for k, (i, _) in enumerate(rows)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cell string")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df, **options).collect()), key=repr)


def test_planted_groups_in_small_blocks(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(6, 24))
    vectors = [list(map(float, np.float32(centres[i % 6] + rnd.normal(size=24) * (0.12 + 0.03 * (i % 5))))) for i in range(150)]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[0]], [-x for x in vectors[0]], None, [0.0] * 24,
                                   [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [], [1.0, 2.0],
                                   [2.0, 4.0], [1e-30] * 24, [1e30] * 24]
    ids = [int(i) for i in rnd.permutation(len(vectors))]
    rows = list(zip(ids, vectors))
    want = brute(rows)
    assert sum(r[1] for r in want) > 500
    assert run(spark, rows, block=16, max_pivots=5) == want
    assert run(spark, rows) == want


def test_ids_null_and_repeated(spark):
    rows = [(None, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (1, [0.0, 1.0]), (7, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_error_bound_is_rigorous():
    rnd = np.random.default_rng(3)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rnd.normal(size=(2, 200, 48)))
    qa, sa, ea = V.quantise(a)
    qb, sb, eb = V.quantise(b)
    exact = a @ b.T
    bound = (ea * (1 + eb.max()) + eb.max())[:, None]
    product = V.integer_product(qa, qb)
    assert (product == qa.astype(np.int64) @ qb.astype(np.int64).T).all()
    assert (np.abs(exact - sa * sb * product) <= bound).all()
    wide = rnd.integers(-127, 128, size=(3, 5000)).astype(np.int8)
    assert (V.integer_product(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()


def test_at_the_threshold():
    """Pairs just above and just below are told apart in double precision."""
    angle = math.acos(0.95)
    a = np.array([[1.0, 0.0]])
    b = np.array([[math.cos(angle - 1e-9), math.sin(angle - 1e-9)], [math.cos(angle + 1e-9), math.sin(angle + 1e-9)]])
    assert [j.tolist() for _, j in V.tile_links(a, b, 0.95)] == [[0]]


def test_rounds_meet_all_pairs_without_copies(spark, monkeypatch):
    """Whatever a round holds, all pairs are met, and no vector is dealt more than once."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(4, 16))
    vectors = [list(map(float, np.float32(centres[i % 4] + rnd.normal(size=16) * 0.15))) for i in range(160)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    dealt, round_ = [], V._round
    monkeypatch.setattr(V, "_round", lambda df, lo, *rest: (dealt.append((lo, df.count())), round_(df, lo, *rest))[1])
    assert run(spark, rows, block=16, max_pivots=3, held_bytes=8 * 16 * 16 * 3) == brute(rows)
    assert len(dealt) >= 3 and max(n for _, n in dealt) == len(rows)
