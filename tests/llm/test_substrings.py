"""Substring dedup against brute force over all windows."""
import random
import re
from collections import defaultdict

import numpy as np

from textsieve.llm import op13_substrings as S

SCHEMA = "doc_id long, text string, hash string, start int, words int"


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = defaultdict(list)
    for (i, _), ws in zip(rows, words):
        for p in range(len(ws) - window + 1):
            if i is not None:
                first[tuple(ws[p:p + window])].append(i)
    out = []
    for (i, t), ws in zip(rows, words):
        gone = set()
        for p in range(len(ws) - window + 1):
            ids = first[tuple(ws[p:p + window])]
            if ids and (i is None or min(ids) < i):
                gone |= set(range(p, p + window))
        out.append((i, len(ws), len(gone), None if t is None else " ".join(w for p, w in enumerate(ws) if p not in gone)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "h", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, S.dedup_substrings(df, **options).collect()), key=repr)


def passages(rnd, n, alphabet):
    pool = [[f"{rnd.choice(alphabet)}{rnd.randint(0, 3)}" for _ in range(rnd.randint(3, 30))] for _ in range(8)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(pool)
            a = rnd.randint(0, len(p) - 1)
            ws += p[a:] if rnd.random() < .5 else [f"own{i}-{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 9))]
        rows.append((i * 13 % 101, rnd.choice([" ", "\n", "\t  ", " "]).join(ws)))
    return rows


def test_small_windows_random_passages(spark):
    rnd = random.Random(13)
    rows = passages(rnd, 70, "abcd") + [(200, "a b " * 60), (201, "a b " * 30), (202, "b a " * 40), (203, "a " * 70), (150, "a " * 90)]
    for window, run_length in ((5, 3), (8, 4), (6, 6), (3, 1)):
        assert run(spark, rows, window=window, run=run_length) == brute(rows, window)


def test_blocks_and_full_sketch_do_not_change_the_result(spark, monkeypatch):
    rnd = random.Random(14)
    rows = passages(rnd, 60, "ab") + [(300, " ".join(str(k % 7) for k in range(400))), (301, " ".join(str(k % 7) for k in range(3, 300)))]
    want = brute(rows, 6)
    assert run(spark, rows, window=6, run=3, block=10) == want
    assert run(spark, rows, window=6, run=3, block=1) == want
    monkeypatch.setattr(S, "repeated_cells", lambda *a: b"\xff" * ((S.DEPTH << a[4]) // 8))
    assert run(spark, rows, window=6, run=3) == want


def test_ids_null_and_repeated_and_copies(spark):
    text = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"w{k}" for k in range(5, 58)) + " tail"
    rows = [(None, text), (None, text), (None, other), (7, text), (7, text), (7, other), (9, text), (9, other), (11, "short text"), (12, None), (13, "")]
    rows += [(20 + k, text) for k in range(40)]
    assert run(spark, rows) == brute(rows, 50)
    only_null = [(None, text), (None, other)]
    assert run(spark, only_null) == brute(only_null, 50)


def test_window_bounds(spark):
    def made(n, mark=""):
        return " ".join(f"v{k}{mark}" for k in range(n))
    rows = [(1, made(50)), (2, "x " + made(50) + " y"), (3, made(49)), (4, made(49, "q") + " z"), (5, made(49, "q")), (6, made(2000)), (7, made(3000))]
    got = run(spark, rows)
    assert got == brute(rows, 50)
    assert {r[0]: r[2] for r in got} == {1: 0, 2: 50, 3: 0, 4: 0, 5: 0, 6: 50, 7: 2000}


def test_documents_long_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows.append((5000, " ".join(r[1] or "" for r in rows[:60])))
    assert run(spark, rows, block=1000) == brute(rows, 50)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_estimates_lose_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    bits = np.frombuffer(S.repeated_cells(docs, "text", 50, 25, 16), np.uint8)
    count = defaultdict(int)
    for r in docs.collect():
        for a in {int(x) for _, _, anchors in S.blocks(S.words_of(r.text), 50, 25, 1 << 17) for x in anchors}:
            count[a] += 1
    anchors = np.array(list(count), np.uint64)
    repeated = np.array(list(count.values())) > 1
    estimated = S.estimated_repeated(anchors, bits, 16)
    assert estimated[repeated].all() and repeated.any()
    assert estimated[~repeated].mean() < 0.5


def test_runs_do_not_depend_on_place():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    d = S.Runs(hashes).digests(slice(0, 451), slice(50, 501))
    for p in (0, 7, 450):
        assert d[p] == S.Runs(hashes[p:p + 50]).digests(slice(0, 1), slice(50, 51))[0]
    assert len(set(d.tolist())) == 451
    x = np.random.default_rng(2).integers(0, 99, 40)
    for width in range(1, 20):
        assert S.least(x, width).tolist() == [min(x[i:i + width]) for i in range(40 - width + 1)]
