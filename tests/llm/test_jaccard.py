"""Jaccard join against brute force, prefix guarantee, edge cases."""
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from textsieve.llm import op3_jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute(rows, percent=80):
    s = sets_of(rows)
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = [0] * len(s)
    for a in range(len(s)):
        for b in range(a):
            if s[a][0] is None or s[b][0] is None:
                continue
            both = len(s[a][1] & s[b][1])
            linked = both and 100 * both >= percent * len(s[a][1] | s[b][1])
            if linked:
                degree[a] += 1
                degree[b] += 1
            if linked or s[a][0] == s[b][0]:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(s):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(x), least.get(find(k)) if i is not None else None, degree[k]) for k, (i, x) in enumerate(s)),
                  key=repr)


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = rnd.choice(["blue", "green", "red", "seven"])
    return " ".join(w)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_join(docs, **options).collect()),
                  key=repr)


def test_planted_groups(spark, monkeypatch):
    """Frequent tokens and split components come into play: a group of 60 near copies, blocks of 16."""
    monkeypatch.setattr(J, "BLOCK_DOCS", 16)
    monkeypatch.setattr(J, "FREQUENT", 4)
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    new = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, notice = new(120), new(30)
    texts = [edited(rnd, base, rnd.randint(0, 3)) for _ in range(60)] + [base] * 5
    texts += [f"{new(60)} {notice}" for _ in range(20)] + [f"{new(8)} {notice}" for _ in range(20)]
    for n in (4, 5, 6, 8, 9, 12, 40, 300):
        t = new(n)
        texts += [t, t.upper(), f"{t} extra", edited(rnd, t, 1)]
    texts += [None, "", "  \n ", "one", "ONE", "one two", "é\xa0è ü\x85x"]
    rows = list(zip(rnd.sample(range(1000), len(texts)), texts))
    assert run(spark, rows) == brute(rows)


def test_groups_with_empty_blocks(spark, monkeypatch):
    """Pairs of near copies longer than a block, of which many fall into one block of several."""
    monkeypatch.setattr(J, "BLOCK_TOKENS", 50)
    rnd = random.Random(3)
    texts = []
    for g in range(16):
        t = " ".join(f"g{g}w{rnd.randrange(100_000)}" for _ in range(90))
        texts += [t, f"{t} more"] + [f"{t} third"] * (g % 2)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_short_sets_at_lower_percent(spark, monkeypatch):
    """Sets of 1 to 4 tokens that differ by one link where the percent says so, also by frequent tokens."""
    monkeypatch.setattr(J, "FREQUENT", 3)
    texts = [" ".join(f"g{g}w{j}" for j in range(n)) for g in range(6) for n in (5, 6, 7, 8, 9)[g % 3:]]
    texts += [f"a b c d e {x}" for x in ("f", "g", "h", "i")] + ["a b c d e", "z a b c d e"]
    rows = list(enumerate(texts))
    for percent in (76, 75, 66, 50, 30):
        assert run(spark, rows, percent=percent) == brute(rows, percent), percent


def test_ids_null_and_repeated(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (5, "x y z"),
            (5, "totally other text here now"), (1, "totally other text here now"), (9, "x y z")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shared_signature_of_similar_sets():
    """Any two sets of at least 80 % share a signature, whatever is frequent."""
    rnd = random.Random(1)
    for _ in range(400):
        n = rnd.randint(4, 400)
        common = set(rnd.sample(range(10_000), n))
        x, y = set(common), set(common)
        while True:
            nx = x - {rnd.choice(sorted(x))} if rnd.random() < 0.5 else x | {rnd.randrange(10_000, 20_000)}
            if not nx or 100 * len(nx & y) < 80 * len(nx | y):
                break
            x = nx
        if len(x) < 4 or len(y) < 4 or 100 * len(x & y) < 80 * len(x | y):
            continue
        frequent = rnd.random()
        sigs = []
        prefixes = {}
        order = lambda s: sorted(s, key=lambda t: (t * 2654435761) % 1_000_003)
        for name, s in (("x", x), ("y", y)):
            longest = J.may_miss(len(s)) + 1 + J.classes(J.levels(len(s))[-1])
            prefixes[name] = order(s)[:longest]
        shared = set(prefixes["x"]) & set(prefixes["y"])
        for name, s in (("x", x), ("y", y)):
            places = np.array([i for i, t in enumerate(prefixes[name]) if t in shared], np.int64)
            tokens = np.array([prefixes[name][i] for i in places], np.uint64)
            often = np.array([(int(t) * 7919 % 1000) / 1000 < frequent for t in tokens], bool)
            sigs.append(set(J.signatures_of(len(s), places, tokens, often).tolist()) if len(tokens) else set())
        assert sigs[0] & sigs[1], (len(x), len(y), len(x & y))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 30), min_size=1, max_size=12), min_size=2, max_size=12), st.booleans())
def test_verified_group(sets, across):
    rows = np.arange(100, 100 + len(sets))
    sides = np.array([i % 2 if across else 0 for i in range(len(sets))])
    copies = np.arange(1, len(sets) + 1)
    got = {a: links for a, _, links in J.verify_group(rows, sides, copies, [np.array(sorted(s), np.uint64) for s in sets], 80)}
    want = {}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and (not (sides != sides[0]).any() or sides[i] != sides[j]) and 100 * len(a & b) >= 80 * len(a | b):
                want[100 + i] = want.get(100 + i, 0) + copies[j]
    assert got == want
