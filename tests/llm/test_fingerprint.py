"""Fingerprints: densification, neighbours and edits against plain versions."""
import hashlib

import numpy as np

from textsieve.llm import op4_fingerprint as P


def neighbours(rows):
    """(doc_id, text, next text) by sorting everything."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


def test_next_text_across_ranges(spark):
    rows = [(i * 37 % 1009, f"text {i}") for i in range(300)] + [(None, "a"), (None, None), (5_000_000, ""), (-7, None),
                                                                (5_000_000, "same id"), (77, "x" * 30_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, next_text int").repartition(4)
    for size in (7, 100_000):
        got = [(r.doc_id, r.text, r.next_text) for r in P.with_next_text(docs, rows_per_range=size).collect()]
        assert sorted(got, key=repr) == sorted(neighbours(rows), key=repr)


def test_one_row_and_empty(spark):
    docs = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    r = P.fingerprints(P.with_next_text(docs)).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert P.fingerprints(P.with_next_text(docs.limit(0))).count() == 0


def test_densification_is_the_same_for_equal_sets_and_fills_all_bins():
    m = P.OnePermutation()
    for text in ("a", "abcdefghij", "abc " * 50):
        bins = m.bins_of(text)
        assert len(bins) == P.BINS and (bins == m.bins_of(text)).all()
    plain = {}
    h = m.hashes("abcdefghijklm")
    for x in sorted(h.tolist(), reverse=True):
        plain[x >> int(m.shift)] = x
    attempt = [plain.get(b) for b in range(P.BINS)]
    for b in range(P.BINS):
        k = 0
        while attempt[b] is None or b not in plain:
            probe = int(m._probe(k // 64)[k % 64, b])
            if probe in plain:
                attempt[b] = plain[probe]
                break
            k += 1
    assert (m.bins_of("abcdefghijklm") == np.array([a & 255 for a in attempt])).all()


def test_likeness_estimates_jaccard():
    m, rnd = P.OnePermutation(), np.random.default_rng(2)
    errors = []
    for _ in range(40):
        base = "".join(rnd.choice(list("abcdefghij "), 1500))
        cut = int(rnd.integers(0, 1500))
        other = base[:cut] + "".join(rnd.choice(list("klmnopqrst "), 1500 - cut))
        a, b = set(m.hashes(base).tolist()), set(m.hashes(other).tolist())
        errors.append(m.likeness(m.bins_of(base), m.bins_of(other)) - len(a & b) / len(a | b))
    assert np.abs(errors).max() < 0.13 and abs(np.mean(errors)) < 0.02


def test_query_columns(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in P.op4_fingerprint(spark, d).collect()}
    maker = P.OnePermutation()
    for i, text, following in neighbours(rows):
        k = len(text) // 3
        changed = text[:len(text) - k] + following[:k]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].fingerprint == maker.fingerprint(text) and got[i].edited_fingerprint == maker.fingerprint(changed)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95


def test_empty_texts():
    m = P.OnePermutation()
    assert m.fingerprint(None) == m.fingerprint("") == ""
    assert m.likeness(None, None) == 1.0 and m.likeness(None, m.bins_of("a")) == 0.0
    assert m.likeness(m.unpack(m.fingerprint("abc")), m.bins_of("abc")) == 1.0
