"""Alignment of two tokenizers against plain sets of ends and plain counting."""
import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from textsieve.llm import op12_alignment as A

PATHS = public_tokenizers.path(A.BYTE_LEVEL), public_tokenizers.path(A.PIECES)
TEXTS = [None, "", " ", "Hello  world!\n\n it's 123,456 ok", "é漢字\U0001F600 ñandú ß ligature ﬁ", "a" * 4000, "don't <|endoftext|> <s> x</s>",
         "lower ▁ block", "\t\ttabs\r\n", "ab" * 300 + " " + "the" * 70, "\U0001F600" * 90, "0123456789" * 500, "  two", "é combining",
         "漢字" * 300 + "\U0001F600é" * 200, "x y z​w"]


@pytest.fixture(scope="module")
def pair():
    with open(PATHS[0], encoding="utf-8") as f, open(PATHS[1], "rb") as g:
        return A.TokenPair(f.read(), g.read())


def brute(rows):
    """The contract read literally: sets of ends, all token pairs of every group."""
    first, second = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    first.encode_special_tokens = True
    letters = A.byte_of_letter()
    docs, count = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            raw_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
            raw_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
                     for p in map(second.id_to_piece, b)]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends = [[sum(map(len, raw[:k + 1])) for k in range(len(raw))] if len(raw) < 500 else list(np.cumsum([len(x) for x in raw]))
                        for raw in (raw_a, raw_b)]
                common, i, j = sorted(set(ends[0]) & set(ends[1])), 0, 0
                for e in common:
                    p, q = bisect.bisect_right(ends[0], e), bisect.bisect_right(ends[1], e)
                    groups.append((a[i:p], b[j:q]))
                    i, j = p, q
        linked = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(linked.keys())
        docs.append((doc_id, groups, linked))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(linked.values()),
                    sum(n for k, n in linked.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in linked.items()),
                    hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
                    if groups else "") for i, groups, linked in docs), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "r", 7) for i, t in rows], "doc_id long, text string, row string, pairs int").repartition(4)
    return sorted(map(tuple, A.link_statistics(df, *PATHS, **options).collect()), key=repr)


def test_gallop_and_common_ends():
    rnd = random.Random(1)
    for _ in range(400):
        a = np.array(sorted(rnd.sample(range(300), rnd.randint(1, 90))))
        b = np.array(sorted(rnd.sample(range(rnd.choice([40, 300, 3000])), rnd.randint(1, 40))))
        assert A.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
        i, j = A.common_ends(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_links_of_dense_groups(monkeypatch):
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 9, 60), rnd.integers(0, 9, 50)
    cut_a, cut_b = np.array([0, 3, 40, 41, 60]), np.array([0, 1, 30, 33, 50])
    plain = Counter((int(x), int(y)) for g in range(4) for x in a[cut_a[g]:cut_a[g + 1]] for y in b[cut_b[g]:cut_b[g + 1]])
    for dense in (0, 100, 4096):
        monkeypatch.setattr(A, "DENSE", dense)
        keys, times = A.links(a, b, cut_a, cut_b)
        assert {(int(k) >> A.ID_BITS, int(k) % (1 << A.ID_BITS)): int(n) for k, n in zip(keys, times)} == plain
        assert A.unpacked(A.packed(keys)).tolist() == keys.tolist()


def test_bytes_of_tokens(pair):
    for text in TEXTS:
        a, b = pair.encode(text)
        if a:
            assert b"".join(pair.bytes_a[i] for i in a) == b"".join(pair.bytes_b[i] for i in b) == (" " + text).encode()
    assert sum(bool(pair.encode(t)[0]) for t in TEXTS) >= 9


def test_all_columns_with_and_without_broadcast(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "Hello  world!"), (3, "Hello  world!"), (3, "Hello  world!")]
    rows += [(100 + k, "".join(rnd.choice(["the ", "cat", "s ", "é", "\n", "  ", "1", "漢", "ing ", "x"]) for _ in range(rnd.randint(1, 60)))) for k in range(60)]
    want = brute(rows)
    assert run(spark, rows) == want
    for bound in (0, 25):
        assert run(spark, rows, max_broadcast=bound) == want


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, A.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()), key=repr) == brute(rows)


def test_empty_table_and_only_empty_texts(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_spelled(spark, pair):
    df = spark.createDataFrame([(1, "Hello world")], "doc_id long, text string")
    row = A.alignments(df, *PATHS, spell=True).collect()[0]
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    a, b = pair.encode("Hello world")
    assert row.groups.replace("|", ",").replace(";", ",").count(",") + 1 == len(a) + len(b)


def test_counts_handed_on_in_parts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS[3:10])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, A.pair_counts(A.alignments(df, *PATHS)).collect()))
    monkeypatch.setattr(A, "HELD", 8)
    assert sorted(map(tuple, A.pair_counts(A.alignments(df, *PATHS)).collect())) == whole


def test_ranks_encode_as_the_list_of_merges(spark, pair):
    rnd = random.Random(9)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    texts += ["".join(rnd.choice(["a", "b", "the", " ", "  ", "\n", "é", "漢", "1", "'s", "!", "\U0001F600", "\u200b", "\x85", "\x1c", "<|endoftext|>"])
                      for _ in range(rnd.randint(1, 60))) for _ in range(3000)] + [t for t in TEXTS if t]
    assert pair.by_rank is not None
    for text in texts:
        assert pair.encode_first(" " + text) == pair.first.encode(" " + text, add_special_tokens=False).ids
    assert len(pair.encode_first("ab" * 200_000)) > 1000


def test_other_order_of_merges_is_not_ranked(pair):
    assert pair._ranked({"vocab": {"ab": 300, "bc": 299}, "merges": [["a", "b"], ["b", "c"]]}) is None
