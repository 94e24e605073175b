"""Token counts and byte-level BPE against plain versions and the tiktoken library."""
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from textsieve.llm import op2_tokens, op6_bpe
from textsieve.llm.ranks import read_ranks

TEXTS = ["", "Hello  world!\n\n  it's 123,456 ok", "é漢字\U0001F600 ñandú ß", "a" * 5000, " \t\n ", "don't DON'T we'll",
         "x" * 300 + "é" * 300, "\x1c\x1d a\x85b\xa0c", "ab" * 40 + " " + "the" * 70]


@pytest.fixture(scope="module")
def coder():
    return op6_bpe.BytePairCoder(read_ranks(public_tokenizers.path(op6_bpe.RANKS)))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=read_ranks(public_tokenizers.path(op6_bpe.RANKS)))


def test_bpe_equals_library(coder, reference):
    rnd = random.Random(3)
    for text in TEXTS + ["".join(rnd.choice("abcé 1,\n\U0001F600ß漢'sT") for _ in range(rnd.randint(1, 80)))
                         for _ in range(500)]:
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()


def test_short_and_long_queue_agree(coder):
    rnd = random.Random(4)
    for _ in range(300):
        word = bytes(rnd.choice(b"abcdeinrst ") for _ in range(rnd.randint(2, 64)))
        assert coder._merge_short(word) == coder._merge_long(word)


def test_long_pretoken_is_not_quadratic(coder, reference):
    word = "abcde" * 40_000
    assert coder.encode(word) == reference.encode_ordinary(word)


def test_splitter_equals_pattern_below_256(coder):
    full = regex.compile(public_tokenizers.PATTERN).findall
    for i in range(256):
        for j in range(0, 256, 3):
            text = f"{chr(i)}a{chr(j)}{chr(i)}{chr(j)}{chr(j)}1"
            assert coder.split(text) == full(text)


def test_bpe_query_edge_cases(spark):
    path = public_tokenizers.path(op6_bpe.RANKS)
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Hello world", 5), (3, "Hello world", 5), (None, "x", 5)],
                                 "doc_id long, text string, ids int")
    rows = op6_bpe.encode(docs, path, digests=True).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert all((r.ids_sha256, r.decoded_sha256) == (nothing, nothing) for r in rows if r.doc_id in (1, 2))
    texts = op6_bpe.decode(op6_bpe.encode(docs, path), path).collect()
    assert sorted(r.text for r in texts) == ["", "", "Hello world", "Hello world", "x"]
    assert op6_bpe.encode(docs.limit(0), path).count() == 0


def test_bpe_query_round_trip(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op6_bpe.op6_byte_bpe(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def _greedy(word, pieces, longest):
    n = at = 0
    while at < len(word):
        end = min(len(word), at + longest)
        while word[at:end] not in pieces:
            end -= 1
        at, n = end, n + 1
    return n


def test_longest_match_equals_rescanning():
    pieces = set(read_ranks(public_tokenizers.path(op2_tokens.VOCABULARY))) | {bytes([b]) for b in range(256)}
    automaton = op2_tokens.LongestMatch(pieces)
    longest, rnd = max(map(len, pieces)), random.Random(5)
    words = [w for t in TEXTS for w in regex.findall(public_tokenizers.PATTERN, t)]
    words += ["".join(rnd.choice("abcdeinorst é漢") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    for w in words:
        assert automaton.count(w.encode()) == _greedy(w.encode(), pieces, longest), w


def test_longest_match_small_vocabulary():
    a = op2_tokens.LongestMatch([b"ab", b"abcx", b"cd", b"bcde"])
    for w in (b"abcd", b"abcde", b"abcxabcd", b"bcdbcde", b"zzz", b""):
        assert a.count(w) == _greedy(w, {b"ab", b"abcx", b"cd", b"bcde"} | {bytes([b]) for b in range(256)}, 4)


def test_token_count_query(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "the cat")],
                                 "doc_id long, text string")
    rows = op2_tokens.token_counts(docs, public_tokenizers.path(op2_tokens.VOCABULARY)).collect()
    assert sorted((r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in rows) == [
        (0, 2, 2), (1, 0, 0), (2, 0, 0), (3, 2, 2), (3, 2, 2)]
    assert op2_tokens.token_counts(docs.limit(0), public_tokenizers.path(op2_tokens.VOCABULARY)).count() == 0
