"""Greedy word-piece token counts with a linear longest-match automaton.

The vocabulary is a trie over bytes.  Longest-match-first tokenization takes,
again and again, the longest vocabulary piece that starts where the last one
ended.  Instead of rescanning, each trie node v carries a failure link (the
node that spells what is left of v after greedily popping pieces off its front)
and the number of pieces popped on the way.  A pre-token is then read once,
following links and adding up counts; no piece is ever built.

Pieces come from a rank file given as a parameter.  As in word-piece
vocabularies, pieces that open a word (here: those with a leading blank) differ
from pieces that continue one, and each match of the pre-token pattern is cut
on its own.  Every single byte is a piece, so each text has a count.

Scale: map-only; the vocabulary is broadcast (its size is that of the file).
Each task caches the counts of recent pre-tokens in a bounded table.

Edge cases: null and empty text have 0 pre-tokens and 0 tokens; whole texts of
any length are counted; repeated rows are counted each.
"""
from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.common import table, values
from textsieve.llm.ranks import read_ranks

VOCABULARY = "byte_bpe_50k.tiktoken"


class LongestMatch:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, pieces):
        pieces = set(pieces) | {bytes([b]) for b in range(256)}
        self.follow: list[dict[int, int]] = [{}]
        whole = {0: False}
        for piece in sorted(pieces):
            v = 0
            for b in piece:
                if b not in self.follow[v]:
                    self.follow[v][b] = len(self.follow)
                    self.follow.append({})
                v = self.follow[v][b]
            whole[v] = True
        self.link, self.popped = [0] * len(self.follow), [0] * len(self.follow)
        layer = [0]
        while layer:                       # breadth first: the links of shorter strings are known
            below = []
            for u in layer:
                for b, v in self.follow[u].items():
                    below.append(v)
                    if whole.get(v):       # the node's whole string is the longest piece: pop it
                        self.link[v], self.popped[v] = 0, 1
                    else:                  # pop from u until what is left can be followed by b
                        self.link[v], self.popped[v] = self._step(self.link[u], self.popped[u], b)
            layer = below

    def _step(self, v: int, n: int, b: int) -> tuple[int, int]:
        while b not in self.follow[v]:     # ends at the root, which reads every byte
            n += self.popped[v]
            v = self.link[v]
        return self.follow[v][b], n

    def count(self, word: bytes) -> int:
        follow, link, popped = self.follow, self.link, self.popped
        v = n = 0
        for b in word:
            w = follow[v].get(b)
            while w is None:
                n += popped[v]
                v = link[v]
                w = follow[v].get(b)
            v = w
        while v:
            n += popped[v]
            v = link[v]
        return n


class CountCache(dict):
    def __init__(self, automaton: LongestMatch, limit: int = 1 << 19):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[word] = self.automaton.count(word.encode("utf-8", "surrogatepass"))
        return n


def token_counts(docs: DataFrame, vocabulary_path: str, pattern: str = public_tokenizers.PATTERN,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pretokens, n_tokens of every whole text."""
    pieces = docs.sparkSession.sparkContext.broadcast(sorted(read_ranks(vocabulary_path)))

    def run(batches):
        count, split = CountCache(LongestMatch(pieces.value)), regex.compile(pattern).findall
        for b in batches:
            pre, total = [], []
            for text in values(b.column(1)):
                found = split(text) if text else []
                pre.append(len(found))
                total.append(sum(map(count.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pre, pa.int64()), pa.array(total, pa.int64())],
                                             names=["doc_id", "n_pretokens", "n_tokens"])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint"))


def op2_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op2_token_counts": op2_token_counts}
