"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of a pre-token form a linked list.  Every neighbouring pair that the
vocabulary knows is put, by the position of its left piece, in the bucket of its
merge rank.  A bitmap of two levels (256 ranks a word, the words in use above)
marks the buckets in use; find-first-set on each level gives the lowest rank.  The
positions of a bucket are taken from left to right; an entry whose pair has
changed since is stale and skipped.  A merge touches two neighbours, so a
pre-token of n bytes needs O(n) queue operations (plus the heap order of
positions inside one rank), however long it is.

Text is cut by the pre-token pattern first, each match is merged separately, and
no special tokens are produced.  Decoding joins the bytes of the ids.

Scale: map-only; ranks are broadcast (their size is that of the file).  Each
worker process keeps a bounded table of recently encoded short pre-tokens over all its tasks.

Edge cases: null and empty text give no ids and decode to no bytes; whole texts
are encoded; repeated rows are encoded each.
"""
from __future__ import annotations

import hashlib
import re
import unicodedata
from heapq import heappop, heappush
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.common import table, values
from textsieve.llm.ranks import read_ranks

RANKS = "byte_bpe_multi_50k.tiktoken"
SHIFT, MASK, SHORT = 8, 255, 64
_PLACE = [1 << i for i in range(SHORT)]
_CODERS: dict = {}          # in each worker process, the coder last used, with what it has cached


def splitter(pattern: str):
    """All matches of the pattern in a text.

    Where every character is below 256, the standard library's matcher does the same faster:
    \\p{L} and \\p{N} are then spelled out as the characters of these classes below 256."""
    full = regex.compile(pattern).findall
    known = {c: "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == c) for c in "LN"}
    blank = r"\t-\r \x85\xa0"               # White_Space below 256; the standard library's \\s has more
    inner = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{blank}{known['L']}{known['N']}]")
    inner = inner.replace("\\S", f"[^{blank}]").replace("\\s", f"[{blank}]")
    inner = inner.replace("\\p{L}", f"[{known['L']}]").replace("\\p{N}", f"[{known['N']}]")
    if re.search(r"\\[pPwWdDbB]", inner):
        return full
    narrow = re.compile(inner).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return narrow(text)

    return split


class _Recent(dict):
    """Short pre-token -> ids, in two generations: a full one becomes the old one, whose entries come back when they
    are used again.  Memory is bounded, and frequent pre-tokens are never lost all at once."""

    def __init__(self, merge, limit: int, longest: int):
        super().__init__()
        self.merge, self.limit, self.longest, self.old = merge, limit, longest, {}

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.old.get(token)
        if ids is None:
            ids = self.merge(token.encode("utf-8", "replace"))
        if len(token) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[token] = ids
        return ids


class BytePairCoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, cache: int = 1 << 19,
                 longest_cached: int = 48):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.ranks = ranks
        self.piece = [b""] * (max(ranks.values()) + 1)
        for p, r in ranks.items():
            self.piece[r] = p
        self.word_of = [r >> SHIFT for r in range(len(self.piece))]
        self.bit_of = [1 << (r & MASK) for r in range(len(self.piece))]
        self.top_of = [1 << m for m in self.word_of]
        self.byte_pair = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.split = splitter(pattern)
        self.recent = _Recent(self.merge, cache, longest_cached)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        whole = self.ranks.get(word)
        if whole is not None:
            return (whole,)
        return self._merge_short(word) if len(word) <= SHORT else self._merge_long(word)

    def _merge_short(self, word: bytes) -> tuple[int, ...]:
        """The queue for few positions: a bucket is a bitmap of positions as well."""
        n, get, word_of, bit_of, top_of = len(word), self.ranks.get, self.word_of, self.bit_of, self.top_of
        byte_pair, place = self.byte_pair, _PLACE
        ends = list(range(1, n + 1))          # piece at i covers word[i:ends[i]]
        before = list(range(-1, n - 1))       # start of the piece to the left
        pending = [-1] * n                    # left position -> rank of its pair now
        top, low, buckets = 0, {}, {}
        i, a = 0, word[0]
        for b in word[1:]:
            r = byte_pair[a << 8 | b]
            if r >= 0:
                pending[i] = r
                if r in buckets:
                    buckets[r] |= place[i]
                else:
                    buckets[r] = place[i]
                    m = word_of[r]
                    low[m] = low[m] | bit_of[r] if m in low else bit_of[r]
                    top |= top_of[r]
            a = b
            i += 1
        while top:
            m = (top & -top).bit_length() - 1          # find-first-set on each level
            bits = low[m]
            r = (m << SHIFT) + (bits & -bits).bit_length() - 1
            at = buckets[r]
            i = (at & -at).bit_length() - 1
            at &= at - 1
            if at:
                buckets[r] = at
            else:
                del buckets[r]
                bits &= bits - 1
                if bits:
                    low[m] = bits
                else:
                    del low[m]
                    top &= top - 1
            if pending[i] != r:               # stale: the pair at i is another one by now, or gone
                continue
            j = ends[i]                       # the right piece joins the left one
            ends[i] = end = ends[j]
            pending[i] = pending[j] = -1
            if end < n:
                before[end] = i
                r = get(word[i:ends[end]])
                if r is not None:
                    pending[i] = r
                    if r in buckets:
                        buckets[r] |= place[i]
                    else:
                        buckets[r] = place[i]
                        m = word_of[r]
                        low[m] = low[m] | bit_of[r] if m in low else bit_of[r]
                        top |= top_of[r]
            i = before[i]
            if i >= 0:
                r = get(word[i:end])
                if r is None:
                    pending[i] = -1
                else:
                    pending[i] = r
                    if r in buckets:
                        buckets[r] |= place[i]
                    else:
                        buckets[r] = place[i]
                        m = word_of[r]
                        low[m] = low[m] | bit_of[r] if m in low else bit_of[r]
                        top |= top_of[r]
        return self._pieces(word, ends)

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        """The queue for many positions: a bucket is a list of positions, the leftmost first."""
        n, get = len(word), self.ranks.get
        ends, before, pending = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        top, low, buckets = 0, {}, {}
        fresh = ((i, r) for i in range(n - 1) if (r := get(word[i:i + 2])) is not None)
        while True:
            for i, r in fresh:
                pending[i] = r
                bucket = buckets.get(r)
                if bucket:
                    heappush(bucket, i)
                else:
                    buckets[r] = [i]
                    m = self.word_of[r]
                    low[m] = low.get(m, 0) | self.bit_of[r]
                    top |= 1 << m
            if not top:
                return self._pieces(word, ends)
            m = (top & -top).bit_length() - 1
            bits = low[m]
            r = (m << SHIFT) + (bits & -bits).bit_length() - 1
            i = heappop(buckets[r])
            if not buckets[r]:
                low[m] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            fresh = []
            if pending[i] != r:
                continue
            j = ends[i]
            ends[i] = end = ends[j]
            pending[i] = pending[j] = -1
            left = before[i]
            if end < n:
                before[end] = i
                if (r := get(word[i:ends[end]])) is not None:
                    fresh.append((i, r))
            if left >= 0:
                pending[left] = -1
                if (r := get(word[left:end])) is not None:
                    fresh.append((left, r))

    def _pieces(self, word: bytes, ends: list[int]) -> tuple[int, ...]:
        out, i, n = [], 0, len(word)
        while i < n:
            out.append(self.ranks[word[i:ends[i]]])
            i = ends[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.recent.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))


def coder_of(ranks: dict[bytes, int], pattern: str, key: tuple) -> BytePairCoder:
    """The coder of these ranks in this process, made once whatever tasks it runs."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = BytePairCoder(ranks, pattern)
    return _CODERS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, digests: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids; with ``digests`` the SHA-256 of the ids and of the decoded bytes instead of ids."""
    pieces = read_ranks(ranks_path)
    ranks, key = docs.sparkSession.sparkContext.broadcast(pieces), (hash(frozenset(pieces.items())), pattern)

    def run(batches):
        coder = coder_of(ranks.value, pattern, key)
        names = [str(r) for r in range(len(coder.piece))]
        for b in batches:
            n, first, second = [], [], []
            for text in values(b.column(1)):
                ids = coder.encode(text) if text else []
                n.append(len(ids))
                if digests:
                    first.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode("ascii")).hexdigest())
                    second.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                else:
                    first.append(ids)
            columns = [b.column(0), pa.array(n, pa.int64())]
            columns += [pa.array(first, pa.string()), pa.array(second, pa.string())] if digests \
                else [pa.array(first, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    fields = ["doc_id", "n_tokens"] + (["ids_sha256", "decoded_sha256"] if digests else ["ids"])
    ddl = "doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl))


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the decoded bytes as UTF-8 (a broken sequence becomes the replacement character)."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        coder = BytePairCoder(ranks.value)
        for b in batches:
            texts = [None if ids is None else coder.decode(ids).decode("utf-8", "replace") for ids in values(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return (encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))
            .mapInArrow(run, "doc_id bigint, text string"))


def op6_byte_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), digests=True)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
