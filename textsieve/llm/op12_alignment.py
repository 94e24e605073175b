"""Cross-tokenizer alignment: groups of tokens that cover the same bytes, and how often token ids are linked.

Both tokenizers encode a text; each gives an increasing list of byte offsets at
which its tokens end.  Offsets in both lists cut the text into groups.  They are
found by galloping intersection (`gallop`): every element of the shorter list
drives an exponential, then a binary search into the longer one; all elements of
a text take their steps together.  The indices of the common ends slice both id
lists into groups, and differences of ranks give the ranges of tokens that
overlap.  All pairs of a group's tokens are links; they are counted by distinct
ids (`links`), so a group without inner cuts, however long, costs its distinct ids.

Scale: one pass encodes and aligns each text and writes one row for it: digests,
counts and the distinct links (packed), in a table in the shared folder.  Corpus-wide counts
are summed in each task before the shuffle; what is shuffled is the distinct id
pairs.  The most frequent pairs, at most ``MAX_BROADCAST`` of them (13 bytes each),
are broadcast; rarer ones, if there are any, are joined, and as each is in few documents
none of them is a hot key.  The results are the same whatever the bound.

Edge cases: null and empty text, and a text that a tokenizer does not give back
byte for byte, have zeros and an empty digest; special tokens' names are plain text; repeated rows
count each, so do rows without id; an empty table has no rows.
"""
from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.common import cut, table
from textsieve.session import ensure_checkpoint_dir

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
MAX_BROADCAST = 1 << 22
HELD = 1 << 21              # links or pairs a task holds before it counts or hands them on
ID_BITS = 16
_LONG_RUN = re.compile(r"\S{500}|\s{500}")
DENSE = 4096                # groups with more links than this are counted by their distinct ids


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each element of ``short`` the first index of ``long`` (both increasing) that holds no less.

    Each search starts at the same share of the longer list, doubles its step until it has passed the element,
    and halves the bracket."""
    n = len(long)
    start = np.arange(len(short)) * n // max(len(short), 1)
    less = long[start] < short
    low, high = np.where(less, start, -1), np.where(less, n, start)
    for sign in (1, -1):
        active, at, step = np.flatnonzero(less == (sign > 0)), start, 1
        at = at[active]
        while len(active):
            at = at + sign * step
            inside = (at < n) & (at >= 0)
            below = long[np.clip(at, 0, n - 1)] < short[active]
            up = inside & below
            down = inside & ~below
            low[active[up]], high[active[down]] = at[up], at[down]
            on = up if sign > 0 else down
            active, at, step = active[on], at[on], 2 * step
    active = np.flatnonzero(high - low > 1)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        below = long[middle] < short[active]
        low[active[below]], high[active[~below]] = middle[below], middle[~below]
        active = active[high[active] - low[active] > 1]
    return high


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in a and in b of the ends that both have."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = gallop(short, long)
    hit = np.flatnonzero((at < len(long)) & (long[np.minimum(at, len(long) - 1)] == short))
    return (hit, at[hit]) if short is a else (at[hit], hit)


def links(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked id pairs (a << ID_BITS | b, increasing) and how many token pairs each stands for.

    ``cut_a`` and ``cut_b`` are where the groups begin, and the lengths at the end."""
    na, nb = np.diff(cut_a), np.diff(cut_b)
    size = na * nb
    few = np.flatnonzero(size <= DENSE)
    group = np.repeat(few, size[few])
    place = np.arange(len(group)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
    i, j = cut_a[group] + place // nb[group], cut_b[group] + place % nb[group]
    pairs = [(a[i] << ID_BITS) | b[j]]
    times = [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(size > DENSE):
        ids_a, n_a = np.unique(a[cut_a[g]:cut_a[g + 1]], return_counts=True)
        ids_b, n_b = np.unique(b[cut_b[g]:cut_b[g + 1]], return_counts=True)
        pairs.append(((ids_a[:, None] << ID_BITS) | ids_b[None, :]).ravel())
        times.append((n_a[:, None] * n_b[None, :]).ravel())
    return _summed(np.concatenate(pairs), np.concatenate(times))


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, increasing, with the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def packed(x: np.ndarray) -> bytes:
    """32-bit numbers, byte plane after byte plane: planes of increasing numbers compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies spell a byte as its Latin-1 letter if that is visible, else as letters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TokenPair:
    """The two tokenizers, with the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.first, letters = Tokenizer.from_str(byte_level), byte_of_letter()
        self.first.encode_special_tokens = True
        model = json.loads(byte_level)["model"]
        vocabulary = model["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.by_rank = self._ranked(model)
        self.second = s = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i)
                        else s.id_to_piece(i).replace("▁", " ").encode() for i in range(s.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.written = [sep + str(i) for sep in ",;|" for i in range(n)]     # an id after each separator
        self.n = n

    def _ranked(self, model):
        """The byte-level vocabulary as ranks, which are encoded several times as fast: ids are ranks where they rise
        with the list of merges, as in every trained vocabulary.  None where they do not."""
        import tiktoken
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])) or (merged and merged[0] < 256):
            return None
        known = {i for i, x in enumerate(self.bytes_a) if len(x) == 1} | set(merged)
        return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks={x: i for i, x in enumerate(self.bytes_a) if i in known})

    def encode_first(self, text: str) -> list[int]:
        if self.by_rank is None or _LONG_RUN.search(text):       # its time grows with the square of a run
            return self.first.encode(text, add_special_tokens=False).ids
        return self.by_rank.encode_ordinary(text)

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both, none where the tokens do not spell a blank and the text."""
        if not text:
            return [], []
        a = self.encode_first(" " + text)
        b = self.second.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return [], []
        return a, b

    def align(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids a, b and where the groups begin in each, with the lengths at the end."""
        a, b = (np.array(x, np.int64) for x in self.encode(text))
        if not len(a):
            return a, b, np.zeros(1, np.int64), np.zeros(1, np.int64)
        cut_a, cut_b = common_ends(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        return a, b, np.concatenate(([0], cut_a + 1)), np.concatenate(([0], cut_b + 1))

    def spelled(self, a, b, cut_a, cut_b) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of the groups in order."""
        na, nb = np.diff(cut_a), np.diff(cut_b)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(cut_b[:-1], na)] = a
        out[np.arange(len(b)) + np.repeat(cut_a[1:], nb)] = b
        out[cut_a[:-1] + cut_b[:-1]] += self.n            # a group's first a comes after ;
        out[cut_a[1:] + cut_b[:-1]] += 2 * self.n         # its first b after |
        return "".join(map(self.written.__getitem__, out.tolist()))[1:]


_PAIRS: dict = {}           # in each worker process, the tokenizers last used


def _pair(files) -> TokenPair:
    key = hashlib.sha256(files[0].encode() + files[1]).digest()
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = TokenPair(*files)
    return _PAIRS[key]


_ROW = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "pairs binary, times binary")


def alignments(docs: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id",
               text_col: str = "text", spell: bool = False) -> DataFrame:
    """One row for each text: a row number, doc_id, counts, digest of the groups, and its distinct linked pairs
    (``pairs``) with the token pairs each stands for (``times``), both `packed`; with ``spell`` also the groups as text."""
    with open(byte_level_path, encoding="utf-8") as f, open(pieces_path, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches):
        pair, row = _pair(files.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for text in batch.column(1):
                a, b, cut_a, cut_b = pair.align(text.as_py())
                groups = pair.spelled(a, b, cut_a, cut_b) if len(a) else ""
                keys, times = links(a, b, cut_a, cut_b)
                out.append((row, len(a), len(b), len(cut_a) - 1, int(times.sum()),
                            hashlib.sha256(groups.encode()).hexdigest() if len(a) else "", packed(keys), packed(times))
                           + ((groups,) if spell else ()))
                row += 1
            cols = list(zip(*out)) if out else [()] * (9 if spell else 8)
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            names = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "groups"][:len(arrays)]
            yield pa.RecordBatch.from_arrays([arrays[0], batch.column(0), *arrays[1:]], names=[names[0], "doc_id", *names[1:]])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, _ROW + (", groups string" if spell else "")))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best) over the corpus: in how many documents the pair is linked, and whether no other pair
    of its first id has a higher count."""
    def run(batches):
        def counted(keys, times):
            keys, times = _summed(np.concatenate(keys), np.concatenate(times))
            return [keys], [times]

        def handed(keys, times):
            return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(times[0], pa.int64())], names=["pair", "n"])

        keys, times, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            for x in batch.column(0):
                found = unpacked(x.as_py())
                keys.append(found)
                times.append(np.ones(len(found), np.int64))
                held += len(found)
                if held > HELD:
                    keys, times = counted(keys, times)
                    if len(keys[0]) > HELD // 2:
                        yield handed(keys, times)
                        keys, times = [keys[0][:0]], [times[0][:0]]
                    held = len(keys[0])
        yield handed(*counted(keys, times))

    counts = cut(aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("count"))
                 .withColumn("a", F.shiftright("pair", ID_BITS)))
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    return cut(counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


_SUMS = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def link_statistics(docs: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id",
                    text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    alignments(docs, byte_level_path, pieces_path, id_col, text_col).write.option("compression", "zstd").parquet(folder)
    aligned = spark.read.parquet(folder)
    counts = pair_counts(aligned)
    rarest, total = 0, counts.count()
    while total > max_broadcast:                       # what is left to the join has counts up to ``rarest``
        rarest = 2 * rarest + 1
        total = counts.where(F.col("count") > rarest).count()
    frequent = counts.where(F.col("count") > rarest).orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast((frequent["pair"].to_numpy().astype("<u4"), frequent["count"].to_numpy(),
                                          frequent["best"].to_numpy()))

    def look_up(pairs, times):
        """n_best, count_sum over the broadcast pairs, and the pairs that are none of them."""
        keys, count, best = known.value
        x, n = unpacked(pairs), unpacked(times)
        at = np.searchsorted(keys, x.astype("<u4"))
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == x[hit]
        at, m = at[hit], n[hit]
        return int(m[best[at]].sum()), int((m * count[at]).sum()), x[~hit], n[~hit]

    def sums(batches):
        for batch in batches:
            found = [look_up(p.as_py(), t.as_py())[:2] for p, t in zip(batch.column("pairs"), batch.column("times"))]
            kept = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)),
                                              batch.column("groups_sha256")],
                                             names=[c.split()[0] for c in _SUMS.split(", ")])

    def rest(batches):
        for batch in batches:
            for r, p, t in zip(batch.column("row"), batch.column("pairs"), batch.column("times")):
                _, _, x, n = look_up(p.as_py(), t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r.as_py()), pa.int64()), pa.array(x, pa.int64()),
                                                  pa.array(n, pa.int64())], names=["row", "pair", "times"])

    out = aligned.mapInArrow(sums, _SUMS)
    if rarest:
        more = (aligned.select("row", "pairs", "times").mapInArrow(rest, "row bigint, pair bigint, times bigint")
                .join(counts.where(F.col("count") <= rarest), "pair").groupBy("row")
                .agg(F.sum(F.col("times") * F.col("count")).alias("more_sum"),
                     F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")))
        out = (out.join(more, "row", "left")
               .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
               .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark, sf_dir):
    return link_statistics(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


QUERIES = {"op12_token_alignment": op12_token_alignment}
