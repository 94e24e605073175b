"""Substring dedup: later copies of every window of 50 words are removed, found through a count-min sketch.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window
that covers it also starts in a document with a smaller id; windows are judged on
the input.

*Sketch.*  Each window is counted under its anchor, the least hash of its runs of
``RUN`` words.  Equal windows have equal anchors, so the number of documents that
have the anchor is at least the number that have the window, and count-min cells, which add
up whatever falls into them, can only overestimate once more.  Partitions count
their anchors, once for each document, into sketches of their own; these are cut into pages
and merged page by page; what remains of the sketch is a bit for each cell: two or
more documents.  A window with a cell below two in any of the ``DEPTH`` rows is in
one document only.

*Exact pass.*  Texts are read again.  Neighbouring windows with one anchor are a span; spans
whose anchor is estimated repeated become rows: anchor, digest of the span's words, and the
digest of each of its windows.  Spans with the same words are settled by the least id that
has them: all others lose the span.  Only anchors with different spans need their
windows compared, and of each of these spans only those with the least id, as the
others' windows are in a document with a smaller id anyhow: windows are grouped by
(anchor, digest), 128 bits, and those whose least id is smaller lose theirs.

Scale: sketches have 2 bytes a cell and word of text / 13, their pages spread over tasks; the
broadcast is ``DEPTH`` bits a cell, at most ``DEPTH * 2 ** MAX_LOG_CELLS / 8`` bytes (128 MB).
Cells grow with the text up to there, about 30 GB of it; beyond, estimates get
coarser and more spans are grouped exactly, with the same result; raise the parameter where executors have
the memory.  Counting has no hot key, as each partition adds up first; a passage in a third of all
documents is one row of least ids, joined to spans (a thirteenth of the windows), which
adaptive execution splits.  Texts are shuffled once, to apply the ranges.

Edge cases: null text has no words; documents below 50 words lose nothing; a window repeated
in its own document only stays; rows with equal id do not count as smaller, so equal rows both
stay; rows without id come after all others and do not remove each other's words; texts are
read in blocks of ``BLOCK`` windows, whole.
"""
from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.common import HashCache, cut, mix, table
from textsieve.session import ensure_checkpoint_dir

WINDOW, RUN = 50, 25
DEPTH, MAX_LOG_CELLS, PAGE = 2, 29, 1 << 16
BYTES_A_CELL = 40           # of text: one anchor for about 13 words
BLOCK = 1 << 17
HELD = 1 << 21              # cells a partition holds before it adds them up
_SEEDS = [np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0), np.uint64(0x082EFA98EC4E6C89)]

_WORDS = HashCache()        # one for each worker process


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, which is how bytes are split."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Runs:
    """Digests of any run of consecutive words, from prefix sums of the hashes times powers of an odd number."""

    _FACTOR = 0x9E3779B97F4A7C15
    _up = _down = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        if n > len(Runs._up):
            size = max(n, 1 << 12)
            powers = np.full(size, np.uint64(Runs._FACTOR))
            inverse = np.full(size, np.uint64(pow(Runs._FACTOR, -1, 1 << 64)))
            powers[0] = inverse[0] = 1
            Runs._up, Runs._down = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(hashes * Runs._up[:n - 1], out=self.sums[1:])

    def digests(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """Digests of the runs [start, end); runs of different lengths need their length beside it."""
        return mix((self.sums[end] - self.sums[start]) * Runs._down[:len(self.sums)][start])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(out) - (width - have)], out[width - have:]) if width > have else out


def blocks(words: list[bytes], window: int, run: int, block: int):
    """(place of the block, hashes of its words, anchors of its windows) for the blocks of a text."""
    for place in range(0, len(words) - window + 1, block):
        hashes = _WORDS.array(words[place:place + block + window - 1])
        runs = Runs(hashes).digests(slice(0, len(hashes) - run + 1), slice(run, len(hashes) + 1))
        yield place, hashes, least(runs, window - run + 1)


def cells(anchors: np.ndarray, log_cells: int) -> np.ndarray:
    """The cell of each anchor in each row of the sketch, one row of the result for each."""
    return np.stack([(mix(anchors ^ _SEEDS[r]) >> np.uint64(64 - log_cells)).astype(np.int64) + (r << log_cells)
                     for r in range(DEPTH)])


def log_cells_for(docs: DataFrame, text_col: str, most: int = MAX_LOG_CELLS) -> int:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(16, min(most, math.ceil(math.log2(max(1, size / BYTES_A_CELL)))))


def repeated_cells(docs: DataFrame, text_col: str, window: int, run: int, log_cells: int, block: int = BLOCK) -> bytes:
    """A bit for each cell of the merged sketch: whether two or more documents were counted in it."""
    def count(batches):
        def added(held):
            where, n = np.unique(np.concatenate(held), return_counts=True)
            page = where // PAGE
            first = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1])))
            ends = [*first[1:], len(where)]
            low, n = (where % PAGE).astype("<u2"), np.minimum(n, 2).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array(page[first], pa.int32()),
                                               pa.array([low[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()),
                                               pa.array([n[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())],
                                              names=["page", "cells", "counts"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                found = [np.unique(anchors) for _, _, anchors in blocks(words_of(text.as_py()), window, run, block)]
                if found:
                    held.append(cells(np.unique(np.concatenate(found)) if len(found) > 1 else found[0], log_cells).ravel())
                    size += len(held[-1])
                if size > HELD:
                    yield added(held)
                    held, size = [], 0
        if held:
            yield added(held)

    def merge(key, partial):
        total = np.zeros(PAGE, np.int64)
        for where, n in zip(partial["cells"], partial["counts"]):
            total[np.frombuffer(where.as_py(), "<u2")] += np.frombuffer(n.as_py(), np.uint8)      # cells of one sketch differ
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})

    partial = docs.select(text_col).mapInArrow(count, "page int, cells binary, counts binary")
    pages = partial.groupBy("page").applyInArrow(merge, "page int, bits binary").toArrow()
    out = np.zeros(((DEPTH << log_cells) // PAGE, PAGE // 8), np.uint8)
    for page, bits in zip(pages["page"], pages["bits"]):
        out[page.as_py()] = np.frombuffer(bits.as_py(), np.uint8)
    return out.tobytes()


def estimated_repeated(anchors: np.ndarray, bits: np.ndarray, log_cells: int) -> np.ndarray:
    where = cells(anchors, log_cells)
    return ((bits[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1).all(axis=0)


_SPAN = "id bigint, hash bigint, anchor bigint, words bigint, n int, start int, windows binary"


def spans(keyed: DataFrame, window: int, run: int, log_cells: int, bits: bytes, block: int = BLOCK) -> DataFrame:
    """The spans with an anchor estimated repeated: document (id, hash), anchor, digest of the span's words, number of
    windows, place of the first one, digests of all (64 bits each)."""
    shared = keyed.sparkSession.sparkContext.broadcast(bits)

    def find(batches):
        marks = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for i, h, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                for place, hashes, anchors in blocks(words_of(text.as_py()), window, run, block):
                    first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
                    end = np.concatenate((first[1:], [len(anchors)]))
                    kept = estimated_repeated(anchors[first], marks, log_cells)
                    first, end = first[kept], end[kept]
                    if not len(first):
                        continue
                    digest = Runs(mix(hashes ^ _SEEDS[3])).digests
                    each = digest(slice(0, len(anchors)), slice(window, len(hashes) + 1)).tobytes()
                    n = len(first)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i.as_py()] * n, pa.int64()), pa.array([h.as_py()] * n, pa.int64()),
                        pa.array(anchors[first].view(np.int64)), pa.array(digest(first, end + window - 1).view(np.int64)),
                        pa.array(end - first, pa.int32()), pa.array(first + place, pa.int32()),
                        pa.array([each[8 * s:8 * e] for s, e in zip(first, end)], pa.binary())],
                        names=[c.split()[0] for c in _SPAN.split(", ")])

    return keyed.select("id", "hash", "text").mapInArrow(find, _SPAN)


def _windows(batches):
    for batch in batches:
        n = batch.column("n").to_numpy()
        digests = np.frombuffer(b"".join(x.as_py() for x in batch.column("windows")), np.int64)
        place = np.arange(len(digests)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(batch.column("start").to_numpy(), n)
        row = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("id", "hash", "anchor")), pa.array(digests),
                                          pa.array(place.astype(np.int32))], names=["id", "hash", "anchor", "digest", "start"])


def repeated_ranges(found: DataFrame, window: int) -> DataFrame:
    """(id, hash, start, stop): ranges of words that windows in documents with smaller ids cover."""
    span = ["anchor", "words", "n"]
    owners = found.groupBy(*span).agg(F.min("id").alias("least"))
    several = owners.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor", F.lit(True).alias("several"))
    owners = owners.join(several, "anchor", "left")
    later = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    judged = cut(found.join(owners, span)
                 .select("id", "hash", "anchor", "n", "start", later.alias("later"),
                         F.when(~later & F.col("several"), F.col("windows")).alias("windows")))
    whole = judged.where("later").select("id", "hash", "start", (F.col("start") + F.col("n") + window - 1).alias("stop"))
    each = judged.where("windows IS NOT NULL").mapInArrow(
        _windows, "id bigint, hash bigint, anchor bigint, digest bigint, start int")
    first = each.groupBy("anchor", "digest").agg(F.min("id").alias("least"))
    single = (each.join(first, ["anchor", "digest"]).where(later)
              .select("id", "hash", "start", (F.col("start") + window).alias("stop")))
    return whole.unionByName(single)


def _kept(batches):
    for batch in batches:
        out = []
        for text, starts, stops in zip(batch.column("text"), batch.column("starts"), batch.column("stops")):
            ws = words_of(text.as_py())
            if starts.is_valid and len(starts):
                edge = np.zeros(len(ws) + 1, np.int64)
                np.add.at(edge, starts.values.to_numpy(), 1)
                np.add.at(edge, stops.values.to_numpy(), -1)
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                kept = [ws[k] for k in stay.tolist()]
            else:
                kept = ws
            out.append((len(ws), len(ws) - len(kept), None if not text.is_valid else b" ".join(kept).decode("utf-8", "surrogatepass")))
        n, gone, kept = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                          pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     run: int = RUN, log_cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words, joined by one blank; null stays null)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    log_cells = log_cells or log_cells_for(keyed, "text")
    bits = repeated_cells(keyed, "text", window, run, log_cells, block)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/spans-{uuid.uuid4().hex}"
    spans(keyed, window, run, log_cells, bits, block).write.parquet(folder)
    ranges = repeated_ranges(spark.read.schema(_SPAN).parquet(folder), window)
    cuts = (ranges.groupBy(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("key"), "hash")
            .agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")))
    whole = keyed.withColumn("no_id", F.col("id").isNull()).withColumn("key", F.coalesce("id", F.lit(0)))
    return (whole.join(cuts, ["no_id", "key", "hash"], "left").select("id", "text", "starts", "stops")
            .mapInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, text string"))


def op13_substring_dedup(spark, sf_dir):
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p, len(ws) AS n FROM d),
g AS (SELECT doc_id, p, n, word, CASE WHEN p + {WINDOW} <= n THEN md5(string_agg(word, ' ') OVER (
        PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)) END AS h FROM w),
m AS (SELECT h, min(doc_id) AS first FROM g WHERE h IS NOT NULL GROUP BY h),
r AS (SELECT g.*, max(CASE WHEN m.first < g.doc_id THEN 1 ELSE 0 END) OVER (
        PARTITION BY g.doc_id ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
      FROM g LEFT JOIN m USING (h)),
k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
             string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op13_substring_dedup": op13_substring_dedup}
ORACLE = {"op13_substring_dedup": ORACLE_SQL}
