"""Document fingerprints by one-permutation MinHash.

Every shingle of a text (``SHINGLE`` consecutive code points; the whole text if
it is shorter) is hashed once.  Its leading bits name the bin, and each bin keeps its
smallest hash.  An empty bin is filled by optimal densification: it
probes bins in an order given by a universal hash of (bin, attempt), the same
for every text, and takes the first full one.  Of each bin only the low
``BITS`` bits are stored, packed as base64.  Two fingerprints agree in a bin by
chance with probability 2**-BITS; the likeness corrects for that:
(agreement - c) / (1 - c), cut to 0..1.

Code-point shingles are used, not words, as the edited text of a short document
would otherwise share nothing with it.

The neighbour of a document in descending doc_id is found without one global
sort: ids are counted in ``CELLS`` cells of equal width, neighbouring cells are
joined into ranges of about ``ROWS_PER_RANGE`` rows, the first document of each
range also goes, as context, to the range before it, and a window per range
looks one row ahead.  Texts are shuffled once.  Cells and range heads (at most
``CELLS`` rows each) are all that is broadcast.

Edge cases: null text counts as empty; an empty text has an empty fingerprint
(likeness 1 with another empty one, else 0); with one row the next document is
the row itself; null ids sort last; equal ids are ordered by their text.
"""
from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsieve.llm.common import mix, table, values

BINS, BITS, SHINGLE = 256, 8, 9
ROWS_PER_RANGE = 4096
CELLS = 1 << 16
_CHUNK = 64


class OnePermutation:
    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        if bits not in (8, 16) or bins < 2 or bins & (bins - 1):
            raise ValueError("bits must be 8 or 16 and bins a power of two")
        self.bins, self.bits, self.shingle = bins, bits, shingle
        self.factors = mix(np.arange(1, shingle + 1, dtype=np.uint64)) | np.uint64(1)
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        self.starts = np.arange(bins, dtype=np.uint64) << self.shift
        self.probes: list[np.ndarray] = []

    def _probe(self, chunk: int) -> np.ndarray:
        """Bins probed in attempts chunk*64 .. chunk*64+63 (rows) for each empty bin (columns)."""
        while len(self.probes) <= chunk:
            lo = len(self.probes) * _CHUNK
            key = (np.arange(lo, lo + _CHUNK, dtype=np.uint64)[:, None] << np.uint64(32)) \
                + np.arange(self.bins, dtype=np.uint64)[None, :]
            self.probes.append((mix(key + np.uint64(0x5BD1E995)) % np.uint64(self.bins)).astype(np.int64))
        return self.probes[chunk]

    def hashes(self, text: str) -> np.ndarray:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        k = min(self.shingle, len(cp))
        if k == 0:
            return np.empty(0, np.uint64)
        out = np.zeros(len(cp) - k + 1, np.uint64)
        for j in range(k):
            out += cp[j:len(cp) - k + 1 + j] * self.factors[j]
        return mix(out + np.uint64(k))

    def bins_of(self, text: str) -> np.ndarray | None:
        """Densified low-order bits of each bin; None for an empty text."""
        h = self.hashes(text)
        if len(h) == 0:
            return None
        h.sort()                                     # bins are the leading bits: each bin is one run
        at = np.searchsorted(h, self.starts)
        least = h[np.minimum(at, len(h) - 1)]
        full = (least >> self.shift) == np.arange(self.bins, dtype=np.uint64)
        empty = np.flatnonzero(~full)
        chunk = 0
        while len(empty):
            probe = self._probe(chunk)[:, empty]
            hit = full[probe]
            got, which = hit.any(axis=0), hit.argmax(axis=0)
            least[empty[got]] = least[probe[which[got], np.flatnonzero(got)]]
            empty = empty[~got]
            chunk += 1
        return (least & np.uint64((1 << self.bits) - 1)).astype(f"<u{self.bits // 8}")

    def pack(self, values: np.ndarray | None) -> str:
        return "" if values is None else base64.b64encode(values.tobytes()).decode("ascii")

    def unpack(self, fingerprint: str | None) -> np.ndarray | None:
        return np.frombuffer(base64.b64decode(fingerprint), f"<u{self.bits // 8}") if fingerprint else None

    def fingerprint(self, text: str | None) -> str:
        return self.pack(self.bins_of(text or ""))

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        if a is None or b is None:
            return float(a is None and b is None)
        chance = 2.0 ** -self.bits
        return float(min(1.0, max(0.0, (np.mean(a == b) - chance) / (1 - chance))))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, text, next_text: the text of the next document in descending doc_id (last: the first)."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, high = src.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = ((high or 0) - (low or 0)) // CELLS + 1
    # cells count up as ids fall; null ids have the last cell
    src = src.withColumn("cell", F.coalesce(F.expr(f"CAST(({high or 0}L - doc_id) DIV {width}L AS int)"), F.lit(CELLS)))
    ranges, cells, rows = [], [], 0
    for r in sorted(src.groupBy("cell").agg(F.count("*").alias("n"), F.max("doc_id").alias("head")).collect()):
        if not ranges or rows + r.n > rows_per_range:
            ranges.append(r.head)
            rows = 0
        rows += r.n
        cells.append((r.cell, len(ranges) - 1))
    if not cells:
        return src.select("doc_id", "text", F.col("text").alias("next_text"))
    heads = [(ranges[(i + 1) % len(ranges)], i) for i in range(len(ranges))]
    heads_df = spark.createDataFrame(heads, "head bigint, to int")
    place = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("context")))
    context = F.array(F.struct(F.col("to").alias("range"), F.lit(True).alias("context")))
    dealt = (src.join(F.broadcast(spark.createDataFrame(cells, "cell int, own int")), "cell")
             .join(F.broadcast(heads_df), F.col("doc_id").eqNullSafe(F.col("head")), "left")
             .select("doc_id", "text", F.inline(F.when(F.col("to").isNull(), place).otherwise(F.concat(place, context)))))
    order = Window.partitionBy("range").orderBy("context", F.col("doc_id").desc_nulls_last(), "text")
    return (dealt.withColumn("next_text", F.lead("text").over(order))
            .where("NOT context").select("doc_id", "text", "next_text"))


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def fingerprints(pairs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of text and edited text, and their likeness, for rows of ``with_next_text``."""
    def run(batches):
        maker = OnePermutation(bins, bits, shingle)
        known: tuple = (None, None)          # rows arrive in order: the next text is soon the text
        for b in batches:
            out = []
            for doc_id, text, following in zip(*(values(b.column(i)) for i in range(3))):
                own = known[1] if known[0] == text else maker.bins_of(text)
                changed = edit(text, following)
                other = own if changed == text else maker.bins_of(changed)
                known = (following, own if following == text else maker.bins_of(following))
                out.append((doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            maker.pack(own), maker.pack(other), maker.likeness(own, other),
                            maker.likeness(own, known[1])))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return pairs.select("doc_id", "text", "next_text").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprint(spark, sf_dir):
    return fingerprints(with_next_text(table(spark, sf_dir, "documents")))


QUERIES = {"op4_fingerprint": op4_fingerprint}
