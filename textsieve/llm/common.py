"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from textsieve.session import ensure_checkpoint_dir, kept  # noqa: F401
from textsieve.sources.tables import read_table

SHINGLE_WORDS = 5
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                       0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of spark.checkpoint.dir."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Ask Python and the driver's JVM to collect garbage, so that Spark's cleaner deletes shuffle files and
    checkpoints that nothing refers to any more now, not when the driver happens to need memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know exactly these letters and blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class HashCache(dict):
    """word -> 64-bit hash; emptied when full, so its memory is bounded."""

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


_RECENT = HashCache()       # one for each worker process, whatever tasks it runs


def word_hashes(text: str) -> np.ndarray:
    """Hash of every word of the text, in text order."""
    return _RECENT.array(words(text))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift-multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(word_hashes: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of every run of k words in text order; with fewer words, of the whole sequence."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    run = min(n, k)
    out = np.full(n - run + 1, np.uint64(run), np.uint64)
    for j in range(run):
        out += word_hashes[j:n - run + 1 + j] * _MULTIPLIERS[j % 5] + np.uint64(j // 5)
    return mix(out)


def values(column) -> Iterator:
    """Python values of an Arrow column, one at a time."""
    for x in column:
        yield x.as_py()
