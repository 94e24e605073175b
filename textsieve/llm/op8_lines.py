"""Line dedup: repeated runs of lines found through suffix ranks, later copies deleted.

A text is the sequence of its lines (cut at line feeds); documents follow each
other by id.  A run of whole lines inside one document is repeated when an equal
run starts earlier, in an earlier document or further up.  Every line that lies
in a repeated run of at least ``MIN_CHARS`` characters (a line break counts one)
is deleted; the first copy stays.

Suffix ranks come from prefix doubling, as when a suffix array is built: round 0
ranks line ids, round k ranks suffixes by their first 2**k lines, from the pairs
(rank of the suffix, rank of the suffix 2**(k-1) lines on).  Suffixes with equal
rank are an interval of the suffix array with a longest common prefix of at least
2**k lines.  A suffix alone in its interval repeats nothing of that length and is
left out of later rounds.

The maximal repeated runs of the wanted size are exactly the union of the
smallest ones, as each of their lines lies in a smallest run of enough characters
read forwards or backwards, and equal text has equal smallest runs.  So rounds end at the
longest smallest run, and each one, [p, p + n) with 2**k <= n < 2**(k+1), is
identified by n and the round-k ranks at p and at p + n - 2**k: all with the same
identity but the earliest are deleted.

DataFrame operations only.  Scale: what is shuffled is line ids (two 64-bit
hashes) and ranks, and the texts once, to apply the deletions.  Ranks are
counted on distinct ids (pre-aggregated), in ranges of the leading key, and then
joined back; a line in a third of all documents is one aggregated row, and its
positions are only joined.

Edge cases: null text stays null (0 lines); empty text is one empty line; rows
without id come last; rows with equal id are ordered by a hash of their text;
rows equal in id and text count as one document and get the same answer.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsieve.llm.common import cut, table

MIN_CHARS = 20
_DOC = ["no_id", "id", "hash"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(id_col).isNull().alias("no_id"),
                       F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"),
                       F.xxhash64(text_col).alias("hash"))


def ranked(keys: DataFrame, first: str, second: str, bucket) -> DataFrame:
    """keys (distinct) with their rank by (first, second); ``bucket`` must not fall as ``first`` grows
    and takes few values."""
    keys = keys.withColumn("bucket", bucket)
    before = (keys.groupBy("bucket").agg(F.count("*").alias("n"))
              .select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before")))
    return (keys.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(first, second)))
            .join(F.broadcast(before), "bucket")
            .select(first, second, (F.col("before") + F.col("place")).alias("rank")))


def line_table(keyed: DataFrame) -> DataFrame:
    """One row per line: document, p (line number), line id (h1, h2), start and end in characters."""
    lines = (keyed.where("text IS NOT NULL").select(*_DOC, F.posexplode(F.split("text", "\n")).alias("p", "line"))
             .select(*_DOC, "p", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                     (F.char_length("line") + 1).alias("size")).distinct())
    order = Window.partitionBy(*_DOC).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return (lines.withColumn("end", F.sum("size").over(order))
            .select(*_DOC, "p", "h1", "h2", (F.col("end") - F.col("size")).alias("start"), "end"))


def smallest_runs(suffixes: DataFrame, min_chars: int) -> DataFrame:
    """(document, p, n): for every line the shortest run of lines of enough characters that begins with it,
    and the shortest that ends with it."""
    ahead = Window.partitionBy(*_DOC).orderBy("p").rangeBetween(0, min_chars - 1)
    behind = Window.partitionBy(*_DOC).orderBy("p").rangeBetween(1 - min_chars, 0)
    at = (suffixes.withColumn("ends", F.collect_list(F.struct("p", "end")).over(ahead))
          .withColumn("starts", F.collect_list(F.struct("p", "start")).over(behind)))
    last = F.array_min(F.transform(F.filter("ends", lambda x: x["end"] >= F.col("start") + min_chars), lambda x: x["p"]))
    first = F.array_max(F.transform(F.filter("starts", lambda x: x["start"] <= F.col("end") - min_chars), lambda x: x["p"]))
    both = F.array(F.struct(F.col("p").alias("p"), (last - F.col("p") + 1).alias("n")),
                   F.struct(first.alias("p"), (F.col("p") - first + 1).alias("n")))
    alone = F.array(F.struct(F.col("p").alias("p"), F.lit(1).alias("n")))
    enough = F.col("end") - F.col("start") >= min_chars
    one = suffixes.where(enough).select(*_DOC, F.inline(alone))
    more = at.where(~enough).select(*_DOC, F.inline(both)).where("p IS NOT NULL AND n IS NOT NULL")
    # a long line may also close a run that starts with a short one: those begin at the short line
    return one.unionByName(more).distinct()


def repeated_lines(lines: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(document, p) of the lines to delete."""
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    rank = ranked(ids.select("h1", "h2"), "h1", "h2", F.shiftright("h1", 52))
    suffixes = cut(lines.join(rank, ["h1", "h2"]).select(*_DOC, "p", "rank", "start", "end"))
    runs = cut(smallest_runs(suffixes, min_chars))
    longest = runs.agg(F.max("n")).first()[0] or 0
    level, k, out = suffixes.select(*_DOC, "p", "rank"), 0, None
    while (1 << k) <= longest:
        size = 1 << k
        own = runs.where((F.col("n") >= size) & (F.col("n") < 2 * size))
        left = own.join(level, [*_DOC, "p"]).withColumnRenamed("rank", "r1")
        named = (left.withColumn("q", F.col("p") + F.col("n") - size)
                 .join(level.select(*_DOC, F.col("p").alias("q"), F.col("rank").alias("r2")), [*_DOC, "q"])
                 .withColumn("at", F.struct(*_DOC, "p")))
        first = (named.groupBy("n", "r1", "r2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
                 .where("first < last").select("n", "r1", "r2", "first"))
        later = (named.join(first, ["n", "r1", "r2"]).where("at > first")
                 .select(*_DOC, F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).alias("p")))
        out = later if out is None else out.unionByName(later)
        if 2 * size > longest:
            break
        ahead = Window.partitionBy(*_DOC).orderBy("p").rangeBetween(size, size)
        paired = cut(level.withColumn("rank2", F.max("rank").over(ahead)).where("rank2 IS NOT NULL"))
        pairs = paired.groupBy("rank", "rank2").agg(F.count("*").alias("n")).where("n > 1").select("rank", "rank2")
        top = level.agg(F.max("rank")).first()[0] or 0
        new = ranked(pairs.select(F.col("rank").alias("r1"), F.col("rank2").alias("r2")), "r1", "r2",
                     F.floor(F.col("r1") / (top // 4096 + 1)))
        level = cut(paired.join(new.select(F.col("r1").alias("rank"), F.col("r2").alias("rank2"),
                                           F.col("rank").alias("new")), ["rank", "rank2"])
                    .select(*_DOC, "p", F.col("new").alias("rank")))
        k += 1
    return out.distinct() if out is not None else suffixes.select(*_DOC, "p").limit(0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_deleted, text without the deleted lines, and the columns named in ``extra``."""
    keyed = _keyed(docs, id_col, text_col)
    lines = cut(line_table(keyed))
    gone = cut(repeated_lines(lines, min_chars))
    touched = gone.select(*_DOC).distinct()
    marks = (lines.select(*_DOC, "p").join(touched, _DOC, "left_semi")
             .join(gone.withColumn("gone", F.lit(True)), [*_DOC, "p"], "left")
             .groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("p", F.coalesce("gone", F.lit(False)).alias("gone"))))
                                 .alias("marks")))
    whole = _keyed(docs.select("*"), id_col, text_col) if not extra else docs.select(
        *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)], F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).alias("text"), F.col(id_col).isNull().alias("no_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("hash"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.col("marks")[i]["gone"])
    return (whole.join(marks, _DOC, "left")
            .select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(
                        F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
                    .cast("bigint").alias("n_lines"),
                    F.coalesce(F.size(F.filter("marks", lambda m: m["gone"])), F.lit(0)).cast("bigint").alias("n_deleted"),
                    F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                    *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)]))


def op8_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


# Pairs of equal lines on one diagonal (same two documents, same distance) that follow each other are a
# common run; a run of enough characters deletes its later copy.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS p FROM d WHERE text IS NOT NULL),
e AS (SELECT a.doc_id AS da, a.p AS pa, b.doc_id AS db, b.p AS pb, length(b.line) + 1 AS size
      FROM l a JOIN l b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.p < b.p))),
g AS (SELECT *, pb - row_number() OVER (PARTITION BY da, db, pb - pa ORDER BY pb) AS island FROM e),
s AS (SELECT *, sum(size) OVER (PARTITION BY da, db, pb - pa, island) AS chars FROM g),
gone AS (SELECT DISTINCT db AS doc_id, pb AS p FROM s WHERE chars >= {MIN_CHARS}),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS text
         FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.p = gone.p GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(d.ls) END::BIGINT AS n_lines,
       coalesce(n.n, 0)::BIGINT AS n_deleted,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLE = {"op8_line_dedup": ORACLE_SQL}
