"""Mixing sources to target weights by entropy balancing.

Every source gets a target number of words.  Document rates r_i minimise the
relative entropy to equal rates under one constraint per source, the sum of
r_i * size_i over its documents being the target.  The dual is convex and has one
multiplier per source; the rates are exponentially tilted, r_i = exp(lambda * x_i),
cut at ``CAP`` copies.  With base "words" (each word counts the same in the
entropy) x_i is 1 and all documents of a source have one rate, so length is not
favoured; with base "documents" x_i is size_i over the mean size.  Newton steps,
kept inside a bracket, solve the dual.  Each is one distributed aggregation of a
histogram (source, size, documents), whose size does not depend on how many
documents a source has.

Rates become copies: the whole part, and one more with the probability of the
fraction, decided by a hash of the document, so reruns agree.  What a source then
has too much or too little is settled on up to ``CHANGE`` documents of each size
class (powers of two): they start from the whole part, and from the largest down
each gets one copy more if that still fits; what is left over is then moved up
or down by a copy where that lessens it.  This list has some hundred rows per
source, whatever its size.

Targets: sources by code point, null last, weigh 5, 2, 1 and so on again.  They
share all words by weight; a target stops at ``CAP`` times the words of its source, and what is
above is shared again by weight among the others.

Edge cases: null text and text without words have size 0, are never taken and
need nothing; a source without words has target 0; null is a source of its own;
rows equal in id, source and text are moved together.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsieve.llm.common import cut, table

WEIGHTS = (5, 2, 1)
CAP = 3
CHANGE = 8
ROUNDS, PRECISION = 60, 1e-9
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def keys(id_col: str, source_col: str, text_col: str) -> list[Column]:
    """128-bit name of a row by id, source and text."""
    return [F.xxhash64(F.lit(SEED), F.col(id_col), F.col(id_col).isNull(), F.col(source_col), F.col(source_col).isNull())
            .alias("k1"), F.xxhash64(F.lit(SEED), F.col(text_col), F.col(text_col).isNull(), F.col(id_col)).alias("k2")]


def weighted_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(no, source, source_size, target) from (source, source_size): one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("no") % len(weights) + 1)
    rows = (sizes.withColumn("no", F.row_number().over(by_name) - 1).withColumn("weight", weight)
            .withColumn("most", F.col("source_size").cast("double") * cap)
            .withColumn("ratio", F.col("most") / F.col("weight")))
    # sources reach their limit in the order of limit over weight; the level is that of the first that does not
    order = Window.orderBy("ratio", "no")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    used = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(used), F.lit(0.0)))
             / F.sum("weight").over(rest))
    rows = rows.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no", "level"))).over(everything)["level"]
    return rows.select("no", "source", "source_size", F.coalesce(F.least("most", reached * F.col("weight")), F.col("most"))
                       .alias("target"))


def tilt(lam: Column, x: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(50.0))))


def multipliers(histogram: DataFrame, targets: DataFrame, base: str = "words", cap: int = CAP) -> DataFrame:
    """(no, lam): the dual solution, from (no, size, n) and (no, target)."""
    if base not in ("words", "documents"):
        raise ValueError("base is words or documents")
    known = histogram.where("size > 0")
    mean = known.groupBy("no").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    x = F.lit(1.0) if base == "words" else F.col("size") / F.col("mean")
    steepest = F.lit(1.0) if base == "words" else F.col("least") / F.col("mean")
    cells = cut(known.join(mean, "no").withColumn("x", x).select("no", "size", "n", "x"))
    state = cut(targets.join(mean, "no").where("target > 0").select(
        "no", "target", F.lit(0.0).alias("lam"), F.lit(-700.0).alias("low"),
        ((F.log(F.lit(float(cap))) + 1e-12) / steepest).alias("high"), F.lit(False).alias("done")))
    for _ in range(ROUNDS):
        rate = tilt(F.col("lam"), F.col("x"), cap)
        words = F.col("n") * F.col("size")
        sums = (cells.join(state.select("no", "lam"), "no").groupBy("no").agg(
            F.sum(words * rate).alias("value"),
            F.sum(F.when(rate < cap, words * F.col("x") * rate).otherwise(0.0)).alias("slope")))
        over = F.col("value") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("lam"))
        high = F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - (F.col("value") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        done = F.abs(F.col("value") - F.col("target")) <= PRECISION * F.col("target")
        state = cut(state.drop("done").join(sums, "no").select(
            "no", "target", F.when(done, F.col("lam")).when(inside, newton).otherwise((low + high) / 2).alias("lam"),
            low.alias("low"), high.alias("high"), done.alias("done")))
        if not state.where("NOT done").limit(1).count():
            break
    return state.select("no", "lam")


def settle(units: DataFrame, missing: DataFrame, cap: int) -> DataFrame:
    """(k1, k2, settled): copies of some documents of each source, set so that its words meet the target, from
    (no, k1, k2, words, whole, copies) and (no, missing words)."""
    band = F.floor(F.log2(F.col("words").cast("double"))).cast("int")
    few = (units.where("words > 0").groupBy("no", band.alias("band"), F.pmod("k2", F.lit(CHANGE)).alias("slot"))
           .agg(F.min(F.struct("k1", "k2", "words", "whole", "copies")).alias("u")))
    lists = few.groupBy("no").agg(F.reverse(F.array_sort(F.collect_list(F.struct(
        *[F.col(f"u.{c}").alias(c) for c in ("words", "k1", "k2", "whole", "copies")])))).alias("us")).join(missing, "no")
    kind = "array<struct<words:bigint,k1:bigint,k2:bigint,c:bigint>>"

    def passed(us, left, had, change):
        """Fold over us: change(left, u) is -1, 0 or 1 copies for each."""
        def step(a, u):
            move = change(a["left"], u)
            return F.struct((a["left"] - u["words"] * move).alias("left"), F.concat(a["us"], F.array(F.struct(
                u["words"].alias("words"), u["k1"].alias("k1"), u["k2"].alias("k2"), (had(u) + move).alias("c")))).alias("us"))
        return F.aggregate(us, F.struct(left.alias("left"), F.array().cast(kind).alias("us")), step)

    def fill(left, u):
        return F.when((u["whole"] < cap) & (u["words"] <= left), F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    def trim(left, u):
        up = (left > 0) & (u["c"] < cap) & (F.abs(left - u["words"]) < F.abs(left))
        down = (left < 0) & (u["c"] > 0) & (F.abs(left + u["words"]) < F.abs(left))
        return F.when(up, F.lit(1)).when(down, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")

    # without the random copies of the candidates, the source lacks this much
    lack = F.col("missing") + F.aggregate("us", F.lit(0).cast("bigint"),
                                          lambda a, u: a + (u["copies"] - u["whole"]) * u["words"])
    first = lists.select("no", passed(F.col("us"), lack, lambda u: u["whole"], fill).alias("f"))
    second = first.select(passed(F.col("f.us"), F.col("f.left"), lambda u: u["c"], trim)["us"].alias("us"))
    return second.select(F.explode("us").alias("u")).select("u.k1", "u.k2", F.col("u.c").alias("settled"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, base: str = "words") -> DataFrame:
    """k1, k2 (``keys`` of a row), doc_id, size, source_size, target, copies: one row per distinct row of docs,
    with its number of ``rows``."""
    units = cut(docs.select(*keys(id_col, source_col, text_col), F.col(id_col).cast("bigint").alias("doc_id"),
                            F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
                .groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").alias("rows")))
    counts = cut(units.groupBy("source", "size").agg(F.sum("rows").alias("n")))
    targets = cut(weighted_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                                   weights, cap))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    histogram = counts.join(targets, same(counts, targets)).select("no", "size", "n")
    duals = cut(targets.join(multipliers(histogram, targets, base, cap), "no", "left"))
    mean = histogram.where("size > 0").groupBy("no").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    x = F.lit(1.0) if base == "words" else F.col("size") / F.col("mean")
    rate = F.when(F.col("size") > 0, F.coalesce(tilt(F.col("lam"), x, cap), F.lit(0.0))).otherwise(0.0)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "k1", "k2"), 11) / float(1 << 53)
    whole = F.floor("rate")
    duals = duals.join(mean, "no", "left")
    rounded = cut(units.join(duals, same(units, duals)).withColumn("rate", rate)
                  .withColumn("copies", F.least(F.lit(cap), whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)))
                  .select("k1", "k2", "doc_id", "no", "size", "rows", "source_size", "target",
                          F.least(F.lit(cap), whole).cast("bigint").alias("whole"), F.col("copies").cast("bigint")))
    missing = (rounded.groupBy("no").agg((F.first("target") - F.sum(F.col("size") * F.col("rows") * F.col("copies")))
                                         .alias("missing")))
    settled = settle(rounded.select("no", "k1", "k2", (F.col("size") * F.col("rows")).alias("words"), "whole", "copies"),
                     missing, cap)
    return (rounded.join(settled, ["k1", "k2"], "left").withColumn("copies", F.coalesce("settled", "copies"))
            .drop("settled", "whole", "no"))


def op9_source_mix(spark, sf_dir):
    """Rates tilted by document length: of all rates that meet the targets those closest to equal ones."""
    docs = table(spark, sf_dir, "documents")
    return (mix(docs, base="documents").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"))


QUERIES = {"op9_source_mix": op9_source_mix}
