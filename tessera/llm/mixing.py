"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document gets a rate, the number of copies the mix takes of it.  Of all rates from 0 to ``most`` that
give every source its target of words, those nearest to 1 in relative entropy have the form
min(most, exp(lambda_source * size)).  Newton's method finds the multipliers of this convex dual: one
distributed aggregation a step, for all sources at once, kept inside a bracket so that it converges where
the limit on copies makes the dual kinked.  The aggregation runs over the distinct (source, size), not
over documents.

Rates then become whole copies.  Within a source, in descending size, the fractions of the rates are
accumulated and a copy is dealt out whenever the sum passes a half; what the words of a source still
differ from the target is repaired by single copies of documents of about that size.

Cases: a null text has size 0 and is taken 0 times its size; a null source is a source of its own, the last
in order; a null id is a document like others; repeated rows are documents of their own; a source without
words has target 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, cut, small

#: Fixed values of the mix: the sources' weights, repeating in their order, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST = 3
#: A (source, size) may hold a third of all documents: ranks inside it are taken in so many parts.
SALTS = 256
STEPS, TOLERANCE = 60, 1e-7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the order of ``key``, without gathering them in one task."""
    dealt = cut(rows.repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return dealt.withColumn("rank", inside).join(F.broadcast(before.drop("n")), "part").withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (src, source_size) with ``target``: shares by weight, stopped at ``most`` times the size, the excess shared again."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    rows = cut(ranked(sources, "src").withColumn("weight", weight).drop("rank"))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    limit, level, before = F.col("source_size") * float(most), 0.0, -1
    stopped: Column = F.lit(False)
    while True:  # the level only rises, so this ends when no further source stops
        fixed, free, n = rows.agg(
            F.coalesce(F.sum(F.when(stopped, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0)), F.count_if(stopped)
        ).first()
        if n == before or not free:
            break
        level, before = (total - fixed) / free, n
        stopped = F.col("weight") * level > limit
    return rows.withColumn("target", F.when(F.col("weight") * level > limit, limit).otherwise(F.col("weight") * level))


def solve(strata: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``strata`` (src, size, n) with ``rate``; ``sources`` has src, source_size, target, scale (of its sizes)."""
    top = float(most)
    full = F.col("target") >= F.col("source_size") * top * (1 - 1e-12)
    none = F.lit(None).cast("double")
    state = cut(
        sources.select("src", "target", "scale", full.alias("full"), F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(0.0).alias("m"), none.alias("low"), none.alias("high"))
    )
    rate = F.when(F.col("full"), top).otherwise(F.least(F.lit(top), F.exp(F.least(F.col("m") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    strata = strata.where("size > 0")
    for _ in range(STEPS):
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < top, words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = strata.join(small(state), "src").groupBy("src").agg(F.sum(words).alias("w"), F.sum(slope).alias("s"))
        state = state.join(sums, "src").withColumn("gap", F.col("w") - F.col("target"))
        low = F.when(F.col("gap") < 0, F.col("m")).otherwise(F.col("low"))
        high = F.when(F.col("gap") > 0, F.col("m")).otherwise(F.col("high"))
        state = state.withColumns({"low": low, "high": high})
        newton = F.col("m") - F.col("gap") / F.col("s")
        wide = 1.0 + F.abs("m") * 2  # the farthest step while one end of the bracket is open
        newton = F.greatest(F.coalesce(F.col("low"), F.col("m") - wide), F.least(F.coalesce(F.col("high"), F.col("m") + wide), newton))
        inside = (F.col("s") > 0) & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        half = F.when(F.col("high").isNull(), F.col("m") + wide).when(F.col("low").isNull(), F.col("m") - wide).otherwise((F.col("low") + F.col("high")) / 2)
        close = F.abs("gap") <= TOLERANCE * F.greatest("target", F.lit(1.0))
        state = cut(state.withColumn("m", F.when(F.col("full") | close, F.col("m")).when(inside, newton).otherwise(half)).withColumn("open", ~(F.col("full") | close)))
        pending = state.where("open").limit(1).count()
        state = state.drop("w", "s", "gap", "open")
        if not pending:
            break
    else:
        raise RuntimeError(f"sources are still off their targets after {STEPS} Newton steps")
    return strata.join(small(state), "src").select("src", "size", "n", F.when(F.col("target") > 0, rate).otherwise(0.0).alias("rate"))


def copies(rates: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(src, size, base, more): every document of a stratum gets ``base`` copies, ``more`` of them one more (or fewer, if negative)."""
    order = Window.partitionBy("src").orderBy(F.col("size").desc())  # distinct sizes of a source
    base = F.floor(F.col("rate") + 1e-9)
    rows = rates.withColumn("base", base).withColumn("part", F.greatest(F.col("n") * (F.col("rate") - F.col("base")), F.lit(0.0)))
    upto = F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("more", F.least(F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("part") + 0.5), F.col("n")))
    rows = cut(rows.select("src", "size", "n", "base", F.greatest("more", F.lit(0)).cast("long").alias("more")))
    while True:  # each round brings some source nearer to its target by a document at least, none further away
        taken = rows.groupBy("src").agg(F.sum((F.col("n") * F.col("base") + F.col("more")) * F.col("size")).alias("taken"))
        gaps = cut(sources.join(taken, "src").select("src", F.round(F.col("target") - F.col("taken")).cast("long").alias("gap")))
        room = F.when(F.col("gap") > 0, F.when(F.col("base") < most, F.col("n") - F.col("more")).otherwise(F.least(-F.col("more"), F.col("n")))).otherwise(
            F.when(F.col("base") > 0, F.col("n") + F.col("more")).otherwise(F.col("more"))
        )
        fits = (F.col("size") <= F.abs("gap")) & (room > 0)
        open_ = rows.join(small(gaps), "src").withColumn("room", room)
        best = cut(open_.where(fits).groupBy("src").agg(F.max_by(F.struct("size", "room", "gap"), "size").alias("b")).select("src", "b.*"))
        if best.isEmpty():
            break
        step = (F.signum("gap") * F.least(F.col("room"), F.floor(F.abs("gap") / F.col("size")))).cast("long")
        change = best.select("src", "size", step.alias("step"))
        rows = cut(rows.join(small(change), ["src", "size"], "left").withColumn("more", F.col("more") + F.coalesce("step", F.lit(0))).drop("step"))
    return rows


def mix(docs: DataFrame, *, id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """id_col, source, size, source_size, target, rate, copies, taken (words, repeats counted) and row_key of every document."""
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))  # in code point order, null last
    rows = docs.select(F.col(id_col), F.col("source"), src.alias("src"), word_count(F.col("text")).alias("size"), F.xxhash64(id_col, "text", "source").alias("row_key"))
    rows = cut(rows.withColumn("salt", F.pmod(F.xxhash64("row_key", F.lit(3)), F.lit(SALTS)).cast("int")))
    cells = cut(rows.groupBy("src", "size", "salt").agg(F.count("*").alias("n")))
    strata = cut(cells.groupBy("src", "size").agg(F.sum("n").alias("n")))
    words = F.sum(F.col("n") * F.col("size"))
    sources = strata.groupBy("src").agg(words.alias("source_size"), (F.sum(F.col("n") * F.col("size") * F.col("size")) / words).alias("scale"))
    goal = cut(targets(sources, weights, most))
    rates = cut(solve(strata, goal.where("source_size > 0"), most))
    dealt = copies(rates, goal, most)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).drop("n")
    cells = cells.join(dealt.join(rates.select("src", "size", "rate"), ["src", "size"]).drop("n"), ["src", "size"], "left")
    rank = F.row_number().over(Window.partitionBy("src", "size", "salt").orderBy("row_key", id_col)) - 1
    rows = rows.withColumn("rank", rank).join(cells, ["src", "size", "salt"])
    picked = F.col("rank") + F.col("before") < F.abs("more")
    n = F.coalesce(F.col("base") + F.when(picked, F.signum("more")).otherwise(0), F.lit(0)).cast("int")
    rows = rows.withColumn("copies", n).join(small(goal.select("src", "source_size", "target")), "src")
    return rows.select(id_col, "source", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"), "row_key")
