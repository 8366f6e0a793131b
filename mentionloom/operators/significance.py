"""Tests of the difference between two systems, over paired scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.session import cut


def _hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash that SQL can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Number of pairs, mean difference and t statistic."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d"))
    g = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return g.select("n", F.round("mean", 6).alias("mean"), F.round(F.col("mean") / (F.col("sd") / F.sqrt(F.col("n"))), 5).alias("t"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The four cells of two systems' right answers and McNemar's statistic with continuity correction."""
    x, y = F.col(a), F.col(b)
    g = pairs.agg(F.count_if(x & y).alias("rr"), F.count_if(x & ~y).alias("rw"), F.count_if(~x & y).alias("wr"), F.count_if(~x & ~y).alias("ww"))
    chi = F.when(F.col("rw") + F.col("wr") > 0, F.pow(F.abs(F.col("rw") - F.col("wr")) - 1, 2) / (F.col("rw") + F.col("wr"))).otherwise(0.0)
    return g.select("rr", "rw", "wr", "ww", F.round(chi, 6).alias("chi2"))


def permutation(pairs: DataFrame, key: str, a: str, b: str, rounds: int = 200) -> DataFrame:
    """Observed mean difference and (r + 1) / (R + 1) for signs flipped by a hash of round and key."""
    d = pairs.select(F.col(key).alias("k"), (F.col(a) - F.col(b)).alias("d"))
    seen = d.agg(F.avg("d").alias("observed"))
    r = d.select("k", "d", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"))
    flipped = F.when(_hash_unit(F.col("r"), F.col("k")) < 0.5, -F.col("d")).otherwise(F.col("d"))
    m = r.groupBy("r").agg(F.avg(flipped).alias("m")).crossJoin(seen)  # one row
    return m.groupBy("observed").agg(((F.count_if(F.abs("m") >= F.abs(F.col("observed")) - 1e-12) + 1) / (rounds + 1)).alias("p")).select(F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"))


def bootstrap(pairs: DataFrame, key: str, a: str, b: str, rounds: int = 100) -> DataFrame:
    """Share of resamples (Poisson weights by hash) whose difference exceeds twice the observed one."""
    d = pairs.select(F.col(key).alias("k"), (F.col(a) - F.col(b)).alias("d"))
    seen = d.agg(F.avg("d").alias("observed"))
    u = _hash_unit(F.lit("b"), F.col("r"), F.col("k"))
    steps, total, weight = [], 0.0, F.lit(0)
    for i in range(7):
        total += math.exp(-1) / math.factorial(i)
        steps.append(total)
    for t in steps:
        weight = weight + F.when(u >= t, 1).otherwise(0)
    r = d.select("k", "d", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r")).withColumn("w", weight)
    m = r.groupBy("r").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("m")).crossJoin(seen)  # one row
    return m.groupBy("observed").agg(F.avg((F.abs("m") > 2 * F.abs(F.col("observed"))).cast("double")).alias("share")).select(F.round("observed", 6).alias("observed"), F.round("share", 6).alias("share"))


def normal(z: Column) -> Column:
    """The normal distribution function, within 2e-7 (a published rational approximation of the error function)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def running(df: DataFrame, value: str, count: str) -> DataFrame:
    """``df`` (distinct values with counts) with ``upto``, the sum of the counts of all values up to each one. Values are parted
    by range; a part's own sums are few rows, so nothing is gathered in one task."""
    parts = cut(df.repartitionByRange(value).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.sum(count).alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.orderBy("part")) - F.col("s")).select("part", "before")
    own = F.sum(count).over(Window.partitionBy("part").orderBy(value))
    return parts.withColumn("own", own).join(F.broadcast(before), "part").withColumn("upto", F.col("own") + F.col("before")).drop("part", "own", "before")


def kolmogorov_smirnov(pairs: DataFrame, value: str) -> DataFrame:
    """The largest distance between a sample's distribution and the normal one of its mean and deviation, over all points."""
    g = pairs.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))  # one row
    x = running(pairs.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c")), value, "c").crossJoin(g)
    phi = normal((F.col(value) - F.col("mean")) / F.col("sd"))
    return x.agg(F.round(F.max(F.greatest(F.abs(F.col("upto") / F.col("n") - phi), F.abs((F.col("upto") - F.col("c")) / F.col("n") - phi))), 5).alias("distance"))


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Number of pairs that differ, the sum of the ranks of positive differences (equal ones share their mean rank), and its
    standard score."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    g = d.groupBy(F.abs("d").alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("pos"))
    r = running(g, "v", "c").agg(F.sum("c").alias("n"), F.sum(F.col("pos") * (F.col("upto") - F.col("c") + (F.col("c") + 1) / 2)).alias("w"))
    n = F.col("n").cast("double")  # its third power leaves the whole numbers beyond 1.66 million pairs
    return r.select("n", F.round("w", 1).alias("w"), F.round((F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), 5).alias("z"))
