"""Tables of log-probabilities of a data value at a model level."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from honeyframe.functions import tables as T
from honeyframe.functions.numbers import col
from honeyframe.operators import statistics as S
from honeyframe.operators.numbering import scalar


def level_values(spark: SparkSession, levels: int, lo, hi) -> DataFrame:
    """All (level, value) pairs; both ranges are settings, not data."""
    d = spark.range(levels).select(F.col("id").alias("level"))
    return d.select("level", F.explode(F.sequence(col(lo), col(hi))).alias("value"))


def poisson_table(
    spark: SparkSession, levels: int, lo, hi, high: float, low: float = 0.0, offset=0.0, floor: float = -60.0
) -> DataFrame:
    """ln of the Poisson probability of each value at each level.

    A level of intensity 0 cannot give counts; it borrows 1.2 times the value
    of the first level. ``lo``, ``hi`` and ``offset`` may be columns, such as
    scalar subqueries of the data.
    """
    d = level_values(spark, levels, F.lit(lo) if isinstance(lo, int) else lo, F.lit(hi) if isinstance(hi, int) else hi)
    mean = T.level_to_intensity("level", low, high, levels)
    first = F.lit(high / (levels - 1))
    lp = F.when((mean == 0) & (F.col("value") > 0), 1.2 * T.log_poisson("value", first)).otherwise(
        T.log_poisson("value", mean)
    )
    off = F.lit(offset) if isinstance(offset, (int, float)) else offset
    lp = lp - off
    return d.select("level", "value", F.coalesce(T.soft_floor(lp, F.lit(floor)), F.lit(2 * floor)).alias("lp"))


def auto_offset(hist: DataFrame, mean) -> DataFrame:
    """Mean log-probability of the data at its own mean."""
    h = F.col("n")
    return hist.agg((F.sum(h * T.log_poisson("value", mean)) / F.sum(h)).alias("offset"))


def table_offset(hist: DataFrame) -> DataFrame:
    """Sum of p ln p over the values of each class, weighted by its share."""
    n = scalar(hist, F.sum("n"))
    p = F.col("p")
    d = hist.withColumn("_w", F.sum("n").over(W.partitionBy("class")) / n)
    return d.agg(F.sum(F.when(p > 0, F.col("_w") * p * F.ln(p))).alias("offset"))


def blur_rows(table: DataFrame, sigma: float, by: str = "level", value: str = "value", p: str = "p") -> DataFrame:
    """Gaussian smoothing along the value axis; the edge values go on."""
    if sigma <= 0:
        return table
    r = math.ceil(3 * sigma)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(r + 1)]
    norm = raw[0] + 2 * sum(raw[1:])
    w = W.partitionBy(by).orderBy(value)  # one row per value of the table
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(p).over(whole), F.last(p).over(whole)
    s = F.col(p) * (raw[0] / norm)
    for k in range(1, r + 1):
        s = s + (raw[k] / norm) * (F.coalesce(F.lag(p, k).over(w), first) + F.coalesce(F.lead(p, k).over(w), last))
    return table.withColumn("_s", s).drop(p).withColumnRenamed("_s", p)


def level_means(spark: SparkSession, levels: int, low: Column, high: Column, curve) -> DataFrame:
    """(level, avg, std): intensity of each level and the std of the curve."""
    avg = low + (high - low) * F.col("id") / (levels - 1)
    d = spark.range(levels).select(F.col("id").alias("level"), avg.alias("avg"))
    return d.withColumn("std", curve(F.col("avg")))


def empirical_table(
    levels: DataFrame, hist: DataFrame, params: DataFrame, curve=None, family: str = "gamma",
    interpolate: bool = True, minfactor: float = 1e-3,
) -> DataFrame:
    """Probability of each value at each level (level, avg, std).

    Between the means of two site classes their measured histograms are mixed;
    outside, or without ``interpolate``, the density of ``family`` with the
    parameters of the curve is taken. ``stretched`` means stretched_density.
    """
    lo, hi = scalar(hist, F.min("value")), scalar(hist, F.max("value"))
    # bounded: one entry per site class of the unit cell
    cls = scalar(params, F.collect_list(F.struct("avg", "class", "std", "n")))
    d = levels.withColumn("_cls", cls)
    d = d.select(
        "level", "avg", "std",
        F.array_max(F.filter("_cls", lambda c: c["avg"] <= F.col("avg"))).alias("a"),
        F.array_min(F.filter("_cls", lambda c: c["avg"] >= F.col("avg"))).alias("b"),
        F.explode(F.sequence(lo, hi)).alias("value"),
    )
    for side in ("a", "b"):
        h = hist.select(F.col("class").alias("_c"), F.col("value").alias("_v"), F.col("p").alias("p" + side))
        d = d.join(h, (F.col(f"{side}.class") == F.col("_c")) & (F.col("value") == F.col("_v")), "left").drop("_c", "_v")

    def least_p(c):
        k = F.col(f"{c}.std") / F.col("std")
        return minfactor * F.when(F.col("value") > F.col("avg"), 1 / k).otherwise(k) / F.col(f"{c}.n")

    pa, pb = F.greatest("pa", least_p("a")), F.greatest("pb", least_p("b"))
    gap = F.col("b.avg") - F.col("a.avg")
    mix = (F.col("avg") - F.col("a.avg")) / F.nullif(gap, F.lit(0.0))
    between = F.when(gap == 0, pa).otherwise((1 - mix) * pa + mix * pb)
    inside = F.col("a").isNotNull() & F.col("b").isNotNull() & F.lit(interpolate)
    if family == "stretched":
        st = stretched_table(levels, hist, params, minfactor, normalize=False)
        d = d.join(st.select("level", "value", F.col("p").alias("_dens")), ["level", "value"], "left")
    else:
        off = S.mean_offsets(params)
        d = S.fitted_params(d, off, "avg", "std")
        d = d.withColumn("_dens", S.fitted_density(family, F.col("value").cast("double"), off, "avg", "std"))
    d = d.withColumn("p", F.when(inside, between).otherwise(F.col("_dens")))
    again = F.lit(family == "stretched") | (F.lit(interpolate) & F.col("b").isNotNull())
    total = F.sum("p").over(W.partitionBy("level"))
    return d.select(
        "level", "value", F.when(again, F.col("p") / F.nullif(total, F.lit(0.0))).otherwise(F.col("p")).alias("p")
    )


def log_table(table: DataFrame, offset, floor: float) -> DataFrame:
    """ln p - offset with the soft floor; impossible values get twice it."""
    off = F.lit(offset) if isinstance(offset, (int, float)) else offset
    lp = F.when(F.col("p") > 0, F.ln("p")) - off
    return table.select("level", "value", F.coalesce(T.soft_floor(lp, F.lit(floor)), F.lit(2 * floor)).alias("lp"))


def stretched_table(
    levels: DataFrame, hist: DataFrame, params: DataFrame, minfactor: float = 1e-3, keep_step: bool = False,
    normalize: bool = True,
) -> DataFrame:
    """Mean of the stretched class histograms per level."""
    lo, hi = scalar(hist, F.min("value")), scalar(hist, F.max("value"))
    t = levels.select("level", "avg", "std", F.explode(F.sequence(lo, hi)).alias("value"))
    d = S.stretched_density(t, ["level"], hist, params, minfactor, keep_step)
    if not normalize:
        return d
    return d.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("level")))


def tail_table(levels: DataFrame, hist: DataFrame, params: DataFrame) -> DataFrame:
    """Second variant: the histogram of the last class, carried on by an
    exponential of the missing mean."""
    last = params.agg(F.max_by(F.struct("class", "avg", "n"), "class").alias("r"))
    cls, avg, n = (scalar(last, F.col(f"r.{c}")) for c in ("class", "avg", "n"))
    lo, hi = scalar(hist, F.min("value")), scalar(hist, F.max("value"))
    d = levels.select("level", "avg", F.explode(F.sequence(lo, hi)).alias("value"))
    src = hist.filter(F.col("class") == cls).select(F.col("value").alias("_m"), F.col("p").alias("_h"))
    d = d.withColumns({"_shift": F.col("avg") - avg, "_min": 1 / n.cast("double")})
    # every value reads the bins below it, one row per table value
    d = d.select("*", F.explode(F.sequence(lo, F.greatest(F.col("value") - 1, lo))).alias("_m")).join(src, "_m")
    step = F.col("value") - F.col("_m")
    w = F.when(step > 0, T.p_exp(step, F.col("_shift") - 0.5))
    g = d.groupBy("level", "value").agg(
        F.sum(w * F.greatest("_h", "_min")).alias("_a"), F.sum(w).alias("_w"),
        F.first("_shift").alias("_shift"), F.first("_min").alias("_min"),
    )
    p = F.when((F.col("_shift") >= 0) & (F.col("_w") > 0), F.col("_a") / F.col("_w")).otherwise(F.col("_min"))
    g = g.select("level", "value", p.alias("p"))
    return g.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("level")))


def seed_models(
    positions: DataFrame, means: DataFrame, key: str, mean: str, low: float, high: float, levels: int, n_models: int
) -> DataFrame:
    """Start models: the mean of the class (or position) of every pixel as a
    gray level, repeated ``n_models`` times."""
    d = positions.select("hp", key).distinct() if key != "hp" else positions.select("hp").distinct()
    d = d.join(means.select(key, F.col(mean).alias("_mean")), key)
    lv = T.intensity_to_level("_mean", low, high, levels)
    return d.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))).alias("m"), "hp", lv.alias("level")
    )


def rescale_models(models: DataFrame, weights: DataFrame, mean: float, levels: int) -> DataFrame:
    """Scale all levels so that their weighted mean is the wanted one; clip to
    [1, levels - 1]."""
    avg = models.groupBy("m").agg(F.avg("level").alias("_a")).join(weights.select("m", "weight"), "m")
    now = scalar(avg, F.sum(F.col("weight") * F.col("_a")) / F.sum("weight"))
    lv = F.round(F.col("level") * (F.lit(float(mean)) / now)).cast("long")
    return models.select("m", "hp", F.least(F.greatest(lv, F.lit(1)), F.lit(levels - 1)).cast("long").alias("level"))
