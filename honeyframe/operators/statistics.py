"""Statistics of sub-frames, site classes and value histograms."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from honeyframe.functions import hexgrid as H, tables as T
from honeyframe.functions.numbers import col
from honeyframe.operators.numbering import scalar
from honeyframe.session import cut_lineage

# -- sub-frames ----------------------------------------------------------------


def frame_stats(sf: DataFrame) -> DataFrame:
    """One row per sub-frame and one for the whole stack (sf_id NULL)."""
    d = sf.select("sf_id", "value").rollup("sf_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count_if(F.col("value") > 0).alias("nonzero"),
    )
    length = 2 * (1 + F.col("max") - F.col("min")) + F.col("nonzero")
    return d.withColumn("encoded", F.when(F.col("sf_id").isNotNull(), length))


def value_histogram(df: DataFrame, by: str, value: str = "value", fill: bool = False) -> DataFrame:
    """n and share p of every value of each class. ``fill`` adds the values between the
    overall minimum and maximum that do not occur, which one far outlier can make many."""
    # written once, so that the data is read once; one row per class and value
    n = cut_lineage(df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n")))
    if fill:
        lim = n.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        span = F.sequence(scalar(lim, F.col("lo")), scalar(lim, F.col("hi")))
        grid = n.select(by).distinct().select(by, F.explode(span).alias(value))
        n = grid.join(n, [by, value], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(by)))


def sum_image(sf: DataFrame, by: list[str] = ()) -> DataFrame:
    return sf.groupBy(*by, "hp").agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"))


def background_stats(sf: DataFrame, bond: int) -> DataFrame:
    """Mean and spread at the hollow sites, and the gamma shape that fits."""
    d = H.with_wrap(sf.select("x", "y", "z", "value"), bond).filter((F.col("x") == 0) & (F.col("z") == 0))
    s = d.agg(
        F.count(F.lit(1)).alias("cells"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
    )
    m, v = F.col("mean"), F.col("var")
    return s.select(
        "cells", "mean", F.sqrt(v).alias("std"),
        F.when(m > 0, m * m / F.nullif(v, F.lit(0.0))).otherwise(1.0).alias("k"),
        F.when(m > 0, v / m).otherwise(m).alias("theta"),
    )


def masked_hex_mean(hex_pixels: DataFrame) -> DataFrame:
    return hex_pixels.groupBy("frame_id").agg(
        F.avg(F.when(F.col("mask") == 1, F.col("value"))).alias("hex_avg")
    )


def zscore_hex(hex_pixels: DataFrame, key: str = "frame_id") -> DataFrame:
    """(v - mean) / std within each frame; 0 for a constant frame."""
    s = hex_pixels.groupBy(key).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    d = hex_pixels.join(s, key)
    z = (F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return d.withColumn("z_score", F.coalesce(z, F.lit(0.0))).drop("_m", "_s")


def subframe_intensity(sf: DataFrame, sfq: str = "sfq", sfr: str = "sfr") -> DataFrame:
    return sf.groupBy(sfq, sfr).agg(F.sum("value").alias("intensity"))


def center_of_mass_shift(df: DataFrame, bond: int, keys: list[str] = ("frame_id",)) -> DataFrame:
    """Weighted mean of folded coordinates near the cell centre.

    Coordinates fold into a hexagon of three bond lengths; pixels count when
    they lie inside the ring that stays off the atoms.
    """
    d = H.with_wrap(df.select(*keys, "x", "y", "z", "value"), 3 * bond)
    near = F.abs("x") + F.abs("y") + F.abs("z") < (3 * bond) // 2
    v = F.col("value")
    s = d.filter(near).groupBy(*keys).agg(
        F.sum(v).alias("_t"), F.sum(v * F.col("x")).alias("_x"), F.sum(v * F.col("z")).alias("_z")
    )
    t = F.nullif(F.col("_t"), F.lit(0))
    return s.select(*keys, (F.col("_x") / t).alias("shift_x"), (F.col("_z") / t).alias("shift_z"))


def contrast_rings(bond: int) -> tuple[int, int, int]:
    """Radius of the hole, radius of the atom, width of the ring between: what
    the bond length leaves beside the centres is dealt out in turn."""
    spare = max(0, bond - 2)
    return (spare + 2) // 3, (spare + 1) // 3, spare // 3


def ring_contrast(cell: DataFrame, bond: int, keys: list[str] = ("frame_id",)) -> DataFrame:
    """Mean at the hole, mean at the atoms and std/mean of a summed cell."""
    low, _, ring = contrast_rings(bond)
    m = F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))
    k = F.least(F.abs("x"), F.abs("y"), F.abs("z"))
    hole = m <= low
    atom = ~hole & (m > low + ring + 1) & (m >= 4 * k)
    v = F.col("value")
    s = cell.groupBy(*keys).agg(
        F.avg(F.when(hole, v)).alias("hex_low"), F.avg(F.when(atom, v)).alias("hex_high"),
        F.avg(v).alias("hex_avg"), F.stddev_pop(v).alias("_s"),
    )
    return s.withColumn("contrast", F.col("_s") / F.nullif(F.col("hex_avg"), F.lit(0.0))).drop("_s")


def pearson(pairs: DataFrame, by: list[str], a: str, b: str, nonzero: bool = False) -> DataFrame:
    """Correlation per group over pixels valid on both sides; a constant image
    scores 0. ``nonzero`` counts only pixels with a value on either side."""
    x, y = col(a).cast("double"), col(b).cast("double")
    d = pairs.filter(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    if nonzero:
        d = d.filter((x != 0) | (y != 0))
    s = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("_c"),
        F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"),
    )
    norm = F.col("_sx") * F.col("_sy")
    # relative limit: rounding may leave a tiny spread for a constant image
    return s.select(*by, "n", F.when(norm > 1e-12, F.col("_c") / norm).otherwise(0.0).alias("corr"))


def orientation_moments(points: DataFrame, by: list[str], x="x", y="y", w="w") -> DataFrame:
    """Second and fourth moments about the origin, main axis, excentricity.

    The excentricity takes the squared eigenvalues, as the original does.
    """
    x, y, w = col(x), col(y), col(w)
    m = points.groupBy(*by).agg(
        F.sum(w).alias("_w"), F.sum(w * x * x).alias("_xx"), F.sum(w * y * y).alias("_yy"),
        F.sum(w * x * y).alias("_xy"), F.sum(w * x * x * x * x).alias("_x4"), F.sum(w * y * y * y * y).alias("_y4"),
    )
    m = m.select(*by, *[(F.col(c) / F.nullif(F.col("_w"), F.lit(0))).alias(c) for c in ("_xx", "_yy", "_xy", "_x4", "_y4")])
    xx, yy, xy = F.col("_xx"), F.col("_yy"), F.col("_xy")
    half, diff = (xx + yy) / 2, (xx - yy) / 2
    root = F.sqrt(diff * diff + xy * xy)
    kx, ky = F.col("_x4") / F.nullif(xx * xx, F.lit(0.0)), F.col("_y4") / F.nullif(yy * yy, F.lit(0.0))
    # direction of the large eigenvector as (row, column), then a quarter turn
    axis = F.atan2(xy, root + diff)
    d = m.select(
        *by, (half + root).alias("large"), (half - root).alias("small"),
        F.pmod(axis, F.lit(math.pi)).alias("angle"),
        F.sqrt(kx * kx + ky * ky).alias("kurtosis"), F.atan2(ky, kx).alias("kurtosis_angle"),
    )
    ratio = F.col("small") / F.nullif(F.col("large"), F.lit(0.0))
    return d.withColumn("excent", F.sqrt(1 - ratio * ratio))


def fit_ellipse(peaks: DataFrame, by: list[str], theta="theta", radius="radius") -> DataFrame:
    """Ellipse through polar points: 1/r^2 = A + B cos 2t + C sin 2t by least
    squares; fewer than three points, or no ellipse, give the mean circle."""
    t, r = col(theta), col(radius)
    u, c, s = 1 / (r * r), F.cos(2 * t), F.sin(2 * t)
    m = peaks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("_r"), F.sum(u).alias("_u"), F.sum(c).alias("_c"),
        F.sum(s).alias("_s"), F.sum(c * c).alias("_cc"), F.sum(s * s).alias("_ss"), F.sum(c * s).alias("_cs"),
        F.sum(u * c).alias("_uc"), F.sum(u * s).alias("_us"),
    )
    n, k = F.col("n"), {x: F.col("_" + x) for x in ("u", "c", "s", "cc", "ss", "cs", "uc", "us")}

    def det(a, b, c_):
        return (
            a[0] * (b[1] * c_[2] - b[2] * c_[1]) - b[0] * (a[1] * c_[2] - a[2] * c_[1])
            + c_[0] * (a[1] * b[2] - a[2] * b[1])
        )

    c1, c2, c3 = (n, k["c"], k["s"]), (k["c"], k["cc"], k["cs"]), (k["s"], k["cs"], k["ss"])
    rhs = (k["u"], k["uc"], k["us"])
    d0 = det(c1, c2, c3)
    nz = F.nullif(d0, F.lit(0.0))
    m = m.withColumns({"_d": d0, "_A": det(rhs, c2, c3) / nz, "_B": det(c1, rhs, c3) / nz, "_C": det(c1, c2, rhs) / nz})
    amp = F.sqrt(F.col("_B") * F.col("_B") + F.col("_C") * F.col("_C"))
    ok = F.coalesce((n >= 3) & (F.abs("_d") > 1e-9) & (F.col("_A") > amp), F.lit(False))
    return m.select(
        *by, "n",
        F.when(ok, 1 / F.sqrt(F.col("_A") - amp)).otherwise(F.col("_r")).alias("a"),
        F.when(ok, 1 / F.sqrt(F.col("_A") + amp)).otherwise(F.col("_r")).alias("b"),
        F.when(ok, F.pmod(F.atan2(-F.col("_C"), -F.col("_B")) / 2, F.lit(math.pi))).otherwise(0.0).alias("phi"),
    )


def peak_asymmetry(peaks: DataFrame, by: str) -> DataFrame:
    """Spread of the first three peak intensities, and the coma score."""
    p = peaks.groupBy(by).agg(
        *[F.max(F.when(F.col("peak") == k, F.col("intensity"))).alias(f"_{k}") for k in range(3)],
        F.sum("intensity").alias("_all"),
    )
    a, b, c = F.col("_0"), F.col("_1"), F.col("_2")
    spread = F.sqrt(F.pow(a - b, 2) + F.pow(a - c, 2) + F.pow(b - c, 2)) / F.nullif(a + b + c, F.lit(0.0))
    return p.select(by, spread.alias("asymmetry"), (F.lit(1e5) / F.nullif(F.col("_all"), F.lit(0.0))).alias("coma"))


# -- class histograms -------------------------------------------------------------


def class_moments(hist: DataFrame, by: str = "class") -> DataFrame:
    """Mean, mode, variance, skew, kurtosis and peak of each class histogram.

    A histogram has one row per value, so a window over a class is small.
    """
    w = W.partitionBy(by)
    p, v = F.col("p"), F.col("value")
    d = hist.withColumn("_m", F.sum(p * v).over(w) / F.sum(p).over(w))
    e = v - F.col("_m")
    s = d.groupBy(by).agg(
        F.first("_m").alias("avg"), F.max_by("value", F.struct(p, -v)).alias("mode"), F.max(p).alias("peak"),
        F.sum("n").alias("n"), *[(F.sum(p * reduce(lambda a, b: a * b, [e] * k)) / F.sum(p)).alias(f"_c{k}") for k in (2, 3, 4)],
    )
    std = F.sqrt("_c2")
    return s.select(
        by, "n", "avg", "mode", "peak", F.col("_c2").alias("var"), std.alias("std"),
        (F.col("_c3") / F.nullif(std * F.col("_c2"), F.lit(0.0))).alias("skew"),
        (F.col("_c4") / F.nullif(F.col("_c2") * F.col("_c2"), F.lit(0.0))).alias("kurtosis"),
    )


def _upper_root(a, b, c) -> Column:
    """Larger root of a t^2 - b t + c, NULL where there is none."""
    inside = b * b - 4 * a * c
    return (b + F.when(inside >= 0, F.sqrt(inside))) / F.nullif(2 * a, F.lit(0.0))


def family_params(moments: DataFrame) -> DataFrame:
    """Method-of-moments parameters and offsets of five families; NULL where a
    family cannot have these moments. Each family solves its own equations for
    skew and spread; its offset moves its mean to the observed one."""
    g, sd, var, avg = (F.col(c) for c in ("skew", "std", "var", "avg"))
    g2 = g * g

    def above(c, low=0.0):
        return F.when(c > low, c)

    # gamma: skew 2 / sqrt(k), spread theta sqrt(k)
    k, theta = 4 / F.nullif(g2, F.lit(0.0)), g * sd / 2
    d = moments.withColumns({"g_k": k, "g_theta": theta, "g_x0": k * theta - avg, "p_x0": var - avg})
    # inverse gamma: the shape from the skew, the scale from the spread
    d = d.withColumn("ig_alpha", _upper_root(g2, 6 * g2 + 4, 9 * g2 - 8))
    alpha = F.col("ig_alpha")
    mean = sd * F.when(alpha >= 2, F.sqrt(alpha - 2))
    d = d.withColumns({"ig_beta": mean * (alpha - 1), "ig_x0": mean - avg})
    # beta prime, from its own mean m = alpha / c with c = beta - 1: the variance is
    # m (m + 1) / (c - 1) and the skew 2 (2 m + 1) / ((c - 2) std). As (2 m + 1)^2 is
    # 4 m (m + 1) + 1, both give (skew std s / 2)^2 = 1 + 4 var (s + 1) for s = c - 2,
    # which has one positive root, and then 2 m + 1 = skew std s / 2.
    s = (8 + F.sqrt(64 + g2 * (16 + 4 / F.nullif(var, F.lit(0.0))))) / F.nullif(g2, F.lit(0.0))
    mean = (F.when(g > 0, g) * sd * s / 2 - 1) / 2
    d = d.withColumns({"ib_alpha": mean * (s + 2), "ib_beta": F.when(g > 0, s + 3), "ib_x0": mean - avg})
    # log-normal: w = exp(variance of the logarithm) solves w^3 + 3 w^2 = 4 + skew^2
    cube = F.pow(above(1 + g2 / 2 + g * F.sqrt(1 + g2 / 4)), F.lit(1 / 3))
    d = d.withColumn("_w", cube + 1 / cube - 1)
    w = F.col("_w")
    d = d.withColumns({"ln_var": F.ln(above(w)), "ln_mu": F.ln(above(var / above(w * (w - 1)))) / 2})
    return d.withColumn("ln_x0", F.exp(F.col("ln_mu") + F.col("ln_var") / 2) - avg).drop("_w")

def fit_std_curve(moments: DataFrame) -> DataFrame:
    """std against mean: const, linear and root (variance as a quadratic), each
    with its rms residual; ``best`` marks the lowest. Coefficients are around
    the mean of the means, ``x0``."""
    n = F.count(F.lit(1))
    s = moments.agg(F.avg("avg").alias("x0"), F.avg("std").alias("y0"), n.alias("n"))
    x0, y0 = scalar(s, F.col("x0")), scalar(s, F.col("y0"))
    d = moments.select((F.col("avg") - x0).alias("d"), F.col("std").alias("y"), x0.alias("x0"), y0.alias("y0"))
    dd, y = F.col("d"), F.col("y")
    m = d.agg(
        F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.sum(dd * y).alias("dy"),
        *[F.sum(F.pow(dd, k)).alias(f"d{k}") for k in range(5)],
        *[F.sum(y * y * F.pow(dd, k)).alias(f"v{k}") for k in range(3)],
    )
    p = [F.col(f"d{k}") for k in range(5)]
    v = [F.col(f"v{k}") for k in range(3)]

    def det(a, b, c):
        return (
            a[0] * (b[1] * c[2] - b[2] * c[1]) - b[0] * (a[1] * c[2] - a[2] * c[1])
            + c[0] * (a[1] * b[2] - a[2] * b[1])
        )

    cols = [(p[0], p[1], p[2]), (p[1], p[2], p[3]), (p[2], p[3], p[4])]
    d0 = F.nullif(det(*cols), F.lit(0.0))
    zero = F.lit(0.0)
    kinds = F.array(
        F.struct(F.lit("const").alias("kind"), F.col("y0").alias("c0"), zero.alias("c1"), zero.alias("c2")),
        F.struct(F.lit("linear").alias("kind"), F.col("y0").alias("c0"),
                 (F.col("dy") / F.nullif(p[2], zero)).alias("c1"), zero.alias("c2")),
        F.struct(F.lit("root").alias("kind"), (det(v, cols[1], cols[2]) / d0).alias("c0"),
                 (det(cols[0], v, cols[2]) / d0).alias("c1"), (det(cols[0], cols[1], v) / d0).alias("c2")),
    )
    curves = m.select("x0", F.inline(kinds))
    pts = scalar(moments, F.collect_list(F.struct("avg", "std")))  # one entry per class
    r = curves.select("*", F.explode(pts).alias("pt"))
    fit = curve_value("kind", "c0", "c1", "c2", F.col("pt.avg") - F.col("x0"))
    r = r.groupBy("kind", "x0", "c0", "c1", "c2").agg(
        F.sqrt(F.avg(F.pow(F.col("pt.std") - fit, 2))).alias("rms")
    )
    order = F.row_number().over(W.orderBy(F.round("rms", 9).asc_nulls_last(), "kind"))  # three rows
    return r.withColumn("best", order == 1)


def curve_value(kind, c0, c1, c2, d) -> Column:
    kind, c0, c1, c2, d = col(kind), col(c0), col(c1), col(c2), col(d)
    poly = c0 + c1 * d + c2 * d * d
    # a quadratic may turn negative beyond the measured means
    return F.when(kind == "root", F.sqrt(F.greatest(poly, F.lit(1e-6)))).otherwise(poly)


def order_classes(moments: DataFrame, by: str = "class") -> DataFrame:
    """Rank the classes by mean; there is one row per site class."""
    w = W.orderBy(F.round("avg", 9), by)
    return moments.withColumn("place", F.row_number().over(w))


# -- models ---------------------------------------------------------------------------


def significance_report(models: DataFrame, weights: DataFrame, sum_img: DataFrame, cases: DataFrame) -> DataFrame:
    """Per model: counts, difference to the mean image, its plus and minus
    part, the same per case, and the share of all counts.

    models (m, hp, intensity), weights (m, weight), sum_img (hp, mean),
    cases (m, cases).
    """
    d = models.join(sum_img.select("hp", F.col("mean").alias("_mean")), "hp")
    diff = F.col("intensity") - F.col("_mean")
    s = d.groupBy("m").agg(
        F.sum("intensity").alias("counts"), F.sum(F.abs(diff)).alias("difference"),
        F.sum(F.when(diff > 0, diff).otherwise(0.0)).alias("plus"),
        F.sum(F.when(diff < 0, -diff).otherwise(0.0)).alias("minus"),
    )
    s = s.join(weights.select("m", "weight"), "m").join(cases, "m", "left")
    s = s.withColumn("cases", F.coalesce("cases", F.lit(0)))
    total = scalar(s, F.sum(F.col("counts") * F.col("cases")))
    return s.withColumns(
        {
            "per_case": F.col("difference") / F.nullif(F.col("cases"), F.lit(0)),
            "share": F.col("counts") * F.col("cases") / F.nullif(total, F.lit(0.0)),
        }
    )


def atom_summary(atoms: DataFrame, pixels: DataFrame, by: str = "frame_id") -> DataFrame:
    """Sites with positive and negative weight, the background floor that the
    sites leave, and the share of the counts they cover in percent."""
    w = F.col("weight")
    a = atoms.groupBy(by).agg(
        F.count_if(w > 0).alias("n_pos"), F.count_if(w < 0).alias("n_neg"),
        F.sum(F.when(w > 0, w)).alias("w_pos"), F.sum(F.when(w < 0, w)).alias("w_neg"),
        F.avg(F.when(w > 0, w)).alias("mean_pos"), F.avg(F.when(w < 0, w)).alias("mean_neg"),
    )
    p = pixels.groupBy(by).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("_n"))
    d = p.join(a, by, "left").fillna(0, ["n_pos", "n_neg", "w_pos", "w_neg"])
    net = F.col("w_pos") + F.col("w_neg")
    return d.withColumns(
        {"floor": (F.col("total") - net) / F.col("_n"), "coverage": 100 * net / F.nullif(F.col("total"), F.lit(0))}
    ).drop("_n")


# -- densities against histograms -------------------------------------------------------

FAMILIES = (
    "poisson", "poisson_fit", "gauss", "gauss_fit", "gamma", "gamma_fit", "exp",
    "invgamma", "invgamma_fit", "betaprime", "betaprime_fit", "lognorm", "lognorm_fit", "stretched",
)


def fitted_params(df: DataFrame, offsets: dict[str, Column], avg="avg", std="std_fit") -> DataFrame:
    """Parameters of the families for a mean and the std of the curve."""
    a, v = col(avg), col(std) * col(std)

    def pos(c):
        return F.when(c > 0, c)

    m = {k: pos(a + offsets[k]) for k in ("g", "ig", "ib", "ln")}
    d = df.withColumns(
        {
            "f_var": v, "f_px0": v - a, "f_theta": v / m["g"], "f_k": m["g"] * m["g"] / pos(v),
            "f_ialpha": 3 + F.sqrt(pos(9 - 4 * (2 - m["ig"] / pos(v)))),
            "f_ibeta2": 2 + m["ib"] * (m["ib"] - 1) / pos(v),
            "f_lvar": F.ln(1 + v / (m["ln"] * m["ln"])),
        }
    )
    return d.withColumns(
        {
            "f_ibeta": m["ig"] * (F.col("f_ialpha") - 1),
            "f_balpha": pos(m["ib"] * (F.col("f_ibeta2") - 1)),
            "f_bbeta": pos(F.col("f_ibeta2")), "f_lmu": F.ln(m["ln"]) - F.col("f_lvar") / 2,
        }
    ).drop("f_ibeta2")


def fitted_density(family: str, x: Column, offsets: dict[str, Column], avg="avg", std="std_fit") -> Column:
    """Density of a family with the parameters of fitted_params."""
    return {
        "poisson": lambda: T.p_poisson(F.floor(x + F.col("f_px0") + 0.5), F.col("f_var")),
        "gamma": lambda: T.p_gamma(x + offsets["g"], "f_k", "f_theta"),
        "gauss": lambda: T.p_gauss(x, avg, std),
        "exp": lambda: T.p_exp(x, avg),
        "invgamma": lambda: T.p_invgamma(x + offsets["ig"], "f_ialpha", "f_ibeta"),
        "betaprime": lambda: T.p_betaprime(x + offsets["ib"], "f_balpha", "f_bbeta"),
        "lognorm": lambda: T.p_lognorm(x + offsets["ln"], "f_lmu", "f_lvar"),
    }[family]()


def mean_offsets(params: DataFrame) -> dict[str, Column]:
    """Offsets of the families averaged over the classes."""
    return {
        k: scalar(params, F.avg(c))
        for k, c in (("g", "g_x0"), ("ig", "ig_x0"), ("ib", "ib_x0"), ("ln", "ln_x0"))
    }


def curve_of(curves: DataFrame, kind: str = "auto"):
    """Function mean -> std of one fitted curve, as scalar subqueries."""
    best = curves.filter("best") if kind == "auto" else curves.filter(F.col("kind") == kind)
    part = {c: scalar(best, F.first(c)) for c in ("kind", "x0", "c0", "c1", "c2")}
    return lambda a: curve_value(part["kind"], part["c0"], part["c1"], part["c2"], a - part["x0"])


def stretched_density(
    targets: DataFrame, keys: list[str], hist: DataFrame, moments: DataFrame, minfactor: float = 1e-3,
    keep_step: bool = False,
) -> DataFrame:
    """Mean of all class histograms, each stretched to the wanted mean and std.

    targets (keys, value, avg, std); gives (keys, value, p). The classes are a
    bounded list (site classes of a cell), spread by explode; their bins are
    found by an equi join.
    """
    lo, hi = scalar(hist, F.min("value")), scalar(hist, F.max("value"))
    src = scalar(moments, F.collect_list(F.struct(
        F.col("class").alias("src"), F.col("avg").alias("s_avg"), F.col("std").alias("s_std"),
        F.col("mode").alias("s_mode"), F.col("peak").alias("s_peak"), F.col("n").alias("s_n"),
    )))
    d = targets.select(*keys, "value", "avg", "std", F.inline(src))
    d = d.withColumn("k", F.col("s_std") / F.col("std"))
    kk = F.when(F.col("value") > F.col("avg"), 1 / F.col("k")).otherwise(F.col("k"))
    d = d.withColumn("_min", minfactor * kk / F.col("s_n"))
    if keep_step:
        own = hist.select(F.col("class").alias("src"), "value", F.col("p").alias("_p0"))
        d = d.join(own, ["src", "value"], "left")
        fill = F.sqrt(F.coalesce("_p0", F.lit(0.0)) / F.col("s_peak"))
        d = d.withColumn(
            "k", F.when(F.col("value") < F.col("s_mode"), 1 + fill * (F.col("k") - 1)).otherwise(F.col("k"))
        )
    k, x = F.col("k"), F.col("value")
    shift = F.col("s_avg") - k * F.col("avg")

    def clip(c):
        return F.least(F.greatest(c, lo), hi)

    d = d.select(*keys, "value", "src", "k", "_min", F.explode(
        F.sequence(clip(F.floor(k * (x - 0.5) + shift)), clip(F.ceil(k * (x + 0.5) + shift)))
    ).alias("bin"))
    bins = hist.select(F.col("class").alias("src"), F.col("value").alias("bin"), "p")
    d = d.join(bins, ["src", "bin"])
    area = F.avg(F.greatest(F.col("k") * F.col("p"), F.col("_min")))
    return d.groupBy(*keys, "value", "src").agg(area.alias("_a")).groupBy(*keys, "value").agg(F.avg("_a").alias("p"))


def pdf_match(hist: DataFrame, params: DataFrame, curve, minfactor: float = 1e-3) -> DataFrame:
    """Score 1 - 2 sum|p - h| / (sum p + 1) of 14 densities, per class and in
    total (class NULL, weighted by the pixels of the classes).

    ``params`` are family_params of the class moments, ``curve`` the function
    of the fitted std curve.
    """
    hist = cut_lineage(hist)
    params = cut_lineage(params.withColumn("std_fit", curve(F.col("avg"))))
    off = mean_offsets(params)
    pr = cut_lineage(fitted_params(params, off))  # one row per class
    d = hist.select("class", "value", F.col("p").alias("h")).join(pr, "class")
    x = F.col("value").cast("double")
    parts = {
        "poisson": T.p_poisson(F.floor(x + F.col("p_x0") + 0.5), "var"),
        "gauss": T.p_gauss(x, "avg", "std"), "exp": T.p_exp(x, "avg"),
        "gamma": T.p_gamma(x + off["g"], "g_k", "g_theta"),
        "invgamma": T.p_invgamma(x + F.col("ig_x0"), "ig_alpha", "ig_beta"),
        "betaprime": T.p_betaprime(x + F.col("ib_x0"), "ib_alpha", "ib_beta"),
        "lognorm": T.p_lognorm(x + F.col("ln_x0"), "ln_mu", "ln_var"),
        **{f + "_fit": fitted_density(f, x, off) for f in ("poisson", "gauss", "gamma", "invgamma", "betaprime", "lognorm")},
    }
    long = d.select("class", "value", "h", "n", *[v.alias(k) for k, v in parts.items()]).unpivot(
        ["class", "value", "h", "n"], list(parts), "family", "p"
    )
    targets = params.select("class", "avg", "std").join(hist.select("class", "value"), "class")
    st = stretched_density(targets.select(F.col("class").alias("c"), "value", "avg", "std"), ["c"], hist,
                           params, minfactor)
    st = st.withColumnRenamed("c", "class").join(hist.select("class", "value", F.col("p").alias("h")), ["class", "value"])
    st = st.join(params.select("class", "n"), "class").select(
        "class", "value", "h", "n", F.lit("stretched").alias("family"), "p"
    )
    long = long.unionByName(st)
    per = long.groupBy("class", "family", "n").agg(
        F.sum(F.abs(F.col("p") - F.col("h"))).alias("_d"), F.sum("p").alias("_a"), F.count("p").alias("_k"),
        F.count(F.lit(1)).alias("_v"),
    )
    score = F.when(F.col("_k") == F.col("_v"), 1 - 2 * F.col("_d") / (F.col("_a") + 1))
    per = per.select("class", "family", "n", score.alias("score"))
    total = per.groupBy("family").agg(
        F.when(F.count("score") == F.count(F.lit(1)), F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("score")
    ).select(F.lit(None).cast("long").alias("class"), "family", "score")
    return per.select(F.col("class").cast("long"), "family", "score").unionByName(total)
