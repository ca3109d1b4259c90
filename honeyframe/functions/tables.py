"""Gray levels, log-gamma and probability densities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from honeyframe.functions.numbers import LN_SQRT_2PI, col


def level_to_intensity(level, low: float, high: float, levels: int) -> Column:
    return F.lit(low) + F.lit(high - low) * col(level) / (levels - 1)


def intensity_to_level(value, low: float, high: float, levels: int) -> Column:
    lv = F.round((col(value) - low) / F.lit(high - low) * (levels - 1))
    return F.least(F.lit(levels - 1), F.greatest(F.lit(0), lv.cast("long"))).cast("long")


def lgamma(c) -> Column:
    """ln Gamma(x) for x > 0: shift the argument up by 7, then the asymptotic
    series with coefficients 1/12, -1/360, 1/1260, -1/1680."""
    x = col(c)
    z = x + 7.0
    u = x * (x + 6.0)  # x (x+1) ... (x+6) = u (u+5) (u+8) (x+3)
    s = F.lit(1.0) / (z * z)
    series = ((F.lit(-1 / 1680) * s + 1 / 1260) * s - 1 / 360) * s + 1 / 12
    return (z - 0.5) * F.ln(z) - z + LN_SQRT_2PI + series / z - F.ln(u * (u + 5.0) * (u + 8.0) * (x + 3.0))


def lbeta(a, b) -> Column:
    a, b = col(a), col(b)
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def log_poisson(x, mean) -> Column:
    """ln of the Poisson probability; 0 or NULL (impossible) for mean <= 0."""
    x, mean = col(x), col(mean)
    return (
        F.when((mean <= 0) & (x == 0), F.lit(0.0))
        .when((mean <= 0) | (x < 0), F.lit(None).cast("double"))
        .when(x == 0, -mean)
        .otherwise(x * F.ln(mean) - mean - lgamma(x + 1.0))
    )


def p_poisson(x, mean) -> Column:
    return F.coalesce(F.exp(log_poisson(x, mean)), F.lit(0.0))


def p_exp(x, mean) -> Column:
    x, mean = col(x), col(mean)
    return (
        F.when(mean <= 0, F.when(x == 0, 1.0).otherwise(0.0))
        .when(x < 0, 0.0)
        .otherwise(F.exp(-x / mean) / mean)
    )


def p_gauss(x, mean, std) -> Column:
    u = (col(x) - col(mean)) / col(std)
    return F.exp(-0.5 * u * u) / (math.sqrt(2 * math.pi) * col(std))


def p_gamma(x, k, theta) -> Column:
    """Gamma density. At 0 with k <= 1 it is the area the counts above leave:
    the sum stops after the first count there, since (k - 1) theta <= 0."""
    x, k, theta = col(x), col(k), col(theta)

    def dens(v):
        return F.exp((k - 1) * F.ln(v) - k * F.ln(theta) - lgamma(k) - v / theta)

    return (
        F.when(x < 0, 0.0)
        .when(theta <= 0, F.when(x == 0, 1.0).otherwise(0.0))
        .when((x == 0) & (k <= 1), 1 - dens(F.lit(1.0)))
        .when(x == 0, 0.0)
        .otherwise(dens(x))
    )


def p_invgamma(x, alpha, beta) -> Column:
    x, alpha, beta = col(x), col(alpha), col(beta)
    return F.when(x <= 0, 0.0).otherwise(
        F.exp(alpha * F.ln(beta) - lgamma(alpha) - (alpha + 1) * F.ln(x) - beta / x)
    )


def p_betaprime(x, alpha, beta) -> Column:
    x, alpha, beta = col(x), col(alpha), col(beta)
    return F.when(x <= 0, 0.0).otherwise(
        F.exp((alpha - 1) * F.ln(x) - (alpha + beta) * F.ln(x + 1) - lbeta(alpha, beta))
    )


def p_lognorm(x, mu, var) -> Column:
    x, mu, var = col(x), col(mu), col(var)
    d = F.ln(x) - mu
    return F.when(x <= 0, 0.0).otherwise(
        F.exp(-d * d / (2 * var)) / (x * F.sqrt(2 * math.pi * var))
    )


def soft_floor(lp, floor) -> Column:
    """Below the floor the value approaches 2 * floor instead of falling on."""
    lp, floor = col(lp), col(floor)
    return F.when(lp < floor, floor * (1 + F.tanh((lp - floor) / floor))).otherwise(lp)


def gaussian2d(x, y, cx, cy, sx, sy, height, offset) -> Column:
    u, v = (col(x) - col(cx)) / col(sx), (col(y) - col(cy)) / col(sy)
    return col(offset) + col(height) * F.exp(-(u * u + v * v) / 2)


def parabola(x, a, x0, c) -> Column:
    d = col(x) - col(x0)
    return col(a) * d * d + col(c)


def hyperbola(x, a, c) -> Column:
    x = col(x)
    return col(a) / (x * x) + col(c)


def triple_roughness(v1, v2, v3) -> Column:
    """Volume spanned by three bond vectors, given as (x, y, z) columns."""
    (a, b, c), (d, e, f), (g, h, i) = (tuple(col(k) for k in v) for v in (v1, v2, v3))
    return F.abs(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))


def heron_shape(a, b, c) -> Column:
    """Triangle shape from its sides: the product of 1 - side / half
    perimeter, largest (1/27) for equal sides."""
    a, b, c = col(a), col(b), col(c)
    half = (a + b + c) / 2
    return (1 - a / half) * (1 - b / half) * (1 - c / half)
