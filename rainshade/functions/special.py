"""Special functions as Column expressions: logarithm of gamma, digamma, regularised incomplete beta, Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8
# Bernoulli terms of the asymptotic series: B(2k) / (2k (2k - 1)) and B(2k) / (2k). Fixed values.
GAMMA_TERMS = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
DIGAMMA_TERMS = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760)


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x > 0: the asymptotic series at x + 8, less the logarithms of the steps."""
    def at(z: Column) -> Column:
        series = sum((F.lit(c) / F.pow(z, 2 * k + 1) for k, c in enumerate(GAMMA_TERMS)), F.lit(0.0))
        steps = F.lit(1.0)
        for i in range(1, SHIFT + 1):
            steps = steps * (z - i)
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(steps)
    return _bind(x.cast("double") + SHIFT, at)


def digamma(x: Column) -> Column:
    """Derivative of ln(gamma(x)) for x > 0."""
    def at(z: Column) -> Column:
        series = sum((F.lit(-c) / F.pow(z, 2 * k + 2) for k, c in enumerate(DIGAMMA_TERMS)), F.lit(0.0))
        steps = sum((1 / (z - i) for i in range(1, SHIFT + 1)), F.lit(0.0))
        return F.log(z) - 0.5 / z + series - steps
    return _bind(x.cast("double") + SHIFT, at)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for a, b > 0 and 0 <= x <= 1 by its continued fraction (Lentz's evaluation).

    The fraction converges in about the square root of the larger parameter; it is taken on the side where it converges fast.
    """
    def both(v: Column) -> Column:
        def side(v: Column) -> Column:
            a, b, x = v["a"], v["b"], v["x"]

            def safe(y: Column) -> Column:
                return F.when(F.abs(y) < 1e-300, 1e-300).otherwise(y)
            d0 = 1 / safe(1 - (a + b) * x / (a + 1))
            zero = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

            def term(acc: Column, numerator: Column):
                def use(dc: Column) -> Column:
                    return F.struct(dc["c"].alias("c"), dc["d"].alias("d"), (acc["h"] * dc["c"] * dc["d"]).alias("h"))
                return _bind(F.struct(safe(1 + numerator / acc["c"]).alias("c"), (1 / safe(1 + numerator * acc["d"])).alias("d")), use)

            def step(acc: Column, m: Column) -> Column:
                even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
                odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                return _bind(term(acc, even), lambda mid: term(mid, odd))
            rounds = (F.lit(60) + F.ceil(4 * F.sqrt(F.greatest(a, b)))).cast("int")
            front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
            return front * F.aggregate(F.transform(F.sequence(F.lit(1), rounds), lambda i: i.cast("double")), zero, step, lambda acc: acc["h"])
        swap = v["x"] > (v["a"] + 1) / (v["a"] + v["b"] + 2)
        turned = F.struct(F.when(swap, v["b"]).otherwise(v["a"]).alias("a"), F.when(swap, v["a"]).otherwise(v["b"]).alias("b"), F.when(swap, 1 - v["x"]).otherwise(v["x"]).alias("x"))
        inner = _bind(turned, side)
        return F.when(v["x"] <= 0, 0.0).when(v["x"] >= 1, 1.0).when(swap, 1 - inner).otherwise(inner)
    return _bind(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x")), both)


def student_t_p(t: Column, df: Column) -> Column:
    """Two-sided probability of a Student's t of at least |t| with df degrees of freedom; null where t is null or not a number."""
    p = incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))
    return F.when(t.isNotNull() & ~F.isnan(t) & (df > 0), p)
