"""Column functions: logarithms of probabilities, extreme-value distributions, information, tests."""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def to_log(p) -> Column:
    """ln p; minus infinity for 0."""
    return F.when(col(p) > 0, F.log(col(p))).otherwise(F.lit(float("-inf")))


def log_sum(a, b) -> Column:
    """ln(e^a + e^b) without overflow; minus infinity stands for no probability."""
    a, b = col(a), col(b)
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))


def logistic(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def gumbel_quantile(p, mu, lam) -> Column:
    return col(mu) - F.log(-F.log(col(p))) / col(lam)


def exponential_survival(x, mu, lam) -> Column:
    return F.when(col(x) < col(mu), 1.0).otherwise(F.exp(-col(lam) * (col(x) - col(mu))))


def bits(p, q) -> Column:
    """p log2(p / q), one term of a relative entropy; 0 for p = 0, infinite for q = 0."""
    p, q = col(p), col(q)
    return F.when(p <= 0, 0.0).when(q <= 0, float("inf")).otherwise(p * F.log2(p / q))


def xlogx(x) -> Column:
    x = col(x).cast("double")
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def g_statistic(a, na, b, nb) -> Column:
    """Log-likelihood ratio (nats) of the 2 x 2 table a of na against b of nb."""
    a, na, b, nb = map(col, (a, na, b, nb))
    cells = xlogx(a) + xlogx(na - a) + xlogx(b) + xlogx(nb - b) + xlogx(na + nb)
    return cells - xlogx(na) - xlogx(nb) - xlogx(a + b) - xlogx(na + nb - a - b)


def close(a, b, epsilon: float) -> Column:
    """Whether two numbers differ by at most epsilon of the larger magnitude."""
    a, b = col(a), col(b)
    return F.abs(a - b) <= epsilon * F.greatest(F.abs(a), F.abs(b))


def allowed_overlap(la, lb) -> Column:
    """How far two motifs must overlap."""
    la, lb = col(la), col(lb)
    return F.when(F.greatest(la, lb) >= 128, F.least(la, lb)).otherwise(F.greatest(F.lit(6), F.least(la, lb) - 2))


def colour(x, low: float, high: float) -> Column:
    """#rrggbb: black in the middle of the range, towards blue below it and red above, on a logarithmic ramp."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(x) - low) / (high - low)))
    ramp = F.when(t > 0, F.log(2 * t)).otherwise(-1.0)
    red, blue = F.greatest(F.lit(0.0), ramp), F.least(F.lit(1.0), F.greatest(F.lit(0.0), -ramp))
    two = lambda v: F.lpad(F.lower(F.hex(F.floor(v * 255 + 0.5).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), two(red), F.lit("00"), two(blue))


def log_gamma(x: float) -> float:
    return math.lgamma(x) if x > 0 else math.inf


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a power series for small x, a continued fraction beyond."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def register(spark) -> None:
    """Functions that SQL lacks, as Arrow-batched functions: log_gamma(x), upper_gamma(a, x), erfc(x)."""
    from pyspark.sql.functions import pandas_udf

    from strandlab.session import for_python

    for_python(spark)

    @pandas_udf("double")
    def log_gamma_(x: pd.Series) -> pd.Series:
        return x.map(log_gamma, na_action="ignore")

    @pandas_udf("double")
    def upper_gamma_(a: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([upper_gamma(p, q) for p, q in zip(a, x, strict=True)], dtype=float)

    @pandas_udf("double")
    def erfc_(x: pd.Series) -> pd.Series:
        return x.map(math.erfc, na_action="ignore")

    spark.udf.register("log_gamma", log_gamma_)
    spark.udf.register("upper_gamma", upper_gamma_)
    spark.udf.register("erfc", erfc_)
