"""Statistical helpers as column arithmetic.

Spark's ``skewness`` and ``kurtosis`` are population moments; the ``adjusted_*`` forms are the
bias-corrected ones data-frame libraries report.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252
ROOT_YEAR = math.sqrt(TRADING_DAYS)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_logpdf(x: Column | str, mean: Column | float, var: Column | float) -> Column:
    """Gaussian log density as column arithmetic."""
    var = var if isinstance(var, Column) else F.lit(float(var))
    return -0.5 * (F.log(2 * math.pi * var) + F.pow(col(x) - mean, 2) / var)


def normal_pdf(x: Column | str, mean: Column | float = 0.0, var: Column | float = 1.0) -> Column:
    return F.exp(normal_logpdf(x, mean, var))


def normal_cdf(x: Column | str) -> Column:
    """Standard normal distribution function (series and tail forms of the error function, 1e-15)."""
    z = F.abs(col(x)) / math.sqrt(2)
    # Maclaurin series below 3, continued fraction above; both folded from fixed-length sequences.
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, k: F.struct(
            (-acc["term"] * z * z / k).alias("term"),
            (acc["total"] + (-acc["term"] * z * z / k) / (2 * k + 1)).alias("total")),
        lambda acc: acc["total"] * 2 / math.sqrt(math.pi))
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0),
                       lambda acc, k: k / 2.0 / (z + acc),
                       lambda acc: F.exp(-z * z) / (math.sqrt(math.pi) * (z + acc)))
    erfc = F.when(z < 3, 1 - series).otherwise(tail)
    return F.when(col(x) < 0, erfc / 2).otherwise(1 - erfc / 2)


def chi2_tail_even(x: Column, dof: int) -> Column:
    """Upper tail of chi-square with an even number of degrees of freedom (closed form)."""
    half = x / 2
    total = F.lit(0.0)
    for k in range(dof // 2):
        total = total + F.pow(half, k) / math.factorial(k)
    return F.exp(-half) * total


def adjusted_skewness(r: Column | str, over: WindowSpec | None = None) -> Column:
    r = col(r)
    n, g = F.count(r), F.skewness(r)
    if over is not None:
        n, g = n.over(over), g.over(over)
    return F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2) * g)


def adjusted_kurtosis(r: Column | str, over: WindowSpec | None = None) -> Column:
    r = col(r)
    n, g = F.count(r), F.kurtosis(r)
    if over is not None:
        n, g = n.over(over), g.over(over)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g + 6))


def safe_ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b, or ``otherwise`` when b is zero or missing."""
    return F.when(b.isNotNull() & (b != 0), a / b).otherwise(F.lit(otherwise).cast("double"))


def ieee_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as floating point has it: over zero infinite, 0 / 0 not a number; null only where a or b is."""
    return F.coalesce(F.try_divide(col(a), col(b)), col(a) * F.pow(col(b), F.lit(-1.0)))


def ieee_corr(a: Column, b: Column) -> Column:
    """Correlation that is not a number where a side does not vary; ``F.corr`` stops there under ANSI rules."""
    both = a.isNotNull() & b.isNotNull()
    return ieee_ratio(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def sign_of(c: Column | str) -> Column:
    return F.signum(col(c)).cast("int")


def argmax(array: Column | str) -> Column:
    """Zero-based position of the largest element, first one on ties."""
    return (F.array_position(col(array), F.array_max(array)) - 1).cast("int")


def lookup(mapping: Column | str, key: Column | str, default) -> Column:
    """Map access with a default."""
    return F.coalesce(F.try_element_at(col(mapping), col(key)), F.lit(default))


def percent_text(c: Column | str) -> Column:
    """'1.5%' as the number 1.5."""
    return F.rtrim(F.regexp_replace(col(c), "%", "")).try_cast("double")


def title_text(c: Column | str) -> Column:
    """'max_position_size' as 'Max Position Size'."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def parse_number(c: Column | str) -> Column:
    """Vendor number text; 'None', empty and unparsable become 0."""
    return F.coalesce(F.nullif(col(c), F.lit("None")).try_cast("double"), F.lit(0.0))
