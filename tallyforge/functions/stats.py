"""Closed-form statistics as column expressions (STA-01 to STA-12, AGG-06).

They work on counts that an aggregation has already reduced, stay inside generated code and need no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 0.975 quantile of the normal distribution.
Z95 = 1.959963984540054
#: Labels of an effect size by its upper bound.
THREE_LABELS = ((0.2, "small"), (0.8, "medium"), (None, "large"))
FOUR_LABELS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"), (None, "large"))


def _double(x: Column | str | float) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def rate(passed: Column, n: Column) -> Column:
    """PRJ-30: a share; 0 of 0 is 0."""
    return F.coalesce(F.try_divide(_double(passed), _double(n)), F.lit(0.0))


def wilson(passed: Column, n: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """STA-01: (rate, lower, upper), held within 0 and 1; zeros for no observation."""
    n, p = _double(n), rate(passed, n)
    spread = z * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    centre, scale = p + F.lit(z * z) / (2 * n), 1 + F.lit(z * z) / n
    none = n == 0
    lower = F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - spread) / scale))
    upper = F.when(none, 0.0).otherwise(F.least(F.lit(1.0), (centre + spread) / scale))
    return F.when(none, 0.0).otherwise(p), lower, upper


def normal_quantile(p: Column) -> Column:
    """STA-02: the rational approximation of Abramowitz and Stegun 26.2.23 (error below 4.5e-4)."""
    q = F.least(_double(p), 1 - _double(p))
    t = F.sqrt(-2 * F.log(q))
    # fixed values of the published formula
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(_double(p) < 0.5, -x).when(_double(p) == 0.5, 0.0).otherwise(x)


def erf(x: Column, terms: int = 140) -> Column:
    """The error function for x >= 0, by its series of positive terms (to about 1e-15 below x = 6, 1 beyond)."""
    x = F.least(x, F.lit(6.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * 2 * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda a: a["sum"])
    return F.least(F.lit(1.0), F.lit(2 / math.sqrt(math.pi)) * x * F.exp(-x * x) * total)


def normal_two_sided(z: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - erf(F.abs(z) / math.sqrt(2)))


def chi2_p(x: Column, dof: Column | int) -> Column:
    """The upper tail of the chi-squared distribution, for any whole number of degrees of freedom."""
    x, dof = _double(x), F.lit(dof) if isinstance(dof, int) else dof
    dof = dof.cast("int")
    half = x / 2
    none = F.array().cast("array<int>")
    even_terms = F.aggregate(
        F.when(dof >= 4, F.sequence(F.lit(1), F.greatest(F.lit(1), (dof / 2).cast("int") - 1))).otherwise(none),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, k: F.struct((a["term"] * half / k).alias("term"), (a["sum"] + a["term"] * half / k).alias("sum")),
        lambda a: a["sum"],
    )
    odd_terms = F.aggregate(
        F.when(dof >= 3, F.sequence(F.lit(1), F.greatest(F.lit(1), ((dof - 1) / 2).cast("int")))).otherwise(none),
        F.struct((F.sqrt(half) * 2 / math.sqrt(math.pi)).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, k: F.struct((a["term"] * half / (k + 0.5)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    even = F.exp(-half) * even_terms
    odd = 1 - erf(F.sqrt(half)) + F.exp(-half) * odd_terms
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(dof % 2 == 0, even).otherwise(odd)))


def student_two_sided(t: Column, dof: Column) -> Column:
    """The two-sided tail of Student's t for whole degrees of freedom: up to 400 by the finite sum of its cosine powers,
    beyond by the normal tail of a transformed t (error below 1e-6), so no sum grows with the sample."""
    t, many = _double(t), _double(dof)
    normal = normal_two_sided(F.sqrt(many * F.log1p(t * t / many)) * (8 * many + 1) / (8 * many + 3))
    dof = F.least(dof, F.lit(400)).cast("int")
    angle = F.atan(F.abs(_double(t)) / F.sqrt(_double(dof)))
    c2 = F.cos(angle) * F.cos(angle)
    odd = dof % 2 == 1
    steps = F.when(dof >= 4, F.sequence(F.lit(1), F.greatest(F.lit(1), F.when(odd, ((dof - 1) / 2).cast("int") - 1).otherwise((dof / 2).cast("int") - 1)))).otherwise(F.array().cast("array<int>"))
    ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    total = F.aggregate(
        F.when(odd & (dof < 5), F.array().cast("array<int>")).otherwise(steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, k: F.struct((a["term"] * c2 * ratio(k)).alias("term"), (a["sum"] + a["term"] * c2 * ratio(k)).alias("sum")),
        lambda a: a["sum"],
    )
    inside = F.when(dof == 1, 2 / math.pi * angle).when(odd, 2 / math.pi * (angle + F.sin(angle) * F.cos(angle) * total)).otherwise(F.sin(angle) * total)
    return F.when(many > 400, normal).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - inside)))


def pearson_p(r: Column, n: Column) -> Column:
    """STA-10: the p of a correlation r of n pairs, null below three."""
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    return F.when(n >= 3, student_two_sided(t, n - 2))


def cohens_h(p1: Column, p2: Column) -> Column:
    """STA-03."""
    held = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    return 2 * F.asin(F.sqrt(held(p1))) - 2 * F.asin(F.sqrt(held(p2)))


def effect_label(h: Column, labels: tuple = FOUR_LABELS) -> Column:
    out = F.lit(labels[-1][1])
    for bound, name in reversed(labels[:-1]):
        out = F.when(F.abs(h) < bound, name).otherwise(out)
    return out


def odds_ratio(a: Column, b: Column, c: Column, d: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """STA-06: (ratio, lower, upper) by Woolf's method; half is added to every cell if one is zero."""
    add = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    a, b, c, d = (_double(x) + add for x in (a, b, c, d))
    centre, error = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return a * d / (b * c), F.exp(centre - z * error), F.exp(centre + z * error)


def log_factorial(n: Column) -> Column:
    """By Stirling's series from n + 8 down, so one expression serves any count."""
    x = _double(n) + 9
    stirling = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    for k in range(1, 9):
        stirling = stirling - F.log(_double(n) + k)
    return stirling


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """STA-05: the two-sided p of a 2 x 2 table with any count: all tables no likelier than the observed one."""
    row, col, n = a + b, a + c, a + b + c + d
    low, high = F.greatest(F.lit(0).cast("long"), row + col - n), F.least(row, col)
    # tables more than 40 standard deviations away weigh nothing in double precision; the sum grows as the root of n
    mean, r, k, m = _double(row) * _double(col) / _double(n), _double(row), _double(col), _double(n)
    reach = 40 * F.sqrt(r * k * (m - r) * (m - k) / (m * m * F.greatest(m - 1, F.lit(1.0)))) + 10
    low, high = F.greatest(low, F.floor(mean - reach)), F.least(high, F.ceil(mean + reach))
    chance = lambda x: F.exp(log_choose(col, x) + log_choose(n - col, row - x) - log_choose(n, row))
    seen = chance(a) * (1 + 1e-7)
    tables = F.transform(F.sequence(low, high), chance)
    return F.least(F.lit(1.0), F.aggregate(F.filter(tables, lambda x: x <= seen), F.lit(0.0), lambda s, x: s + x))


def mcnemar(b: Column, c: Column, exact_below: int = 25) -> tuple[Column, Column, Column]:
    """STA-07: (statistic, p, method) of discordant counts; below ``exact_below`` the exact binomial test."""
    n, k = b + c, F.least(b, c)
    terms = F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: F.exp(log_choose(n, i) - n * math.log(2)))
    exact = F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))
    x2 = F.pow(F.abs(_double(b) - _double(c)) - 1, F.lit(2.0)) / n
    method = F.when(n == 0, "none").when(n < exact_below, "exact").otherwise("chi2")
    p = F.when(n == 0, 1.0).when(n < exact_below, exact).otherwise(chi2_p(x2, 1))
    return F.when(method == "chi2", x2), p, method


def pass_at_k(n: Column, c: Column, k: int, small_n: str = "null") -> Column:
    """AGG-06: 1 - C(n-c, k) / C(n, k); where n < k by ``small_n``: null, pass1 (c / n) or clip (k = n)."""
    n, c = _double(n), _double(c)
    size = F.least(F.lit(float(k)), n) if small_n == "clip" else F.lit(float(k))
    miss = F.aggregate(F.sequence(F.lit(0), (F.greatest(size, F.lit(1.0)) - 1).cast("int")), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    value = F.when(c == 0, 0.0).when(n - c < size, 1.0).otherwise(1 - miss)
    if small_n == "clip":
        return F.when(n > 0, value)
    return F.when(n >= k, value).otherwise(c / n if small_n == "pass1" else F.lit(None).cast("double"))


def bonferroni(p: Column, tests: Column) -> Column:
    """STA-11."""
    return F.least(F.lit(1.0), p * tests)
