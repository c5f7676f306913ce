"""Column builders with explicit missing-value rules: missing is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a lenient number may look like; Spark's own cast also takes 1d or 1f.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(c: Column) -> Column:
    """A text as a finite double, else NULL."""
    return F.when(c.rlike(NUMBER), finite(c.try_cast("double")))


def divide(a: Column, b: Column) -> Column:
    """a / b where b > 0."""
    return F.when(b > 0, a / b)


def safe_ratio(a: Column, b: Column, least: float = 1e-8) -> Column:
    """a / b where abs(b) exceeds ``least``; signs are allowed."""
    return F.when(F.abs(b) > least, a / b)


def subject_key(c: Column) -> Column:
    """SHA-256 of a trimmed, lower-cased identifier; an empty-like one is an error."""
    plain = F.lower(F.trim(c))
    bad = c.isNull() | plain.isin("", "nan", "none", "<na>")
    return F.when(bad, F.raise_error(F.lit("empty subject identifier")).cast("string")).otherwise(F.sha2(plain, 256))


def local_timestamp(c: Column, zone: str = "Asia/Seoul") -> Column:
    """A text as wall-clock time in ``zone``: with an offset converted, else taken as is."""
    text = F.trim(c)
    aware = text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d[T ]\d")
    instant = F.from_utc_timestamp(F.try_to_timestamp(text), zone)
    bare = F.try_to_timestamp(F.regexp_replace(text, r"([zZ]|[+-]\d{2}:?\d{2})$", ""))
    return F.when(aware, instant).otherwise(bare)


def clock_hours(t: Column) -> Column:
    return F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0


def clip_scores(columns: Sequence[Column], least: float = 1e-12) -> list[Column]:
    """Scores of at least ``least``, divided by their sum."""
    low = [F.greatest(c, F.lit(least)) for c in columns]
    total = sum(low[1:], low[0])
    return [c / total for c in low]


def softmax(columns: Sequence[Column]) -> list[Column]:
    top = F.greatest(*columns)
    e = [F.exp(c - top) for c in columns]
    return [x / sum(e[1:], e[0]) for x in e]


def expit(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def logit(c: Column, least: float = 1e-9) -> Column:
    p = F.least(F.greatest(c, F.lit(least)), F.lit(1 - least))
    return F.ln(p / (1 - p))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def argmax(columns: Sequence[Column]) -> Column:
    """Index of the largest; the first of ties."""
    top = F.greatest(*columns)
    out = F.lit(len(columns) - 1)
    for i in range(len(columns) - 2, -1, -1):
        out = F.when(columns[i] == top, F.lit(i)).otherwise(out)
    return out


def guarded_corr(x: Column, y: Column, least: int) -> Column:
    """Pearson r of pairs with both values; NULL below ``least`` pairs or for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    ok = (F.count(a) >= least) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(ok, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def guarded_slope(y: Column, x: Column, least: int = 4) -> Column:
    """OLS slope of y on x; NULL below ``least`` pairs or without spread in x."""
    both = x.isNotNull() & y.isNotNull()
    return F.when((F.count(F.when(both, y)) >= least) & (F.min(F.when(both, x)) < F.max(F.when(both, x))), F.regr_slope(y, x))


# Coefficients of a published rational approximation of the normal quantile.
_CENTRE = ((-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239), (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0))
_TAIL = ((-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0))


def normal_quantile(p: Column) -> Column:
    """The standard normal's quantile, to nine digits; for 0 < p < 1."""

    def polynomial(coefficients: Sequence[float], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    r = p - 0.5
    centre = polynomial(_CENTRE[0], r * r) * r / polynomial(_CENTRE[1], r * r)
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = polynomial(_TAIL[0], t) / polynomial(_TAIL[1], t)
    return F.when((p >= 0.02425) & (p <= 1 - 0.02425), centre).when(p < 0.5, tail).otherwise(-tail)


def digamma(n: Column) -> Column:
    """The digamma function of a number of at least 1: its recurrence up by eight, then the asymptotic series."""
    x = n.cast("double") + 8
    up = sum((1 / (n.cast("double") + i) for i in range(1, 8)), 1 / n.cast("double"))
    q = 1 / (x * x)
    return F.ln(x) - 0.5 / x - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240))) - up
