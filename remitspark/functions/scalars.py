"""Small column expressions: dates, codes, text, numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def date_key(d: Column) -> Column:
    """yyyymmdd as an integer; 0 stands for a missing date."""
    return F.coalesce((F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int"), F.lit(0))


def date_from_key(k: Column) -> Column:
    return F.try_to_date(F.nullif(k, F.lit(0)).cast("string"), "yyyyMMdd")


def day_number(d: Column) -> Column:
    """Days since 1970-01-01, the numeric order range frames need."""
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def day_to_date(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int"))


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + F.lit(1)


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_start_from_text(m: Column) -> Column:
    """First day of a ``YYYY-MM`` label, null when the label does not parse."""
    return F.try_to_date(F.concat(m, F.lit("-01")), "yyyy-MM-dd")


def age_years(birth: Column, at: Column) -> Column:
    return F.round(F.datediff(at, birth).cast("decimal(18,4)") / F.lit(365.25).cast("decimal(5,2)"), 2)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def same_text(c: Column, value: str) -> Column:
    return F.upper(F.trim(c)) == value.strip().upper()


def zero_pad(c: Column, width: int) -> Column:
    """Left-pad with zeros; longer values stay whole."""
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def normalise_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def safe_log1p(x: Column) -> Column:
    return F.log1p(x.cast("double"))


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def scrub_non_finite(df: DataFrame) -> DataFrame:
    """Every floating column without NaN/Inf, so the rows can be written as strict JSON."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            finite_or_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def first_true_label(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Label of the first rule that holds; a rule that is null does not hold."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(F.lit(default)) if default is not None else out


def cut_points(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bands ``value < edge`` in order; the last label is open above."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    rules = [(value < F.lit(edge), label) for edge, label in zip(edges, labels)]
    return F.when(value.isNotNull(), first_true_label(rules, labels[-1]))


def weekday_monday_zero(d: Column) -> Column:
    return F.weekday(d)


def zscore(value: Column, mean: Column, sd: Column) -> Column:
    return (value - mean) / F.nullif(sd, F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def poisson_tail(observed: Column, expected: Column) -> Column:
    """One-sided Poisson probability on the side of the observed count.

    P(X >= o) when o >= e, else P(X <= o). The probability mass is walked outward from the
    observed count by the ratio between neighbouring terms, starting from the log mass at o,
    so large counts do not underflow: downward for the lower tail; for the upper tail upward
    until the remaining terms cannot move the sum.
    """
    o = observed.cast("double")
    e = expected.cast("double")
    log_mass = -e + o * F.ln(F.greatest(e, F.lit(1e-300))) - log_factorial(o)
    span = (F.lit(60) + F.lit(12) * F.sqrt(F.greatest(o, e) + F.lit(1.0))).cast("int")
    up = F.aggregate(
        F.sequence(F.lit(1), span),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, k: _grow(a, e / (o + k)),
        lambda a: a["s"],
    )
    down = F.aggregate(
        F.sequence(F.lit(0), span),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, k: _grow(a, F.greatest(o - k, F.lit(0.0)) / e),
        lambda a: a["s"],
    )
    tail = F.when(o >= e, up).otherwise(down) * F.exp(log_mass)
    return F.when(o.isNull() | e.isNull(), None).when(e <= 0, F.when(o > 0, 0.0).otherwise(1.0)).otherwise(
        F.least(tail, F.lit(1.0))
    )


def _grow(a: Column, step: Column) -> Column:
    term = a["t"] * step
    return F.struct(term.alias("t"), (a["s"] + term).alias("s"))


def log_factorial(n: Column) -> Column:
    """ln n! — summed for n < 20, Stirling's series above (error below 1e-12)."""
    x = n.cast("double")
    small = F.ln(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))
    series = (
        x * F.ln(x) - x + F.lit(0.5) * F.ln(F.lit(6.283185307179586) * x)
        + F.lit(1.0) / (F.lit(12.0) * x)
        - F.lit(1.0) / (F.lit(360.0) * x * x * x)
        + F.lit(1.0) / (F.lit(1260.0) * F.pow(x, F.lit(5.0)))
    )
    return F.when(x < 20, small).otherwise(series)
