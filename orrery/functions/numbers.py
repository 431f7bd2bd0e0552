"""Arithmetic, trigonometry, NULL handling, conversion and finance as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

abs = F.abs
sign = F.sign
pow = F.pow
sqrt = F.sqrt
exp = F.exp
ln = F.ln
log2 = F.log2
log10 = F.log10
atan2 = F.atan2
cot = F.cot
pi = F.pi
radians = F.radians
degrees = F.degrees
greatest = F.greatest  # NULL arguments are skipped
least = F.least
coalesce = F.coalesce
ifnull = F.ifnull
nullif = F.nullif
nvl2 = F.nvl2
zeroifnull = F.zeroifnull
nullifzero = F.nullifzero


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where the divisor is zero or either is NULL."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and NULL where the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_digits(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def round_to_increment(x: Column, step: float) -> Column:
    return F.round(x / F.lit(step)) * F.lit(step)


def floor(x: Column, significance: float | None = None) -> Column:
    return F.floor(x) if significance is None else F.floor(x / F.lit(significance)) * F.lit(significance)


def ceil(x: Column, significance: float | None = None) -> Column:
    return F.ceil(x) if significance is None else F.ceil(x / F.lit(significance)) * F.lit(significance)


def trunc(x: Column, digits: int = 0) -> Column:
    """Cut toward zero after `digits` decimals."""
    scale = F.lit(float(10**digits))
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def to_int(x: Column) -> Column:
    """Toward zero, as a whole number."""
    return x.cast("bigint")


def mod(x: Column, y) -> Column:
    """Remainder with the sign of the dividend."""
    return x % y


def square(x: Column) -> Column:
    return x * x


def log_base(x: Column, base: float) -> Column:
    return F.ln(x) / F.lit(math.log(base))


def sin_deg(x: Column) -> Column:
    return F.sin(F.radians(x))


def cos_deg(x: Column) -> Column:
    return F.cos(F.radians(x))


def tan_deg(x: Column) -> Column:
    return F.tan(F.radians(x))


def asin_deg(x: Column) -> Column:
    return F.degrees(F.asin(x))


def acos_deg(x: Column) -> Column:
    return F.degrees(F.acos(x))


def atan_deg(x: Column) -> Column:
    return F.degrees(F.atan(x))


sin_rad, cos_rad, tan_rad = F.sin, F.cos, F.tan
asin_rad, acos_rad, atan_rad = F.asin, F.acos, F.atan


def range_sum(*cols: Column) -> Column:
    """Across columns, NULL counted as 0."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return total


def range_avg(*cols: Column) -> Column:
    """Across columns, NULL skipped; NULL if all are."""
    n = F.lit(0)
    for c in cols:
        n = n + c.isNotNull().cast("int")
    return F.try_divide(range_sum(*cols), n)


def range_min(*cols: Column) -> Column:
    return F.least(*cols)


def range_max(*cols: Column) -> Column:
    return F.greatest(*cols)


def div(x: Column, y) -> Column:
    """Whole quotient, rounded down."""
    return F.floor(x / y)


def frac(x: Column) -> Column:
    return x - F.floor(x)


def odd(x: Column) -> Column:
    return x % 2 != 0


def even(x: Column) -> Column:
    return x % 2 == 0


def permutation(n: Column, k: Column) -> Column:
    """Ordered choices of k out of n, for n up to 20."""
    return F.when(k > n, 0.0).otherwise(F.factorial(n) / F.factorial(F.greatest(n - k, F.lit(0))))


def combination(n: Column, k: Column) -> Column:
    """Unordered choices of k out of n, for n up to 20."""
    return permutation(n, k) / F.factorial(k)


def to_integer(s: Column) -> Column:
    """Nearest whole number; NULL if the text is no number."""
    return F.round(s.try_cast("double")).try_cast("bigint")


def to_double(s: Column) -> Column:
    return s.try_cast("double")


def to_string(x: Column) -> Column:
    return x.cast("string")


def to_bool(s: Column) -> Column:
    return s.try_cast("boolean")


def parse_number(s: Column, fmt: str) -> Column:
    """Formatted text such as `$1,234.50` by a number format; NULL if it does not fit."""
    return F.try_to_number(s, F.lit(fmt)).cast("double")


def future_value(rate, periods, payment, present=0.0, at_start: bool = False) -> Column:
    """Value after the periods, of payments and a present sum (money paid out is negative)."""
    rate, periods = _col(rate), _col(periods)
    grown = F.pow(1 + rate, periods)
    annuity = F.when(rate == 0, periods).otherwise((grown - 1) / F.nullif(rate, F.lit(0.0)))
    if at_start:
        annuity = annuity * (1 + rate)
    return -(_col(present) * grown + _col(payment) * annuity)


def present_value(rate, periods, payment, future=0.0, at_start: bool = False) -> Column:
    rate, periods = _col(rate), _col(periods)
    grown = F.pow(1 + rate, periods)
    annuity = F.when(rate == 0, periods).otherwise((grown - 1) / F.nullif(rate, F.lit(0.0)))
    if at_start:
        annuity = annuity * (1 + rate)
    return -(_col(future) + _col(payment) * annuity) / grown


def npv(rate: float, value: Column, period: Column) -> Column:
    """Aggregate: values discounted by the number of their period, counted from 1."""
    return F.sum(value / F.pow(F.lit(1.0 + rate), period))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))
