"""Number, time and noise rules that decide whether rows come out equal. All are column expressions."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """A blank or unreadable cell counts 0."""
    return F.coalesce(F.trim(col(c).cast("string")).try_cast("double"), F.lit(0.0))


def to_time(c: Column | str) -> Column:
    """A blank or unreadable moment is null: it has not come."""
    return F.trim(col(c).cast("string")).try_cast("timestamp")


def half_up(c: Column | str) -> Column:
    """Halves go up, towards plus infinity."""
    return F.floor(col(c) + 0.5)


def half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def ratio(part: Column, whole: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(otherwise))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def percent_text(c: Column | str, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", col(c))


def total(columns: list[Column | str]) -> Column:
    """Row-wise sum."""
    return reduce(lambda a, b: a + b, [col(c) for c in columns])


def fraction(c: Column | str) -> Column:
    """Text such as 1/3 or 0.25 as a number; blank is 0, division by zero null."""
    parts = F.split(F.trim(col(c)), "/")
    value = F.when(F.size(parts) == 2, F.try_divide(F.trim(parts[0]).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double"))).otherwise(parts[0].try_cast("double"))
    return F.when(F.trim(col(c)) == "", F.lit(0.0)).otherwise(value)


def round_up_hours(hours: Column, minutes: int = 30) -> Column:
    """Up to the next multiple of so many minutes; 0 leaves the hours as they are."""
    return F.ceil(hours * 60 / minutes) * minutes / 60 if minutes > 0 else hours


def plus_seconds(moment: Column | str, seconds: Column) -> Column:
    """A timestamp so many whole seconds later."""
    return F.timestamp_seconds(F.unix_seconds(col(moment)) + seconds.cast("long"))


def iso_utc(moment: Column | str) -> Column:
    """Text to the second, as 2026-08-11T10:30:00Z; the session's time zone must be UTC."""
    return F.date_format(col(moment), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def once(value: Column, f) -> Column:
    """``f`` of a value that is made once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def keyed_uniform(seed: str, *keys: Column | str) -> Column:
    """A number in (0, 1) that depends on the seed and the keys alone, whatever the partitions; SQL can compute the same."""
    text = F.concat_ws("|", F.lit(seed), *[col(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


# Fixed values of Acklam's rational approximation to the standard normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which a share ``p`` of cases lies; the relative error is under 1.2e-9."""
    q = p - 0.5
    middle = _horner(q * q, _A) * q / _horner(q * q, (*_B, 1.0))
    tail = lambda r: _horner(r, _C) / _horner(r, (*_D, 1.0))
    return F.when(p < _LOW, tail(F.sqrt(-2 * F.ln(p)))).when(p > 1 - _LOW, -tail(F.sqrt(-2 * F.ln(1 - p)))).otherwise(middle)


def normal_quantile_sql(p: str) -> str:
    def horner(x: str, cs: tuple[float, ...]) -> str:
        out = f"({cs[0]!r}::DOUBLE)"
        for c in cs[1:]:
            out = f"({out} * {x} + ({c!r}::DOUBLE))"
        return out

    q = f"({p} - 0.5)"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (
        f"CASE WHEN {p} < {_LOW} THEN {horner(low, _C)} / {horner(low, (*_D, 1.0))} WHEN {p} > {1 - _LOW} THEN -({horner(high, _C)} / {horner(high, (*_D, 1.0))})"
        f" ELSE {horner(f'({q} * {q})', _A)} * {q} / {horner(f'({q} * {q})', (*_B, 1.0))} END"
    )


def keyed_uniform_sql(seed: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0"


def keyed_normal(seed: str, mean: Column, sd: Column, *keys: Column | str) -> Column:
    """A draw with this mean and deviation; a mean of 0 gives 0. The hash of the keys is made once, the quantile names it some thirty times."""
    return F.when(mean == 0, F.lit(0.0)).otherwise(mean + sd * once(keyed_uniform(seed, *keys), normal_quantile))


def keyed_normal_sql(seed: str, mean: str, sd: str, *keys: str) -> str:
    return f"CASE WHEN ({mean}) = 0 THEN 0.0 ELSE ({mean}) + ({sd}) * ({normal_quantile_sql('(' + keyed_uniform_sql(seed, *keys) + ')')}) END"
