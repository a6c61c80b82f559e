"""Column expressions shared by the operators. Everything here stays inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def as_column(value: Column | str) -> Column:
    return F.col(quoted(value)) if isinstance(value, str) else value


def quoted(name: str) -> str:
    """A column name such as ``Flow Byts/s`` or ``a.b`` taken literally."""
    return name if name.startswith("`") else f"`{name.replace('`', '``')}`"


def number_or_zero(value: Column | str) -> Column:
    """Text to number; what is no number becomes 0 (infinities stay)."""
    parsed = as_column(value).try_cast("double")
    return F.coalesce(F.nanvl(parsed, F.lit(0.0)), F.lit(0.0))


def finite_or_null(value: Column | str) -> Column:
    """NULL for NaN and both infinities. NaN sorts above infinity, so one comparison finds all."""
    number = as_column(value).cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def finite_or_zero(value: Column | str) -> Column:
    return F.coalesce(finite_or_null(value), F.lit(0.0))


def not_below_zero(value: Column | str) -> Column:
    return F.greatest(as_column(value), F.lit(0.0))


def log1p_clipped(value: Column | str) -> Column:
    return F.log1p(not_below_zero(value))


def z_score(value: Column | str, mean: Column | float, sd: Column | float) -> Column:
    """Distance from the mean in standard deviations, with a floor under the deviation.

    Values, means and deviations that are NULL give NULL, which no rule comparison accepts.
    """
    mean, sd = _lit(mean), _lit(sd)
    floored = F.when(sd.isNotNull(), F.greatest(F.abs(sd), F.lit(1e-9)))
    return (as_column(value) - mean) / floored


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 on an empty denominator."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / denominator.cast("double")
    )


def hash_key(ids: Sequence[str], *salts: Column | int | str) -> Column:
    """Sort key that shuffles rows the same way on every engine: md5 of the ids and salts."""
    parts = [F.col(quoted(name)).cast("string") for name in ids]
    parts += [s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salts]
    return F.md5(F.concat_ws(":", *parts))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def total_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left + right, columns)


def _lit(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
