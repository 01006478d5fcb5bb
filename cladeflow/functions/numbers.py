"""Numeric functions: tolerant rounding and scale factors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance from a half within which a value counts as that half.
TOLERANCE = 1e-7


def tolerant_round(value: Column) -> Column:
    """Round half to even; values within TOLERANCE of a half are taken as that half first."""
    half = F.bround(value * 2) / 2
    return F.when(F.abs(value - half) <= TOLERANCE, F.bround(half)).otherwise(F.bround(value))


def exact_round(value: Column, digits: int) -> Column:
    """``digits`` decimals, decided by the binary value as Python's round does; the tolerance shrinks with the digits.

    Spark's rounding works on the decimal rendering and differs (1.05 at one digit), so this one
    runs as an Arrow function.
    """
    def one(x: float) -> float:
        half = round(x * 2, digits) / 2
        return round(half if abs(x - half) <= TOLERANCE / 10**digits else x, digits)

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore").astype("float64")

    return run(value)


def round_to(value: Column, digits: int | None = None) -> Column:
    value = value.cast("double")
    return exact_round(value, digits) if digits else tolerant_round(value)


def scale_factor(text: str | float) -> int | float:
    """A number, perhaps with k (thousand) or M (million) behind it, in either case."""
    if not isinstance(text, str):
        return text
    unit = {"k": 1_000, "m": 1_000_000}.get(text[-1:].lower(), 1)
    number = text[:-1] if unit > 1 else text
    try:
        return (int(number) if number else 1) * unit
    except ValueError:
        return float(number) * unit
