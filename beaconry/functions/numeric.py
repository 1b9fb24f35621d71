"""Rounding and number formatting that must agree to the last digit."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def score(value: Column) -> Column:
    """Clamp to 0..100 and round half to even."""
    return F.bround(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)), 0).cast("int")


def half_up_1(value: Column) -> Column:
    """One decimal, halves toward plus infinity."""
    return F.floor(value * 10 + 0.5) / F.lit(10.0)


def half_up_0(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def signed(value: Column) -> Column:
    return F.format_string("%+d", value.cast("long"))


def thousands(value: Column) -> Column:
    return F.format_string("%,d", value.cast("long"))


def compact_number(value: Column) -> Column:
    """Short display form on the 1e4 / 1e8 ladder."""
    return (
        F.when(value >= 100_000_000, F.concat(F.format_string("%.1f", F.bround(value / 1e8, 1)), F.lit("e8")))
        .when(value >= 10_000, F.concat(F.format_string("%.1f", F.bround(value / 1e4, 1)), F.lit("e4")))
        .otherwise(value.cast("string")))
