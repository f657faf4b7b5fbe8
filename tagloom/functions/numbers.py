"""Number expressions shared by the checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(value: Column | str, digits: int) -> Column:
    """A double rounded to ``digits`` places, halves to even.

    Halves are looked for after scaling, where 7.050000000000001 is 70.5: ``bround`` goes by the shortest decimal form, so what the last
    bit of a quotient holds would decide.
    """
    scale = F.lit(10.0 ** digits)
    return F.rint((F.col(value) if isinstance(value, str) else value) * scale) / scale
