"""Rounding that matches the published results."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(x: Column) -> Column:
    """One decimal, ties decided by the exact binary value (12.35 -> 12.3, 0.15 -> 0.1).

    `round` and `bround` decide ties on the printed digits, which moves the result of about one
    tenth of all two-decimal sums; the number formatter looks at the binary value.
    """
    return F.call_function("format_number", x, F.lit("0.0")).cast("double")


def whole_text(x: Column) -> Column:
    """No decimals, ties to even, no grouping: 2.5 -> '2'."""
    return F.call_function("format_number", x, F.lit("0"))


def exact_sum(x: Column) -> Column:
    """Sum of a DOUBLE column as decimals, so the result does not depend on the order of rows."""
    return F.sum(x.cast("decimal(18,4)"))


def exact_avg(x: Column) -> Column:
    return exact_sum(x).cast("double") / F.count(x)
