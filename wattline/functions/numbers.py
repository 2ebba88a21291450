"""Locale-tolerant number parsing and small arithmetic used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """Read ``1,234.5``, ``1.234,5``, ``12,5``, ``1,234,567`` or ``kWh 12``; null when no number is left.

    With both signs the later one is the decimal point.  A single comma is a decimal comma,
    several commas group thousands.  Trailing text after the number is ignored.
    """
    kept = F.regexp_replace(F.trim(text), r"[^0-9,.\-]", "")
    commas = F.length(kept) - F.length(F.regexp_replace(kept, ",", ""))
    last_comma = F.length(kept) - F.locate(",", F.reverse(kept))
    last_dot = F.length(kept) - F.locate(".", F.reverse(kept))
    no_commas = F.regexp_replace(kept, ",", "")
    decimal_comma = F.regexp_replace(kept, r"^([^,]*),", "$1.")
    both = kept.contains(",") & kept.contains(".")
    plain = (
        F.when(both & (last_comma > last_dot),
               F.regexp_replace(F.regexp_replace(kept, r"\.", ""), r"^([^,]*),", "$1."))
        .when(both, no_commas)
        .when(commas == 1, decimal_comma)
        .otherwise(no_commas)
    )
    number = F.regexp_extract(plain, r"^(-?(?:\d+\.?\d*|\.\d+))", 1)
    return F.when(number != "", number.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
