"""Names of families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def family_name(column: str) -> Column:
    """The last number in a family identifier however written, as TXF%06d; null if it holds none."""
    digits = F.regexp_extract(column, r"([0-9]+)\D*$", 1)
    number = F.regexp_replace(digits, "^0+", "")
    padded = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    return F.when(F.length(digits) > 0, F.concat(F.lit("TXF"), padded))
