"""Column functions for DNA text and record headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest period that counts as short.
SHORT_PERIOD = 19


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(c: Column | str) -> Column:
    """Upper-case reverse complement; N stays."""
    return F.translate(F.reverse(F.upper(_col(c))), "ACGT", "TGCA")


def orient(c: Column | str) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(_col(c), reverse_complement(c))


def base_count(c: Column | str, bases: str) -> Column:
    return F.length(_col(c)) - F.length(F.translate(_col(c), bases, ""))


def gc_content(c: Column | str) -> Column:
    """Share of G and C; null for an empty sequence."""
    return F.when(F.length(_col(c)) > 0, base_count(c, "GC") / F.length(_col(c)))


def wallace_tm(c: Column | str) -> Column:
    """Melting temperature by Wallace's rule."""
    return (4.0 * base_count(c, "GC") + 2.0 * base_count(c, "AT")).cast("double")


def top_base_share(c: Column | str) -> Column:
    """Share of the most frequent base; 1 for an empty sequence."""
    most = F.greatest(*[base_count(c, b) for b in "ACGT"])
    return F.when(F.length(_col(c)) > 0, most / F.length(_col(c))).otherwise(F.lit(1.0))


def low_complexity(c: Column | str) -> Column:
    """Whether a monomer is of low complexity: at most two bases, 80 % of one base, or one repeated pair."""
    s = _col(c)
    n = F.length(s)
    pair = (n >= 4) & (n % 2 == 0) & (s == F.repeat(F.substring(s, 1, 2), (n / 2).cast("int")))
    return (n <= 2) | (top_base_share(s) >= 0.8) | pair


def record_id(header: Column | str) -> Column:
    """Identifier in a header: up to the first white space, then up to the first semicolon."""
    return F.split(F.split(F.btrim(_col(header)), r"\s+")[0], ";")[0]


def header_field(header: Column | str, key: str) -> Column:
    """Value of `key=` in a header of fields separated by semicolons; null if it has none."""
    value = F.regexp_extract(F.concat(F.lit(";"), _col(header)), f";{key}=([^;]*)", 1)
    return F.when(F.concat(F.lit(";"), _col(header)).contains(f";{key}="), value)


def strand(header: Column | str) -> Column:
    """+ or - from `strand=` in a header, else a dot."""
    value = header_field(header, "strand")
    return F.when(value.isin("+", "-"), value).otherwise(F.lit("."))


def half_even(c: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(c, 0)
