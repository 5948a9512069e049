"""Text helpers for codes and table labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import col


def pad0(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer text is left whole."""
    s = col(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def slice_code(c: Column | str, start: int, stop: int) -> Column:
    """Characters ``start`` to ``stop`` of a code, 1-based and inclusive."""
    return F.substring(col(c).cast("string"), start, stop - start + 1)


def first_match(c: Column | str, pattern: str, group: int = 0) -> Column:
    """First regex match, null if there is none."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def number(c: Column | str) -> Column:
    """Text to double: thousands commas removed, unparsable text becomes null."""
    return F.regexp_replace(F.trim(col(c)), ",", "").try_cast("double")


def title_case(c: Column | str) -> Column:
    return F.initcap(col(c))


def sentence_case(c: Column | str) -> Column:
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def comma(c: Column | str, digits: int = 0) -> Column:
    return F.format_number(col(c), digits)


def percent_label(c: Column | str, digits: int = 2, space: str = "") -> Column:
    """Percent text with trailing zeros, as in ``2.50%``."""
    return F.concat(F.format_number(col(c), digits), F.lit(f"{space}%"))
