"""Text helpers for labels and formatted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c: str | Column, places: int) -> Column:
    """K2: fixed decimals as text, half-even, no thousands separator."""
    return F.regexp_replace(F.format_number(_col(c), places), ",", "")


def thousands(c: str | Column, places: int = 0) -> Column:
    """K7: thousands separators (``{:,.0f}``), half-even."""
    return F.format_number(_col(c), places)


def percent_text(ratio: str | Column, places: int = 0) -> Column:
    """``{:.0%}``: a ratio times 100 with a percent sign."""
    return F.concat(fixed(_col(ratio) * 100, places), F.lit("%"))


def upper(c: str | Column) -> Column:
    """K4."""
    return F.upper(_col(c))


def capitalize_first(c: str | Column) -> Column:
    """K5: first letter kept, the rest lower case (``VENTURE`` -> ``Venture``)."""
    col = _col(c)
    return F.concat(F.substring(col, 1, 1), F.lower(F.substring(col, 2, 1 << 30)))


def key_to_label(c: str | Column) -> Column:
    """K6: ``_`` to space and each word capitalised (``Emp_length`` -> ``Emp Length``)."""
    return F.initcap(F.regexp_replace(_col(c), "_", " "))


def remove_word(c: str | Column, word: str) -> Column:
    """K9: drop every occurrence of ``word`` (``Random Forest Classifier`` -> ``Random Forest ``)."""
    return F.replace(_col(c), F.lit(word), F.lit(""))


def text_bar(c: str | Column, width: int = 50, char: str = "#") -> Column:
    """``char * int(x * width)``."""
    return F.repeat(F.lit(char), (_col(c) * width).cast("int"))
