"""Text clean-up and locale formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_symbol(x: Column) -> Column:
    """Trimmed upper case."""
    return F.upper(F.trim(x))


def bare_symbol(x: Column) -> Column:
    """Without the Brazilian suffix and the index mark."""
    return F.replace(F.replace(x, F.lit(".SA"), F.lit("")), F.lit("^"), F.lit(""))


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))


def money(x: Column, currency: str = "R$") -> Column:
    """``R$ 1.234,56``: point for thousands, comma for decimals."""
    text = F.translate(F.format_number(x, 2), ",.", ".,")
    return F.when(x.isNull(), F.lit(f"{currency} N/A")).otherwise(F.concat(F.lit(f"{currency} "), text))


def two_decimals(x: Column) -> Column:
    """Half-even on the exact binary value, as Python's ``.2f`` rounds (``format_string``
    rounds half up)."""
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))


def percent(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("N/A %")).otherwise(F.concat(two_decimals(x), F.lit("%")))


def change_percent(now: Column, prev: Column) -> Column:
    """Signed percent change, ``N/A`` without a previous value."""
    pct = (now - prev) / F.nullif(prev, F.lit(0.0)) * 100.0
    sign = F.when(pct > 0, "+").otherwise("")
    return F.when(pct.isNull(), "N/A").otherwise(F.concat(sign, two_decimals(pct), F.lit("%")))


def date_br(x: Column) -> Column:
    """``dd/MM/yyyy`` of an ISO date text; text that is no date stays as it is."""
    day = F.split(x, " ").getItem(0).try_cast("date")
    return F.coalesce(F.date_format(day, "dd/MM/yyyy"), x)
