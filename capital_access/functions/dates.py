"""Years out of text dates and day serials."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from capital_access.functions.nulls import as_col, to_number
from capital_access.functions.text import last_chars

# Two-digit years from 69 on belong to the 1900s.
FIRST_YEAR_OF_LAST_CENTURY = 2069
# Fixed value: origin of the day serials in the award extract.
SERIAL_ORIGIN = "1900-01-01"


def parse_month_date(c: Column | str) -> Column:
    """Date from day-month-year text such as ``05-January-17`` or ``5-JAN-17``; else missing."""
    c = as_col(c)
    parsed = F.coalesce(
        F.try_to_timestamp(c, F.lit("d-MMMM-yy")), F.try_to_timestamp(c, F.lit("d-MMM-yy"))
    ).cast("date")
    last_century = F.year(parsed) >= FIRST_YEAR_OF_LAST_CENTURY
    return F.when(last_century, F.add_months(parsed, -1200)).otherwise(parsed)


def month_date_year(c: Column | str) -> Column:
    return F.year(parse_month_date(c))


def serial_year(c: Column | str, origin: str = SERIAL_ORIGIN, text_marker: str = "January") -> Column:
    """Year of a day serial; text that holds ``text_marker`` ends in its year instead."""
    c = as_col(c)
    day = F.date_add(F.lit(origin).cast("date"), F.floor(to_number(c)).try_cast("int"))
    return F.when(c.contains(text_marker), last_chars(c, 4).try_cast("int")).otherwise(F.year(day))
