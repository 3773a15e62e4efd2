"""Text shaping of result cells, labels and request bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every code point Unicode lists as white space.
WHITESPACE = (
    "\t\n\u000b\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NULL_CELL = "NULL"


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def metric_label(name: Column, description: Column) -> Column:
    """Trimmed description, or the name with underscores read as spaces."""
    trimmed = trim_space(description)
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.replace(name, F.lit("_"), F.lit(" ")))


def cell_text(column: Column, dtype: T.DataType) -> Column:
    """One result value as text.

    Missing is ``NULL``; days and instants are RFC 3339 (UTC); a double is written as
    a plain decimal with four places, never in exponent form; one that is no such number
    (NaN, infinite, 35 digits and more) as Spark spells it.
    """
    if isinstance(dtype, T.DateType):
        text = F.date_format(column, "yyyy-MM-dd'T'00:00:00'Z'")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = F.coalesce(column.try_cast("decimal(38,4)").cast("string"), column.cast("string"))
    elif isinstance(dtype, T.BinaryType):
        text = F.decode(column, "UTF-8")
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(NULL_CELL))


def escape_cell(text: Column) -> Column:
    """A cell that stays on one table row: bars escaped, line breaks as spaces."""
    barred = F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.replace(barred, F.lit("\n"), F.lit(" "))


def comma_list(text: Column) -> Column:
    """Comma separated names, trimmed, without empty ones."""
    names = F.transform(F.split(text, ","), trim_space)
    return F.filter(names, lambda n: F.length(n) > 0)


def form_value(body: Column, name: str) -> Column:
    """Decoded value of one field of a form-encoded body; NULL when absent or empty."""
    raw = F.regexp_extract(body, f"(?:^|&){name}=([^&]*)", 1)
    return F.nullif(F.try_url_decode(raw), F.lit(""))
