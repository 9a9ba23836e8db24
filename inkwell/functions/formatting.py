"""Display formatting as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_cell(col: Column, dtype: T.DataType) -> Column:
    """NULL -> "", decimal -> thousands separators and no decimals
    (half-even), date -> yyyy-MM-dd, anything else -> its text."""
    if isinstance(dtype, T.DecimalType):
        text = F.format_number(col, 0)
    elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(col, "yyyy-MM-dd")
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def format_frame(df: DataFrame) -> DataFrame:
    """Every column of ``df`` as display text."""
    return df.select([format_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
                      for f in df.schema.fields])


def or_default(col: Column, default: str) -> Column:
    """Python's ``x or default`` on text: NULL or "" give ``default``."""
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(default)).otherwise(col)


def rename_columns(df: DataFrame, headings: Mapping[str, str]) -> DataFrame:
    """localised column headings."""
    return df.withColumnsRenamed(dict(headings))
