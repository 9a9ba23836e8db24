"""Export a report as CSV, the way the reference's export writes it.

Cells are the formatted display strings (F1): NULL empty, money with
thousands separators and no decimals, dates ``yyyy-MM-dd``. The file is UTF-8
with a byte-order mark, CRLF line ends, a header row, and minimal quoting
(fields with a comma, quote or line break are quoted, quotes doubled). A line
break inside a cell stays as it is: rows are quoted by expression and written
as text, since Spark's CSV sink rewrites line breaks. An empty result is
refused.

The write is an ordinary distributed text write: one file per partition that
has rows, each with its header (and BOM). ``single_file=True`` funnels the
rows through one task and is meant for small report results only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.formatting import format_frame

BOM = "﻿"


class EmptyResultError(ValueError):
    pass


LINE_END = "\r\n"


def quoted(cell: Column, alone: bool = False) -> Column:
    """A text cell as a CSV field. ``alone``: the only field of its row, where
    an empty one is quoted, so that the row is no blank line."""
    needs = cell.rlike('[,"\r\n]')
    if alone:
        needs = needs | (cell == "")
    return F.when(needs, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def csv_rows(df: DataFrame) -> DataFrame:
    """``df`` (text columns) as CSV rows in a column ``value``; the first row
    of every partition brings the header along."""
    alone = len(df.columns) == 1
    row = F.concat_ws(",", *[quoted(F.col(f"`{c}`"), alone) for c in df.columns])
    header = F.concat_ws(",", *[quoted(F.lit(c), alone) for c in df.columns])
    # the low 33 bits of the id are the row's place in its partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.select(F.when(place == 0, F.concat(F.lit(BOM), header, F.lit(LINE_END), row)).otherwise(row).alias("value"))


def export_csv(df: DataFrame, path: str, headings: Mapping[str, str] | None = None,
               single_file: bool = False, mode: str = "errorifexists") -> None:
    if df.isEmpty():
        raise EmptyResultError("nothing to export: the result has no rows")
    out = format_frame(df)
    if headings:
        out = out.withColumnsRenamed(dict(headings))
    if single_file:
        out = out.coalesce(1)
    csv_rows(out).write.mode(mode).option("lineSep", LINE_END).text(path)
