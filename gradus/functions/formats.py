"""Text formats as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_value(value: Column) -> Column:
    """The value as text, quoted only if it holds a comma or a quote; null is empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike('[,"]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_value(v) for v in values])
