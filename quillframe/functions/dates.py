"""Time stamps as text with microseconds, as older datasets keep them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def time_text(time: Column) -> Column:
    return F.date_format(time, FORMAT)


def parsed_time(text: Column) -> Column:
    """The time of such a text; null if it is none."""
    return F.try_to_timestamp(text, F.lit(FORMAT))
