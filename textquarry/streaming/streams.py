"""The functions in Structured Streaming: they have no state, so a stream takes them as a table does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Unicode


def measured(stream: DataFrame, text: str) -> DataFrame:
    """The stream with graphemes (their number) and columns (the display width) of a text column."""
    u = Unicode(stream.sparkSession)
    return stream.withColumn("graphemes", u.grapheme_count(F.col(text))).withColumn("columns", u.display_width(F.col(text)))
