"""DataFrame operators over texts: segments as rows, censuses, joins and groups without regard to case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical_key, compatibility_key, nfc, valid
from ..sources.ucd import unicode_props

KEYS = {"nfc": nfc, "canonical": canonical_key, "compatibility": compatibility_key}


def explode_segments(df: DataFrame, segments: Column, *keep: str) -> DataFrame:
    """A row for each segment: the kept columns, pos, offset, len and text."""
    return df.select(*keep, F.posexplode(segments).alias("pos", "s")).select(*keep, "pos", "s.*")


def census(df: DataFrame, text: str, prop: str, *by: str) -> DataFrame:
    """Code points by a property, for each group of the by columns. Null and empty texts have none.

    Characters are counted first, on the map side before the shuffle; only the few different ones meet the property table.
    """
    chars = df.select(*by, F.explode(F.split(valid(F.col(text)), "")).alias("_char")).filter("_char <> ''")
    found = chars.groupBy(*by, "_char").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cp", F.ascii("_char"))
    props = unicode_props(df.sparkSession).select(F.col("cp").alias("_of"), F.col(prop).alias("_prop"))
    return found.join(props, F.col("_cp") == F.col("_of"), "left").groupBy(*by, F.col("_prop").alias(prop)).agg(F.sum("_n").alias("n"))


def with_key(df: DataFrame, text: str, kind: str, name: str = "key") -> DataFrame:
    """df with a key that is equal where texts match; a column of its own, as joins need."""
    return df.withColumn(name, KEYS[kind](F.col(text)))


def _hashed(df: DataFrame, text: str, kind: str, name: str) -> DataFrame:
    """df with the key's SHA-256; a null text has the column's name, which matches nothing. So it is never null, and a join needn't evaluate it once more to ask."""
    return df.withColumn(name, F.coalesce(F.sha2(KEYS[kind](F.col(text)), 256), F.lit(name)))


def matching_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, kind: str = "canonical", how: str = "inner") -> DataFrame:
    """An equi-join of texts that match by the kind of key; the key is computed once for each row.

    Rows meet by the key's SHA-256, so that long texts aren't shuffled twice. A null matches nothing.
    """
    a, b = _hashed(left, left_text, kind, "_left_key"), _hashed(right, right_text, kind, "_right_key")
    return a.join(b, F.col("_left_key") == F.col("_right_key"), how).drop("_left_key", "_right_key")


def matching_groups_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, *aggregates: Column, kind: str = "canonical", how: str = "inner") -> DataFrame:
    """Each row of left with the aggregates over all rows of right whose texts match its text. Texts are neither shuffled nor sorted."""
    groups = _hashed(right, right_text, kind, "_right_key").groupBy("_right_key").agg(*aggregates)
    return _hashed(left, left_text, kind, "_left_key").join(groups, F.col("_left_key") == F.col("_right_key"), how).drop("_left_key", "_right_key")
