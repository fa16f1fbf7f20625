"""Small pieces the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word separators of the project: spaces, tabs and line breaks.
WORD_BREAK = r"[ \t\r\n]+"


def distinct_rows(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each non-null ``key`` with the named columns; rows delivered twice count once."""
    return df.select(key, *columns).where(F.col(key).isNotNull()).dropDuplicates([key])


def words(text: Column) -> Column:
    """The words of ``text`` (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of ``text``, the project's token count of one token a byte; null counts 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def limit(spark, root: str, name: str) -> tuple[int, int]:
    """``(max_size, overlap)`` of one row of the two-row size_limits table."""
    from webloom.sources.tables import table

    row = table(spark, root, "size_limits").where(F.col("limit_name") == name).select("max_size", "overlap").first()
    if row is None:
        raise ValueError(f"size_limits has no row {name!r}")
    return int(row[0]), int(row[1] or 0)
