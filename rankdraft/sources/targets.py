"""Target lists: a TSV whose second column is the raw title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankdraft.sources.lines import read_lines

HEADER = "number"


def _fields() -> Column:
    return F.split("line", "\t")


def _data_lines(lines: DataFrame) -> DataFrame:
    """All lines but headers, which may stand anywhere."""
    return lines.where(F.substring_index("line", "\t", 1) != HEADER)


def parse_targets(lines: DataFrame) -> DataFrame:
    """(seq, raw_title) of the well-formed lines; quotes are kept as they are."""
    data = _data_lines(lines).where(F.size(_fields()) > 1)
    return data.select(F.col("line_no").alias("seq"), _fields()[1].alias("raw_title"))


def rejected_targets(lines: DataFrame) -> DataFrame:
    """Lines without a title column."""
    return _data_lines(lines).where(F.size(_fields()) < 2)


def scan_targets(spark: SparkSession, path: str) -> DataFrame:
    return parse_targets(read_lines(spark, path))
