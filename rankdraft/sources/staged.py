"""Reviewed staging files: five tab-separated columns, no header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankdraft.functions.pytext import strip
from rankdraft.sources.lines import read_lines

# A line holding one of these belongs to a wiki table around the data.
TABLE_MARKS = ["{|", "|}"]


def _data_lines(lines: DataFrame) -> DataFrame:
    """All lines but blank ones and those of a wiki table."""
    kept = lines.where(strip(F.col("line")) != "")
    for mark in TABLE_MARKS:
        kept = kept.where(~F.col("line").contains(mark))
    return kept


def parse_staged(lines: DataFrame) -> DataFrame:
    """(seq, title, description) of the well-formed data lines."""
    fields = F.split("line", "\t")
    return _data_lines(lines).where(F.size(fields) > 2).select(
        F.col("line_no").alias("seq"),
        strip(fields[1]).alias("title"),
        strip(fields[2]).alias("description"),
    )


def rejected_staged(lines: DataFrame) -> DataFrame:
    """Data lines without a title and a description."""
    return _data_lines(lines).where(F.size(F.split("line", "\t")) < 3)


def scan_staged(spark: SparkSession, path: str) -> DataFrame:
    return parse_staged(read_lines(spark, path))
