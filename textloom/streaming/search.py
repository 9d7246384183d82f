"""Searches over streams. Matching keeps no state, so Columns and line operators work as they are; what
is added here is counting by event time, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.matching import count_matches, is_match
from textloom.plans.planner import Pattern, compile_pattern


def filter_stream(rows: DataFrame, column: str, pattern: str | Pattern, invert: bool = False, **options) -> DataFrame:
    """Rows of a stream (or table) whose column matches."""
    test = is_match(F.col(column), compile_pattern(pattern, **options))
    return rows.where(~test if invert else test)


def windowed_counts(rows: DataFrame, time: str, column: str, pattern: str | Pattern, window: str = "10 minutes", late: str = "10 minutes", **options) -> DataFrame:
    """Matching rows and matches by window of event time; rows later than `late` are left out of windows
    that are closed. In a batch, all rows count."""
    p = compile_pattern(pattern, **options)
    base = rows.withWatermark(time, late) if rows.isStreaming else rows
    n = count_matches(F.col(column), p)
    return base.groupBy(F.window(time, window).alias("window")).agg(F.sum((n > 0).cast("long")).alias("n_rows"), F.sum(n).alias("n_matches")).select(F.col("window.start").alias("window_start"), "n_rows", "n_matches")
