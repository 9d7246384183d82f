"""The search surface: select, invert, count, list, only the matches; over lines of files or columns.

All results are lazy DataFrames. Only counting and listing shuffle, and they aggregate partially
before that. Rows come in no order unless the caller sorts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.matching import find_all, find_all_text, highlight, is_match
from textloom.plans.planner import Pattern, compile_pattern
from textloom.sources.lines import invalid_files, list_files, read_lines


def select_lines(lines: DataFrame, pattern: str | Pattern, invert: bool = False, column: str = "line", **options) -> DataFrame:
    """Rows whose line matches; with invert, rows whose line doesn't. A null line is in neither."""
    test = is_match(F.col(column), compile_pattern(pattern, **options))
    return lines.where(~test if invert else test)


def count_lines(lines: DataFrame, pattern: str | Pattern, *keys: str, invert: bool = False, column: str = "line", every: DataFrame | None = None, **options) -> DataFrame:
    """keys and n, the number of selected lines (not of matches), 0 where there are none. `every` has all
    keys, also those without a line; by default the keys of `lines`."""
    test = is_match(F.col(column), compile_pattern(pattern, **options))
    n = F.sum(F.coalesce((~test if invert else test).cast("long"), F.lit(0).cast("long")))
    counts = lines.groupBy(*keys).agg(n.alias("n"))
    if every is None:
        return counts
    return every.select(*keys).distinct().join(counts, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def list_keys(lines: DataFrame, pattern: str | Pattern, *keys: str, invert: bool = False, column: str = "line", **options) -> DataFrame:
    """Distinct keys with a selected line; this takes precedence over counting."""
    return select_lines(lines, pattern, invert, column, **options).select(*keys).distinct()


def only_matching(lines: DataFrame, pattern: str | Pattern, *keys: str, invert: bool = False, column: str = "line", offsets: bool = False, **options) -> DataFrame:
    """A row for each match, empty ones too: keys, match; with offsets, start and end in bytes. With
    invert there are no matches to show, so whole lines come as `match`."""
    p = compile_pattern(pattern, **options)
    if invert:
        return select_lines(lines, p, True, column).select(*keys, F.col(column).alias("match"))
    rows = select_lines(lines, p, False, column)
    if not offsets:
        return rows.select(*keys, F.explode(find_all_text(F.col(column), p)).alias("match"))
    return rows.select(*keys, F.explode(find_all(F.col(column), p)).alias("m")).select(*keys, F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.text").alias("match"))


SHOWN_ERRORS = 1000


@dataclass
class Outcome:
    """How a search went: status 0 if a line was selected, else 2 if a path was skipped, else 1. Files with
    a bad line are told, but neither raise the status nor, with their earlier lines, lower it.
    errors has SHOWN_ERRORS messages of bad files at most; n_errors is how many paths and files were bad."""

    matched: bool
    errors: list[str]
    n_errors: int = 0
    skipped: int = 0

    @property
    def status(self) -> int:
        return 0 if self.matched else 2 if self.skipped else 1


@dataclass
class Grep:
    """A search over text files, with the options of the command line.

    rows() gives path (if with_path), line_no (if number) and line, match or n, as the options say:
    listing goes before counting, counting before only_matching, and only_matching is without effect
    under invert. A path that does not exist, and a directory without recursive, is skipped with a
    message in outcome(). A file is searched up to its first line that is not valid UTF-8, and such a
    file has no row in counts and lists; with skip_invalid its earlier lines are left out too.

    source: lines from elsewhere, as standard input is: a DataFrame or stream with line, line_no if
    number, and path if with_path is wanted for it (then paths is not looked at)."""

    spark: SparkSession
    pattern: str
    paths: list[str] | str = ()
    invert: bool = False
    ignore_case: bool = False
    number: bool = False
    count: bool = False
    list_files: bool = False
    only: bool = False
    recursive: bool = False
    color: bool = False
    skip_invalid: bool = False
    source: DataFrame | None = None

    def compiled(self) -> Pattern:
        return compile_pattern(self.pattern, ignore_case=self.ignore_case)

    @cached_property
    def found(self) -> tuple[list[tuple[str, int]], list[str], list[str]]:
        """Files, usable paths and messages, as list_files gives them."""
        return list_files(self.spark, self.paths, self.recursive)

    @property
    def with_path(self) -> bool:
        """Whether rows name their files: if there are several, or several paths were asked for."""
        if self.source is not None:
            return "path" in self.source.columns
        given = 1 if isinstance(self.paths, str) else len(self.paths)
        return len(self.found[0]) > 1 or bool(self.found[0]) and given > 1

    def _bad(self) -> DataFrame:
        """Bad files; no more rows than the listing has, so it is broadcast where that is short."""
        bad = invalid_files(self.spark, self.found[1], self.recursive)
        return F.broadcast(bad) if len(self.found[0]) <= 100_000 else bad

    def lines(self, whole: bool = False) -> DataFrame:
        """The lines that are searched; whole: those of files without a bad line only."""
        if self.source is not None:
            return self.source
        if not self.found[1]:
            return self.spark.createDataFrame([], "path string, line_no long, line string")
        skip = whole or self.skip_invalid
        rows = read_lines(self.spark, self.found[1], self.recursive, self.number, after_bad=skip)
        return rows.join(self._bad(), "path", "left_anti") if skip else rows

    def rows(self) -> DataFrame:
        p = self.compiled()
        path = ["path"] if self.source is None or self.with_path else []
        keys = [*path, *(["line_no"] if self.number else [])]
        if self.list_files:
            return list_keys(self.lines(True), p, *path, invert=self.invert) if path else select_lines(self.lines(), p, self.invert).select(F.lit("(stdin)").alias("path")).distinct()
        if self.count:
            every = None
            if self.source is None:
                every = self.spark.createDataFrame([f[:1] for f in self.found[0]], "path string")
                every = every.join(self._bad(), "path", "left_anti") if self.found[1] else every
            return count_lines(self.lines(True), p, *path, invert=self.invert, every=every)
        lines = self.lines()
        if self.only and not self.invert:
            out = only_matching(lines, p, *keys).withColumnRenamed("match", "line")
        else:
            out = select_lines(lines, p, self.invert)
        if self.color and not self.invert:
            out = out.withColumn("line", highlight(F.col("line"), p))
        return out.select(*(keys if self.with_path else [k for k in keys if k != "path"]), "line")

    def errors(self) -> DataFrame:
        """path of each file that is not valid UTF-8, all of them."""
        if self.source is not None or not self.found[1]:
            return self.spark.createDataFrame([], "path string")
        return invalid_files(self.spark, self.found[1], self.recursive)

    def outcome(self) -> Outcome:
        messages = [] if self.source is not None else self.found[2]
        bad = [f"{r.path}: invalid UTF-8" for r in self.errors().limit(SHOWN_ERRORS).collect()]
        n = len(bad) if len(bad) < SHOWN_ERRORS else self.errors().count()
        return Outcome(not select_lines(self.lines(True), self.compiled(), self.invert).isEmpty(), messages + bad, len(messages) + n, len(messages))
