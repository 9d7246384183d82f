"""The matching operations in SQL: views of them as functions with a pattern argument.

A pattern in SQL is a value, not known when the plan is made, so these run as Arrow functions (and a
table function) that compile each distinct pattern once for each worker. Where the pattern is known,
the Columns of textloom.functions.matching are better: they may run in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.matching import _CAPTURES, _MATCH, CAPTURES, MATCH, _all, _Bytes, _one, _slices
from textloom.pattern.parse import PatternError
from textloom.plans.planner import Engine, Pattern

_engines: dict[str, Engine] = {}


def _engine(pattern: str) -> Engine:
    if pattern not in _engines:
        if len(_engines) > 1000:
            _engines.clear()
        _engines[pattern] = Pattern(pattern).engine
    return _engines[pattern]


def _udf(make, spark_type: T.DataType, arrow_type: pa.DataType):
    @F.arrow_udf(spark_type)
    def apply(texts: pa.Array, patterns: pa.Array) -> pa.Array:
        made = [pa.array([None if t is None or p is None else make(_engine(p))(t) for t, p in zip(texts.slice(*x).to_pylist(), patterns.slice(*x).to_pylist())], arrow_type) for x in _slices(texts)]
        return pa.concat_arrays(made) if made else pa.array([], arrow_type)

    return apply


def _udf_lists(captures: bool, spark_type: T.DataType):
    @F.arrow_udf(spark_type)
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, patterns in batches:
            for x in _slices(texts):
                some = texts.slice(*x).to_pylist()
                yield _all(some, [None if t is None or p is None else _engine(p) for t, p in zip(some, patterns.slice(*x).to_pylist())], captures)

    return apply


class FindAll:
    """SELECT * FROM find_all_rows(text, pattern): match_no, start, end, match."""

    def eval(self, text: str, pattern: str):
        if text is None or pattern is None:
            return
        byte = _Bytes(text)
        for i, (start, end, _) in enumerate(_engine(pattern).iterate(text)):
            yield i + 1, byte(start), byte(end), text[start:end]


def register(spark: SparkSession) -> list[str]:
    """Register the functions in a session; returns their names."""
    made = {
        "rx_is_match": _udf(lambda e: lambda t: e.search(t) is not None, T.BooleanType(), pa.bool_()),
        "rx_find": _udf(lambda e: _one(e, False), MATCH, _MATCH),
        "rx_find_all": _udf_lists(False, T.ArrayType(MATCH)),
        "rx_count": _udf(lambda e: lambda t: sum(1 for _ in e.iterate(t)), T.LongType(), pa.int64()),
        "rx_captures": _udf(lambda e: _one(e, True), CAPTURES, _CAPTURES),
        "rx_captures_all": _udf_lists(True, T.ArrayType(CAPTURES)),
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    spark.udtf.register("rx_find_rows", F.udtf(FindAll, returnType="match_no int, start long, end long, match string"))
    return [*made, "rx_find_rows"]


def check(pattern: str) -> str | None:
    """What is wrong with a pattern; null if it compiles."""
    try:
        Pattern(pattern)
    except PatternError as e:
        return str(e)
    return None
