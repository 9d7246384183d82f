"""Matching operations as Columns. Null in, null out; offsets are UTF-8 bytes, ends exclusive."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.plans.planner import Engine, Pattern, compile_pattern

MATCH = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])
CAPTURES = T.StructType([T.StructField("match", MATCH), T.StructField("groups", T.ArrayType(MATCH))])
_MATCH = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
_CAPTURES = pa.struct([("match", _MATCH), ("groups", pa.list_(_MATCH))])


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


class _Bytes:
    """Byte offsets of code point positions of a text, each found from the one asked for before."""

    def __init__(self, text: str):
        self.text, self.plain, self.at, self.byte = text, text.isascii(), 0, 0

    def __call__(self, pos: int) -> int:
        if self.plain:
            return pos
        if pos < self.at:
            self.byte -= len(self.text[pos : self.at].encode())
        else:
            self.byte += len(self.text[self.at : pos].encode())
        self.at = pos
        return self.byte


def _span(text: str, byte: _Bytes, span) -> dict | None:
    return None if span is None else {"start": byte(span[0]), "end": byte(span[1]), "text": text[span[0] : span[1]]}


def _one(engine: Engine, captures: bool):
    def run(text: str):
        got = engine.search(text)
        if got is None:
            return None
        byte = _Bytes(text)
        match = _span(text, byte, got[:2])
        return {"match": match, "groups": [_span(text, byte, g) for g in got[2]]} if captures else match

    return run


class _Spans:
    """Spans of texts, None for unset ones, as an Arrow array of MATCH; no Python object stays for any of them."""

    def __init__(self):
        self.start, self.end, self.unset, self.cuts, self.data = array("q"), array("q"), bytearray(), array("i", [0]), bytearray()

    def add(self, text: str, byte: _Bytes, span) -> None:
        self.unset.append(span is None)
        self.start.append(0 if span is None else byte(span[0]))
        self.end.append(0 if span is None else byte(span[1]))
        self.data += b"" if span is None else text[span[0] : span[1]].encode()
        self.cuts.append(len(self.data))

    def made(self) -> pa.Array:
        n = len(self.start)
        numbers = (pa.Array.from_buffers(pa.int64(), n, [None, pa.py_buffer(x)]) for x in (self.start, self.end))
        texts = pa.StringArray.from_buffers(n, pa.py_buffer(self.cuts), pa.py_buffer(self.data))
        return pa.StructArray.from_arrays([*numbers, texts], fields=list(_MATCH), mask=pa.array(np.frombuffer(self.unset, np.bool_)))


def _lists(cuts: list[int], nulls: list[bool], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values, mask=pa.array(nulls, pa.bool_()))


def _all(texts: list[str | None], engines: list[Engine | None], captures: bool) -> pa.Array:
    """The matches of each text with its engine; null without a text or an engine."""
    matches, groups, cuts, group_cuts = _Spans(), _Spans(), [0], [0]
    nulls = [t is None or e is None for t, e in zip(texts, engines)]
    for text, engine, null in zip(texts, engines, nulls):
        if not null:
            byte = _Bytes(text)
            for start, end, spans in engine.iterate(text):
                matches.add(text, byte, (start, end))
                if captures:
                    for g in spans:
                        groups.add(text, byte, g)
                    group_cuts.append(len(groups.start))
        cuts.append(len(matches.start))
    made = matches.made()
    if captures:
        made = pa.StructArray.from_arrays([made, pa.ListArray.from_arrays(pa.array(group_cuts, pa.int32()), groups.made())], fields=list(_CAPTURES))
    return _lists(cuts, nulls, made)


#: Bytes of text whose results are held as Python objects at once.
SLICE_BYTES = 1 << 20


def _slices(texts: pa.Array):
    """Where to cut an array of texts into pieces of SLICE_BYTES at most, or of one text: (first, how many)."""
    first = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > first and held + n > SLICE_BYTES:
            yield first, i - first
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts) - first


def _arrow(column: Column, run, spark_type: T.DataType, arrow_type: pa.DataType) -> Column:
    """One result for each text."""

    @F.arrow_udf(spark_type)
    def apply(texts: pa.Array) -> pa.Array:
        made = [pa.array([None if t is None else run(t) for t in texts.slice(*x).to_pylist()], arrow_type) for x in _slices(texts)]
        return pa.concat_arrays(made) if made else pa.array([], arrow_type)

    return apply(column)


def _pieces(batches: Iterator[pa.Array], run) -> Iterator[pa.Array]:
    for texts in batches:
        for x in _slices(texts):
            yield run(texts.slice(*x).to_pylist())


def _arrow_lists(column: Column, run, spark_type: T.DataType) -> Column:
    """A list of results for each text, by a function from texts to an Arrow array. As lists may be many times larger
    than texts, they leave piece by piece."""

    @F.arrow_udf(spark_type)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _pieces(batches, run)

    return apply(column)


def _guard(column: Column, p: Pattern) -> Column:
    """Null where a literal that every match needs is missing: the Arrow function skips those at once."""
    if not p.needed:
        return column
    return F.when(_any_literal(column, "contains", p.needed), column)


def _any_literal(column: Column, test: str, texts: list[str]) -> Column:
    make = {"contains": lambda t: column.contains(t), "startswith": lambda t: column.startswith(t), "endswith": lambda t: column.endswith(t), "equals": lambda t: column == t}[test]
    out = make(texts[0])
    for t in texts[1:]:
        out = out | make(t)
    return out


def is_match(column: Column | str, pattern: str | Pattern, **options) -> Column:
    """Whether the pattern matches anywhere."""
    c, p = _column(column), compile_pattern(pattern, **options)
    if p.literal_test:
        return _any_literal(c, *p.literal_test)
    if p.jvm_test is not None:
        test = c.rlike(p.jvm_test)
        # what a match needs goes ahead: it reaches the Parquet reader, a regular expression doesn't
        return _any_literal(c, "contains", p.needed) & test if p.needed and min(map(len, p.needed)) > 1 else test
    engine = p.engine
    test = _arrow(_guard(c, p), lambda t: engine.search(t) is not None, T.BooleanType(), pa.bool_())
    if not p.needed:
        return test
    return _any_literal(c, "contains", p.needed) & F.coalesce(test, F.when(c.isNotNull(), F.lit(False)))


def find(column: Column | str, pattern: str | Pattern, **options) -> Column:
    """The leftmost match as struct<start, end, text>; null if there is none."""
    c, p = _column(column), compile_pattern(pattern, **options)
    return _arrow(_guard(c, p), _one(p.engine, False), MATCH, _MATCH)


def find_from(column: Column | str, pattern: str | Pattern, pos: int, **options) -> Column:
    """The leftmost match that starts at code point pos or later; anchors and lookbehind see the whole text."""
    c, p = _column(column), compile_pattern(pattern, **options)
    engine = p.engine

    def run(text: str):
        got = engine.search(text, pos) if pos <= len(text) else None
        return None if got is None else _span(text, _Bytes(text), got[:2])

    return _arrow(_guard(c, p), run, MATCH, _MATCH)


def find_text(column: Column | str, pattern: str | Pattern, **options) -> Column:
    """The text of the leftmost match; null if there is none."""
    c, p = _column(column), compile_pattern(pattern, **options)
    if p.jvm is not None:
        return F.when(is_match(c, p), F.regexp_extract(c, p.jvm, 0))
    return find(c, p)["text"]


def find_all(column: Column | str, pattern: str | Pattern, **options) -> Column:
    """All matches in order as array<struct<start, end, text>>."""
    c, p = _column(column), compile_pattern(pattern, **options)
    engine = p.engine
    made = _arrow_lists(_guard(c, p), lambda texts: _all(texts, [engine] * len(texts), False), T.ArrayType(MATCH))
    return made if not p.needed else F.when(c.isNotNull(), F.coalesce(made, F.array().cast(T.ArrayType(MATCH))))


def find_all_text(column: Column | str, pattern: str | Pattern, **options) -> Column:
    """The texts of all matches, in order."""
    c, p = _column(column), compile_pattern(pattern, **options)
    if p.jvm is not None:
        return F.regexp_extract_all(c, F.lit(p.jvm), F.lit(0))
    return F.transform(find_all(c, p), lambda m: m["text"])


def count_matches(column: Column | str, pattern: str | Pattern, **options) -> Column:
    """How many matches there are."""
    c, p = _column(column), compile_pattern(pattern, **options)
    if p.jvm is not None:
        return F.regexp_count(c, F.lit(p.jvm)).cast("long")
    engine = p.engine
    made = _arrow(_guard(c, p), lambda t: sum(1 for _ in engine.iterate(t)), T.LongType(), pa.int64())
    return made if not p.needed else F.when(c.isNotNull(), F.coalesce(made, F.lit(0).cast("long")))


def captures(column: Column | str, pattern: str | Pattern, **options) -> Column:
    """The leftmost match and its groups as struct<match, groups>; a group that took no part is null."""
    c, p = _column(column), compile_pattern(pattern, **options)
    return _arrow(_guard(c, p), _one(p.engine, True), CAPTURES, _CAPTURES)


def captures_all(column: Column | str, pattern: str | Pattern, **options) -> Column:
    """All matches and their groups, as an array of what captures() gives."""
    c, p = _column(column), compile_pattern(pattern, **options)
    engine = p.engine
    made = _arrow_lists(_guard(c, p), lambda texts: _all(texts, [engine] * len(texts), True), T.ArrayType(CAPTURES))
    return made if not p.needed else F.when(c.isNotNull(), F.coalesce(made, F.array().cast(T.ArrayType(CAPTURES))))


def group(captured: Column, pattern: str | Pattern, ref: int | str, **options) -> Column:
    """A group of captures() by number or name: 0 is the whole match, of equal names the last counts. An
    unknown name or number is an error of the plan."""
    i = compile_pattern(pattern, **options).group_index(ref)
    return captured["match"] if i == 0 else F.try_element_at(captured["groups"], F.lit(i))


def extract(column: Column | str, pattern: str | Pattern, ref: int | str = 0, **options) -> Column:
    """The text of a group of the leftmost match; null if there is no match or the group took no part."""
    c, p = _column(column), compile_pattern(pattern, **options)
    i = p.group_index(ref)
    if i == 0:
        return find_text(c, p)
    return group(captures(c, p), p, i)["text"]


def group_count(pattern: str | Pattern, **options) -> int:
    """How many groups a pattern has, the whole match not counted; known when the plan is made."""
    return compile_pattern(pattern, **options).groups


def captures_len(captured: Column) -> Column:
    """How many groups captures() has found or left unset, the whole match not counted."""
    return F.when(captured.isNotNull(), F.size(captured["groups"]))


def captures_empty(captured: Column) -> Column:
    """Whether captures() has no groups."""
    return captures_len(captured) == 0


def replace_all(column: Column | str, pattern: str | Pattern, replacement: str, **options) -> Column:
    """A convenience: all matches replaced by a text."""
    c, p = _column(column), compile_pattern(pattern, **options)
    if p.jvm is not None:
        return F.regexp_replace(c, F.lit(p.jvm), F.lit(replacement.replace("\\", "\\\\").replace("$", "\\$")))
    engine = p.engine

    def run(text: str) -> str:
        out, at = [], 0
        for start, end, _ in engine.iterate(text):
            if start >= at:
                out += [text[at:start], replacement]
                at = end
        return "".join(out) + text[at:]

    return F.coalesce(_arrow(_guard(c, p), run, T.StringType(), pa.string()), c)


def split(column: Column | str, pattern: str | Pattern, **options) -> Column:
    """A convenience: the texts between matches. An empty match at the start or the end splits nothing."""
    c, p = _column(column), compile_pattern(pattern, **options)
    if p.jvm is not None:
        return F.split(c, p.jvm)
    engine = p.engine

    def run(text: str) -> list[str]:
        out, at = [], 0
        for start, end, _ in engine.iterate(text):
            if start >= at and not (start == end and start in (0, len(text))):
                out.append(text[at:start])
                at = end
        return [*out, text[at:]]

    made = _arrow_lists(_guard(c, p), lambda texts: pa.array([None if t is None else run(t) for t in texts], pa.list_(pa.string())), T.ArrayType(T.StringType()))
    return F.coalesce(made, F.when(c.isNotNull(), F.array(c)))


def highlight(column: Column | str, pattern: str | Pattern, before: str = "\x1b[1;31m", after: str = "\x1b[0m", **options) -> Column:
    """The text with each match between two marks; empty matches are not marked."""
    c, p = _column(column), compile_pattern(pattern, **options)
    engine = p.engine

    def run(text: str) -> str:
        out, at = [], 0
        for start, end, _ in engine.iterate(text):
            if end > start >= at:
                out += [text[at:start], before, text[start:end], after]
                at = end
        return "".join(out) + text[at:]

    made = _arrow(_guard(c, p), run, T.StringType(), pa.string())
    return F.coalesce(made, c)
