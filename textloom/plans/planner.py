"""Compile a pattern once, on the driver, and choose how to run it.

L0  literal predicates (contains, startswith, endswith, =): pushed down to Parquet
L1  a canonical java.util.regex pattern inside whole-stage codegen
L2  an Arrow function: Python's re where it gives the same results, else our own matcher

Which tier serves an operation depends on what it returns: a boolean, a count or texts come from L0 or
L1 if the pattern allows; offsets and captures, where unset and empty groups differ, come from L2.
"""

from __future__ import annotations

import re
from functools import lru_cache

from textloom.pattern import analyze as A
from textloom.pattern.emit import Unsupported, emit
from textloom.pattern.matcher import Matcher
from textloom.pattern.parse import Anchor, Cat, Parsed, PatternError, parse

TIERS = ("L0", "L1", "L2")


class Engine:
    """Runs a pattern over Python strings, in tasks. Picklable; compiled once for each worker."""

    def __init__(self, source: str | None, matcher: Matcher | None, groups: int):
        self.source, self.matcher, self.groups = source, matcher, groups
        self._re = None

    def __getstate__(self):
        return self.__dict__ | {"_re": None}

    def search(self, text: str, pos: int = 0):
        """(start, end, spans of groups 1..n; None where unset) of the leftmost match from pos on."""
        if self.matcher is not None:
            got = self.matcher.search(text, pos)
            if got is None:
                return None
            start, end, slots = got
            return start, end, [None if slots[2 * i] is None or slots[2 * i + 1] is None else (slots[2 * i], slots[2 * i + 1]) for i in range(1, self.groups + 1)]
        if self._re is None:
            self._re = re.compile(self.source)
        m = self._re.search(text, pos)
        if m is None:
            return None
        return m.start(), m.end(), [None if m.start(i) < 0 else m.span(i) for i in range(1, self.groups + 1)]

    def iterate(self, text: str):
        """All matches in order, none overlapping. After an empty match the search goes on one code point later."""
        pos, n = 0, len(text)
        while pos <= n:
            got = self.search(text, pos)
            if got is None:
                return
            yield got
            pos = got[1] if got[1] > got[0] else got[1] + 1


class Pattern:
    """A compiled pattern: its groups, its names and its tiers."""

    def __init__(self, text: str, ignore_case: bool = False, dot_all: bool = False, extended: bool = False, ascii_only: bool = False, force_tier: str | None = None):
        if force_tier not in (None, *TIERS):
            raise PatternError(f"no tier {force_tier!r}")
        self.text = text
        self.parsed: Parsed = parse(text, ignore_case, dot_all, extended, ascii_only)
        self.groups, self.names = self.parsed.groups, self.parsed.names
        root = self.parsed.root
        test = A.for_test(root) if force_tier is None else root
        self.literal_test = _literal_test(test) if force_tier in (None, "L0") else None
        self.jvm, self.why_not_jvm = None, None
        if force_tier in (None, "L1"):
            try:
                self.jvm = emit(root, "jvm", False)
            except Unsupported as e:
                self.why_not_jvm = str(e)
        # tests may run a shorter pattern than the other operations
        self.jvm_test = self.jvm
        if test != root:
            try:
                self.jvm_test = emit(test, "jvm", False)
            except Unsupported:
                pass
        source = None
        if force_tier is None:
            try:
                source = emit(root, "re", True)
                re.compile(source)
            except (Unsupported, re.error, OverflowError):
                source = None
        self.engine = Engine(source, None if source is not None else Matcher(self.parsed), self.groups)
        self.needed = A.needed(root)
        self.always = A.always_set(root)
        if force_tier == "L0" and self.literal_test is None or force_tier == "L1" and self.jvm is None:
            raise PatternError(f"{text!r} can't run in tier {force_tier}: {self.why_not_jvm or 'it is no literal'}")

    @property
    def tier(self) -> str:
        """The tier of a boolean test."""
        return "L0" if self.literal_test else "L1" if self.jvm_test is not None else "L2"

    @property
    def how(self) -> str:
        """The engine of offsets and captures: 're' or 'matcher'."""
        return "re" if self.engine.source is not None else "matcher"

    def group_index(self, ref: int | str) -> int:
        if isinstance(ref, str):
            if ref not in self.names:
                raise PatternError(f"no group is named {ref!r} in {self.text!r}")
            return self.names[ref]
        if not 0 <= ref <= self.groups:
            raise PatternError(f"there is no group {ref} in {self.text!r}")
        return ref

    def __len__(self) -> int:
        return self.groups


def _literal_test(root) -> tuple[str, list[str]] | None:
    """('contains' | 'startswith' | 'endswith' | 'equals', literals) if that is all that a pattern asks."""
    items = list(root.items) if isinstance(root, Cat) else [root]
    start = bool(items) and items[0] == Anchor("A")
    end = len(items) > start and items[-1] == Anchor("z")
    middle = items[int(start) : len(items) - int(end)]
    found = A.literals(Cat(tuple(middle)))
    if not found or not (all(found) or (start and end)):
        return None
    return ("equals" if start and end else "startswith" if start else "endswith" if end else "contains"), found


@lru_cache(1024)
def _compiled(text: str, options: tuple) -> Pattern:
    return Pattern(text, **dict(options))


def compile_pattern(pattern: str | Pattern, **options) -> Pattern:
    """A compiled pattern, from a cache. Options: ignore_case, dot_all, extended, ascii_only, force_tier."""
    if isinstance(pattern, Pattern):
        return pattern
    from textloom.pattern import emit as e

    e.jvm_sets()  # before the cache: large classes are written with what the running JVM knows
    return _compiled(pattern, tuple(sorted(options.items())))
