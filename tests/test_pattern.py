import random

import pytest

from tests.cases import ALL, ERRORS, GROUPS
from textloom.functions.matching import find_all_text, is_match
from textloom.pattern.parse import PatternError
from textloom.plans.planner import Pattern


def texts(p: Pattern, subject: str) -> list[str]:
    return [subject[a:b] for a, b, _ in p.engine.iterate(subject)]


@pytest.mark.parametrize("pattern, subject, expected", ALL)
def test_matches(pattern, subject, expected):
    for tier in (None, "L2"):
        p = Pattern(pattern, force_tier=tier)
        assert texts(p, subject) == expected, (tier, p.how)


@pytest.mark.parametrize("pattern, subject, expected", GROUPS)
def test_groups(pattern, subject, expected):
    for tier in (None, "L2"):
        _, _, spans = Pattern(pattern, force_tier=tier).engine.search(subject)
        assert [s and subject[slice(*s)] if s is not None else None for s in spans] == expected


@pytest.mark.parametrize("pattern", ERRORS)
def test_errors(pattern):
    with pytest.raises(PatternError):
        Pattern(pattern)


def test_jvm_agrees(spark):
    """All cases that the JVM may run give the same texts there, in one job."""
    from pyspark.sql import functions as F
    from textloom.pattern import emit

    emit.jvm_sets()
    made = [(i, p, s, e) for i, (pat, s, e) in enumerate(ALL) if (p := Pattern(pat)).jvm is not None]
    assert len(made) > 55
    row = spark.createDataFrame([(1,)], "one int")
    got = row.select(*(find_all_text(F.lit(s), p).alias(f"c{i}") for i, p, s, _ in made)).first()
    for i, p, s, e in made:
        assert got[f"c{i}"] == e, (p.text, s)
    got = row.select(*(is_match(F.lit(s), Pattern(pat)).alias(f"c{i}") for i, (pat, s, _) in enumerate(ALL))).first()
    for i, (pat, _, e) in enumerate(ALL):
        assert got[i] == bool(e), pat


def _random_pattern(r: random.Random, depth: int = 0) -> str:
    if depth > 3 or r.random() < 0.35:
        return r.choice(["a", "b", "c", ".", "[ab]", "[^a]", r"\w", "ab", "é", r"\b", "^", "$", "(?i:A)"])
    kind = r.randrange(7)
    sub = lambda: _random_pattern(r, depth + 1)
    if kind < 2:
        return sub() + sub()
    if kind == 2:
        return f"(?:{sub()}|{sub()})"
    if kind == 3:
        return f"(?:{sub()}){r.choice(['*', '+', '?', '{1,2}', '*?', '+?', '*+', '{2}'])}"
    if kind == 4:
        return f"({sub()})"
    if kind == 5:
        return f"(?{r.choice(['=', '!', '>'])}{sub()})"
    return f"(?<{r.choice('=!')}{r.choice(['a', 'b', 'ab', '[ab]'])})"


def test_random_engines_agree(spark):
    """re, the matcher and the JVM on seeded random patterns."""
    from pyspark.sql import functions as F

    r = random.Random(7)
    jvm = []
    for _ in range(400):
        pattern = _random_pattern(r)
        subject = "".join(r.choice("abcé\n A") for _ in range(r.randrange(12)))
        p, m = Pattern(pattern), Pattern(pattern, force_tier="L2")
        expected = list(m.engine.iterate(subject))
        if p.how == "re":
            got = list(p.engine.iterate(subject))
            assert [g[:2] for g in got] == [g[:2] for g in expected], (pattern, subject)
        if p.jvm is not None:
            jvm.append((p, subject, [subject[a:b] for a, b, _ in expected]))
    row = spark.createDataFrame([(1,)], "one int")
    for at in range(0, len(jvm), 50):
        some = jvm[at : at + 50]
        got = row.select(*(find_all_text(F.lit(s), p).alias(f"c{i}") for i, (p, s, _) in enumerate(some))).first()
        for i, (p, s, e) in enumerate(some):
            assert got[i] == e, (p.text, p.jvm, s)


def test_shortened_tests_agree():
    """What for_test leaves of a pattern matches somewhere exactly where the pattern does."""
    from dataclasses import replace

    from textloom.pattern import analyze as A
    from textloom.pattern.matcher import Matcher
    from textloom.pattern.parse import parse

    r, shorter = random.Random(11), 0
    loop = lambda: r.choice(["a?", "b*", "(?:ab)*", "a+", "(b)+", "a{2,3}", "[ab]{0,2}?", "a++", "b*+", "(?:a|b)+?", "a?+"])
    for _ in range(400):
        pattern = "".join(loop() for _ in range(r.randrange(3))) + r.choice(["", "ab", "^a", "b$", r"\bab", "(?<=a)b", "(?!a)b", "(?>a|ab)b", r"\Gab"]) + "".join(loop() for _ in range(r.randrange(3)))
        parsed = parse(pattern, False, False, False, False)
        short = A.for_test(parsed.root)
        shorter += short != parsed.root
        whole, part = Matcher(parsed), Matcher(replace(parsed, root=short))
        for _ in range(12):
            text = "".join(r.choice("aab \n") for _ in range(r.randrange(9)))
            assert (whole.search(text, 0) is None) == (part.search(text, 0) is None), (pattern, text)
    assert shorter > 200


def test_pathological_is_bounded():
    for n in (20, 200):
        p = Pattern("a?" * n + "a" * n)
        assert p.jvm is None and p.how == "matcher"
        assert p.engine.search("a" * n)[:2] == (0, n)
    p = Pattern(r"(?:a|b|ab)*\z", force_tier="L2")
    assert p.engine.search("ab" * 3000 + "c") == (6001, 6001, []) or p.engine.search("ab" * 3000 + "c")[0] == 6001
    assert Pattern(r"(x+x+)+y", force_tier="L2").engine.search("x" * 60) is None


def test_long_subjects(spark):
    from pyspark.sql import functions as F

    long = "ab" * 50_000
    p = Pattern(r"\A(?:ab|y)*z")
    assert p.tier == "L2"  # the JVM would overflow its stack
    row = spark.createDataFrame([(long,)], "t string")
    assert row.select(is_match("t", p).alias("m"), is_match("t", r"\A[aby]*\z").alias("n")).first() == (False, True)
    assert row.select(F.size(find_all_text("t", "(?:ab)+"))).first()[0] == 1


def test_duplicate_names_and_numbers():
    p = Pattern(r"(?<a>x)(y)(?<a>z)")
    assert p.group_index("a") == 3 and len(p) == 3
    with pytest.raises(PatternError):
        p.group_index("b")
    with pytest.raises(PatternError):
        p.group_index(4)


def test_call_depth_and_left_recursion_fail():
    assert Pattern(r"(?<a>\g<a>b|c)").engine.search("cb") is not None
    assert Pattern(r"(?<a>a\g<a>?b)").engine.search("a" * 150 + "b" * 150)[:2] == (0, 300)


def test_options():
    assert Pattern("a|B", ignore_case=True).engine.search("b") is not None
    assert Pattern("a.b", dot_all=True).engine.search("a\nb") is not None
    assert Pattern(" a b ", extended=True).engine.search("ab") is not None
    assert Pattern(r"\w", ascii_only=True).engine.search("é") is None


@pytest.mark.parametrize(
    "pattern, subject, expected",
    [
        (r"\G[a-z]", "abc de", ["a", "b", "c"]),
        (r"(?=\Ga)\w+", "ab ab", ["ab"]),
        (r"(?:\Ga|\Gb){1,2}?", "abxa", ["a", "b"]),
        (r"\Gx|b", "xab", ["x", "b"]),
        (r"(?!\Ga)a", "aaa", ["a"]),
        (r"(?:\Ga)?b", "bxb", ["b", "b"]),
        (r"\G", "ab", ["", "", ""]),
        (r"\A(a)?(?(1)b|c)", "abc", ["ab"]),
        (r"\A(a)?(?(1)b|c)|d", "xcd", ["d"]),
    ],
)
def test_anchored_starts(pattern, subject, expected):
    assert texts(Pattern(pattern, force_tier="L2"), subject) == expected


@pytest.mark.parametrize("pattern", [r"\G[A-Za-z]", r"\A(a)?(?(1)b|c)"])
def test_anchored_starts_are_tried_once(pattern, monkeypatch):
    """What must begin where the search began, or at the start, is not tried at each letter of a text."""
    from textloom.pattern.matcher import _State

    runs, run = [], _State.run
    monkeypatch.setattr(_State, "run", lambda self, entry, *a: runs.append(entry) or run(self, entry, *a))
    assert texts(Pattern(pattern), "ab " + "c" * 1000) in (["a", "b"], ["ab"])
    assert len(runs) <= 4


FOLDED = [r"(?i)\b([a-z]+) \1\b", r"(?i)([a-z])\1", r"(?i)(ss|s|k)x?\1", r"(?i)(\w+)-\1", r"(?i)(?<a>[kß]+)(s*)\k<a>", r"(?i)([st]+)(?-i:k)\1", r"(?i)(a*)\1k", r"(?i:(ß|k)(?:x|\1)\1)", r"(?i)(é+)\1", r"(?i)(s)((?i)\1)", r"(?i)((?-i:S)+)\1", r"(?i)(?=(s+))\1", r"([a-z]+)(?i)\1", r"(?i)(ﬁ|i)f?\1"]


@pytest.mark.parametrize("pattern", FOLDED)
def test_looking_ahead_for_folded_references_loses_nothing(pattern):
    r = random.Random(pattern)
    fast, plain = Pattern(pattern).engine, Pattern(pattern).engine
    plain.matcher.ahead = None
    found = 0
    for _ in range(2500):
        subject = "".join(r.choice("sSſßẞkK\u212aſtiIfﬁﬃéÉaAxX -- -" if r.random() < 0.7 else "sSkKaAx -") for _ in range(r.randrange(14)))
        expected = list(plain.iterate(subject))
        assert list(fast.iterate(subject)) == expected, subject
        found += bool(expected)
    assert found > 3


def test_folded_references_are_looked_for_before_they_are_tried(monkeypatch):
    from textloom.pattern.matcher import _State

    runs, run = [], _State.run
    monkeypatch.setattr(_State, "run", lambda self, entry, *a: runs.append(entry) or run(self, entry, *a))
    text = "one two three für heiß " * 200 + "Der der SS ß. " + "ßa " * 200
    assert texts(Pattern(r"(?i)\b([a-z]+) \1\b"), text) == ["Der der", "SS ß"]
    assert len(runs) < 500
