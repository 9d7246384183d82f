import contextlib
import io

import pytest
from pyspark.sql import functions as F

from textloom.functions.matching import is_match
from textloom.pattern.parse import PatternError
from textloom.plans.planner import Pattern, compile_pattern

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "pattern, tier, how",
    [("error", "L0", "re"), (r"\Aab\z", "L0", "re"), ("a|bc", "L0", "re"), ("[a-z]+ing", "L1", "re"), (r"(?<=\. )[A-Z]", "L1", "re"), (r"(a)\1", "L1", "re"), (r"a\Kb", "L2", "matcher"), (r"\Ga", "L2", "matcher"), ("(?~abc)", "L2", "re"), (r"(a)?(?(1)b|c)", "L2", "matcher"), (r"(\(\g<1>\))", "L2", "matcher"), ("(?<=a+)b", "L2", "matcher"), (r"(?i)(a)\1", "L2", "matcher"), (r"x(?:ab|y)*z", "L2", "re"), (r"(?:ab|y)*z", "L0", "re"), ("a?" * 20 + "eea", "L0", "matcher"), ("[a-z]*[0-9]{2,}", "L1", "re"), (r"(?:ab|y)*+z", "L1", "re"), (r"(?<x>a)\g<x>", "L1", "matcher")],
)
def test_tiers(pattern, tier, how):
    p = Pattern(pattern)
    assert (p.tier, p.how) == (tier, how)


def test_forced_tiers():
    assert Pattern("abc", force_tier="L1").tier == "L1"
    with pytest.raises(PatternError):
        Pattern("a+", force_tier="L0")
    with pytest.raises(PatternError):
        Pattern(r"a\Kb", force_tier="L1")


def test_needed_literals():
    assert Pattern(r"\d+ error: (.*)").needed == [" error: "]
    assert Pattern(r"(?:foo|quux)\d").needed == ["foo", "quux"]
    assert Pattern(r"a?b*").needed is None


def test_pushdown(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert "StringContains(text,Licensed)" in plan(df.where(is_match("text", "Licensed")).select("doc_id"))
    assert "StringStartsWith(text,The)" in plan(df.where(is_match("text", r"\AThe")).select("doc_id"))
    # a needed literal goes ahead of a JVM pattern and of an Arrow function
    assert "StringContains(text, under)" in plan(df.where(is_match("text", r"[A-Z]\w+ under")).select("doc_id"))
    p = plan(df.where(is_match("text", r"\w+\Kunder")).select("doc_id"))
    assert "StringContains(text,under)" in p and "ArrowEvalPython" in p
    # only the columns that are needed are read
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_no_python_in_jvm_tiers(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    p = plan(df.where(is_match("text", r"\p{Lu}\w+ing\b")))
    assert "Python" not in p and "Arrow" not in p and "Exchange" not in p


def test_cache():
    assert compile_pattern("a+b") is compile_pattern("a+b")
    assert compile_pattern("a+b") is not compile_pattern("a+b", ignore_case=True)


def test_null_column(spark):
    df = spark.createDataFrame([(None,), ("a",)], "t string")
    for pattern in ("a", "[a]", r"x?\Ka"):
        assert [r[0] for r in df.select(is_match(F.col("t"), pattern)).collect()] == [None, True]
