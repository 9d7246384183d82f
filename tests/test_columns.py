import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import matching as M
from textloom.functions import sql as S


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("c")).first().c


def test_offsets_are_bytes(spark):
    for pattern in ("b", "b|zz", r"\Gx|b", "[b]"):
        assert tuple(one(spark, "😀b é b", M.find("t", pattern))) == (4, 5, "b")
        assert [tuple(m) for m in one(spark, "😀b é b", M.find_all("t", pattern))] == [(4, 5, "b"), (9, 10, "b")]


def test_nulls_and_no_match(spark):
    for p in ("a+", r"x?\Ka", "a"):
        assert one(spark, None, M.find("t", p)) is None
        assert one(spark, "q", M.find("t", p)) is None
        assert one(spark, None, M.find_all("t", p)) is None
        assert one(spark, "q", M.find_all("t", p)) == []
        assert one(spark, None, M.count_matches("t", p)) is None
        assert one(spark, "q", M.count_matches("t", p)) == 0
        assert one(spark, "", M.count_matches("t", p)) == 0
        assert one(spark, "q", M.captures_all("t", p)) == []
        assert one(spark, None, M.captures("t", p)) is None
        assert one(spark, "q", M.find_text("t", p)) is None
        assert one(spark, "q", M.highlight("t", p)) == "q"


def test_empty_matches(spark):
    assert [tuple(m) for m in one(spark, "xax", M.find_all("t", "a*"))] == [(0, 0, ""), (1, 2, "a"), (2, 2, ""), (3, 3, "")]
    assert one(spark, "xax", M.count_matches("t", "a*")) == 4
    assert one(spark, "foofoo", M.count_matches("t", r"foo\K")) == 1  # the search goes on one letter after an empty match


def test_unset_is_not_empty(spark):
    c = one(spark, "b", M.captures("t", "(a)?(x*)b"))
    assert c.groups[0] is None and tuple(c.groups[1]) == (0, 0, "") and tuple(c.match) == (0, 1, "b")


def test_names(spark):
    p = r"(?<year>\d{4})-(?<month>\d\d)"
    c = M.captures("t", p)
    df = spark.createDataFrame([("on 2024-05",), ("no",)], "t string").select(c.alias("c"))
    rows = df.select(M.group(F.col("c"), p, "year")["text"].alias("y"), M.group(F.col("c"), p, 2)["start"].alias("m"), M.group(F.col("c"), p, 0)["text"].alias("w")).collect()
    assert [tuple(r) for r in rows] == [("2024", 8, "2024-05"), (None, None, None)]
    assert one(spark, "x=1", M.extract("t", r"(?<k>\w)=(?<v>\d)", "v")) == "1"


def test_replace_split_highlight(spark):
    assert one(spark, "a1b22", M.replace_all("t", r"\d+", "$1\\")) == "a$1\\b$1\\"
    assert one(spark, "a, b;c", M.split("t", r"[,;]\s*")) == ["a", "b", "c"]
    assert one(spark, "a1", M.highlight("t", r"\d*", "<", ">")) == "a<1>"


def test_sql_functions(spark):
    S.register(spark)
    spark.createDataFrame([(1, "a1b22"), (2, None)], "id int, t string").createOrReplaceTempView("rx_rows")
    assert [tuple(r) for r in spark.sql(r"SELECT rx_is_match(t, r'\d'), rx_count(t, r'\d'), rx_find(t, r'\d+').text FROM rx_rows ORDER BY id").collect()] == [(True, 3, "1"), (None, None, None)]
    assert [tuple(r) for r in spark.sql(r"SELECT id, r.match_no, r.start, r.match FROM rx_rows, LATERAL rx_find_rows(t, r'\d+') r ORDER BY 2").collect()] == [(1, 1, 1, "1"), (1, 2, 3, "22")]
    assert S.check("(") and S.check("a") is None


def test_empty_matches_have_a_text(spark):
    df = spark.createDataFrame([("bbb",), ("",), (None,), ("xa",)], "t string")
    assert [r[0] for r in df.select(M.find_text("t", "a*")).collect()] == ["", "", None, ""]
    assert [r[0] for r in df.select(M.extract("t", "(?:a|$)", 0)).collect()] == ["", "", None, "a"]
    assert [r[0] for r in df.select(M.find_text("t", "a+")).collect()] == [None, None, None, "a"]


def test_group_counts(spark):
    df = spark.createDataFrame([("ab",), ("x",)], "t string")
    for pattern, n in (("a", 0), ("(a)(b)?", 2)):
        c = M.captures("t", pattern)
        assert M.group_count(pattern) == n
        assert [tuple(r) for r in df.select(M.captures_len(c), M.captures_empty(c)).collect()] == [(n, n == 0), (None, None)]


def test_replacing_and_splitting_by_any_pattern(spark):
    df = spark.createDataFrame([("aab-cc$d",), ("",), (None,), ("xyz",)], "t string")
    both = lambda pattern, force: [tuple(r) for r in df.select(M.replace_all("t", pattern, "<$1>", force_tier=force), M.split("t", pattern, force_tier=force)).collect()]
    for pattern in ("[a-c]", "b|c+"):
        assert both(pattern, "L1") == both(pattern, "L2")
    assert both(r"(.)\1", None)[0] == ("<$1>b-<$1>$d", ["", "b-", "$d"])


def test_lists_leave_piece_by_piece(monkeypatch):
    """A worker holds the matches of a piece of a batch, not those of all its texts as Python objects."""
    monkeypatch.setattr(M, "SLICE_BYTES", 1 << 16)
    texts = pa.array(["<a> <é> <bc x>" * 600] * 80)
    engine = M.compile_pattern("<([a-z]+)( x)?>").engine
    tracemalloc.start()
    rows = [len(x) for x in M._pieces(iter([texts]), lambda some: M._all(some, [engine] * len(some), True))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) == 80 and len(rows) > 4
    assert peak < 4 * texts.nbytes, peak  # as one list of dicts they take 100 times as much


def test_lists_over_several_pieces(spark):
    long = "é<a> <bc x>" * 60_000
    df = spark.createDataFrame([(0, long), (1, None), (2, ""), (3, "é<q>"), (4, long), (5, "none")], "k int, t string").coalesce(1)
    got = {r.k: r.c for r in df.select("k", M.captures_all("t", r"<([a-z]+)( x)?>").alias("c")).collect()}
    assert got[1] is None and got[2] == [] and got[5] == [] and got[0] == got[4] and len(got[0]) == 120_000
    one = lambda m: (tuple(m.match), [g and tuple(g) for g in m.groups])
    assert one(got[3][0]) == ((2, 5, "<q>"), [(3, 4, "q"), None])
    assert [one(m) for m in got[0][2:4]] == [((14, 17, "<a>"), [(15, 16, "a"), None]), ((18, 24, "<bc x>"), [(19, 21, "bc"), (21, 23, " x")])]
    # several functions of one and of many results in one row
    row = df.where("k = 3").select(M.find_all("t", "[a-z]").alias("a"), M.find("t", "q").alias("b"), M.split("t", "(?=<)q?<").alias("c"), M.captures_all("t", "(z)|q").alias("d")).first()
    assert [tuple(x) for x in row.a] == [(3, 4, "q")] == [tuple(row.b)] and row.c == ["é", "q>"] and one(row.d[0]) == ((3, 4, "q"), [None])


def test_sql_functions_skip_rows_without_text(spark):
    S.register(spark)
    spark.createDataFrame([(1, "ab", "(a)|b"), (2, None, "("), (3, "x", None), (4, "", "y")], "id int, t string, p string").createOrReplaceTempView("rx_nulls")
    got = spark.sql("SELECT rx_captures_all(t, p) c, rx_find_all(t, p) f FROM rx_nulls ORDER BY id").collect()
    assert [[(m.match.text, [g and g.text for g in m.groups]) for m in r.c] if r.c is not None else None for r in got] == [[("a", ["a"]), ("b", [None])], None, None, []]
    assert [[tuple(m) for m in r.f] if r.f is not None else None for r in got] == [[(0, 1, "a"), (1, 2, "b")], None, None, []]
