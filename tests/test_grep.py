import pytest

from textloom.operators.grep import Grep, count_lines, list_keys, only_matching, select_lines
from textloom.sources.lines import files, invalid_files, lines_of, read_lines, stream_lines


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    (d / "a.txt").write_bytes(b"one\r\ntwo\rx\n\nfour")
    (d / "b.txt").write_bytes(b"foo one\none one\n")
    (d / "empty.txt").write_bytes(b"")
    (d / "sub").mkdir()
    (d / "sub" / "c.txt").write_bytes("ünd one\n".encode())
    (d / "sub" / "bad.txt").write_bytes(b"ok one\n\xff\xfe\n")
    return d


def name(path):
    return path.rsplit("/", 1)[-1]


def test_lines(spark, tree):
    expected = ["one", "two\rx", "", "four"]
    for numbered in (False, True):
        rows = read_lines(spark, str(tree / "a.txt"), numbered=numbered).collect()
        assert sorted(r.line for r in rows) == sorted(expected)
    assert [(r.line_no, r.line) for r in sorted(rows, key=lambda r: r.line_no)] == list(enumerate(expected, 1))
    df = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, None), (4, "x\r\n\r\n"), (5, "\n")], "id int, text string")
    got = sorted(tuple(r) for r in lines_of(df, "text", "id").collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (4, 1, "x"), (4, 2, ""), (5, 1, "")]


def test_files(spark, tree):
    assert [name(r.path) for r in files(spark, str(tree), True).collect()] == ["a.txt", "b.txt", "empty.txt", "bad.txt", "c.txt"]
    with pytest.raises(IsADirectoryError):
        files(spark, str(tree))
    assert [name(r.path) for r in invalid_files(spark, str(tree), True).collect()] == ["bad.txt"]


def test_modes(spark, tree):
    g = lambda **k: Grep(spark, "one", str(tree), recursive=True, **k)
    rows = sorted((name(r.path), r.line) for r in g().rows().collect())
    # a file that has a bad line is searched up to it, and has no row in counts and lists
    assert rows == [("a.txt", "one"), ("b.txt", "foo one"), ("b.txt", "one one"), ("bad.txt", "ok one"), ("c.txt", "ünd one")]
    assert sorted((name(r.path), r.n) for r in g(count=True).rows().collect()) == [("a.txt", 1), ("b.txt", 2), ("c.txt", 1), ("empty.txt", 0)]
    assert sorted(name(r.path) for r in g(list_files=True, count=True).rows().collect()) == ["a.txt", "b.txt", "c.txt"]
    assert sorted(name(r.path) for r in g(only=True).rows().collect()) == ["a.txt", "b.txt", "b.txt", "b.txt", "bad.txt", "c.txt"]
    assert sorted((name(r.path), r.line_no) for r in g(number=True, invert=True).rows().collect() if name(r.path) == "a.txt") == [("a.txt", 2), ("a.txt", 3), ("a.txt", 4)]
    assert sorted(r.line for r in Grep(spark, "ONE", str(tree / "b.txt"), ignore_case=True, color=True).rows().collect())[0].startswith("\x1b[1;31mone")
    assert "bad.txt" not in {name(r.path) for r in g(skip_invalid=True).rows().collect()}


def test_outcome(spark, tree):
    o = Grep(spark, "one", str(tree), recursive=True).outcome()
    assert o.status == 0 and len(o.errors) == 1
    assert Grep(spark, "nowhere", str(tree / "a.txt")).outcome().status == 1
    # bad lines are told, but only paths that can't be opened make the status 2
    o = Grep(spark, "nowhere", str(tree), recursive=True).outcome()
    assert o.status == 1 and o.n_errors == 1
    assert Grep(spark, "ok", str(tree / "sub" / "bad.txt")).outcome().status == 1
    for bad in (str(tree / "missing.txt"), str(tree)):
        o = Grep(spark, "nowhere", [str(tree / "a.txt"), bad]).outcome()
        assert o.status == 2 and o.errors[0].startswith(bad)
        assert Grep(spark, "one", [str(tree / "a.txt"), bad]).outcome().status == 0


def test_errors_that_are_not_shown_are_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("textloom.operators.grep.SHOWN_ERRORS", 2)
    for i in range(5):
        (tmp_path / f"{i}.txt").write_bytes(b"\xff\n" if i else b"fine\n")
    g = Grep(spark, "nowhere", str(tmp_path), recursive=True)
    o = g.outcome()
    assert (o.status, len(o.errors), o.n_errors) == (1, 2, 4)
    assert sorted(name(r.path) for r in g.errors().collect()) == [f"{i}.txt" for i in range(1, 5)]
    assert Grep(spark, "fine", str(tmp_path / "0.txt")).outcome().n_errors == 0


ODD = ["b c.txt", "p%20q.txt", "plus+x.txt", "ü#1.txt", "a[1].txt", "c{d}*.txt"]


def test_odd_names(spark, tmp_path):
    """Names with letters that urls or globs would change are the same in every mode."""
    for i, n in enumerate(ODD):
        (tmp_path / n).write_bytes(b"hit\nhit\nmiss\n" + (b"\xff\n" if i == 0 else b""))
    every = sorted(str(tmp_path / n) for n in ODD)
    for where, recursive in ((str(tmp_path), True), (every, False)):
        g = lambda **k: Grep(spark, "hit", where, recursive=recursive, **k)  # noqa: E731, B023
        good = [p for p in every if "b c" not in p]
        assert sorted((r.path, r.n) for r in g(count=True).rows().collect()) == [(p, 2) for p in good]
        assert sorted(r.path for r in g(list_files=True).rows().collect()) == good
        assert sorted({r.path for r in g().rows().collect()}) == every
        assert sorted({r.path for r in g(number=True).rows().collect()}) == every
        assert sorted({r.path for r in g(skip_invalid=True).rows().collect()}) == good
        assert [r.path for r in g().errors().collect()] == [str(tmp_path / "b c.txt")]


def test_directories_are_skipped_in_every_mode(spark, tree):
    for options in ({}, {"count": True}, {"list_files": True}, {"only": True}, {"number": True}, {"invert": True}):
        g = Grep(spark, "one", str(tree), **options)
        assert g.rows().collect() == [] and not g.with_path
        assert g.outcome().errors == [f"{tree}: Is a directory"]
        both = Grep(spark, "one", [str(tree), str(tree / "b.txt")], **options)
        assert {name(r.path) for r in both.rows().collect()} <= {"b.txt"} and both.with_path


def test_hidden_files(spark, tmp_path):
    for n in ("_x.txt", ".y.txt", "z.txt"):
        (tmp_path / n).write_text("one\n")
    g = Grep(spark, "one", [str(tmp_path), str(tmp_path / "_x.txt")], recursive=True, count=True)
    assert [name(r.path) for r in g.rows().collect()] == ["z.txt"]
    assert g.outcome().errors == [f"{tmp_path / '_x.txt'}: Is hidden"]


def test_names_are_shown_for_several_files(spark, tree, tmp_path):
    (tmp_path / "only.txt").write_text("one\n")
    assert not Grep(spark, "one", str(tmp_path), recursive=True).with_path
    assert Grep(spark, "one", str(tree), recursive=True).with_path
    assert Grep(spark, "one", [str(tmp_path / "only.txt"), str(tree / "missing")]).with_path


def test_a_file_ends_before_its_first_bad_line(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"one 1\none 2\none \xff\none 3\n")
    (tmp_path / "y.txt").write_bytes(b"one \xef\xbf\xbd\none\n")  # U+FFFD itself is no bad byte
    (tmp_path / "long.txt").write_bytes(b"one\n" * 5000 + b"\xff\n" + b"one\n" * 5000)
    for number in (False, True):
        rows = Grep(spark, "one", str(tmp_path), recursive=True, number=number).rows().collect()
        assert sorted(r.line for r in rows if name(r.path) == "x.txt") == ["one 1", "one 2"]
        assert len([r for r in rows if name(r.path) == "y.txt"]) == 2
        assert len([r for r in rows if name(r.path) == "long.txt"]) == 5000
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = Grep(spark, "one", str(tmp_path / "long.txt")).rows()
        assert rows.rdd.getNumPartitions() > 4 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lines_from_elsewhere(spark, tree):
    df = spark.createDataFrame([(1, "one two"), (2, "none"), (3, "x")], "line_no long, line string")
    g = lambda **k: Grep(spark, "one", source=df, **k)
    assert [tuple(r) for r in g().rows().collect()] == [("one two",), ("none",)]
    assert [tuple(r) for r in g(number=True, invert=True).rows().collect()] == [(3, "x")]
    assert [tuple(r) for r in g(only=True).rows().collect()] == [("one",), ("one",)]
    assert [tuple(r) for r in g(count=True).rows().collect()] == [(2,)]
    assert [tuple(r) for r in g(list_files=True).rows().collect()] == [("(stdin)",)]
    assert g().outcome().status == 0
    stream = stream_lines(spark, str(tree / "sub")).select("line")
    q = Grep(spark, "ONE", source=stream, ignore_case=True, only=True).rows().writeStream.format("memory").queryName("stdin_rows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.line for r in spark.table("stdin_rows").collect()) == ["one", "one"]


def test_columns(spark):
    df = spark.createDataFrame([("k", "a1"), ("k", "b"), ("m", None)], "key string, line string")
    assert [r.line for r in select_lines(df, r"\d").collect()] == ["a1"]
    assert [r.line for r in select_lines(df, r"\d", invert=True).collect()] == ["b"]  # a null line is in neither
    assert sorted(tuple(r) for r in count_lines(df, r"\d", "key").collect()) == [("k", 1), ("m", 0)]
    assert [tuple(r) for r in list_keys(df, "b|a", "key").collect()] == [("k",)]
    assert [tuple(r) for r in only_matching(df, r"\d|$", "key", offsets=True).where("match <> ''").collect()] == [("k", 1, 2, "1")]
    assert sorted(r.match for r in only_matching(df, r"\d", "key", invert=True).collect()) == ["b"]


def test_streams(spark, tree, tmp_path):
    q = select_lines(stream_lines(spark, str(tree / "b.txt").rsplit("/", 1)[0]), "foo").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [r.line for r in spark.table("found").collect()] == ["foo one"]


def test_windows_over_a_stream(spark, tmp_path):
    from textloom.streaming.search import windowed_counts

    rows = [("2024-01-01 00:01:00", "click x click"), ("2024-01-01 00:12:00", "none"), ("2024-01-01 02:00:00", "click")]
    spark.createDataFrame(rows, "ts string, t string").selectExpr("timestamp(ts) ts", "t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, t string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "t", "click").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r.window_start), r.n_rows, r.n_matches) for r in spark.table("counts").collect())
    assert got == [("2024-01-01 00:00:00", 1, 2), ("2024-01-01 00:10:00", 0, 0), ("2024-01-01 02:00:00", 1, 1)]
