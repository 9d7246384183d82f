"""The pipeline as a whole, and its stages, on a small table with everything odd in it."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.fixtures import SCHEMA, empty, pairs, rows
from tests.llm.test_dedup import joined
from tests.llm.test_texts import brute_posteriors, contaminated, naive_trigrams
from textloom.llm import language_id as L
from textloom.llm import queries
from textloom.llm.common import made_tables


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows(5, 50), SCHEMA).withColumn("language", F.lit("clash")).withColumn("rep2", F.lit(1))
    docs.write.parquet(f"{d}/documents.parquet")
    long = next(r.text for r in docs.collect() if r.text and len(r.text.split()) > 150)
    spark.createDataFrame([(1, " ".join(long.split()[20:40]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def content(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    step = {k: f for k, f in C.STAGES}
    assert list(step) == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "packing"]

    told = step["language_id"](spark, docs, corpus)
    assert told.columns == columns
    rows_ = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    model = L.train(docs)
    expected = []
    for (i, t, _, _), p in zip(rows_, brute_posteriors(model, [(t, lang, source, None) for _, t, lang, source in rows_])):
        g = naive_trigrams((t or "").encode())
        if g and p.max() >= L.LEAST_POSTERIOR and (len(g) < 20 or model.table[int(p.argmax()), g].mean() > model.even):
            expected.append((i, t))
    assert content(told) == sorted(expected, key=repr)
    assert {i for i, _, _, _ in rows_} - {i for i, _ in expected} >= {1001, 1002}

    single = step["near_duplicates"](spark, told, corpus)
    assert single.columns == columns
    data = content(told)
    root = {}
    for (i, _, c, _) in joined(data, 5, 80):
        root[i] = c
    expected = sorted({(i, t) for i, t in data if i is None or root[i] == i}, key=repr)
    assert sorted(set(content(single)), key=repr) == expected
    named = [x for x in content(single) if x[0] is not None]
    assert len(named) == len(set(named))  # repeated rows once

    cut = step["substring_dedup"](spark, single, corpus)
    assert cut.columns == columns
    assert content(cut) == words_kept(content(single))
    assert set(content(cut)) != set(content(single))
    for r in cut.collect():
        assert r.n_chars is None or r.text is None or r.n_chars == len(r.text)

    clean = step["decontamination"](spark, cut, corpus)
    assert clean.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    bad = {x[0] for x in contaminated(content(cut), items) if x[-1] and x[0] is not None}
    assert content(clean) == sorted((x for x in content(cut) if x[0] not in bad), key=repr)
    assert bad

    packed = step["packing"](spark, clean, corpus).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in content(clean)}


def words_kept(data, width=13):
    """Rows without the words under windows that start in a smaller doc_id too; rows that lose all go."""
    first = {}
    for i, t in data:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1) if i is not None else ():
            first[tuple(w[k : k + width])] = min(i, first.get(tuple(w[k : k + width]), i))
    out = []
    for i, t in data:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k : k + width])] < i:
                keep[k : k + width] = [False] * width
        if all(keep):
            out.append((i, t))
        elif any(keep):
            out.append((i, b" ".join(x for x, y in zip(w, keep) if y).decode()))
    return sorted(out, key=repr)


def packed_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in texts]


def test_run(spark, corpus):
    """run() against a chain of brute-force stages (what language ID keeps is tested in test_stages and test_texts)."""
    import struct
    import zlib
    from collections import Counter, defaultdict

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    data = content(C.language_id(spark, docs, corpus))
    root = {i: c for i, _, c, _ in joined(data, 5, 80)}
    data = [x for x in data if x[0] is None] + sorted({x for x in data if x[0] is not None and root[x[0]] == x[0]}, key=repr)
    data = words_kept(data)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    bad = {x[0] for x in contaminated(data, items) if x[-1] and x[0] is not None}
    expected = packed_ids([x for x in data if x[0] not in bad])
    # every id of every text, once, in pieces that their checksums prove
    pieces = set()
    for i, ids in expected:
        for start in range(len(ids)):
            for end in range(start + 1, min(len(ids), start + 2048) + 1) if len(ids) < 300 else ():
                pieces.add((i, start, end - start, zlib.crc32(struct.pack(f"<{end - start}I", *ids[start:end])), len(ids)))
    long = defaultdict(list)
    for i, ids in expected:
        long[i, len(ids)].append(ids)
    before = made_tables()
    got = C.run(spark, corpus)
    assert len(made_tables() - before) == 1  # nothing is left but the result
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = got.collect()
    sequences, tokens = defaultdict(list), Counter()
    for r in rows:
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        assert key in pieces or any(zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32 for ids in long[r.doc_id, r.doc_tokens])
        sequences[r.sequence_id].append((r.offset, r.length))
        tokens.update((r.doc_id, r.doc_tokens, k) for k in range(r.start, r.start + r.length))
    wanted = Counter((i, len(ids), k) for i, ids in expected for k in range(len(ids)))
    assert tokens == wanted
    sizes = []
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        sizes.append(sum(n for _, n in spans))
    assert max(sizes) <= 2048 and sum(n < 2048 for n in sizes) <= 1


def test_empty(spark, corpus):
    docs = empty(spark)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, corpus)
        assert docs.count() == 0
        docs = empty(spark)


def test_all_ten_are_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES] == list(range(1, 11))
    assert set(queries.SQL) <= {*queries.QUERIES, *queries.MORE}


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_as_sql(spark, name):
    """Queries with SQL, against DuckDB, on the smallest tables."""
    from pathlib import Path

    import duckdb

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, expected = {**queries.QUERIES, **queries.MORE}[name](spark, sf), duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert pairs(got, *columns) == sorted((tuple(r[expected.columns.index(c)] for c in columns) for r in expected.fetchall()), key=repr)
