"""Decontamination, packing, language ID and quality rules."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import empty, pairs
from textloom.llm import language_id as L
from textloom.llm import packing as P
from textloom.llm import quality as Q
from textloom.llm.decontaminate import contamination, find_contamination

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")


# -- decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(data, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for d, t in data:
        w, hit, seen = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found is not None:
                    hit |= set(range(k, k + size))
                    seen |= found
        seen = sorted(str(x) for x in seen if x is not None)
        out.append((d, len(w), len(hit), len(seen), hashlib.sha256(",".join(seen).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    long = next(t for _, t in data if t and len(t.split()) > 150)
    items = [(1, " ".join(long.split()[5:17])), (10, " ".join(long.split()[5:15]).upper()), (2, "a."), (2, "nothing like it " * 4), (3, None), (4, "--"), (None, " ".join(long.split()[30:45])), (5, "X; Y? z"), (6, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = contaminated(data, items)
    assert sum(x[-1] for x in expected) >= 2
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert pairs(contamination(docs, bench), *columns) == expected
    # in several blocks of the benchmark
    one, many = find_contamination(docs, bench), find_contamination(docs, bench, block_mb=0.002)
    assert pairs(one, "doc_id", "n_words", "hit_runs", "items") == pairs(many, "doc_id", "n_words", "hit_runs", "items")
    assert pairs(contamination(docs, bench.limit(0)), *columns) == contaminated(data, [])
    assert contamination(empty(spark), bench).collect() == []


def test_rarest_shingle_order_changes_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b c " * 30), (3, "b c d e f g h i j k l")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "b c d e f g h i j k"), (8, "a b c a b c a b c a")], "item_id long, text string")
    assert pairs(contamination(docs, bench), "doc_id", "n_hit", "n_items") == [(1, 10, 1), (2, 88, 1), (3, 10, 1)]


# -- packing


def check_packing(rows, data, length):
    exact = Tokenizer.from_file(JSON)
    wanted = Counter()
    for d, t in data:
        ids = np.append(np.array(exact.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4")
        wanted[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    # every sequence is gapless and holds at most `length`; all but one are full
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    short = 0
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
        short += at < length
    assert short <= 1
    assert sum(r.length for r in rows) == sum(n * k for (_, n, _), k in wanted.items())
    whole = Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in rows if r.length == r.doc_tokens)
    for k, n in whole.items():
        assert wanted[k] >= n
    for doc, n in Counter(r.doc_id for r in rows for _ in [0] if r.start == 0).items():
        assert n == sum(k for (d, _, _), k in wanted.items() if d == doc)
    return exact


@pytest.mark.parametrize("length, windows, gather", [(2048, 64, 64), (16, 2, 2), (7, 1, 3)])
def test_packing(spark, docs, length, windows, gather):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    rows = P.pack(docs, JSON, length, windows, gather=gather).collect()
    check_packing(rows, data, length)
    # pieces of a document with its own id join to its ids
    exact = Tokenizer.from_file(JSON)
    doc, text = next((d, t) for d, t in data if d == 1005)
    ids = np.append(np.array(exact.encode(text, add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4")
    at = 0
    for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
        assert r.start == at and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at += r.length
    assert at == len(ids)


def test_packing_empty(spark):
    assert P.pack(empty(spark), JSON).collect() == []


def test_encoder_is_the_tokenizer():
    e, exact = P.Encoder(JSON), Tokenizer.from_file(JSON)
    assert e.fast is not None
    for t in ("", " ", "Hello  world\n\n 123's 😀\u00a0x", "a<|endoftext|>b", "ß" * 500, "\r\n\t x"):
        assert e.encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_best_fit():
    p = P.Packer(10, 2)
    ids = lambda n: np.arange(n, dtype=np.uint32)
    assert p.place((1, 0, ids(6), 6)) == [] and p.place((2, 0, ids(7), 7)) == []
    assert p.room == [4, 3]
    assert len(p.place((3, 0, ids(3), 3))) == 1 and p.room == [4]  # the window with the least room that holds it
    assert p.place((4, 0, ids(8), 8)) == [] and p.room == [4, 2]
    full = p.place((5, 0, ids(5), 5))  # none fits: the fullest is topped up and emitted, and the rest fits the other
    assert [sum(len(x[2]) for x in w) for w in full] == [10] and p.room == [1]


# -- language ID


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs.where("doc_id % 2 = 0"), per_language=50)
    got = L.identify(docs.where("doc_id % 2 = 1"), model, carry=("lang",)).toPandas()
    assert (got.language == got.lang).mean() > 0.99 and got.kept.mean() > 0.99


def test_language_evidence(spark, docs):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(base)
    rows = [(1, None, "en", "http://a.example.de/x"), (2, "", None, None), (3, "123 %% 7", "de", "nonsense"), (4, "und", None, "https://x.b.de:80/"), (5, "Привет мир это другой язык совсем и он длинный", None, None), (6, "the of and", "de", None)]
    df = spark.createDataFrame(rows, "page_id long, text string, said string, url string")
    host, suffix = L.address_parts(F.col("url"))
    got = {r.page_id: r for r in L.identify(df, model, "page_id", declared=F.col("said"), host=host, suffix=suffix).collect()}
    assert len(got) == 6
    assert [got[i].language for i in (1, 2, 3)] == [None] * 3 and not any(got[i].kept for i in (1, 2, 3, 5))
    assert got[6].language == "en" and got[6].kept
    many = L.identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    assert many.count() == docs.count()
    assert L.identify(empty(spark), model).count() == 0
    assert L.identify(docs, L.train(docs.limit(0))).where("kept").count() == 0


def test_training_rows_are_the_least_hashes_of_every_label(spark):
    """Copies count once, a label of nothing but copies is in the model, and the bound holds."""
    copies = [("aa", "only one text that is copied")] * 1000
    single = [("bb", f"text number {'abcdefghij'[i] * 3} of many") for i in range(10)] * 2
    df = spark.createDataFrame([*copies, *single, ("cc", "rare"), (None, "unlabelled"), ("dd", None)], "lang string, text string").repartition(5)
    model = L.train(df, per_language=4)
    assert model.languages == ["aa", "bb", "cc"]
    hashes = sorted((r.h, r.lang, r.text) for r in df.dropna().distinct().withColumn("h", F.xxhash64("text", F.lit(7))).collect())
    for k, row in zip(model.languages, model.table):
        counts = sum(np.bincount(naive_trigrams(t.encode()), minlength=L.BUCKETS) for t in [t for _, x, t in hashes if x == k][:4])
        assert np.allclose(row, np.log((counts + 0.1) / (counts.sum() + 0.1 * L.BUCKETS)))


def test_pages_are_judged_by_markup_and_address(spark, tmp_path):
    import __spark_entry__ as entry

    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    page = lambda lang: f"<!DOCTYPE html><html{lang}><style>the of and</style><p>zq &amp; 7</p></html>"
    rows = [(1, "http://a.example.de/x", page("")), (2, "http://b.example.fr/x", page("")), (3, "http://c.example.test/", page(" lang='es-MX'")), (4, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in entry.queries()["op7_language_id_pages"](spark, str(tmp_path)).collect()}
    assert [got[i].language for i in (1, 2, 3, 4)] == ["de", "fr", "es", None]
    assert got[1].n_trigrams == got[2].n_trigrams == got[3].n_trigrams


def naive_trigrams(raw):
    """Trigrams of one text, letter by letter."""
    letters = [0]
    for b in raw:
        x = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0
        if x or letters[-1]:
            letters.append(x)
    letters += [0] if letters[-1] else []
    return [((x * 65599 + y * 257 + z) * 2654435761 >> 7) & (L.BUCKETS - 1) for x, y, z in zip(letters, letters[1:], letters[2:])] if len(letters) > 2 else []


def test_trigrams_of_many_texts():
    r = random.Random(4)
    texts = ["".join(r.choice("aBc \n.é9") for _ in range(r.randrange(12))).encode() for _ in range(300)] + [b"", b"   ", b"x", "ß".encode() * 3]
    hashed, owner = L.trigrams(texts)
    for i, t in enumerate(texts):
        assert hashed[owner == i].tolist() == naive_trigrams(t)


def brute_posteriors(model, rows):
    """rows: (text, declared, host, suffix). The posteriors of each, by the formulas of the module's text."""
    langs, n = model.languages, len(model.languages)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    grams = [naive_trigrams((t or "").encode()) for t, *_ in rows]
    evidence = [min(len(g), L.TEMPER) * model.table[:, g].mean(1) if g else np.zeros(n) for g in grams]
    hints = [(d and re.match("[a-z]*", d.lower())[0], L.SUFFIX_LANGUAGE.get((s or "").lower())) for _, d, _, s in rows]
    logs = [e.copy() for e in evidence]
    for k, guess in enumerate((L.DECLARED_RELIABLE, L.SUFFIX_RELIABLE)):
        borne = [soft(e)[langs.index(h[k])] for e, g, h in zip(evidence, grams, hints) if g and h[k] in langs]
        rate = min(L.MOST_RELIABLE, max(1 / n, (sum(borne) + guess * L.PRIOR_ROWS) / (len(borne) + L.PRIOR_ROWS)))
        for x, h in zip(logs, hints):
            if h[k] in langs:
                x += [np.log(rate if y == h[k] else (1 - rate) / (n - 1)) for y in langs]
    counts = lambda test: sum((soft(x) for x, g, (_, _, host, _) in zip(logs, grams, rows) if g and test(host)), np.zeros(n))
    whole = counts(lambda h: True) + 1
    out = []
    for x, (_, _, host, _) in zip(logs, rows):
        prior = whole / whole.sum()
        if host is not None:
            top, domain = re.search(r"\.([^.]+)$", host), re.search(r"([^.]+\.[^.]+)$", host)
            for found in (top and (lambda h: h is not None and h.endswith("." + top[1])), domain and (lambda h: h is not None and ("." + h).endswith("." + domain[1])), lambda h: h == host):
                if found:
                    c = counts(found)
                    prior = (c + L.HOST_STRENGTH * prior) / (c.sum() + L.HOST_STRENGTH)
        out.append(soft(x + np.log(prior)))
    return out


def test_posteriors_against_brute_force(spark):
    """Text, declared language, suffix and host priors fused row by row; kept and margin follow."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs, per_language=20)
    r = random.Random(2)
    texts = [x.text for x in docs.orderBy("doc_id").limit(40).collect()]
    rows = [(r.choice([None, "", "12 %", "zq", "und", "the", r.choice(texts)[:60], r.choice(texts)]), r.choice([None, "en", "DE-at", "fr", "xx", "es"]), r.choice([None, "a.b.de", "c.b.de", "x.de", "src1", "w.fr", "q.w.fr"]), r.choice([None, "de", "FR", "test"])) for _ in range(120)]
    df = spark.createDataFrame([(i, *x, 1, "clash", 0.5) for i, x in enumerate(rows)], "doc_id long, text string, said string, host string, suffix string, id int, means string, p double").repartition(4)
    got = {x.doc_id: x for x in L.identify(df, model, declared=F.col("said"), host=F.col("host"), suffix=F.col("suffix"), carry=("id", "means", "host")).collect()}
    for i, (p, (text, _, host, _)) in enumerate(zip(brute_posteriors(model, rows), rows)):
        g = naive_trigrams((text or "").encode())
        x = got[i]
        assert (x.id, x.means, x.host, x.n_trigrams) == (1, "clash", host, len(g))
        assert x.posterior == pytest.approx(p.max(), abs=1e-6)
        assert x.language == (model.languages[int(p.argmax())] if g else None)
        if g:
            margin = model.table[int(p.argmax()), g].mean() - model.even
            assert x.text_margin == pytest.approx(margin)
            assert x.kept == (p.max() >= L.LEAST_POSTERIOR and (margin > 0 or len(g) < 20))


def test_equal_posteriors_take_the_first_language(spark):
    model = L.Model(["aa", "bb"], np.zeros((2, L.BUCKETS)), -10.0)
    got = L.identify(spark.createDataFrame([(1, "word"), (2, "w " * 200_000)], "doc_id long, text string"), model).collect()
    assert {(x.language, x.posterior) for x in got} == {("aa", 0.5)}
    assert {x.n_trigrams for x in got} == {4, 399_999}


def test_more_labels_than_are_trained(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LABELS", 3)
    rows = [(f"{x}{y}", f"text of {x}{y} {i}") for x in "abc" for y in "abc" for i in range(1 + (x == "b"))] + [("EN-us", "one"), ("en-GB", "two"), ("en", "three")]
    model = L.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["ba", "bb", "en"]


def test_host_prior_moves_short_texts(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(base)
    side = lambda lang, host: base.where(f"lang = '{lang}'").limit(30).selectExpr("doc_id", "text", f"'{host}' AS host")
    df = side("de", "d.example").unionByName(side("fr", "f.example")).unionByName(spark.createDataFrame([(10**6, "zq", "d.example"), (10**6 + 1, "zq", "f.example")], "doc_id long, text string, host string"))
    p = {r.doc_id: r.language for r in L.identify(df, model, host=F.col("host")).collect()}
    assert (p[10**6], p[10**6 + 1]) == ("de", "fr")


# -- quality


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    raw = text.encode()
    z = zstandard.ZstdCompressor(level=Q.LEVEL)
    odd = sum(not Q.CHUNK_BAND[0] <= len(z.compress(raw[i : i + Q.CHUNK])) / Q.CHUNK <= Q.CHUNK_BAND[1] for i in range(0, len(raw) - Q.CHUNK + 1, Q.CHUNK))
    good = odd <= Q.CHUNK_SHARE * (len(raw) // Q.CHUNK)
    for low, least, most in Q.BANDS[::-1]:
        if len(raw) >= low:
            good &= least <= len(z.compress(raw)) / len(raw) <= most
            break
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed, not failed and good


def test_quality(spark, docs):
    expected = sorted(((r.doc_id, *measured(r.text)) for r in docs.collect()), key=repr)
    assert pairs(Q.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == expected
    assert Q.quality_rules(empty(spark)).collect() == []


def test_compression_bands():
    import os

    z = zstandard.ZstdCompressor(level=Q.LEVEL)
    noise = os.urandom(30000).hex().encode()
    r = random.Random(3)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(2000)]
    prose = " ".join(r.choice(vocabulary) for _ in range(5000)).encode()
    assert Q.compression(b"ab " * 5000, z)[3] is False  # repetitive
    assert Q.compression(os.urandom(5000), z)[3] is False  # noise
    assert Q.compression(prose, z)[3] is True
    assert Q.compression(b"", z) == (None, 0, 0, True)
    assert Q.compression(prose[:20000] + b"same " * 8000 + noise[:100], z)[3] is False  # in chunks


def test_junk_in_the_rest_after_whole_chunks(spark):
    z = zstandard.ZstdCompressor(level=Q.LEVEL)
    r = random.Random(5)
    texts = [x.text.encode() for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' AND n_chars > 5000").orderBy("doc_id").limit(20).collect()]
    heads = [t[: Q.CHUNK] for t in texts if Q.compression(t[: Q.CHUNK], z)[1:] == (1, 0, True)]
    assert len(heads) >= 10
    for head in heads:
        for tail in (b"x" * 2000, bytes(r.randrange(33, 127) for _ in range(2000))):
            assert Q.compression(head + tail, z)[1:] == (2, 1, False)
    assert Q.compression(heads[0][:-1], z)[1:] == (0, 0, True)  # no chunk below CHUNK bytes
    assert [Q.compression(heads[0] * n, z)[1] for n in (1, 2, 3)] == [1, 2, 3]  # no rest, no chunk more
