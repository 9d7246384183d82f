"""Jaccard join, byte and word deduplication against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA, empty, pairs, rows
from textloom.llm import jaccard_join as J
from textloom.llm.countmin_dedup import dedup_substrings
from textloom.llm.exchange import Route, messages
from textloom.llm.graph import connected_components, spanning_forest
from textloom.llm import suffix_dedup as S
from textloom.llm.suffix_dedup import dedup_suffixes


def shingle_sets(data, n):
    out = []
    for i, t in data:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    return out


def joined(data, n, num):
    sets = shingle_sets(data, n)
    root = {i: i for i, _ in sets if i is not None}
    links = Counter()

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    known = [(i, s) for i, s in sets if i is not None and s]
    for a in range(len(known)):
        for b in range(a + 1, len(known)):
            (i, x), (j, y) = known[a], known[b]
            if 100 * len(x & y) >= num * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    number = {id(s): n for n, s in enumerate(known)}
    out = []
    at = 0
    for i, s in sets:
        here = None
        if i is not None and s:
            here, at = at, at + 1
        out.append((i, len(s), None if i is None else find(i), links[here] if here is not None else 0))
    assert len(number) == len(known)
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, num, block", [(3, 90, 16.0), (5, 80, 16.0), (2, 60, 0.002)])
def test_jaccard_join(spark, docs, n, num, block):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    got = pairs(J.jaccard_join(docs, n, num, 100, block_mb=block), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == joined(data, n, num)


def test_jaccard_join_empty(spark):
    assert J.jaccard_join(empty(spark)).collect() == []


def test_tree_bounds_lose_nothing():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(r.choice(base, r.integers(1, 60))) for _ in range(150)]
    sets += [np.unique(np.append(s, r.integers(0, 2**63, 1, dtype=np.uint64))) for s in sets[:80]]
    for left, right in ((sets, None), (sets[:37], sets[37:])):
        found = set()
        for a, b, linked in J.tree_links(left, right, 70, 100):
            found |= {(int(a[i]), int(b[j])) for i, j in zip(*np.nonzero(linked))}
        expected = set()
        other = left if right is None else right
        for i, x in enumerate(left):
            for j, y in enumerate(other):
                both = len(np.intersect1d(x, y))
                if (right is not None or i != j) and 100 * both >= 70 * (len(x) + len(y) - both):
                    expected.add((i, j))
        if right is None:
            found = {tuple(sorted(p)) for p in found}
            expected = {tuple(sorted(p)) for p in expected}
        assert found == expected


@pytest.mark.parametrize("num", [60, 80, 90])
def test_parts_meet(num):
    """Linked sets agree on something, whatever n-grams count as frequent."""
    r = np.random.default_rng(num)
    bands, met = J.Bands(num, 100), 0
    for share in (0.0, 0.3, 0.9, 1.0):
        for _ in range(400):
            often = lambda u: (u * np.uint64(2654435761) >> np.uint64(40)) % np.uint64(1000) < np.uint64(1000 * share)
            a = np.unique(r.integers(0, 2**63, r.integers(1, 80), dtype=np.uint64))
            keep = r.random(len(a)) < (num / 100 + 1) / 2
            b = np.unique(np.concatenate([a[keep], r.integers(0, 2**63, r.integers(0, 6), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= num * (len(a) + len(b) - both):
                met += 1
                assert np.intersect1d(bands.part_prints(a, ~often(a)), bands.part_prints(b, ~often(b))).size
    assert met > 200


@pytest.mark.parametrize("rows", [0, 10, 200_000])
def test_components_of_random_graphs(spark, monkeypatch, rows):
    """Chains, stars and random edges, with maps joined or broadcast; the number of rounds stays small."""
    from textloom.llm import graph as G

    monkeypatch.setattr(G, "BROADCAST_ROWS", rows)
    r = np.random.default_rng(rows)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 2000 + i) for i in range(80)] + [tuple(x) for x in r.integers(5000, 5150, (110, 2)).tolist()]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    rounds = []
    kept = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, tag: rounds.append(tag) or kept(df, tag))
    got = pairs(G.connected_components(spark.createDataFrame(edges, "src long, dst long")), "id", "label")
    assert got == sorted(((v, find(v)) for v in root), key=repr)
    assert rounds.count("step") <= 6


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (8, 9), (None, 1)], "src long, dst long")
    assert pairs(connected_components(e), "id", "label") == [(i, 1) for i in range(1, 6)] + [(8, 8), (9, 8)]
    chain = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(chain).where("label <> 0").count() == 0
    assert connected_components(e.limit(0)).count() == 0
    assert spanning_forest([(5, 4), (4, 3), (9, 8)]).tolist() == [[4, 3], [5, 3], [9, 8]]


def words_removed(data, width=13):
    least = {}
    for i, t in data:
        w = (t or "").encode().split()
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in data:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        if i is not None:
            for k in range(len(w) - width + 1):
                if least[tuple(w[k : k + width])] < i:
                    keep[k : k + width] = [False] * width
        left = b" ".join(x for x, y in zip(w, keep) if y)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark, docs):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    for options in ({}, {"shard_mb": 0.0001, "slice_mb": 0.0002}):
        got = dedup_substrings(docs, carry=F.struct("lang", "source"), **options)
        assert pairs(got, "doc_id", "n_words", "n_removed", "kept_sha256") == words_removed(data)
    for r in got.collect():
        assert r.n_removed == 0 or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert dedup_substrings(empty(spark)).collect() == []


def test_substring_dedup_depths_agree(spark, docs):
    one = dedup_substrings(docs, depth=1, with_text=False)
    four = dedup_substrings(docs, depth=4, with_text=False)
    key = ("doc_id", "n_removed", "kept_sha256")
    assert pairs(one, *key) == pairs(four, *key)


def bytes_removed(data, length):
    seen = Counter(t.encode()[k : k + length] for _, t in data if t for k in range(len(t.encode()) - length + 1))
    out = []
    for i, t in data:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, np.int8)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[1 + k : 1 + k + length] = 1
        left = np.frombuffer(raw, np.uint8)[gone[1:-1] == 0].tobytes()
        out.append((i, len(raw), len(raw) - len(left), int((np.diff(gone) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, gram, hot", [(200, 48, 20000), (64, 16, 20000), (64, 16, 1), (24, 8, 3)])
def test_suffix_dedup(spark, docs, length, gram, hot):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    got = dedup_suffixes(docs, length=length, gram=gram, hot=hot, shard_mb=0.0002, slice_mb=0.0005)
    assert pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_removed(data, length)
    for r in got.collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.spans) == 2 * r.n_spans


def test_suffix_dedup_empty_and_bad(spark):
    assert dedup_suffixes(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        dedup_suffixes(empty(spark), length=30)


def shard_entries(r, shards, length=16):
    """Random pieces about two anchors, each shard's in suffix order: (shard, key, windows, offset, text)."""
    out = []
    for k in range(shards):
        rows = []
        for _ in range(r.integers(0, 30)):
            windows = int(r.integers(1, 6))
            offset = int(r.integers(windows - 1, windows + 3))
            text = r.integers(97, 99, windows + length - 1).astype(np.uint8).tobytes()
            rows.append((k, int(r.integers(0, 2)), windows, offset, text))
        out += sorted(rows, key=lambda x: (x[1], x[4][x[3] :]))
    return out


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_orders_merge(shards):
    """The merged order is that of all suffixes, keeps each shard's own order, and has the common prefixes;
    walking left by BWT symbols finds the windows that occur twice."""
    length = 16
    for seed in range(8):
        rows = shard_entries(np.random.default_rng(seed), shards)
        if not rows:
            continue
        right, bwt = [x[4][x[3] :] for x in rows], [x[4][: x[3]][::-1] for x in rows]
        entries = S.Entries(length, np.array([x[1] for x in rows], np.uint64), np.array([x[2] for x in rows]), np.array([x[3] for x in rows]), right, bwt)
        order, lcp = S.merge_orders(entries)
        padded = [r.ljust(length, b"\0") for r in right]
        assert [(rows[i][1], padded[i]) for i in order] == sorted((x[1], p) for x, p in zip(rows, padded))
        for k in range(shards):
            mine = [i for i in order if rows[i][0] == k]
            assert mine == sorted(mine)
        for p, q, n in zip(order, order[1:], lcp[1:]):
            same = next((i for i in range(length) if padded[p][i] != padded[q][i]), length)
            assert n == (same if rows[p][1] == rows[q][1] else 0)
        window = lambda i, o: (rows[i][1], o, rows[i][4][rows[i][3] - o :][:length])
        every = [(i, o) for i, x in enumerate(rows) for o in range(x[3] - x[2] + 1, x[3] + 1)]
        seen = Counter(window(i, o) for i, o in every)
        who, offset = S.repeated_windows(entries)
        assert sorted(zip(who.tolist(), offset.tolist())) == sorted((i, o) for i, o in every if seen[window(i, o)] > 1)


def test_many_copies(spark):
    """A group of copies and of near copies that is most of the table."""
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    data = [(i, same) for i in range(300)] + [(1000 + i, f"{same} {i} {same} end {i}") for i in range(100)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert pairs(J.jaccard_join(df, 3, 90, 100, block_mb=0.01), "doc_id", "n_shingles", "component_id", "n_links") == joined(data, 3, 90)
    assert pairs(dedup_substrings(df, with_text=False), "doc_id", "n_words", "n_removed", "kept_sha256") == words_removed(data)


def test_other_seeds(spark):
    for seed in (2, 3):
        df = spark.createDataFrame(rows(seed, 60), SCHEMA)
        data = [(r.doc_id, r.text) for r in df.collect()]
        assert pairs(J.jaccard_join(df, 5, 80, 100), "doc_id", "n_shingles", "component_id", "n_links") == joined(data, 5, 80)
        assert pairs(dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept_sha256") == words_removed(data)


def test_inner_nodes_are_dropped():
    """Groups of like sets: nearly all pairs of inner nodes from different groups fall before their leaves are seen."""
    r = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = np.unique(r.integers(0, 2**63, 120, dtype=np.uint64))
        sets += [np.unique(np.append(base[: 120 - k % 5], r.integers(0, 2**63, 2, dtype=np.uint64))) for k in range(16)]
    walked: dict = {}
    n = sum(int(linked.sum()) for _, _, linked in J.tree_links(sets, None, 80, 100, walked))
    assert n == 40 * 16 * 15 // 2
    assert walked["inner dropped"] > 1000
    assert walked["leaves"] < len(sets) * (len(sets) - 1) // 2 // 5


def test_sketch_counts_documents(spark, monkeypatch):
    """The cells of n-grams that are in many documents, and no cells of rare ones, whatever the rounds of adding up."""
    monkeypatch.setattr(J.Sketch, "GATHER", 2)
    monkeypatch.setattr(J.Sketch, "HELD", 100)
    monkeypatch.setattr(J.Sketch, "SEGMENT", 1 << 12)
    data = [(i, f"the same words here and own{i} x{i} y{i} z{i}") for i in range(60)]
    base = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    common, = J.ngram_sets([b"the same words here and"], 5)
    rare = np.concatenate(J.ngram_sets([f"own{i} x{i} y{i} z{i}".encode() for i in range(60)], 4))
    for lots in (1, 5):
        sketch = J.Sketch(base, 5, 16, lots)
        assert sketch(common).all()
        assert sketch(rare).mean() < 0.05


def test_messages_over_relays(spark, docs):
    """With more slices than the fan, bundles go over relays; the results are the same."""
    data = [(r.doc_id, r.text) for r in docs.collect()]
    small = {"slice_mb": 0.0005, "fan": 3}
    assert pairs(J.jaccard_join(docs, 3, 90, 100, **small), "doc_id", "n_shingles", "component_id", "n_links") == joined(data, 3, 90)
    assert pairs(dedup_substrings(docs, with_text=False, shard_mb=0.0002, **small), "doc_id", "n_words", "n_removed", "kept_sha256") == words_removed(data)
    assert pairs(dedup_suffixes(docs, 64, 16, shard_mb=0.0002, hot=3, **small), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_removed(data, 64)


def test_a_shard_sends_a_row_for_each_range():
    way = Route(1000, 10)
    made = messages({"slice": list(range(1000)), "shard": [25] * 1000, "row": [0] * 1000, "a": [b"%d" % i for i in range(1000)]})
    sent = way.sending(lambda t: t)(made)
    assert sent.num_rows == 10 and set(sent["shard"].to_pylist()) == {2}
    first = sent.filter(pc.equal(sent["slice"], 4))
    relayed = way._relay(first, False)
    assert relayed.num_rows == 100 and relayed["slice"].to_pylist() == list(range(400, 500))
    assert way._open(relayed)["a"].to_pylist() == [b"%d" % i for i in range(400, 500)]
