"""Benchmark decontamination by a prefix-filtered set join of documents with benchmark windows.

A window is `width` consecutive words of an item (or a whole shorter item). As a set join, a window
is the set of its shingles of SHINGLE words, and it is contained in a document only if every one of
them is. So the necessary prefix of a window is one token, its rarest: all shingles of the benchmark
are ordered by their frequency over all documents, and the join probes documents with the rarest of
each window only. A hit fixes where in the document the window must begin (positional bound) and the
document must have that many words from there on (length bound); what is left is verified exactly.

The documents are scanned twice, whatever the benchmark: to count shingles, and to probe. A benchmark
whose windows fit BLOCK_MB, by their measured size, is held by each task (Block). A larger one stays a
table: tasks only hold a bitmap of the benchmark's shingles (BITMAP_LOG2 bits at most, of which a share
says yes by chance), send counts of the shingles that it knows, and then, for those that some window has
as its rarest, the place and the words around it; these are joined with the windows by shingle and
verified in the JVM. Joins by a frequent shingle are split by the adaptive planner, as no aggregation
stands above them.

Defined results: null or empty text has no words and is returned clean; a null or wordless item has
no window; items that share an item_id count once; an item with null item_id hits words but is not
listed; repeated rows of a document return a row each; very long texts are scanned whole; of a window's
equally rare shingles the least fingerprint counts, which changes no result; an empty benchmark leaves
all clean; columns other than those named are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.common import as_bytes, bounded_batches, discard, materialize, pieces, trimmed

WIDTH = 10
SHINGLE = 3
BLOCK_MB = 8.0
BITMAP_LOG2 = 28
_GAP = bytes(i if H.ALNUM[i] else 32 for i in range(256))


def tokens(raw: bytes) -> list[bytes]:
    """Lower-cases A-Z; words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    return raw.lower().translate(_GAP).split()


def item_windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def shingles(h: np.ndarray, n: int, size: int) -> np.ndarray:
    """Shingle fingerprints of a window of n words: of `size` words, or of all if it has fewer."""
    return H.windows(h, min(size, n))


class Block:
    """The windows of some items, and their shingles."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.windows: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, raw in items:
            for w in item_windows(tokens(raw), width):
                self.windows[w].add(item)
        self.keys = list(self.windows)
        self.items = [sorted(x for x in self.windows[k] if x is not None) for k in self.keys]
        self.hashes = [H.words([b" ".join(k)])[0] for k in self.keys]
        self.sizes = sorted({min(SHINGLE, len(k)) for k in self.keys})
        self.all = {s: H.distinct(np.concatenate([H.windows(h, s) for h in self.hashes if min(SHINGLE, len(h)) == s])) for s in self.sizes}

    def order(self, frequency: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle: prefix[size] has (shingle, window, position), by shingle."""
        rows = defaultdict(list)
        for i, h in enumerate(self.hashes):
            s = min(SHINGLE, len(h))
            sh = H.windows(h, s)
            at = min(range(len(sh)), key=lambda j: (frequency.get((s, int(sh[j])), 0), int(sh[j])))
            rows[s].append((int(sh[at]), i, at))
        self.prefix = {}
        for s, found in rows.items():
            found.sort()
            self.prefix[s] = (np.array([x[0] for x in found], np.uint64), [x[1:] for x in found])


def _count(block: Block):
    """Partial counts of the benchmark's shingles: a row for each that a partition of documents has."""

    def counted(batches):
        total = {s: np.zeros(len(block.all[s]), np.int64) for s in block.sizes}
        for b in pieces(batches):
            h, owner = H.words([x.lower().translate(_GAP) for x in as_bytes(b.column("text"))])
            for s in block.sizes:
                if len(h) >= s:
                    sh = H.windows(h, s)[owner[: len(h) - s + 1] == owner[s - 1 :]]
                    at = np.minimum(np.searchsorted(block.all[s], sh), len(block.all[s]) - 1)
                    total[s] += np.bincount(at[block.all[s][at] == sh], minlength=len(block.all[s]))
        for s, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(block.all[s][some].view(np.int64)), pa.array(n[some])], ["size", "shingle", "n"])

    return counted


def _probe(block: Block):
    names = ["doc_id", "n_words", "hit_runs", "items"]

    def probed(batches):
        for b in pieces(batches):
            texts = [x.lower().translate(_GAP) for x in as_bytes(b.column("text"))]
            h, owner = H.words(texts)
            counts = np.bincount(owner, minlength=len(texts)) if len(h) else np.zeros(len(texts), np.int64)
            first = np.cumsum(counts) - counts
            found = defaultdict(set)
            for s, (keys, places) in block.prefix.items():
                if len(h) < s:
                    continue
                sh = H.windows(h, s)
                lo, hi = np.searchsorted(keys, sh, "left"), np.searchsorted(keys, sh, "right")
                for at in np.flatnonzero(hi > lo):
                    doc = owner[at]
                    for window, offset in places[lo[at] : hi[at]]:
                        start = at - offset - first[doc]
                        if start >= 0 and start + len(block.keys[window]) <= counts[doc]:
                            found[int(doc)].add((int(start), window))
            runs, items = [[]] * len(texts), [[]] * len(texts)
            for doc, places in found.items():
                words, hit, seen = texts[doc].split(), [], set()
                for start, window in sorted(places):
                    key = block.keys[window]
                    if words[start : start + len(key)] == list(key):
                        seen.update(block.items[window])
                        if hit and start <= hit[-1][1]:
                            hit[-1][1] = max(hit[-1][1], start + len(key))
                        else:
                            hit.append([start, start + len(key)])
                runs[doc], items[doc] = [x for r in hit for x in r], sorted(seen)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names)

    return probed


# ---- a benchmark that no task holds ---------------------------------------------------------------


def _bench_windows(width: int):
    """Windows of items as texts, and the shingles of each: (window, size, item, shingles)."""

    def made(batches):
        for b in pieces(batches):
            rows = [(w, item) for item, raw in zip(b.column("item").to_pylist(), as_bytes(b.column("text"))) for w in dict.fromkeys(item_windows(tokens(raw), width))]
            found = [shingles(H.words([b" ".join(w)])[0], len(w), SHINGLE).view(np.int64).tolist() for w, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(w).decode("utf-8", "replace") for w, _ in rows], pa.string()), pa.array([len(w) for w, _ in rows], pa.int32()), pa.array([i for _, i in rows], pa.string()), pa.array(found, pa.list_(pa.int64()))], ["window", "size", "item", "shingles"])

    return made


class Known:
    """A bitmap of fingerprints, in each task; it says yes to all of them and to a share of others."""

    def __init__(self, fingerprints: DataFrame):
        n = fingerprints.count()
        self.log2 = max(16, min(BITMAP_LOG2, (32 * n).bit_length()))
        segment, log2 = 1 << min(20, self.log2), self.log2

        def bits(batches):
            for b in batches:
                cell = H.distinct(b.column("shingle").to_numpy().view(np.uint64) >> np.uint64(64 - log2)).astype(np.int64)
                for s in np.unique(cell // segment, return_index=True)[0].tolist():
                    own = np.zeros(segment, bool)
                    own[cell[cell // segment == s] % segment] = True
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["segment", "bits"])

        def merge(t: pa.Table) -> pa.Table:
            out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()])
            return pa.table({"segment": t["segment"][:1], "bits": pa.array([out.tobytes()], pa.binary())})

        schema = "segment int, bits binary"
        whole = np.zeros(((1 << log2) // segment, segment // 8), np.uint8)
        for r in fingerprints.mapInArrow(bits, schema).groupBy("segment").applyInArrow(merge, schema).collect():
            whole[r.segment] = np.frombuffer(bytes(r.bits), np.uint8)
        self.bits = fingerprints.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    def __call__(self, shingle: np.ndarray) -> np.ndarray:
        cell = (shingle >> np.uint64(64 - self.log2)).astype(np.int64)
        return (self.bits.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def _batches_of_words(batches):
    """Texts of a batch, cleaned; fingerprints of their words, the owner of each, words and first word of each text."""
    for b in pieces(batches):
        texts = [x.lower().translate(_GAP) for x in as_bytes(b.column("text"))]
        h, owner = H.words(texts)
        counts = np.bincount(owner, minlength=len(texts)) if len(h) else np.zeros(len(texts), np.int64)
        yield b, texts, h, owner, counts, np.cumsum(counts) - counts


def _count_known(known: Known, sizes: list[int]):
    def counted(batches):
        for _, _, h, owner, _, _ in _batches_of_words(batches):
            for s in sizes:
                sh = H.windows(h, s)
                sh = sh[owner[: len(sh)] == owner[s - 1 :]] if len(sh) else sh
                values, n = np.unique(sh[known(sh)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["shingle", "n"])

    return counted


PROBED = "row long, doc_id long, n_words long, at long, shingle long, first long, context string"
_PROBED = (pa.int64(),) * 6 + (pa.string(),)


def _probe_known(known: Known, sizes: list[int], width: int):
    """A row for each document (at: null) and one for each place where a known shingle stands, with the
    words that a window around it can have."""

    def probed(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for b, texts, h, owner, counts, before in _batches_of_words(batches):
            ids = b.column("doc_id").to_pylist()
            rows = [(number + i, d, int(n), None, None, None, None) for i, (d, n) in enumerate(zip(ids, counts))]
            split: dict[int, list[bytes]] = {}
            for s in sizes:
                sh = H.windows(h, s)
                at = np.flatnonzero((owner[: len(sh)] == owner[s - 1 :]) & known(sh)) if len(sh) else sh
                for p in at.tolist():
                    d = int(owner[p])
                    if d not in split:
                        split[d] = texts[d].split()
                    words = split[d]
                    place = p - int(before[d])
                    first = max(0, place - width + 1)
                    rows.append((number + d, ids[d], int(counts[d]), place, int(sh[p].view(np.int64)), first, b" ".join(words[first : place + width]).decode("utf-8", "replace")))
            number += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PROBED)], [f.split()[0] for f in PROBED.split(", ")])

    return probed


def _find_in_table(base: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """find_contamination for a benchmark of any size: documents are scanned twice, windows stay a table."""
    made = materialize(items.mapInArrow(trimmed(_bench_windows(width)), "window string, size int, item string, shingles array<long>"), "windows")
    sizes = sorted({min(SHINGLE, r["size"]) for r in made.select("size").distinct().collect()})
    places = made.select("window", "size", F.posexplode("shingles").alias("offset", "shingle")).distinct()
    distinct = materialize(places.select("shingle").distinct(), "shingles")
    # first scan: how often the benchmark's shingles stand in all documents
    counts = base.select("text").mapInArrow(trimmed(_count_known(Known(distinct), sizes)), "shingle long, n long")
    counts = materialize(counts.groupBy("shingle").agg(F.sum("n").alias("n")).join(distinct, "shingle", "left_semi"), "counts")
    rarest = places.join(counts, "shingle", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("least"))
    by_item = made.groupBy("window").agg(F.collect_set("item").alias("items"))
    windows = materialize(rarest.select("window", "size", "least.shingle", "least.offset").join(by_item, "window"), "prefixes")
    # second scan: the places of shingles that are the rarest of some window
    chosen = Known(windows.select("shingle").distinct())
    probed = materialize(base.select("doc_id", "text").mapInArrow(trimmed(_probe_known(chosen, sizes, width)), PROBED), "probed")
    start = F.col("at") - F.col("offset")
    met = probed.where("at IS NOT NULL").join(windows, "shingle").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    words = F.slice(F.split("context", " "), (start - F.col("first") + 1).cast("int"), F.col("size"))
    hits = met.where(F.array_join(words, " ") == F.col("window")).select("row", F.array(start, start + F.col("size")).alias("run"), "items")
    by = hits.groupBy("row").agg(F.flatten(F.collect_set("run")).alias("hit_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    by = by.mapInPandas(lambda frames: (f.assign(hit_runs=[_union(r) for r in f["hit_runs"]]) for f in frames), "row long, hit_runs array<long>, items array<string>")
    by = materialize(by, "hits")
    discard(made, distinct, counts, windows)
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return probed.where("at IS NULL").join(by, "row", "left").select("doc_id", "n_words", none("hit_runs", "long").alias("hit_runs"), none("items", "string").alias("items"))


def _union(runs) -> list[int]:
    out: list[list[int]] = []
    for s, e in sorted(zip(runs[::2], runs[1::2])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [int(x) for r in out for x in r]


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_mb: float = BLOCK_MB) -> DataFrame:
    """Where benchmark windows occur: doc_id, n_words, hit_runs (starts and ends of hit runs of words,
    in turn), items (the item_ids whose windows occur, sorted as strings). A row for each document."""
    base = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # a window for each word at most, each of up to `width` words: so many bytes for each byte of text
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total * width > block_mb * 1e6:
        return _find_in_table(base, items, width)
    block = Block([(r.item, bytes(r.raw)) for r in items.select("item", F.encode("text", "UTF-8").alias("raw")).collect()], width)
    if block.keys:
        counts = base.select("text").mapInArrow(trimmed(_count(block)), "size int, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n")).toPandas()
        block.order(dict(zip(zip(counts["size"], counts["shingle"].to_numpy().view(np.uint64).tolist()), counts["n"])))
    else:
        block.prefix = {}
    return base.mapInArrow(trimmed(_probe(block)), "doc_id long, n_words long, hit_runs array<long>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The digest of find_contamination: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, width)
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_runs") - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.element_at("hit_runs", i + 1) * F.when(i % 2 == 1, 1).otherwise(-1))
    n_hit = F.when(F.size("hit_runs") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


