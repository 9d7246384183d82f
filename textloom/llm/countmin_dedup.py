"""Substring deduplication by windows of words, with a count-min prefilter.

1. Documents are dealt to shards of a few MB by their id. Each shard builds its sketch: for each of
   DEPTH hash functions, the cells its windows fall in, with counts that saturate at 2. Only cells
   that are not zero are kept, as differences of ascending cell numbers.
2. Sketches are merged by slices of the cell space. A merged count is never below the true count,
   so a window whose estimate is 1 occurs once: no repeated window is lost. Each shard gets one bit
   for each of its cells.
3. Only windows that are estimated repeated in every row of the sketch are grouped exactly, by a
   96-bit fingerprint of the window, again by slices. Each shard sends a window once, with its
   smallest doc_id there, whatever number of copies it holds, so no key is hot.
4. Each shard removes the words under windows that start in a document with a smaller id.

A fingerprint collision needs two of W distinct windows to agree in 96 bits: about W^2 / 2^97.

Defined results: null or empty text has no words; a text of fewer than `width` words has no window
and is kept whole; rows that share a doc_id are one document for the order (none removes the
other's words) and each returns its own row; a null doc_id is not smaller than any other and no
other is smaller than it, so such rows neither remove nor lose words; an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from textloom.llm import hashing as H
from textloom.llm.common import as_bytes, parts, trimmed, with_shard
from textloom.llm.exchange import MESSAGE, Route, messages

WIDTH = 13
DEPTH = 2
SHARD_MB = 2.0  # of the stored table
SLICE_MB = 8.0
CELLS_PER_BYTE = 2  # of the stored table: some seven cells for each window of usual prose
SEEDS = (np.uint64(0x8F14E45FCEEA167A), np.uint64(0x3C6EF372FE94F82B), np.uint64(0x510E527FADE682D1), np.uint64(0x1F83D9ABFB41BD6B))
NO_ID = np.iinfo(np.int64).min

def _ids(t: pa.Table) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in t["doc_id"].to_pylist()], np.int64)


def _windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of words, their texts, and the first words of windows that lie in one text."""
    h, owner = H.words(texts)
    if len(h) < width:
        return h, owner, np.zeros(0, np.int64)
    return h, owner, np.flatnonzero(owner[: len(h) - width + 1] == owner[width - 1 :])


def _cells(key: np.ndarray, row: int, cells_log2: int) -> np.ndarray:
    """The cell of each window in one row of the sketch, as the leading bits of 64."""
    return H.mix(key ^ SEEDS[row]) >> np.uint64(64 - cells_log2) << np.uint64(64 - cells_log2)


def sketch(t: pa.Table, width: int, depth: int, n_slices: int, cells_log2: int) -> pa.Table:
    """A shard's count-min sketch, as messages to the slices."""
    h, _, at = _windows(as_bytes(t["text"]), width)
    key = H.windows(h, width)[at] if len(at) else np.zeros(0, np.uint64)
    shard, out = t["shard"][0].as_py(), {k: [] for k in ("slice", "shard", "row", "a", "b")}
    for row in range(depth):
        cells, n = np.unique(_cells(key, row, cells_log2), return_counts=True)
        edges = H.slice_edges(cells, n_slices)
        for s in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[s], edges[s + 1]
            for k, v in zip(out, (int(s), shard, row, H.pack(cells[lo:hi] >> np.uint64(64 - cells_log2)), np.packbits(n[lo:hi] > 1).tobytes())):
                out[k].append(v)
    return messages(out)


def merge_sketches(t: pa.Table) -> pa.Table:
    """Add the shards' counts of a slice; answer each shard with a bit for each of its cells: 2 or more."""
    out = {k: [] for k in ("slice", "shard", "row", "a")}
    rows, shards = t["row"].to_pylist(), t["shard"].to_pylist()
    for row in sorted(set(rows)):
        mine = [i for i, r in enumerate(rows) if r == row]
        cells = [H.unpack(t["a"][i].as_py()) for i in mine]
        counts = [np.unpackbits(np.frombuffer(t["b"][i].as_py(), np.uint8), count=len(c)).astype(np.int32) + 1 for i, c in zip(mine, cells)]
        _, inverse = np.unique(np.concatenate(cells), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts))
        repeated, at = total[inverse] > 1, 0
        for i, c in zip(mine, cells):
            for k, v in zip(out, (t["slice"][i].as_py(), shards[i], row, np.packbits(repeated[at : at + len(c)]).tobytes())):
                out[k].append(v)
            at += len(c)
    return messages(out)


def _keys(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """96-bit keys: an array of 12-byte records that sort as unsigned big-endian strings."""
    a, b = H.windows(h, width)[at], H.windows(h, width, H.SHINGLE_BASE_2)[at]
    return a, (b >> np.uint64(32)).astype(np.uint64)


def _order(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sort by (a, b, doc), and where a new (a, b) begins."""
    order = np.argsort(a)
    x = a[order]
    tie = np.flatnonzero(x[1:] == x[:-1])
    if len(tie):
        runs = np.zeros(len(x), bool)
        runs[tie] = runs[tie + 1] = True
        some = np.flatnonzero(runs)
        o = order[some]
        order[some] = o[np.lexsort((doc[o], b[o], a[o]))]
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, new


def candidates(t: pa.Table, replies: pa.Table, width: int, depth: int, n_slices: int, cells_log2: int) -> pa.Table:
    """Of the windows estimated repeated in every row: key and smallest doc_id in this shard."""
    out = {k: [] for k in ("slice", "shard", "row", "a", "b", "c")}
    if not t.num_rows:
        return messages(out)
    h, owner, at = _windows(as_bytes(t["text"]), width)
    doc = _ids(t)
    key = H.windows(h, width)[at] if len(at) else np.zeros(0, np.uint64)
    answer = {(r, s): a for r, s, a in zip(*(replies[k].to_pylist() for k in ("row", "slice", "a")))}
    keep = doc[owner[at]] != NO_ID
    for row in range(depth if len(at) else 0):
        cells = _cells(key, row, cells_log2)
        order = np.argsort(cells)
        cells = cells[order]
        new = np.ones(len(cells), bool)
        new[1:] = cells[1:] != cells[:-1]
        edges = H.slice_edges(cells[new], n_slices)
        bits = [np.unpackbits(np.frombuffer(answer[row, int(s)], np.uint8), count=edges[s + 1] - edges[s]) for s in np.flatnonzero(np.diff(edges))]
        keep[order] &= np.concatenate(bits).astype(bool)[np.cumsum(new) - 1]
    del key
    at = at[keep]
    a, b = _keys(h, at, width) if len(at) else (np.zeros(0, np.uint64),) * 2
    ids = doc[owner[at]]
    order, new = _order(a, b, ids)
    first = order[new]
    a, b, ids = a[first], b[first], ids[first]
    edges, shard = H.slice_edges(a, n_slices), t["shard"][0].as_py()
    for s in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[s], edges[s + 1]
        for k, v in zip(out, (int(s), shard, 0, H.pack(a[lo:hi]), b[lo:hi].astype(np.uint32).tobytes(), H.pack_any(ids[lo:hi]))):
            out[k].append(v)
    return messages(out)


def group_exactly(t: pa.Table) -> pa.Table:
    """For each shard, the windows that also start in a document with a smaller id than its own smallest."""
    a = [H.unpack(x) for x in t["a"].to_pylist()]
    sizes = [len(x) for x in a]
    b = np.concatenate([np.frombuffer(x, np.uint32) for x in t["b"].to_pylist()]).astype(np.uint64)
    ids = np.concatenate([H.unpack_any(x) for x in t["c"].to_pylist()])
    key = np.concatenate(a)
    order, new = _order(key, b, ids)
    if len(order):
        # smallest id of each group: the order of ids within a group is only sure where the key ties
        group = np.cumsum(new) - 1
        least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids[order])
        later = np.zeros(len(key), bool)
        later[order] = ids[order] > least[group]
    out, at = {k: [] for k in ("slice", "shard", "row", "a", "b")}, 0
    for i, n in enumerate(sizes):
        hit = at + np.flatnonzero(later[at : at + n])
        at += n
        if len(hit):
            for k, v in zip(out, (t["slice"][i].as_py(), t["shard"][i].as_py(), 0, H.pack(key[hit]), b[hit].astype(np.uint32).tobytes())):
                out[k].append(v)
    return messages(out)


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def remove(t: pa.Table, replies: pa.Table, width: int, with_text: bool, carry: bool = False) -> pa.Table:
    """Documents without the words under windows that are known from a smaller doc_id."""
    texts, doc = as_bytes(t["text"]), _ids(t)
    h, owner, at = _windows(texts, width)
    at = at[doc[owner[at]] != NO_ID] if len(at) else at
    cover = np.zeros(len(h) + 1, np.int64)
    if len(at):
        a, b = _keys(h, at, width)
        ids = doc[owner[at]]
        order, new = _order(a, b, ids)
        group = np.cumsum(new) - 1
        least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids[order])
        gone = np.zeros(len(at), bool)
        gone[order] = ids[order] > least[group]
        if replies.num_rows:
            ra = np.concatenate([H.unpack(x) for x in replies["a"].to_pylist()])
            rb = np.concatenate([np.frombuffer(x, np.uint32) for x in replies["b"].to_pylist()]).astype(np.uint64)
            uniq_a, uniq_b = a[order][new], b[order][new]
            # replies are a subset of this shard's keys; several keys may agree in their first 64 bits
            flag, todo, at_key = np.zeros(len(uniq_a), bool), np.arange(len(ra)), np.searchsorted(uniq_a, ra)
            while len(todo):
                same = uniq_b[at_key[todo]] == rb[todo]
                flag[at_key[todo[same]]] = True
                todo = todo[~same]
                at_key[todo] += 1
            gone[order] |= flag[group]
        hit = at[gone]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + width, -1)
    covered = np.cumsum(cover)[:-1] > 0
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(counts)
    removed, kept, digests = [], [], []
    for i, raw in enumerate(texts):
        gone = covered[ends[i] - counts[i] : ends[i]]
        removed.append(int(gone.sum()))
        left = b" ".join(compress(raw.split(), ~gone))
        digests.append(hashlib.sha256(left).hexdigest())
        kept.append(left if with_text and removed[-1] else raw if with_text else None)
    return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), **({"row": t["row"]} if carry else {})})


def dedup_substrings(docs: DataFrame, width: int = WIDTH, depth: int = DEPTH, with_text: bool = True, carry: Column | None = None, shard_mb: float = SHARD_MB, slice_mb: float = SLICE_MB, fan: int | None = None) -> DataFrame:
    """Remove each word covered by a window of `width` words that also starts in a smaller doc_id.

    Returns doc_id, kept_text (kept words joined by a space, the text itself where nothing is removed;
    null unless with_text), n_words, n_removed, kept_sha256 (of the kept words joined by a space).
    carry: a column of docs that comes back, unchanged, as `row`. Null text comes back as ''. See the module's text for nulls, ties and repeated rows.
    """
    n_shards, n_slices = parts(docs, shard_mb), parts(docs, slice_mb)
    cells_log2 = min(60, max(16, (CELLS_PER_BYTE * max(1, min(1 << 58, n_shards * int(shard_mb * 1e6)))).bit_length()))
    base = with_shard(docs, n_shards, *([] if carry is None else [carry.alias("row")]))
    carried = carry is not None
    result = RESULT if carry is None else T.StructType([*RESULT.fields, base.schema["row"]])
    way = Route(n_slices, fan)
    sent = base.groupBy("shard").applyInArrow(trimmed(way.sending(lambda t: sketch(t, width, depth, n_slices, cells_log2))), MESSAGE)
    bits = way.relayed(sent).groupBy("slice").applyInArrow(trimmed(way.sending(way.receiving(lambda t: merge_sketches(t)))), MESSAGE)
    keys = base.groupBy("shard").cogroup(way.returned(bits).groupBy("shard")).applyInArrow(trimmed(way.sending(lambda a, b: candidates(a, way.opened(b), width, depth, n_slices, cells_log2))), MESSAGE)
    found = way.relayed(keys).groupBy("slice").applyInArrow(trimmed(way.sending(way.receiving(lambda t: group_exactly(t)))), MESSAGE)
    return base.groupBy("shard").cogroup(way.returned(found).groupBy("shard")).applyInArrow(trimmed(lambda a, b: remove(a, way.opened(b), width, with_text, carried)), result)
