"""Exact Jaccard join of documents on sets of word n-grams, by signature trees.

1. Each document becomes the set of its distinct n-grams (64-bit fingerprints) and a 128-bit
   fingerprint of the set; documents with the same set are one class.
2. Sets that can link are brought together exactly (no pair is lost): set sizes fall in bands, a set
   joins its own band and the one below, and in a band of k parts, with k above the largest
   symmetric difference that two linked sets may have, two linked sets agree on a whole part. The
   parts are of n-grams that are not frequent, so a passage that many documents hold brings none of
   them together. What is frequent comes from a sketch over all documents whose cells grow with the input,
   up to 2 ** MOST_CELLS bits for each task; beyond that, a cell holds several n-grams and must be in more
   documents to count, so that clusters get larger but no link is lost. A set with too few parts for that
   argument (parts that are empty in both agree too) also sends parts of all its n-grams, and if these are
   too few a prefix of its ordered n-grams, which two such sets share if they link. A task sends each part's
   fingerprint once, with one set of those that have it, so a frequent one is no hot key.
3. Sets that agree on one make clusters (components of the agreements, see graph.py; equal sets are one
   vertex). In each, the sets are the leaves of a signature tree. A node has the OR of the bitmaps of its
   sets' tokens, the range of their sizes and the largest number of bitmap collisions; its children are
   FANOUT neighbours by size band and least token, so that like sets share nodes. Two trees are walked
   together from their roots: a pair of nodes is dropped if its largest possible overlap,
   popcount(OR_a & OR_b) + collisions, is less than the overlap that the smallest sizes need, or if the
   size ranges are too far apart. Pairs of leaves that remain are counted exactly. A cluster of more than
   BLOCK_MB of tokens makes a tree for each block of a size band, and each pair of blocks in one band or
   in neighbouring ones is a task of its own.
4. Links make components again, and these come back to documents through their classes.

Defined results: null or empty text, or text of spaces, has an empty set and links with nothing; a
text of fewer words than n has one n-gram, the whole; rows that share a doc_id are one node, and each
row returns its own set size; a null doc_id returns its set size, no links and a null component;
very long texts are whole sets; an empty table gives no rows; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.common import as_bytes, bounded_batches, discard, materialize, parts, pieces, trimmed
from textloom.llm.exchange import MESSAGE, Route, messages
from textloom.llm.graph import connected_components, spanning_forest

U = np.uint64
S1, S2, S3, S4 = U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0), U(0x082EFA98EC4E6C89)
#: Cells of the sketch: one for each CELL_BYTES bytes of the stored table, within these powers of 2.
CELL_BYTES, LEAST_CELLS, MOST_CELLS = 3, 20, 28
LOT_MB = 1000.0  # of the stored table, whose counts are added up by one task a segment
MOST_COUNTED = 65535
FREQUENT = 16  # documents, and twice what a cell has on average
SLICE_MB = 4.0
BITS = 4096
FANOUT = 4
COARSE = 3  # levels above the leaves from which pairs of nodes are walked one by one
BLOCK_MB = 8.0
SPREAD = 4
SET_BYTES = 2048  # of a set besides its tokens: bitmaps of the tree, and objects
BROADCAST_ROWS = 200_000


def ngram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The ascending distinct n-gram fingerprints of each text; A-Z count as a-z."""
    h, owner = H.words([t.lower() for t in texts])
    ends = np.cumsum(np.bincount(owner, minlength=len(texts))) if len(texts) else []
    out, at = [], 0
    for end in ends:
        w = h[at:end]
        out.append(H.distinct(H.windows(w, min(n, len(w)))) if len(w) else w)
        at = end
    return out


def set_print(u: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    return int(H.mix(u ^ S1).sum(dtype=np.uint64).view(np.int64)), int(H.mix(u ^ S2).sum(dtype=np.uint64).view(np.int64))


def prefix(u: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first |u| - need + 1 fingerprints, where need is what a link shares at least."""
    return u[: len(u) - -(-num * len(u) // den) + 1]


class Bands:
    """Size bands for a link of num / den: a set links within its band or to a neighbouring one."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1, 2]
        self.slack = 1.1 if 10 * num >= 9 * den else 1.25

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, (self.low[-1] - 1) * self.den // self.num + 1))
        return bisect_right(self.low, n) - 1

    def most_apart(self, band: int) -> int:
        """The largest symmetric difference of linked sets whose smaller one is in the band."""
        while len(self.low) <= band + 1:
            self.band(self.low[-1])
        return (self.low[band + 1] - 1) * (self.den - self.num) // self.num

    def part_prints(self, u: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """What a set may agree on with one that it links to; rare: which of its n-grams are not frequent."""
        own, out = self.band(len(u)), []
        value = H.mix(u ^ S3)
        for band in (own, own - 1) if own else (own,):
            apart = self.most_apart(band)
            k = int(np.ceil((apart + 1) * self.slack)) if apart else 1
            for turn, v in ((0, value[rare]), (1, value)):
                part = (((v ^ S4) & U(0xFFFFFFFF)) * U(k) >> U(32)).astype(np.int64)
                total = np.zeros(k, np.uint64)
                np.add.at(total, part, v)
                used = np.zeros(k, bool)
                used[part] = True
                used = np.flatnonzero(used)
                out.append(H.mix(total[used] ^ H.mix(used.astype(np.uint64) ^ self.salt(band, turn))))
                if len(used) > apart:
                    break
            else:
                out.append(H.mix(prefix(u, self.num, self.den) ^ self.salt(band, 2)))
        return np.concatenate(out)

    @staticmethod
    def salt(band: int, turn: int) -> np.ndarray:
        return H.mix(np.array([band * 3 + turn], np.uint64) ^ S1)


class Sketch:
    """In how many documents the n-grams of each cell are, and from that which cells are frequent.

    It has 2 ** log2 cells, in segments; tasks count sparsely, counts are added up segment by segment in
    rounds of at most GATHER tables, and one bit for each cell comes to the driver and goes to the tasks."""

    GATHER, SEGMENT, HELD = 64, 1 << 20, 2_000_000

    def __init__(self, base: DataFrame, n: int, log2: int, lots: int):
        self.log2, self.size, self.held = log2, min(self.SEGMENT, 1 << log2), self.HELD
        schema = "segment int, lot int, cells binary, counts binary"
        counts = base.select("text").mapInArrow(trimmed(self._count(n, lots)), schema)
        while lots > 1:
            lots = -(-lots // self.GATHER)
            counts = counts.groupBy("segment", "lot").applyInArrow(trimmed(self._merge(lots)), schema)
        bits = np.zeros((1 << log2) // 8, np.uint8).reshape(-1, self.size // 8)
        for r in counts.groupBy("segment").applyInArrow(trimmed(self._frequent), "segment int, bits binary").collect():
            bits[r.segment] = np.frombuffer(bytes(r.bits), np.uint8)
        self.bits = base.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def __call__(self, u: np.ndarray) -> np.ndarray:
        """Which n-grams are in a frequent cell."""
        cell = (u >> U(64 - self.log2)).astype(np.int64)
        return (self.bits.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)

    def _rows(self, segment, lot, cells, counts) -> pa.Table:
        return pa.table({"segment": pa.array(segment, pa.int32()), "lot": pa.array(lot, pa.int32()), "cells": pa.array(cells, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def _count(self, n: int, lots: int):
        size = self.size

        def sent(held, lot):
            cells, hits = np.unique(np.concatenate(held), return_counts=True)
            edge = np.searchsorted(cells, np.arange(0, (1 << self.log2) + 1, size, dtype=np.uint64))
            some, squeeze = np.flatnonzero(np.diff(edge)), zstandard.ZstdCompressor(level=1).compress
            at = [slice(edge[s], edge[s + 1]) for s in some]
            return self._rows(some, [lot] * len(some), [H.pack(cells[x] - U(int(s) * size)) for s, x in zip(some, at)], [squeeze(np.minimum(hits[x], MOST_COUNTED).astype("<u2").tobytes()) for x in at])

        def counted(batches):
            from pyspark import TaskContext

            lot, held = TaskContext.get().partitionId() % lots, []
            for b in pieces(batches):
                held += [u >> U(64 - self.log2) for u in ngram_sets(as_bytes(b.column("text")), n)]
                if sum(map(len, held)) > self.held:
                    yield from sent(held, lot).to_batches()
                    held = []
            if held:
                yield from sent(held, lot).to_batches()

        return counted

    def _total(self, t: pa.Table) -> np.ndarray:
        """The counts of all rows; without cells, a row has a count for each cell of its segment."""
        total, inflate = np.zeros(self.size, np.int64), zstandard.ZstdDecompressor().decompress
        for cells, counts in zip(t["cells"], t["counts"]):
            hits = np.frombuffer(inflate(counts.as_py()), "<u2")
            if cells.is_valid:
                total[H.unpack(cells.as_py()).astype(np.int64)] += hits
            else:
                total += hits
        return total

    def _merge(self, lots: int):
        def merged(t: pa.Table) -> pa.Table:
            total = np.minimum(self._total(t), MOST_COUNTED).astype("<u2")
            return self._rows([t["segment"][0].as_py()], [t["lot"][0].as_py() % lots], [None], [zstandard.ZstdCompressor(level=1).compress(total.tobytes())])

        return merged

    def _frequent(self, t: pa.Table) -> pa.Table:
        total = self._total(t)
        return pa.table({"segment": t["segment"][:1], "bits": pa.array([np.packbits(total > FREQUENT + 2 * total.mean()).tobytes()], pa.binary())})


FOUND = "kind int, a long, b long, c long, d long"


def _describe(n: int, num: int, den: int, n_slices: int, frequent, way: Route):
    """Part prints of the sets of a batch, by slice, and what the batch has to tell of each document. Sets
    go by half of their print here: if two should agree in it, a cluster has some sets more."""
    bands = Bands(num, den)

    def described(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        turn, often = task, frequent
        for batch in pieces(batches):
            ids = [None if x is None else int(x) for x in batch.column("doc_id").to_pylist()]
            sets = ngram_sets(as_bytes(batch.column("text")), n)
            meta = np.zeros((len(ids), 5), np.int64)  # doc_id, is null, size, print
            seen, prints, owner, edges = set(), [], [], []
            for i, (doc, u) in enumerate(zip(ids, sets)):
                a, b = set_print(u)
                meta[i] = (doc or 0, doc is None, len(u), a, b)
                if doc is None or not len(u):
                    continue
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                p = bands.part_prints(u, ~often(u))
                prints.append(p)
                owner.append(np.full(len(p), a))
            rows = [(turn % n_slices, H.pack_any(meta.reshape(-1)), None, -1)]
            if prints:
                key, of = np.concatenate(prints), np.concatenate(owner)
                key, of, more = _first_of_each(key, of)
                edges += [tuple(x) for x in more.tolist()]
                at = H.slice_edges(key, n_slices)
                rows += [(int(s), H.pack(key[at[s] : at[s + 1]]), H.pack_repeated(of[at[s] : at[s + 1]]), 0) for s in np.flatnonzero(np.diff(at))]
            if edges:
                rows.append((turn % n_slices, H.pack_any(np.array(sorted(set(edges)), np.int64).reshape(-1)), None, -2))
            turn += 1
            made = messages({"slice": [r[0] for r in rows], "shard": [task] * len(rows), "row": [r[3] for r in rows], "a": [r[1] for r in rows], "b": [r[2] for r in rows]})
            yield from way.sending(lambda t: t)(made).to_batches()

    return described


def _first_of_each(key: np.ndarray, doc: np.ndarray):
    """Ascending distinct keys, the smallest owner of each, and edges to it from the others."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    least = doc[new][np.cumsum(new) - 1]
    far = least != doc
    return key[new], doc[new], spanning_forest(np.stack([doc[far], least[far]], 1))


def _meet(t: pa.Table) -> pa.Table:
    """A slice of all part prints: edges between sets that agree; passes on what batches told."""
    out, keys, docs = [], [], []
    for a, b, n in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["row"].to_pylist()):
        if n == -1:
            m = H.unpack_any(a).reshape(-1, 5)
            out.append(np.column_stack([np.where(m[:, 1] == 1, 2, 0), m[:, 0], m[:, 2:]]))
        elif n == -2:
            e = H.unpack_any(a).reshape(-1, 2)
            out.append(np.column_stack([np.ones(len(e), np.int64), e, np.zeros_like(e)]))
        else:
            keys.append(H.unpack(a))
            docs.append(H.unpack_repeated(b))
    if keys:
        _, _, e = _first_of_each(np.concatenate(keys), np.concatenate(docs))
        out.append(np.column_stack([np.ones(len(e), np.int64), e, np.zeros_like(e)]))
    all_ = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
    return pa.table({"kind": pa.array(all_[:, 0].astype(np.int32)), **{k: pa.array(all_[:, i + 1]) for i, k in enumerate("abcd")}})


class Tree:
    """A signature tree over sets: levels of nodes, leaves last, each of FANOUT children."""

    def __init__(self, sets: list[np.ndarray], ratio: float = 1.25):
        size = np.array([len(s) for s in sets])
        band = np.floor(np.log(size) / np.log(ratio)).astype(np.int64)
        self.order = np.lexsort((size, np.array([s[0] for s in sets], np.uint64), band))
        self.sets = [sets[i] for i in self.order]
        m = len(sets)
        bits = np.zeros((m, BITS // 64), np.uint64)
        for i, s in enumerate(self.sets):
            b = (s & U(BITS - 1)).astype(np.int64)
            np.bitwise_or.at(bits[i], b >> 6, U(1) << (b & 63).astype(np.uint64))
        size = size[self.order]
        extra = size - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, size, size, extra)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, x = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(x, at)))
        self.levels.reverse()


def _possible(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of nodes may hold linked sets."""
    keep = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 14):
        i, j = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
        sizes = (a[2][i] * den >= b[1][j] * num) & (b[2][j] * den >= a[1][i] * num)
        overlap = np.bitwise_count(a[0][i] & b[0][j]).sum(1) + np.minimum(a[3][i], b[3][j])
        overlap = np.minimum(overlap, np.minimum(a[2][i], b[2][j]))
        keep[at : at + (1 << 14)] = sizes & (overlap * (num + den) >= num * (a[1][i] + b[1][j]))
    return keep


def tree_links(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, num: int, den: int, walked: dict | None = None):
    """Yields (ia, ib, linked) for pairs of coarse nodes: indices into both lists, and a matrix.

    With sets_b None, sets_a is joined with itself and each pair comes once. walked gets the number of
    pairs of inner nodes and of leaves that were looked at and dropped."""
    A = Tree(sets_a, 1.01 * den / num)
    B = Tree(sets_b, 1.01 * den / num) if sets_b is not None else A
    same = B is A
    depth = max(len(A.levels), len(B.levels))
    la = [A.levels[0]] * (depth - len(A.levels)) + A.levels
    lb = [B.levels[0]] * (depth - len(B.levels)) + B.levels

    def kept(d, x, y):
        keep = _possible(la[d], lb[d], x, y, num, den)
        if walked is not None:
            kind = "leaves" if d == depth - 1 else "inner"
            walked[kind] = walked.get(kind, 0) + len(x)
            walked[f"{kind} dropped"] = walked.get(f"{kind} dropped", 0) + int((~keep).sum())
        return x[keep], y[keep]

    def down(d, x, y):
        """The pairs of children at level d + 1 of pairs at level d."""
        x, y = _children(x, y, FANOUT if la[d + 1] is not la[d] else 1, FANOUT if lb[d + 1] is not lb[d] else 1, len(la[d + 1][0]), len(lb[d + 1][0]))
        if same:
            some = (x < y) if d + 1 == depth - 1 else (x <= y)
            x, y = x[some], y[some]
        return x, y

    x = y = np.zeros(1, np.int64)
    coarse = max(0, depth - 1 - COARSE)
    for d in range(coarse):
        x, y = down(d, *kept(d, x, y))
    for i, j in zip(x, y):
        p, q = np.array([i]), np.array([j])
        for d in range(coarse, depth - 1):
            p, q = down(d, *kept(d, p, q))
        if same and depth == 1:
            return
        p, q = kept(depth - 1, p, q)
        if not len(p):
            continue
        ra, at_a = np.unique(p, return_inverse=True)
        rb, at_b = np.unique(q, return_inverse=True)
        may = np.zeros((len(ra), len(rb)), bool)
        may[at_a, at_b] = True
        inter = _overlaps([A.sets[r] for r in ra], [B.sets[r] for r in rb])
        union = A.levels[-1][1][ra][:, None] + B.levels[-1][1][rb][None, :] - inter
        yield A.order[ra], B.order[rb], (den * inter >= num * union) & may


def _children(x, y, fa, fb, na, nb):
    cx = (x[:, None] * fa + np.arange(fa)[None, :]) if fa > 1 else x[:, None]
    cy = (y[:, None] * fb + np.arange(fb)[None, :]) if fb > 1 else y[:, None]
    px = np.repeat(cx, cy.shape[1], axis=1).reshape(-1)
    py = np.tile(cy, (1, cx.shape[1])).reshape(-1)
    some = (px < na) & (py < nb)
    return px[some], py[some]


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two short lists of sets."""
    vocabulary = H.distinct(np.concatenate(a))
    out = np.zeros((len(a), len(b)), np.int64)
    place_b = []
    for s in b:
        at = np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)
        place_b.append(at[vocabulary[at] == s])
    place_a = [np.searchsorted(vocabulary, s) for s in a]
    step = 1 << 15
    for lo in range(0, len(vocabulary), step):
        ma, mb = (np.zeros((len(p), min(step, len(vocabulary) - lo)), np.float32) for p in (place_a, place_b))
        for m, places in ((ma, place_a), (mb, place_b)):
            for r, p in enumerate(places):
                m[r, p[np.searchsorted(p, lo) : np.searchsorted(p, lo + step)] - lo] = 1
        out += np.rint(ma @ mb.T).astype(np.int64)
    return out


LINKED = "rep long, p long, parent long, n_links long"


def _join_group(t: pa.Table, num: int, den: int) -> pa.Table:
    """All clusters (or pairs of blocks of one) of a group: for each set, its partial number of linked
    documents and a set that it is connected to. i and j: the blocks of a pair; equal for one tree."""
    where: dict[tuple, list[int]] = {}
    seen = set()
    for i, (k, row) in enumerate(zip(zip(*(t[c].to_pylist() for c in ("cluster", "i", "j"))), zip(t["rep"].to_pylist(), t["p"].to_pylist()))):
        if (k, row) not in seen:
            seen.add((k, row))
            where.setdefault(k, []).append(i)
    # two sets may have the same representative, if rows share a doc_id; the set's print tells them apart
    rep, print_, copies, block = (t[c].to_numpy() for c in ("rep", "p", "copies", "block"))
    tokens = t["tokens"]
    out: list[tuple] = []
    for (_, i, j), rows in where.items():
        rows = np.array(rows)
        left = rows[block[rows] == i] if i != j else rows
        right = rows[block[rows] == j] if i != j else None
        if not len(left) or (right is not None and not len(right)):
            continue
        sets = lambda r: [np.frombuffer(tokens[int(x)].as_py(), np.uint64) for x in r]
        root = {int(r): int(r) for r in rows}

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = v = root[root[v]]
            return v

        links = dict.fromkeys(root, 0)
        for a, b, linked in tree_links(sets(left), None if right is None else sets(right), num, den):
            ra, rb = left[a], (left if right is None else right)[b]
            for r, n in zip(ra.tolist(), (linked @ copies[rb]).tolist()):
                links[r] += n
            for r, n in zip(rb.tolist(), (copies[ra] @ linked).tolist()):
                links[r] += n
            fa, fb = np.array([find(v) for v in ra.tolist()]), np.array([find(v) for v in rb.tolist()])
            for p, q in set(zip(*(z.tolist() for z in (fa[np.nonzero(linked)[0]], fb[np.nonzero(linked)[1]])))):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
        out += [(int(rep[v]), int(print_[v]), int(rep[find(v)]), links[v]) for v in root]
    return pa.table({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("rep", "p", "parent", "n_links"))})


def _tokens(n: int):
    names = ["cluster", "block", "pairs", "rep", "copies", "p", "tokens"]

    def made(batches):
        sent = set()  # rows that repeat a document are sent once by a task
        for b in pieces(batches):
            sets = ngram_sets(as_bytes(b.column("text")), n)
            keep = []
            for u, rep, p, q in zip(sets, *(b.column(c).to_pylist() for c in ("rep", "p", "q"))):
                keep.append(set_print(u) == (p, q) and (rep, p) not in sent)
                if keep[-1]:
                    sent.add((rep, p))
            mask = pa.array(keep, pa.bool_())
            cols = [b.column(c).filter(mask) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([u.tobytes() for u, k in zip(sets, keep) if k], pa.binary())], names)

    return made


def _blocks(member: DataFrame, ratio: float, block_mb: float) -> DataFrame:
    """Members of clusters of two sets or more, each with its block and the pairs of blocks (struct i, j)
    that it takes part in. A cluster of a tenth of block_mb is one block; others have blocks of their size
    bands, by the bytes of their tokens, and a band is joined with itself and the next one. A band has up to
    SPREAD blocks before they are full, so that several tasks share it; from then on blocks are as large as
    may be, since each set goes to a task for every block of its band."""
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(np.log(ratio)))).cast("long")
    weight = 8 * F.col("n_shingles") + SET_BYTES
    cluster = member.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum(weight).alias("bytes")).where("sets > 1")
    member = member.withColumn("band", band)
    bands = member.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.sum(weight) / F.lit(block_mb * 1e6)), F.least(F.lit(SPREAD), F.ceil(F.sum(weight) / F.lit(block_mb * 1e5)))).cast("int").alias("nb"))
    w = Window.partitionBy("cluster").orderBy("band")  # a row for each size band: some dozens at most
    near = lambda f, k: F.when(f("band").over(w) == F.col("band") + k, f("nb").over(w)).otherwise(0)
    bands = bands.join(cluster.where(F.col("bytes") > block_mb * 1e5).select("cluster"), "cluster", "left_semi").select("cluster", "band", "nb", near(F.lead, 1).alias("above"), near(F.lag, -1).alias("below"))
    got = member.join(cluster.select("cluster"), "cluster").join(bands, ["cluster", "band"], "left")
    at = lambda b, i: b * (1 << 24) + i.cast("long")
    own = F.when(F.col("nb").isNull(), F.lit(0).cast("long")).otherwise(at(F.col("band"), F.pmod("p", "nb")))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    none = F.array().cast("array<struct<i:bigint,j:bigint>>")
    inside = F.transform(upto(F.col("nb")), lambda k: pair(F.least("block", at(F.col("band"), k)), F.greatest("block", at(F.col("band"), k))))
    up = F.when(F.col("above") > 0, F.transform(upto(F.col("above")), lambda k: pair(F.col("block"), at(F.col("band") + 1, k)))).otherwise(none)
    low = F.when(F.col("below") > 0, F.transform(upto(F.col("below")), lambda k: pair(at(F.col("band") - 1, k), F.col("block")))).otherwise(none)
    pairs = F.when(F.col("nb").isNull(), F.array(pair(F.col("block"), F.col("block")))).otherwise(F.concat(inside, up, low))
    return got.withColumn("block", own).select("rep", "p", "q", "copies", "cluster", "block", pairs.alias("pairs"))


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, slice_mb: float = SLICE_MB, block_mb: float = BLOCK_MB, fan: int | None = None) -> DataFrame:
    """Link documents whose sets of word n-grams have den * intersection >= num * union.

    Returns a row for each document: doc_id, n_shingles (size of its set), class_id (smallest doc_id
    with the same set), n_links (other documents that it links to, those of the same set included),
    component_id (smallest doc_id reachable by links, its own included)."""
    n_slices = parts(docs, slice_mb)
    base = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cells = parts(docs, CELL_BYTES * 1e-6 * (1 << LEAST_CELLS), 1)
    frequent = Sketch(base, n, min(MOST_CELLS, LEAST_CELLS + (cells - 1).bit_length()), parts(docs, LOT_MB, 1))
    way = Route(n_slices, fan)
    sent = base.mapInArrow(trimmed(_describe(n, num, den, n_slices, frequent, way)), MESSAGE)
    told = materialize(way.relayed(sent).groupBy("slice").applyInArrow(trimmed(way.receiving(lambda t: _meet(t))), FOUND), "jaccard")
    meta = told.where("kind <> 1").select(F.when(F.col("kind") == 0, F.col("a")).alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("p"), F.col("d").alias("q"))
    named = meta.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(named.groupBy("p", "q", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    cluster = connected_components(told.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    member = classes.join(cluster, classes.p == cluster.id).select("rep", "p", "q", "n_shingles", "copies", F.col("label").alias("cluster"))
    sized = materialize(_blocks(member, 1.01 * den / num, block_mb), "members")
    few = sized.count() <= BROADCAST_ROWS
    picked = (F.broadcast(sized) if few else sized).select("rep", "p", "q", "copies", "cluster", "block", "pairs")
    sets = base.join(picked, base.doc_id == F.col("rep")).select("text", "cluster", "block", "pairs", "rep", "copies", "p", "q").mapInArrow(trimmed(_tokens(n)), "cluster long, block long, pairs array<struct<i:bigint,j:bigint>>, rep long, copies long, p long, tokens binary")
    # a group is a pair of blocks of a large cluster, or some small clusters
    pair = sets.select("cluster", "block", "rep", "copies", "p", "tokens", F.explode("pairs").alias("pair")).select("cluster", "block", "rep", "copies", "p", "tokens", "pair.i", "pair.j")
    bucket = F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("cluster"), F.lit(4 * n_slices))).otherwise(F.xxhash64("cluster", "i", "j"))
    links = materialize(pair.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(trimmed(lambda t: _join_group(t, num, den)), LINKED), "links")
    n_links = links.groupBy("rep", "p").agg(F.sum("n_links").alias("more"))
    # rows that share a doc_id are one node, so the classes that they are in are tied to each other
    least = named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    sharing = named.join(least, "doc_id").join(classes, ["p", "q", "n_shingles"]).select("doc_id", "rep").distinct()
    ties = sharing.join(sharing.groupBy("doc_id").agg(F.min("rep").alias("first")), "doc_id").select(F.col("rep").alias("src"), F.col("first").alias("dst"))
    component = connected_components(links.select(F.col("rep").alias("src"), F.col("parent").alias("dst")).unionByName(ties))
    of = classes.join(n_links, ["rep", "p"], "left").join(component, F.col("rep") == F.col("id"), "left").where("copies > 1 OR more IS NOT NULL OR label IS NOT NULL")
    of = materialize(of.select("p", "q", "n_shingles", "rep", "copies", "more", F.coalesce("label", "rep").alias("label")), "linked")
    discard(cluster, component, sized, links, classes)
    if of.count() <= BROADCAST_ROWS:
        of = F.broadcast(of)
    got = meta.join(of, ["p", "q", "n_shingles"], "left")
    tied = F.col("doc_id").isNotNull()
    return got.select("doc_id", "n_shingles", F.when(tied, F.coalesce("rep", "doc_id")).alias("class_id"), F.when(tied, F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("more", F.lit(0))).otherwise(F.lit(0).cast("long")).alias("n_links"), F.when(tied, F.coalesce("label", "doc_id")).alias("component_id"))
