"""Exact removal of repeated byte strings, by merging the suffix orders and BWTs of shards.

A byte goes if it is covered by a string of LENGTH bytes that starts anywhere else too.

1. Windows of LENGTH bytes are put in pieces: neighbours whose least k-gram hash is at the same
   place, the anchor. Equal windows have equal anchors at equal offsets, so only pieces with the same
   anchor gram can hold them. A shard sends each distinct piece once, as fingerprints; slices of the
   fingerprint space tell it which whole pieces occur again (those are done), and which share their
   anchor with other pieces. Only these are sorted and merged.
2. A shard sorts the suffixes that start at its anchors, once (suffix_order). What it sends to a slice
   is that order with its common prefixes (lcp): the right contexts, each without what it shares with
   the one before, and the BWT symbols of the suffixes, that is the bytes before each, nearest first.
3. A slice merges the orders of all shards (merge_orders). The interleave starts with the shards in turn
   and is refined iteratively: round t deals the entries of each block of equal prefixes out, stably, by
   their next SYMBOL bytes, and where a block parts is the common prefix of the two neighbours. Entries
   of one shard never change places among themselves, so no shard is sorted anew, and entries alone in
   their block take no part in later rounds.
4. From the merged order repeated_windows() walks left as the LF mapping does: step o deals the entries
   out, by a stable counting pass within their blocks, by the o-th BWT symbol. Then the blocks hold what
   agrees in the o bytes before the anchor, still in the order of their right contexts, whose common
   prefixes are range minima of the merged lcp. A repeated interval is a run of neighbours with
   o + lcp >= LENGTH: their windows that start o bytes before the anchor are equal.
5. Shards get a bit for each window that they sent, and remove the bytes covered.

An anchor with more than HOT distinct pieces would be one large block in one task. Its pieces are cut into
smaller ones of SPLIT windows by their place before the anchor; the bytes which these have in common are
the longer anchor that they are dealt by. They are sorted, sent and merged like all others.

Defined results: null text is empty; texts shorter than LENGTH are kept; a string that repeats within
one document counts, overlaps too; very long texts are whole in one shard; rows that share a doc_id are
separate documents; a null doc_id stays null; an empty table gives no rows; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import hashing as H
from textloom.llm.common import as_bytes, bounded_batches, parts, trimmed
from textloom.llm.exchange import MESSAGE, TYPES, Route, messages

LENGTH = 200
GRAM = 48
SYMBOL = 8
SHARD_MB = 4.0
SLICE_MB = 8.0
HOT = 20_000
SPLIT = 8
BATCH_PIECES = 20_000
U = np.uint64
SPREAD = U(0x5BE0CD19137E2179)  # anchors are least hashes, so slices go by another one


def _rows(rows: list[tuple]) -> pa.Table:
    return messages({k: [r[i] for r in rows] for i, k in enumerate(TYPES)})


def _sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` consecutive hashes; of equal ones, the first."""
    n = len(hashes)
    key = (hashes & ~U((1 << 30) - 1)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    m = n - width + 1
    return (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & U((1 << 30) - 1)).astype(np.int64)


class Shard:
    """The pieces of a shard's documents, and the distinct ones in the order of messages."""

    def __init__(self, t: pa.Table, length: int, gram: int):
        self.length, self.texts = length, as_bytes(t["text"])
        cols: list[tuple] = []
        for lo, hi in H.blocks(self.texts):
            raw = np.frombuffer(b"".join(self.texts[lo:hi]), np.uint8)
            if len(raw) < length:
                continue
            sizes = np.array([len(x) for x in self.texts[lo:hi]])
            begin = np.cumsum(sizes) - sizes
            power, inverse = H._powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(H.BYTE_CODE[raw] * power[: len(raw)], out=total[1:])
            grams = H.mix((total[gram:] - total[:-gram]) * inverse[: len(raw) - gram + 1])
            anchor = _sliding_argmin(grams, length - gram + 1)
            owner = np.repeat(np.arange(hi - lo), sizes)
            inside = owner[: len(raw) - length + 1] == owner[length - 1 :]
            edge = np.ones(len(anchor), bool)
            edge[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
            first = np.flatnonzero(edge & inside)
            if not len(first):
                continue
            stop = np.flatnonzero(np.append(edge[1:] | ~inside[1:], True) & inside) + 1
            end = stop - 1 + length
            content = H.mix((total[end] - total[first]) * inverse[first] ^ (end - first).astype(np.uint64))
            cols.append((owner[first] + lo, first - begin[owner[first]], stop - first, anchor[first] - first, H.mix(grams[anchor[first]] ^ SPREAD), content))
        z = [np.concatenate(c) for c in zip(*cols)] if cols else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        self.doc, self.start, self.windows, self.offset, self.key, self.content = z
        order = np.lexsort((self.content, self.key))
        new = np.ones(len(order), bool)
        k, c = self.key[order], self.content[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        self.first = order[new]  # a piece for each distinct one
        self.which = np.zeros(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.count = np.bincount(self.which, minlength=len(self.first))

    def piece(self, i: int) -> bytes:
        s = self.start[i]
        return self.texts[self.doc[i]][s : s + self.windows[i] + self.length - 1]

    def flags(self, replies: pa.Table, n_slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces: occurs again as a whole; to be merged; its anchor is hot."""
        edges = H.slice_edges(self.key[self.first], n_slices)
        got = {s: (a, b, c) for s, r, a, b, c in zip(*(replies[k].to_pylist() for k in ("slice", "row", "a", "b", "c"))) if r == 0}
        out = [np.zeros(len(self.first), bool) for _ in range(3)]
        for s in np.flatnonzero(np.diff(edges)):
            for flag, bits in zip(out, got[int(s)]):
                flag[edges[s] : edges[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=edges[s + 1] - edges[s])
        return tuple(out)

    def chosen(self, merge: np.ndarray, hot: np.ndarray) -> "Order":
        """The pieces to be merged and the smaller ones of hot pieces, in suffix order."""
        i = np.flatnonzero(merge)
        f = self.first[i]
        cols = [(i, np.zeros(len(i), np.int64), self.windows[f], self.offset[f], self.key[f])]
        for j in np.flatnonzero(hot):
            raw = np.frombuffer(self.piece(self.first[j]), np.uint8)
            n, a = int(self.windows[self.first[j]]), int(self.offset[self.first[j]])
            m = np.arange((a - n + 1) // SPLIT, a // SPLIT + 1)  # windows that start SPLIT * m to SPLIT * (m + 1) - 1 bytes before the anchor
            first, last = np.maximum(a - SPLIT * m - SPLIT + 1, 0), np.minimum(a - SPLIT * m, n - 1)
            lo = a - SPLIT * m  # what all windows of that kind have in common starts here
            hi = lo + self.length - SPLIT + 1
            key = H.mix(H.span_hashes(raw, lo, np.minimum(hi, len(raw))) ^ SPREAD)
            cols.append((np.full(len(m), j), first, last - first + 1, lo - first, key))
        return Order(self, [np.concatenate(c) for c in zip(*cols)])


class Order:
    """Suffixes at the anchors of some pieces of a shard, sorted by anchor and right context."""

    def __init__(self, shard: Shard, columns: list[np.ndarray]):
        length = shard.length
        j, place, windows, offset, key = columns
        left, right = [], []
        for i, p, w, a in zip(shard.first[j].tolist(), place.tolist(), windows.tolist(), offset.tolist()):
            s = shard.start[i] + p
            text = shard.texts[shard.doc[i]]
            left.append(text[s : s + a][::-1])
            right.append(text[s + a : s + w + length - 1])
        order = np.array(suffix_order(key, right), np.int64)
        self.piece, self.place, self.windows, self.offset, self.key = j[order], place[order], windows[order], offset[order], key[order]
        self.bwt, self.right = [left[i] for i in order], [right[i] for i in order]
        self.lcp = [0] * len(order)
        for i in range(1, len(order)):
            if self.key[i] == self.key[i - 1]:
                x, y = self.right[i - 1], self.right[i]
                self.lcp[i] = len(y) if x.startswith(y) else _common(x, y)

    def message(self, lo: int, hi: int, compressor: zstandard.ZstdCompressor) -> tuple[bytes, bytes, bytes]:
        """Entries lo to hi: anchors; front-coded right contexts and BWT symbols; windows, offsets, lcp."""
        lcp = [0, *self.lcp[lo + 1 : hi]]
        right = compressor.compress(b"".join(r[n:] for r, n in zip(self.right[lo:hi], lcp)))
        bwt = compressor.compress(b"".join(self.bwt[lo:hi]))
        return H.pack(self.key[lo:hi]), len(right).to_bytes(8, "little") + right + bwt, H.pack_any(np.concatenate([self.windows[lo:hi], self.offset[lo:hi], np.array(lcp, np.int64)]))


def suffix_order(key: np.ndarray, right: list[bytes]) -> list[int]:
    keys = key.tolist()
    return sorted(range(len(right)), key=lambda i: (keys[i], right[i]))


def _common(x: bytes, y: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(x), len(y))
    lo = 0
    while lo < n:  # by halves: slices compare fast
        mid = (lo + n + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            n = mid - 1
    return lo


def _shard(t: pa.Table) -> int:
    return t["shard"][0].as_py()


def tell_pieces(t: pa.Table, length: int, gram: int, n_slices: int) -> pa.Table:
    x = Shard(t, length, gram)
    key, content, twice = x.key[x.first], x.content[x.first], x.count > 1
    e = H.slice_edges(key, n_slices)
    return _rows([(int(s), _shard(t), 0, H.pack(key[e[s] : e[s + 1]]), content[e[s] : e[s + 1]].tobytes(), np.packbits(twice[e[s] : e[s + 1]]).tobytes()) for s in np.flatnonzero(np.diff(e))])


def compare_pieces(t: pa.Table, hot: int) -> pa.Table:
    """Which pieces occur again, which share their anchor with others (the first shard sends those that
    several have), and which anchors are hot."""
    keys = [H.unpack(x) for x in t["a"].to_pylist()]
    sizes = [len(k) for k in keys]
    key = np.concatenate(keys)
    content = np.concatenate([np.frombuffer(x, np.uint64) for x in t["b"].to_pylist()])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t["c"].to_pylist(), sizes)]).astype(np.int64)
    shard = np.repeat(t["shard"].to_numpy(), sizes)
    order = np.lexsort((shard, content, key))
    k, c = key[order], content[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= c[1:] != c[:-1]
    piece, anchor = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    n_of_piece = np.bincount(piece, 1 + twice[order])
    pieces_of_anchor = np.bincount(anchor[new])
    again, others, warm = np.zeros(len(k), bool), np.zeros(len(k), bool), np.zeros(len(k), bool)
    again[order] = n_of_piece[piece] > 1
    many = pieces_of_anchor[anchor]
    others[order] = (many > 1) & (many <= hot) & new
    warm[order] = many > hot
    out, at = [], 0
    for s, r, n in zip(t["slice"].to_pylist(), t["shard"].to_pylist(), sizes):
        out.append((s, r, 0, *(np.packbits(f[at : at + n]).tobytes() for f in (again, others, warm))))
        at += n
    return _rows(out)


def send_orders(t: pa.Table, replies: pa.Table, length: int, gram: int, n_slices: int) -> pa.Table:
    if not t.num_rows:
        return _rows([])
    x = Shard(t, length, gram)
    _, merge, hot = x.flags(replies, n_slices)
    order, compressor = x.chosen(merge, hot), zstandard.ZstdCompressor(level=1)
    e = H.slice_edges(order.key, n_slices)
    return _rows([(int(s), _shard(t), 1, *order.message(e[s], e[s + 1], compressor)) for s in np.flatnonzero(np.diff(e))])


class Entries:
    """Entries of several shards, shard by shard, as matrices; offsets from least to most have windows."""

    def __init__(self, length: int, key, windows, offset, right: list[bytes], bwt: list[bytes]):
        self.key, self.length, self.most, self.least = key, length, offset, offset - windows + 1
        n, wide = len(key), -(-length // SYMBOL) * SYMBOL
        self.right = np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in right), np.uint8).reshape(n, wide)
        deep = int(offset.max(initial=0))
        self.bwt = np.frombuffer(b"".join(b.ljust(deep, b"\0") for b in bwt), np.uint8).reshape(n, deep)


def merge_orders(x: Entries) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the entries, and the common prefix of each with the one before it in that
    order (0 where the anchors differ). x has the shards in turn, each in its suffix order."""
    n = len(x.key)
    lcp = np.zeros(n, np.int64)
    symbols = np.ascontiguousarray(x.right).view(">u8").astype(np.uint64)
    interleave = np.argsort(x.key, kind="stable")
    _, block = np.unique(x.key[interleave], return_inverse=True)
    live = np.arange(n)  # places of the interleave whose block has others
    for t in range(symbols.shape[1]):
        twice = np.zeros(len(live), bool)
        same = block[live[1:]] == block[live[:-1]]
        twice[1:] |= same
        twice[:-1] |= same
        live = live[twice]
        if not len(live):
            break
        who, b = interleave[live], block[live]
        dealt = np.lexsort((symbols[who, t], b))
        who = who[dealt]
        interleave[live] = who
        s = symbols[who, t]
        part = (b[1:] == b[:-1]) & (s[1:] != s[:-1])  # a block parts here
        high = s[1:][part] ^ s[:-1][part]
        lcp[live[1:][part]] = SYMBOL * t + _equal_bytes(high)
        # a block number for each place: the first place of the block, so that settled places keep theirs
        new = np.ones(len(live), bool)
        new[1:] = (b[1:] != b[:-1]) | (s[1:] != s[:-1])
        block[live] = (n + live[new])[np.cumsum(new) - 1] + n * (t + 1)
    same = block[1:] == block[:-1]
    lcp[1:][same] = x.length
    return interleave, np.minimum(lcp, x.length)


def _equal_bytes(difference: np.ndarray) -> np.ndarray:
    """How many leading bytes of 8 are 0."""
    out = np.zeros(len(difference), np.int64)
    for k in range(1, SYMBOL):
        out += difference < U(1) << U(64 - 8 * k)
    return out


class RangeMinimum:
    """Least of values[i : j] for many pairs, from tables of the least of 2 ** k neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [values.astype(np.uint16)]
        while 2 ** len(self.levels) <= len(values):
            v, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(v[:-half], v[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp((j - i).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            v = self.levels[k]
            out[at] = np.minimum(v[i[at]], v[j[at] - (1 << int(k))])
        return out


def repeated_windows(x: Entries) -> tuple[np.ndarray, np.ndarray]:
    """(entry, offset) of the windows that occur more than once among the entries."""
    interleave, lcp = merge_orders(x)
    least, most, bwt = x.least[interleave], x.most[interleave], x.bwt[interleave]
    rmq = RangeMinimum(lcp)
    _, block = np.unique(x.key[interleave], return_inverse=True)
    live, who, offsets = np.arange(len(interleave)), [], []
    for o in range(int(most.max(initial=-1)) + 1):
        reach = most[live] >= o
        live, block = live[reach], block[reach]
        if o and len(live):
            symbol = (block << 8) | bwt[live, o - 1]
            dealt = np.argsort(symbol, kind="stable")
            live, symbol = live[dealt], symbol[dealt]
            block = np.cumsum(np.append(False, symbol[1:] != symbol[:-1]))
        if not o & (o - 1) or not o % 16:
            # an entry alone in its block, or too unlike its neighbours for any window, has none further left
            same = np.flatnonzero(block[1:] == block[:-1])
            r = np.full(max(0, len(live) - 1), -1)
            r[same] = rmq(live[same] + 1, live[same + 1] + 1)
            best = np.maximum(np.append(-1, r), np.append(r, -1))[: len(live)]
            keep = (best >= 0) & (best + most[live] >= x.length)
            live, block = live[keep], block[keep]
        if not len(live):
            break
        has = least[live] <= o
        v, b = live[has], block[has]
        same = np.flatnonzero(b[1:] == b[:-1])
        equal = same[rmq(v[same] + 1, v[same + 1] + 1) >= x.length - o]
        hit = np.union1d(v[equal], v[equal + 1])
        who.append(interleave[hit])
        offsets.append(np.full(len(hit), o))
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *who]), np.concatenate([z, *offsets])


def _entries(keys, rows, length: int):
    """Right contexts, BWT symbols, windows and offsets of messages, decoded."""
    right, bwt, windows, offset, inflate = [], [], [], [], zstandard.ZstdDecompressor()
    for k, (_, _, _, _, b, c) in zip(keys, rows):
        w, a, lcp = H.unpack_any(c).reshape(3, -1)
        n = int.from_bytes(b[:8], "little")
        tails, symbols = inflate.decompress(b[8 : 8 + n]), inflate.decompress(b[8 + n :])
        sizes, at, last = (w + length - 1 - a).tolist(), 0, b""
        for size, common in zip(sizes, lcp.tolist()):
            last = last[:common] + tails[at : at + size - common]
            at += size - common
            right.append(last)
        at = 0
        for size in a.tolist():
            bwt.append(symbols[at : at + size])
            at += size
        windows.append(w)
        offset.append(a)
    return right, bwt, np.concatenate(windows), np.concatenate(offset)


def merge_shards(t: pa.Table, length: int) -> pa.Table:
    """Merge the orders of a slice; a bit for each window back to its shard."""
    told = sorted(zip(*(t[k].to_pylist() for k in ("slice", "shard", "row", "a", "b", "c"))), key=lambda r: r[1])
    if not told:
        return _rows([])
    keys = [H.unpack(r[3]) for r in told]
    right, bwt, windows, offset = _entries(keys, told, length)
    key = np.concatenate(keys)
    before = np.cumsum(windows) - windows
    bits = np.zeros(int(windows.sum()), bool)
    # anchors are merged in batches, so that the matrices stay small
    order, cuts = np.argsort(key, kind="stable"), [0]
    while cuts[-1] < len(order):
        end = min(len(order), cuts[-1] + BATCH_PIECES)
        while end < len(order) and key[order[end]] == key[order[end - 1]]:
            end += 1
        cuts.append(end)
    for lo, hi in zip(cuts, cuts[1:]):
        p = np.sort(order[lo:hi])  # shard by shard
        who, o = repeated_windows(Entries(length, key[p], windows[p], offset[p], [right[i] for i in p], [bwt[i] for i in p]))
        bits[before[p[who]] + offset[p[who]] - o] = True
    out, at = [], 0
    for r, k in zip(told, keys):
        first = before[at]
        at += len(k)
        out.append((r[0], r[1], 1, np.packbits(bits[first : before[at] if at < len(before) else len(bits)]).tobytes(), None, None))
    return _rows(out)


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())])


def cut(t: pa.Table, replies: pa.Table, length: int, gram: int, n_slices: int, with_bytes: bool) -> pa.Table:
    """Documents without the bytes covered by repeated windows."""
    x = Shard(t, length, gram)
    again, merge, hot = x.flags(replies, n_slices)
    windows = x.windows[x.first]
    base = np.cumsum(windows) - windows
    repeated = np.repeat(again, windows)
    answers = {s: a for s, r, a in zip(*(replies[k].to_pylist() for k in ("slice", "row", "a"))) if r}
    order = x.chosen(merge, hot)
    e = H.slice_edges(order.key, n_slices)
    for s in np.flatnonzero(np.diff(e)):
        n = order.windows[e[s] : e[s + 1]]
        bits = np.unpackbits(np.frombuffer(answers[int(s)], np.uint8), count=int(n.sum())).astype(bool)
        at = np.repeat(base[order.piece[e[s] : e[s + 1]]] + order.place[e[s] : e[s + 1]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        repeated[at] |= bits
    # all pieces, by document
    some = np.add.reduceat(repeated, base).astype(bool) if len(base) else repeated
    by = np.flatnonzero(some[x.which]) if len(base) else x.which
    by = by[np.argsort(x.doc[by], kind="stable")]
    first = np.searchsorted(x.doc[by], np.arange(len(x.texts) + 1))
    rows = []
    for d, raw in enumerate(x.texts):
        spans: list[int] = []
        hit = np.zeros(len(raw) + 1, np.int64)
        for p in by[first[d] : first[d + 1]]:
            w = x.which[p]
            at = x.start[p] + np.flatnonzero(repeated[base[w] : base[w] + windows[w]])
            if len(at):
                hit[at] += 1
                hit[at + length] -= 1
        if hit.any():
            covered = np.zeros(len(raw) + 2, np.int8)
            covered[1:-1] = np.cumsum(hit)[:-1] > 0
            edge = np.diff(covered)
            s, f = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            spans = np.stack([s, f], 1).reshape(-1).tolist()
            left = b"".join(raw[i:j] for i, j in zip([0, *f.tolist()], [*s.tolist(), len(raw)]))
        else:
            left = raw
        rows.append((len(raw), len(raw) - len(left), len(spans) // 2, hashlib.sha256(left).hexdigest(), spans, left if with_bytes else None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
    return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), **{f.name: pa.array([r[i] for r in rows], k) for i, (f, k) in enumerate(zip(RESULT.fields[1:], kinds))}})


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True, shard_mb: float = SHARD_MB, slice_mb: float = SLICE_MB, hot: int = HOT, fan: int | None = None) -> DataFrame:
    """Returns for each document doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends
    of removed runs, in turn, in bytes), kept (the remaining bytes; null unless with_bytes).

    length is a multiple of SYMBOL, and gram is shorter than it."""
    if length % SYMBOL or not SYMBOL <= gram < length:
        raise ValueError("length must be a multiple of 8, and gram from 8 to less than it")
    n_shards, n_slices = parts(docs, shard_mb), parts(docs, slice_mb)
    base = bounded_batches(docs).select(F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    way = Route(n_slices, fan)
    told = base.groupBy("shard").applyInArrow(trimmed(way.sending(lambda t: tell_pieces(t, length, gram, n_slices))), MESSAGE)
    known = way.returned(way.relayed(told).groupBy("slice").applyInArrow(trimmed(way.sending(way.receiving(lambda t: compare_pieces(t, hot)))), MESSAGE))
    sent = base.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(trimmed(way.sending(lambda a, b: send_orders(a, way.opened(b), length, gram, n_slices))), MESSAGE)
    merged = way.returned(way.relayed(sent).groupBy("slice").applyInArrow(trimmed(way.sending(way.receiving(lambda t: merge_shards(t, length)))), MESSAGE))
    answers = known.unionByName(merged)
    return base.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(trimmed(lambda a, b: cut(a, way.opened(b), length, gram, n_slices, with_bytes)), RESULT)
