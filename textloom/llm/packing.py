"""Packing of tokenized documents into fixed-length sequences, in bounded space and online.

Each partition keeps OPEN_WINDOWS windows that are not full. A document is cut into whole windows,
each a sequence of its own, and a rest. The rest goes where it fits best: into the open window with
the least room that still holds it; if none holds it and no window can be opened, the fullest one is
topped up with the rest's head and emitted, and what remains of the rest is placed again. At its end
a partition hands on its open windows; these leftovers are merged in rounds of GATHER partitions
each, by the same rule, until one task has them all: it then joins them from the fullest on, so that
at most one sequence of the whole output is not full.

Every task sorts nothing and holds the open windows and one batch only. Leftover rounds sort what
they read by (doc_id, start, ...) so that a task that runs again emits the same sequences.

Defined results: null text is empty, so its document is the end token alone; very long texts are
many sequences; of windows with equal room the one opened first is taken; rows that share a doc_id are packed each on their own; a null doc_id stays null;
an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import bounded_batches, materialize, trimmed

LENGTH = 2048
END_ID = 1
OPEN_WINDOWS = 64
GATHER = 64

PIECE = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())])
_NAMES = [f.name for f in PIECE.fields]
_TYPES = [pa.int64()] * 7 + [pa.binary()]


class Encoder:
    """Ids of a tokenizers JSON file with byte-level BPE, as that library gives them.

    The vocabulary and merges of the file are run by tiktoken's engine, some six times as fast; texts
    that hold one of the file's special tokens go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.exact = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        plain = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer") and not spec["pre_tokenizer"].get("add_prefix_space") and _ordered(spec, ranks, byte_of)
        self.fast = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if plain else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


#: The split of byte-level BPE (fixed value of the public tokenizer).
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b], extra = chr(256 + extra), extra + 1
    return out


def _ordered(spec: dict, ranks: dict, byte_of: dict) -> bool:
    """Whether ids ascend in the order of the merges, as ranks need."""
    last = -1
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        now = ranks.get(bytes(byte_of[c] for c in a + b), -1)
        if now <= last:
            return False
        last = now
    return True


class Packer:
    """The open windows of one partition; emit() gets each full window as a list of pieces."""

    def __init__(self, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.open: list[list] = []
        self.room: list[int] = []

    def place(self, piece: tuple) -> list[list]:
        """piece: (doc_id, start, ids, doc_tokens)."""
        full = []
        doc, start, ids, total = piece
        at = 0
        while len(ids) - at >= self.length:
            full.append([(doc, start + at, ids[at : at + self.length], total)])
            at += self.length
        while at < len(ids):
            n = len(ids) - at
            fits = [i for i, r in enumerate(self.room) if r >= n]
            if fits:
                i = min(fits, key=lambda i: self.room[i])
                take = n
            elif len(self.open) < self.most:
                self.open.append([])
                self.room.append(self.length)
                i, take = len(self.open) - 1, n
            else:
                i = min(range(len(self.room)), key=lambda i: self.room[i])
                take = self.room[i]
            self.open[i].append((doc, start + at, ids[at : at + take], total))
            self.room[i] -= take
            at += take
            if not self.room[i]:
                full.append(self.open.pop(i))
                self.room.pop(i)
        return full

    def rest(self) -> list[list]:
        order = sorted(range(len(self.open)), key=lambda i: self.room[i])
        out = [self.open[i] for i in order]
        self.open, self.room = [], []
        return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _finished(window: list, sequence: int) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, total in window:
        out.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, sequence, offset, None))
        offset += len(ids)
    return out


def _left(windows: list[list]) -> list[tuple]:
    return [(doc, start, len(ids), None, total, None, None, np.ascontiguousarray(ids, "<u4").tobytes()) for w in windows for doc, start, ids, total in w]


class _Ids:
    """Sequence numbers that no other task gives: round, partition, count."""

    def __init__(self, rnd: int):
        from pyspark import TaskContext

        self.next = (rnd << 58) | (TaskContext.get().partitionId() << 32)

    def __call__(self) -> int:
        self.next += 1
        return self.next - 1


_encoders: dict[str, Encoder] = {}


def _first(path: str, length: int, open_windows: int, end_id: int):
    def packed(batches):
        enc = _encoders.setdefault(path, None) or Encoder(path)
        _encoders[path] = enc
        packer, number, rows = Packer(length, open_windows), _Ids(0), []
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(enc.encode(text or ""), np.uint32(end_id))
                for window in packer.place((doc, 0, ids, len(ids))):
                    rows += _finished(window, number())
            if len(rows) > 1000:
                yield _table(rows)
                rows = []
        yield _table(rows + _left(packer.rest()))

    return packed


def _again(length: int, open_windows: int, rnd: int, last: bool):
    def packed(batches):
        packer, number, rows = Packer(length, open_windows), _Ids(rnd), []
        for b in batches:
            for doc, start, ids, total in zip(*(b.column(k).to_pylist() for k in ("doc_id", "start", "ids", "doc_tokens"))):
                for window in packer.place((doc, start, np.frombuffer(ids, "<u4"), total)):
                    rows += _finished(window, number())
            if len(rows) > 1000:
                yield _table(rows)
                rows = []
        windows = packer.rest()
        if last:
            joined = Packer(length, 1)
            for window in windows:
                for piece in window:
                    for w in joined.place(piece):
                        rows += _finished(w, number())
            for w in joined.rest():
                rows += _finished(w, number())
            windows = []
        yield _table(rows + _left(windows))

    return packed


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, gather: int = GATHER) -> DataFrame:
    """A row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Every id of every document, with the end token, is in exactly one piece."""
    base = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = materialize(base.mapInArrow(trimmed(_first(tokenizer, length, open_windows, end_id)), PIECE), "packing")
    whole = done.where("sequence_id IS NOT NULL")
    left = done.where("sequence_id IS NULL")
    # a task of a round gets as many ids as `gather` partitions have in half-full open windows
    ids = left.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(ids / (gather * open_windows * length / 2)))
    rnd = 1
    while True:
        dealt = left.repartition(groups, F.xxhash64("doc_id", "start")) if groups > 1 else left.coalesce(1)
        merged = dealt.sortWithinPartitions("doc_id", "start", "doc_tokens", "length", "ids").mapInArrow(_again(length, open_windows, rnd, groups == 1), PIECE)
        if groups == 1:
            return whole.unionByName(merged).drop("ids")
        merged = materialize(merged, "packing")
        whole = whole.unionByName(merged.where("sequence_id IS NOT NULL"))
        left, groups, rnd = merged.where("sequence_id IS NULL"), math.ceil(groups / gather), rnd + 1
