"""Messages between shards of a table and slices of a key space, some for each slice and back for each shard.

Each shard has something to say to nearly every slice, so rows would grow with shards times slices, that
is with the square of the input. Up to FAN slices that is what is done. With more of them, messages travel
in bundles over one stop: a shard sends a row for each of FAN ranges of slices; a relay task for a range and
a lot of FAN shards opens their bundles and makes one for each slice of the range; answers go back the same
way. So a shard sends and gets FAN rows at most, a slice a row for each lot, and a relay holds what FAN
shards say to one range, about as much as a shard. (The messages inside keep their own few bytes of framing.)

Functions that make messages return a table of MESSAGE, functions that read them get one: sending,
receiving and returning wrap them, relayed and returned are the stops.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import trimmed

FAN = 4096
MESSAGE = "slice int, shard int, row int, a binary, b binary, c binary"
TYPES = {"slice": pa.int32(), "shard": pa.int32(), "row": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
BUNDLE = -(1 << 20)  # row of a bundle: a holds the messages


def messages(columns: dict) -> pa.Table:
    """Columns by name, those that are missing null."""
    return pa.table({k: pa.array(columns.get(k, [None] * len(columns["slice"])), t) for k, t in TYPES.items()})


class Route:
    """The way between shards and a number of slices."""

    def __init__(self, n_slices: int, fan: int | None = None):
        self.n, self.fan = n_slices, fan or FAN
        self.direct = n_slices <= self.fan

    def _range(self, slices: np.ndarray) -> np.ndarray:
        return slices.astype(np.int64) * self.fan // self.n

    def _lot(self, shards: np.ndarray) -> np.ndarray:
        return shards.astype(np.int64) // self.fan

    @staticmethod
    def _bundle(t: pa.Table, slices: np.ndarray, shards: np.ndarray) -> pa.Table:
        """A row for each pair of the two keys, with the messages that have it."""
        order = np.lexsort((shards, slices))
        x, y = slices[order], shards[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(order) else order
        sorted_, bodies = t.take(pa.array(order)), []
        for lo, hi in zip(first, [*first[1:], len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, sorted_.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(sorted_.slice(lo, hi - lo))
            bodies.append(sink.getvalue().to_pybytes())
        return messages({"slice": x[first], "shard": y[first], "row": [BUNDLE] * len(first), "a": bodies})

    @staticmethod
    def _open(t: pa.Table) -> pa.Table:
        rows = t["row"].to_numpy()
        if not (rows == BUNDLE).any():
            return t
        return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in t["a"].to_pylist()])

    def _keys(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t["slice"].to_numpy(), t["shard"].to_numpy()

    def sending(self, make):
        """Messages from a shard, or answers from a slice, on the way to a relay."""
        if self.direct:
            return make

        def bundled(*t: pa.Table) -> pa.Table:
            out = make(*t)
            s, r = self._keys(out)
            return self._bundle(out, self._range(s), self._lot(r))

        return (lambda a, b: bundled(a, b)) if make.__code__.co_argcount == 2 else (lambda t: bundled(t))

    def receiving(self, read):
        """What a slice does with its messages."""
        return read if self.direct else lambda t: read(self._open(t))

    def relayed(self, sent: DataFrame) -> DataFrame:
        """From shards to slices."""
        return sent if self.direct else sent.groupBy("slice", "shard").applyInArrow(trimmed(lambda t: self._relay(t, False)), MESSAGE)

    def returned(self, answers: DataFrame) -> DataFrame:
        """From slices to shards."""
        return answers if self.direct else answers.groupBy("slice", "shard").applyInArrow(trimmed(lambda t: self._relay(t, True)), MESSAGE)

    def opened(self, t: pa.Table) -> pa.Table:
        """What came back to a shard."""
        return t if self.direct else self._open(t)

    def _relay(self, t: pa.Table, back: bool) -> pa.Table:
        t = self._open(t)
        s, r = self._keys(t)
        return self._bundle(t, self._range(s) if back else s, r if back else self._lot(r))
