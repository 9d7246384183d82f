"""Quality rules: word, line and repetition counts, and bands of zstandard compression ratios.

A text compresses by more than prose does if it repeats itself, and by less if it is noise. The ratio
(compressed to raw bytes) depends on the length, so each length has its own band; a text of fixed
chunks of CHUNK bytes is also judged by how many of them fall outside the band of a chunk, which finds
repetitive passages within long prose. Where chunks leave a rest, one more ends at the end of the text,
so every byte of a text of CHUNK bytes or more is in a chunk. Nothing is learned and no text is looked at twice: one pass,
no shuffle.

Defined results: null or empty text has no words and fails the base rule; texts below the first
length of BANDS have no band and are judged by the base rule alone; very long texts are judged whole; a ratio
equal to a limit is inside its band; repeated rows return a row each;
an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.common import as_bytes, pieces

LEVEL = 3
CHUNK = 2048
#: (bytes from, least ratio, largest ratio), by ascending length.
BANDS = ((200, 0.30, 1.00), (500, 0.25, 0.90), (1000, 0.20, 0.80), (4000, 0.17, 0.75), (16000, 0.14, 0.70))
CHUNK_BAND = (0.20, 0.80)
#: A text is rejected if more than this share of its chunks is outside CHUNK_BAND.
CHUNK_SHARE = 0.20
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # of 100 words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunks long, odd_chunks long, kept boolean"
_TYPES = (pa.int64(),) * 6 + (pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())


def repeated_words(h: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words under windows that occur twice or more."""
    w = H.windows(h, width)
    if len(w) < 2:
        return 0
    order = np.sort(w)
    twice = H.distinct(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, w), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == w)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def compression(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """Ratio of the whole text, number of chunks, chunks outside their band; the verdict."""
    if not raw:
        return None, 0, 0, True
    ratio = len(compressor.compress(raw)) / len(raw)
    starts = list(range(0, len(raw) - CHUNK + 1, CHUNK))
    if starts and len(raw) % CHUNK:
        starts.append(len(raw) - CHUNK)
    chunks, odd = len(starts), 0
    for i in starts:
        r = len(compressor.compress(raw[i : i + CHUNK])) / CHUNK
        odd += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
    good = odd <= CHUNK_SHARE * chunks
    for low, least, most in reversed(BANDS):
        if len(raw) >= low:
            good &= least <= ratio <= most
            break
    return ratio, chunks, odd, good


def _rules(batches):
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for b in pieces(batches):
        rows = []
        texts = as_bytes(b.column("text"))
        h, owner = H.words(texts)
        ends = np.cumsum(np.bincount(owner, minlength=len(texts))) if len(texts) else []
        at = 0
        for doc, raw, end in zip(b.column("doc_id").to_pylist(), texts, ends):
            words, at = h[at:end], end
            a = np.frombuffer(raw, np.uint8)
            lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
            repeat = repeated_words(words)
            failed = len(words) < LEAST_WORDS or 100 * repeat > MOST_REPEATED * len(words)
            ratio, chunks, odd, good = compression(raw, compressor)
            rows.append((doc, len(words), int((_FIRST[a] & ~H.SPACE[a]).sum()), int(_SYMBOL[a].sum()), len(lines) - len(set(lines)), repeat, failed, ratio, chunks, odd, good and not failed))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], [f.split()[0] for f in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row for each document: its counts, base_failed, compression figures, kept."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rules, SCHEMA)
