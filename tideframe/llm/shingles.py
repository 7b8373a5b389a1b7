"""Hashed word shingles of whole texts: words between ASCII spaces, A-Z lower-cased, windows of five words."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

WIDTH = 5
#: Bytes of a text that are hashed at a time, and the longest word that is hashed with them.
PIECE, LONG = 1 << 16, 256
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a permutation of 64-bit integers without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** k modulo 2 ** 64 for k = 0 to n - 1."""
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_BASE = 0xD6E8FEB86659FD93
_UP, _DOWN = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BYTE[list(_SPACES)] = 0
_IS_WORD = np.ones(256, np.int8)
_IS_WORD[list(_SPACES)] = 0


def _piece_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of PIECE bytes at most: sums of a byte's value times a power by its place in the word, which
    differences of one running sum give, as all is modulo 2 ** 64 and the base is odd."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(_IS_WORD[raw], prepend=np.int8(0), append=np.int8(0))
    lo, hi = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _UP[: len(raw)], out=sums[1:])
    size = hi - lo
    out = mix((sums[hi] - sums[lo]) * _DOWN[lo] + size.astype(np.uint64) * _STEP)
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[lo[k] : hi[k]])
    return out


def word_hashes(text: str | None) -> np.ndarray:
    data = (text or "").encode().lower()
    if len(data) <= PIECE:
        return _piece_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = max(data.rfind(c, at, end) for c in _SPACES)
            if end <= at:  # a word that fills the piece, or a space before one
                at += end == at
                end = min((k for k in (data.find(c, at) for c in _SPACES) if k >= 0), default=len(data))
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])] if end - at > LONG else _piece_hashes(data[at:end]), np.uint64))
                at = end
                continue
        out.append(_piece_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def windows(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of every window in order; of fewer words than width, that of the whole sequence; none without words."""
    n = len(words) - width + 1
    if not len(words):
        return words
    h = np.full(max(n, 1), np.uint64(len(words) if n < 1 else width))
    for k in range(len(words) if n < 1 else width):
        h = h * _STEP + (words[k : k + n] if n > 0 else words[k : k + 1])
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(windows(word_hashes(text), width))


def slices(batches, rows: int, text: int | None = None, size: int = 1 << 20):
    """The batches in parts of at most rows rows and, by column number text, size bytes of text or one row."""
    for batch in batches:
        if text is None:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(max(int(np.searchsorted(ends, before + size, "right")), start + 1), start + rows)
            yield batch.slice(start, stop - start)
            start = stop


def packed(texts: DataFrame) -> DataFrame:
    """texts (key, text) with the text compressed, as it will be moved once for each pair."""

    def run(batches):
        for part in slices(batches, 256, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([zlib.compress((t or "").encode(), 1) for t in part.column(1).to_pylist()], pa.binary())], names=["key", "text"])

    return texts.select("key", "text").mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, text binary")


def unpacked(text: bytes) -> str:
    return zlib.decompress(text).decode()
