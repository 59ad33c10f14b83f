"""Vectorised word splitting and hashing over Arrow text batches.

Texts are handled as UTF-8 bytes. Every separator set used here is ASCII, so splitting bytes
equals splitting characters. Work goes in groups of documents of about ``GROUP_BYTES``; inside a
group the bytes are hashed in segments cut at separators, so memory stays a small multiple of the
largest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 2 << 20
SEGMENT_BYTES = 1 << 19

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def _table(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACES = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, once A-Z are lower-cased.
NON_ALNUM = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
NEWLINE = _table([(0x0A, 0x0A)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` 64-bit constants fixed by ``seed``."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _MULT + _U(seed & (2**64 - 1)))


def odd_inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class ByteHash:
    """Polynomial prefix hash modulo 2^64 over remapped bytes; any span costs O(1) afterwards."""

    def __init__(self, seed: int, lower: bool):
        codes = stream(seed, 256)
        if lower:
            codes[0x41:0x5B] = codes[0x61:0x7B]
        self.codes = codes
        self.base = int(stream(seed ^ 0x5DEECE66D, 1)[0]) | 1
        self.powers = self.inverses = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SEGMENT_BYTES + 4096)
            for name, base in (("powers", self.base), ("inverses", odd_inverse(self.base))):
                table = np.full(n, _U(base))
                table[0] = _U(1)
                setattr(self, name, np.multiply.accumulate(table))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        prefix = np.zeros(len(data) + 1, _U)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=prefix[1:])
        value = (prefix[ends] - prefix[starts]) * self.inverses[starts]
        return mix(value ^ ((ends - starts).astype(_U) * _MULT))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges of at most ``limit`` bytes each, one document at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _segments(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    n, lo = len(data), 0
    while lo < n:
        hi = lo + SEGMENT_BYTES
        if hi >= n:
            hi = n
        else:
            step = hi
            while step < n:  # up to the next separator; a document's end is a fair cut as well
                block = sep[data[step : step + 65536]]
                at = int(block.argmax())
                if block[at]:
                    step += at
                    break
                step += len(block)
            k = int(np.searchsorted(offsets, hi))
            hi = min(step, int(offsets[k])) if k < len(offsets) else step
            hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses a document's border."""
    inside = ~sep[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cuts = offsets[(offsets >= 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Words:
    """Hashes, byte spans and per-document word ranges of one group of documents."""

    __slots__ = ("ends", "hashes", "ptr", "starts")

    def __init__(self, data, offsets, sep, hasher: ByteHash | None):
        starts, ends, hashes = [], [], []
        for lo, hi in _segments(data, offsets, sep):
            part = data[lo:hi]
            s, e = word_spans(part, offsets - lo, sep)
            if hasher is not None:
                hashes.append(hasher.spans(part, s, e))
            starts.append(s + lo)
            ends.append(e + lo)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        self.ptr = np.searchsorted(self.starts, offsets)


def document_groups(column, limit: int = GROUP_BYTES):
    """(lo, hi, bytes, offsets) for each group of documents of a text column."""
    data, offsets = utf8(column)
    for lo, hi in groups(offsets, limit):
        own = offsets[lo : hi + 1]
        yield lo, hi, data[own[0] : own[-1]], own - own[0]


def arrow_lists(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and row borders."""
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(values, kind))
