"""Words of many texts at once: places and 64-bit hashes as numpy arrays, for use inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2_000_000
_LONG = 512  # longer words are hashed one by one: sums of powers are weak on very long strings


_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_held: dict[int, list[np.ndarray]] = {}  # of this worker: the powers for slices of the usual size


def _powers(size: int):
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if size in _held:
        return _held[size]
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size == SLICE_BYTES:
        _held[size] = out
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a well-known 64-bit generator: spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Cut an Arrow array of texts into runs of about ``most`` bytes: (first row, end row, bytes, offsets from 0).

    Nulls count as empty. One text longer than ``most`` is a slice of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_places(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each text, the place of its first word (one more at the end)."""
    return run_places(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)


def run_places(filled: np.ndarray, offsets: np.ndarray):
    """The same for the runs of bytes that ``filled`` marks."""
    edge = np.zeros(len(filled) + 1, bool)
    edge[offsets] = True
    first, last = filled.copy(), filled.copy()
    if len(filled):
        first[1:] &= ~filled[:-1] | edge[1:-1]
        last[:-1] &= ~filled[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``hashes_of`` takes the hash of any stretch of ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    own = sums[1:]
    own[:] = _BYTES[data]
    own *= _powers(_room(len(data)))[0][: len(data)]
    np.cumsum(own, out=own)
    return sums


def _room(size: int) -> int:
    return SLICE_BYTES if size <= SLICE_BYTES else 1 << size.bit_length()


def hashes_of(sums: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    length = (ends - starts).astype(np.uint64)
    inverse = _powers(_room(len(data)))[1]
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + length * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(length > _LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return hashes


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hashes_of(byte_sums(data), data, starts, ends)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, by its first word; the last ``k - 1`` places are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, k):
        total = mix(total) + hashes[i : n + i]
    return mix(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + length - 1`` of all pairs, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift
