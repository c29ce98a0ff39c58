"""Words and hashes of whole Arrow text columns with numpy, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finaliser of the splitmix64 generator)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = splitmix(_LOWER.astype(U) + U(1) + U(0x9E3779B97F4A7C15))
#: Values of bytes for hashes that tell A-Z from a-z.
EXACT = splitmix(np.arange(256, dtype=U) + U(1) + U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words between white space, and of words of letters and digits (every byte of a non-ASCII character counts).
NOT_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and each text's start in them with the end as the last; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of ``letters`` within a text, and each text's first word, with their number as the last."""
    inside = letters[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    begins[offsets[filled]] = inside[offsets[filled]]
    ends[offsets[filled + 1] - 1] = inside[offsets[filled + 1] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


_PLACE = splitmix(np.arange(1, 257, dtype=U)) | U(1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased unless ``values`` are EXACT."""
    global _PLACE
    if not len(start):
        return np.zeros(0, U)
    length = end - start
    if (longest := int(length.max())) > len(_PLACE):
        _PLACE = splitmix(np.arange(1, 2 * longest + 1, dtype=U)) | U(1)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    values = values[data[place + np.repeat(start, length)]] * _PLACE[place]
    return splitmix(np.add.reduceat(values, first) + length.astype(U) * U(0xD6E8FEB86659FD93))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each word on; the last k - 1 have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total += hashes[j : j + n] * _PLACE[j + 128]
    return splitmix(total + U(k))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of a text's k-word shingles, in order; of the whole sequence if it is shorter; empty without words."""
    if not len(hashes):
        return np.zeros(0, U)
    if len(hashes) < k:
        return shingle_hashes(hashes, len(hashes))
    return np.unique(shingle_hashes(hashes, k))


def int64(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def list_column(values: np.ndarray, lengths: list[int] | np.ndarray) -> pa.Array:
    """A list<int64> column from the values of all rows in one array."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(int64(values)))


def stretch_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each word on for any k, by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, rest, at = np.full(n, k, U), hashes, k, 0
    size = 1
    while rest:
        if rest & 1:
            out = splitmix(out * U(0x9E3779B97F4A7C15) + done[at : at + n])
            at += size
        rest >>= 1
        if rest:
            done = splitmix(done[:-size] * U(0xD6E8FEB86659FD93) + done[size:])
            size *= 2
    return out
