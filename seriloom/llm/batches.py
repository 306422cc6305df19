"""Helpers for tasks that work on Arrow batches of texts: bounded slices, words, hashes.

All of them are vectorised over a slice of documents and keep no state between slices, so a
task's memory is bounded by ``SLICE_BYTES`` of text or one document, whichever is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def give_back() -> None:
    """Return freed memory to the system, so that a reused worker keeps none of an earlier task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(
    batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES, rows: int = 1 << 30
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most ``most`` bytes of ``column`` (or one row) and ``rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(ends, before + most, "right")), start + 1)
            end = min(end, start + rows)
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])
            give_back()


def filled(texts: pa.Array) -> pa.Array:
    """Texts with null as the empty text."""
    return pc.fill_null(texts, "")


def without_empty(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(first position of each list and the end, items) of a list array, empty strings left out."""
    flat = lists.flatten()
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(kept)])
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return before[offsets].astype(np.int64), flat.filter(pa.array(kept))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+``: (starts per text and the end, code of each word, distinct words)."""
    starts, flat = without_empty(pc.ascii_split_whitespace(filled(texts)))
    coded = flat.dictionary_encode()
    return starts, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def sums_between(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:starts[i + 1]] for each i."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def owner_of(starts: np.ndarray) -> np.ndarray:
    """Index of the text that each position belongs to."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
