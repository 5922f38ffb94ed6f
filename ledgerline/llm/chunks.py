"""Distinct chunks: work that depends on a word alone is done once for each distinct word a worker meets.

A batch of texts is cut at white space, its words are dictionary-encoded, and what a word stands for comes
from a table that the worker keeps between tasks; results join back by position with array indexing. A table
that has grown past its limit begins anew, so memory stays bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut and joined back at once.
SLICE_BYTES = 1 << 20
#: Distinct chunks that a table keeps before it begins anew.
KEPT_CHUNKS = 200_000


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES each; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield at, to
        at = to
    pa.default_memory_pool().release_unused()  # once for all slices: it costs time, and holds the worker's memory down


def cut(texts: pa.Array, at: str = " ") -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks between at, the number of each occurrence's chunk, and each text's first occurrence."""
    lists = pc.split_pattern(texts, at)
    words = pc.list_flatten(lists).dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), offsets


class ChunkTable:
    """Ragged int arrays by chunk. make: of new chunks, the array sizes and all values one after another."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT_CHUNKS) -> None:
        self.make, self.kept = make, kept
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.start, self.size, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def look_up(self, chunks: list[str]) -> np.ndarray:
        """The rows of chunks, which are made where they are new. A call may drop rows of calls before it."""
        if len(self.row) > self.kept:
            self._clear()
        if new := [c for c in chunks if c not in self.row]:
            sizes, values = self.make(new)
            self.start = np.concatenate([self.start, len(self.values) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.values = np.concatenate([self.values, values.astype(np.int32)])
            at = len(self.row)
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.row.__getitem__, chunks), np.int64, len(chunks))

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The values of rows, one after another."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        return self.values[np.repeat(self.start[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
