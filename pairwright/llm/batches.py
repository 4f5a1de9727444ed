"""Slices of Arrow batches with a bounded amount of text."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute  # noqa: F401


def slices(batches: Iterator[pa.RecordBatch], name: str, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in order, cut so that the texts of a slice have about `size` bytes, or it is one row."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths.tolist()):
            if total + n > size and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(lengths) > start:
            yield batch.slice(start)
        freed()


def freed() -> None:
    """Give back what the batch before took: a worker lives through many tasks, beside others on its machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()


#: Texts longer than this are matched in lists of so many words.
LONG_TEXT, WORDS_AT_ONCE = 200_000, 50_000


def words_in_lists(pattern: re.Pattern, text: str | bytes) -> Iterator[list]:
    """All matches in order. A long text gives several lists: as objects, its words take many times its memory."""
    if len(text) <= LONG_TEXT:
        yield pattern.findall(text)
        return
    matches = pattern.finditer(text)
    while words := [m[0] for m in islice(matches, WORDS_AT_ONCE)]:
        yield words
