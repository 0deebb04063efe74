"""Hashes of words in NumPy, for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in blocks of this many characters, a longer text alone.
BLOCK = 1 << 22
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run without ASCII white space), and the text it is in.

    A word's hash sums its bytes times a pseudo-random number per place.
    """
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", "u1")
    inner = ~SPACE[data]
    at = np.flatnonzero(inner)
    first = np.flatnonzero(~inner[at - 1])
    if not len(first):
        return np.array([], "u8"), np.array([], "i8")
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    weights = mixed(np.arange(1, sizes.max() + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
    words = np.add.reduceat((data[at].astype("u8") + np.uint64(1)) * weights[place], first)
    ends = np.cumsum([len(r) + 1 for r in raw])
    return mixed(words), np.searchsorted(ends, at[first] - 1, "right")


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[slice, list[str | None]]]:
    """Rows of a batch in runs of about BLOCK characters, with their texts."""
    texts, at, size = batch.column(column).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        length = len(t or "")
        if i > at and size + length > BLOCK:
            yield slice(at, i), texts[at:i]
            at, size = i, 0
        size += length
    if texts:
        yield slice(at, len(texts)), texts[at:]


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n items' connected component."""
    out = np.arange(n)
    while len(a):
        least = np.minimum(out[a], out[b])
        new = out.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == out).all():
            break
        out = new
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of a partition that is sorted by keys, cut so that no group is divided."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        change = starts(table, keys)
        if len(change) > 1:
            yield table.slice(0, change[-1]).combine_chunks()
            held = table.slice(change[-1])
        else:
            held = table
    if held is not None and len(held):
        yield held.combine_chunks()


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of every group of a sorted table."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        ids = table.column(k).combine_chunks().dictionary_encode()
        ids = ids.indices if isinstance(ids, pa.DictionaryArray) else ids.combine_chunks().indices
        new[1:] |= np.diff(ids.to_numpy(zero_copy_only=False)) != 0
    return np.flatnonzero(new)
