"""Hashes of all words of a batch of texts, by numpy over their bytes.

A word is a run of bytes that a table does not map to zero; the table also folds case.
Its hash is a polynomial over the mapped bytes, mixed, so that equal words have equal
64-bit hashes in all tasks. Work and memory follow the bytes of the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
# Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 19


def spaced_table() -> np.ndarray:
    """Words are runs without white space (0x20, 0x09 to 0x0D), unchanged."""
    table = np.arange(1, 257, dtype=np.uint64)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def folded_table() -> np.ndarray:
    """Words are runs of letters, digits and non-ASCII characters; A-Z in lower case."""
    table = np.zeros(256, dtype=np.uint64)
    kept = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    table[kept] = np.array(kept, dtype=np.uint64) + np.uint64(1)
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


SPACED, FOLDED = spaced_table(), folded_table()


def other_table(table: np.ndarray) -> np.ndarray:
    """The same words under other values, for a second hash that tells apart words which
    agree in the first by chance."""
    values = mix(table * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    return np.where(table == 0, np.uint64(0), values)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Words:
    """Words of texts in order: hash and bytes of each, and where each text's begin."""

    hashes: np.ndarray
    starts: np.ndarray  # first byte of each word in ``data``
    ends: np.ndarray
    first: np.ndarray  # number of texts + 1: index of the first word of each text
    data: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * PIECE)
            factors = np.full(size, MULTIPLIER, dtype=np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = INVERSE
            self.down = np.multiply.accumulate(factors)
        return self.up, self.down


_POWERS = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows; a null has no bytes."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split_words(column: pa.Array, table: np.ndarray) -> Words:
    """The words of every text of a string column."""
    data, offsets = text_bytes(column)
    inside = table[data] != 0
    edges = np.zeros(len(data) + 1, dtype=bool)
    # A word starts or ends where bytes change kind, and at the borders of texts.
    edges[1:-1] = inside[1:] != inside[:-1]
    edges[offsets] = True
    cuts = np.flatnonzero(edges)
    kept = inside[cuts[:-1]] if len(data) else np.empty(0, bool)
    starts, ends = cuts[:-1][kept], cuts[1:][kept]
    first = np.searchsorted(starts, offsets)
    return Words(_hashes(data, starts, ends, table), starts, ends, first, data)


def beginnings(words: Words, size: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` bytes of longer words, and the words' indexes."""
    longer = np.flatnonzero(words.ends - words.starts > size)
    starts = words.starts[longer]
    return ~_hashes(words.data, starts, starts + size, table), longer


def rehashed(words: Words, table: np.ndarray) -> np.ndarray:
    """Hashes of the words by another table."""
    return _hashes(words.data, words.starts, words.ends, table)


def _hashes(data, starts, ends, table) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, begin + PIECE, side="right")))
        size = ends[stop - 1] - begin
        up, down = _POWERS.of(size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(table[data[begin : begin + size]] * up[:size], out=sums[1:])
        a, b = starts[at:stop] - begin, ends[at:stop] - begin
        out[at:stop] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        at = stop
    return mix(out)


def windows(
    words: Words, size: int, seed: int = 0, hashes: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, and each run's first word.

    ``hashes`` are those of the words, unless the words' own are meant.
    """
    hashes = words.hashes if hashes is None else hashes
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _POWERS.of(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(hashes + np.uint64(seed)) * up[:n], out=sums[1:])
    text = words.text
    at = np.flatnonzero(text[size - 1 :] == text[: n - size + 1])
    return mix((sums[at + size] - sums[at]) * down[at]), at


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and their texts; a shorter text that has
    words is one run."""
    hashes, at = windows(words, size)
    text = words.text[at]
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        up, down = _POWERS.of(size)
        parts = []
        for i in short:
            own = mix(words.hashes[words.first[i] : words.first[i + 1]])
            parts.append((own * up[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own)))
        hashes = np.concatenate((hashes, mix(np.array(parts, np.uint64))))
        text = np.concatenate((text, short))
    return hashes, text


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text), by text and then hash, and how often each occurs."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return hashes[at], text[at], np.diff(np.append(at, len(hashes)))
