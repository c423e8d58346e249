"""Names for runs and pairs of words that are the same wherever the words are the same.

First every maximal run of one word gets one name, made of the word and the run's
length. Then, in each round, all symbols fall into a left and a right half, by a hash of
name and round, and each left symbol that stands before a right one is joined with it
under a name made of both. Names are 64-bit fingerprints of what they stand for, so that all
tasks of all rounds agree on them without a dictionary of the corpus.

Whether a symbol comes about depends on the words in it and on a few around it, which
are tracked as its reach. (Naming runs widens the reach of all symbols by one on either
side. That pays for words only; equal neighbours of later rounds are in the same half
and stay apart.) Two occurrences of the same words therefore hold the same
symbols, as far as the reach of those lies within: the interior symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rankdraft.llm.words import Words, mix

ROUNDS = 7
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Symbols:
    """Symbols of one round in order; reach is the range of words each depends on, and
    is beyond all words where it depends on the border of its text."""

    names: np.ndarray
    text: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __len__(self) -> int:
        return len(self.names)


def word_symbols(words: Words) -> Symbols:
    at = np.arange(len(words.hashes))
    return Symbols(mix(words.hashes + B), words.text, at, at + 1)


BEYOND = np.int64(1) << 60


def _neighbours(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a symbol has a next one in its text; reach of the one before and after."""
    next_here = np.zeros(len(s), bool)
    next_here[:-1] = s.text[1:] == s.text[:-1]
    before = np.full(len(s), -BEYOND)
    before[1:] = np.where(next_here[:-1], s.low[:-1], -BEYOND)
    after = np.full(len(s), BEYOND)
    after[:-1] = np.where(next_here[:-1], s.high[1:], BEYOND)
    return next_here, before, after


def name_runs(s: Symbols) -> Symbols:
    if not len(s):
        return s
    next_here, before, after = _neighbours(s)
    begins = np.ones(len(s), bool)
    begins[1:] = ~(next_here[:-1] & (s.names[1:] == s.names[:-1]))
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(s)))
    last = first + size - 1
    names = s.names[first]
    run = size > 1
    names[run] = mix(names[run] * A + size[run].astype(np.uint64))
    # That a run ends where it does, the symbols around it have to tell.
    low, high = np.minimum(s.low[first], before[first]), np.maximum(s.high[last], after[last])
    return Symbols(names, s.text[first], low, high)


def name_pairs(s: Symbols, number: int) -> Symbols:
    if not len(s):
        return s
    next_here, before, after = _neighbours(s)
    salt = np.uint64(number * int(B) % (1 << 64))
    left = mix(s.names ^ salt) >> np.uint64(63) == 1
    joins = np.zeros(len(s), bool)
    joins[:-1] = left[:-1] & ~left[1:] & next_here[:-1]
    joined = np.zeros(len(s), bool)
    joined[1:] = joins[:-1]
    # A single left symbol depends on the next one, a single right one on that before.
    low = np.where(~left & ~joined, np.minimum(s.low, before), s.low)
    high = np.where(left & ~joins, np.maximum(s.high, after), s.high)
    first = np.flatnonzero(~joined)
    pair = joins[first]
    names, high = s.names[first].copy(), high[first]
    second = first[pair] + 1
    names[pair] = mix(mix(names[pair] * A) + s.names[second] * B)
    high[pair] = s.high[second]
    return Symbols(names, s.text[first], low[first], high)


def rounds(words: Words, window: int) -> list[Symbols]:
    """The symbols of each round, words first, as long as any is interior to a window."""
    levels = [word_symbols(words)]
    symbols = name_runs(levels[0])
    for number in range(1, ROUNDS + 1):
        symbols = name_pairs(symbols, number)
        if not np.any(symbols.high - symbols.low <= window):
            break
        levels.append(symbols)
    return levels


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, at, n): windows of a text by the interior symbol that stands for them.

    A window is represented by its interior symbol of the highest round, of several by
    that with the least name; a word is interior to every window, so that each has one.
    Windows ``at`` to ``at + n - 1`` (by first word) share the symbol, whose name, with
    the round, is the key. Equal windows have equal keys.
    """
    n_words = np.diff(words.first)
    own = np.flatnonzero(n_words >= window)
    count = n_words[own] - window + 1
    starts = np.repeat(words.first[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
    keys, symbol = np.zeros(len(starts), np.uint64), np.full(len(starts), -1)
    offset, left = 0, np.arange(len(starts))
    levels = rounds(words, window)
    for number in range(len(levels) - 1, -1, -1):
        s = levels[number]
        kept = np.flatnonzero(s.high - s.low <= window)
        low, high, names = s.low[kept], s.high[kept], mix(s.names[kept] + np.uint64(number))
        at = starts[left]
        begin = np.searchsorted(low, at, side="left")
        end = np.searchsorted(high, at + window, side="right")
        some = np.flatnonzero(begin < end)
        begin, end = begin[some], end[some]
        best = begin.copy()
        for step in range(1, int((end - begin).max()) if len(some) else 0):
            other = np.minimum(begin + step, end - 1)
            best = np.where(names[other] < names[best], other, best)
        windows = left[some]
        keys[windows], symbol[windows] = names[best], best + offset
        offset += len(kept)
        left = np.delete(left, some)
        if not len(left):
            break
    text = np.repeat(own, count)
    new = np.ones(len(starts), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(starts)))
    return text[at], keys[at], starts[at] - words.first[text[at]], size
