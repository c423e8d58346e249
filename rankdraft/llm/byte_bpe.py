"""Byte-level byte-pair encoding with a hierarchical-bitmap rank queue, and decoding.

Every merge rank has a bucket of linked-list positions. A bitmap of two levels tells
which buckets hold something, and find-first-set on it gives the next rank. Entries
whose pair has changed meanwhile are skipped when they come up. A pre-token of n bytes
takes n queue steps whatever its length, so very long ones cost no more a byte.

One queue takes many pre-tokens side by side: no pair reaches over their borders, and
for each of them the pairs still come up by rank and then from the left. So a bucket
that is found is emptied at once, unless a pair of a lower rank comes up meanwhile.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankdraft.llm.common import Remembered, kept, map_slices, strings, texts

# A leaf of the bitmap has a bit for each of 2^10 ranks.
LEAF_BITS = 10
LEAF_MASK = (1 << LEAF_BITS) - 1
# Pre-tokens up to this length are remembered, so many in each generation.
CACHED_LENGTH = 48
CACHED_PIECES = 150_000
# For digests, which leave more memory free, more of them are, and the words of texts of
# so many bytes are cut together.
DIGESTS_PIECES = 400_000
DIGESTS_BYTES = 8 << 20
# Bytes of the pre-tokens that one queue takes, beyond the last of them.
QUEUED_BYTES = 1 << 14

# A space before other white space, or at the end.
SPACE_RUN = re.compile(r" (?:\s|\Z)")

Ids = tuple[int, ...]

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, n_tokens long, ids array<int>, decoded string"


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_file: str, pattern: str, cached: int = CACHED_PIECES) -> None:
        with open(rank_file, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        # No match of the pattern goes on from a word into white space, so that words
        # with the white space before them are encoded apart.
        self.word = regex.compile(r"\s*\S+|\s+")
        self.pieces = Remembered(lambda p: tuple(self.merge(p.encode())), cached, CACHED_LENGTH)
        # Rank of each byte and of each pair of bytes, -1 for none.
        self.bytes = np.full(256, -1, np.int64)
        self.pairs = np.full(1 << 16, -1, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.bytes[token[0]] = rank
            elif len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Each different word of them is cut once, and all pre-tokens
        that are not remembered are merged together."""
        odd = [SPACE_RUN.search(text) is not None for text in texts]
        # But for the odd ones, every space stands right before a word.
        split = [self.word.findall(t) if o else t.split(" ") for o, t in zip(odd, texts)]
        rests = [itertools.islice(x, 1, None) for o, x in zip(odd, split) if not o]
        alone = set(itertools.chain.from_iterable(x if o else x[:1] for o, x in zip(odd, split)))
        spaced = self._cut_spaced(list(set().union(*rests)))
        others = {word: tuple(self.pattern.findall(word)) for word in alone}
        cuts = itertools.chain(spaced.values(), others.values())
        found, fresh = self.pieces.known(set(itertools.chain.from_iterable(cuts)))
        found |= zip(fresh, self.merge_all([piece.encode() for piece in fresh]))
        self.pieces.keep(found, fresh)
        ids_of, of_other = _put_together(spaced, found), _put_together(others, found)
        ids = []
        for o, parts in zip(odd, split):
            if o:
                lists = map(of_other.__getitem__, parts)
            else:
                rest = map(ids_of.__getitem__, itertools.islice(parts, 1, None))
                lists = itertools.chain([of_other[parts[0]]], rest)
            ids.append(list(itertools.chain.from_iterable(lists)))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _cut_spaced(self, words: list[str]) -> dict[str, tuple[str, ...]]:
        """Pre-tokens of each word, with a space before it; no word holds a space."""
        if not words:
            return {}
        # Python's garbage collection passes over tuples of strings and of integers.
        pieces = tuple(self.pattern.findall(" " + " ".join(words)))
        # The first of each word, and no other, begins with a space.
        begins = [i for i, piece in enumerate(pieces) if piece[0] == " "]
        cuts = itertools.pairwise([*begins, len(pieces)])
        return {word: pieces[a:b] for word, (a, b) in zip(words, cuts, strict=True)}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return list(self.merge_all([piece])[0])

    def merge_all(self, pieces: list[bytes]) -> list[Ids]:
        """Ids of each pre-token."""
        whole = [self.ranks.get(piece) for piece in pieces]
        queued = self._queued([p for p, rank in zip(pieces, whole) if rank is None])
        return [next(queued) if rank is None else (rank,) for rank in whole]

    def _queued(self, pieces: list[bytes]) -> Iterator[Ids]:
        begin = 0
        while begin < len(pieces):
            stop, size = begin, 0
            while stop < len(pieces) and size < QUEUED_BYTES:
                size += len(pieces[stop])
                stop += 1
            yield from self._merged(pieces[begin:stop])
            begin = stop

    def _merged(self, pieces: list[bytes]) -> list[Ids]:
        """Ids of pre-tokens, none of them empty, by one queue."""
        text, get = b"".join(pieces), self.ranks.get
        n = len(text)
        borders = np.append(0, np.cumsum([len(p) for p in pieces]))
        border = bytearray(n + 1)
        np.frombuffer(border, np.uint8)[borders] = 1
        data = np.frombuffer(text, np.uint8).astype(np.int64)
        # The token that starts at a position, and whether one still does.
        tokens = self.bytes[data].tolist()
        alive = bytearray(b"\x01") * n
        # ends[i] is where the token that starts at i ends, starts[j] its start by end.
        ends, starts = list(range(1, n + 1)), list(range(-1, n))
        # Rank of the pair that starts at a position, -1 for none; also marks entries of
        # the queue as stale.
        pairs = np.append(self.pairs[data[:-1] << 8 | data[1:]], -1)
        pairs[borders[1:] - 1] = -1
        pair = pairs.tolist()
        # The queue: positions by rank, those of the start from right to left and those
        # that came later as a heap; bits of the ranks in use by leaf, leaves in use.
        buckets: dict[int, tuple[list[int], list[int]]] = {}
        leaves: dict[int, int] = {}
        summary = 0
        order = np.argsort(-pairs, kind="stable")[::-1]
        order = order[np.searchsorted(pairs, 0, sorter=order) :]
        ranks, at = np.unique(pairs[order], return_index=True)
        cuts, order = itertools.pairwise([*at.tolist(), len(order)]), order.tolist()
        for rank, (a, b) in zip(ranks.tolist(), cuts):
            buckets[rank] = order[a:b], []
            leaf = rank >> LEAF_BITS
            leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & LEAF_MASK)
            summary |= 1 << leaf
        bucket_of = buckets.get
        while summary:
            # Find first set: the lowest leaf in use, the lowest rank in it.
            leaf = (summary & -summary).bit_length() - 1
            bits = leaves[leaf]
            lowest = bits & -bits
            rank = leaf << LEAF_BITS | lowest.bit_length() - 1
            bucket, later = buckets[rank]
            least = rank
            while least >= rank:
                if later and (not bucket or later[0] < bucket[-1]):
                    left = heappop(later)
                elif bucket:
                    left = bucket.pop()
                else:
                    break
                if pair[left] != rank:
                    continue
                right = ends[left]
                end = ends[left] = ends[right]
                starts[end] = left
                tokens[left] = rank
                alive[right] = 0
                pair[right] = -1
                if border[end]:
                    pair[left] = -1
                else:
                    new = pair[left] = get(text[left : ends[end]], -1)
                    if new >= 0:
                        held = bucket_of(new)
                        if held is not None:
                            heappush(held[1], left)
                        else:
                            buckets[new] = [], [left]
                            high = new >> LEAF_BITS
                            leaves[high] = leaves.get(high, 0) | 1 << (new & LEAF_MASK)
                            summary |= 1 << high
                        if new < least:
                            least = new
                if not border[left]:
                    before = starts[left]
                    new = pair[before] = get(text[before:end], -1)
                    if new >= 0:
                        held = bucket_of(new)
                        if held is not None:
                            heappush(held[1], before)
                        else:
                            buckets[new] = [], [before]
                            high = new >> LEAF_BITS
                            leaves[high] = leaves.get(high, 0) | 1 << (new & LEAF_MASK)
                            summary |= 1 << high
                        if new < least:
                            least = new
            if not bucket and not later:
                del buckets[rank]
                leaves[leaf] ^= lowest
                if not leaves[leaf]:
                    summary ^= 1 << leaf
        at = np.flatnonzero(np.frombuffer(alive, np.uint8))
        ids = np.array(tokens)[at]
        if ids.min() < 0:
            raise KeyError("a byte without a rank")
        cuts = np.searchsorted(at, borders).tolist()
        ids = tuple(ids.tolist())
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]


def _put_together(cuts: dict[str, tuple[str, ...]], ids: dict[str, Ids]) -> dict[str, Ids]:
    """Ids of each word from those of its pre-tokens."""
    return {
        word: ids[pieces[0]]
        if len(pieces) == 1
        else tuple(itertools.chain.from_iterable([ids[piece] for piece in pieces]))
        for word, pieces in cuts.items()
    }


def codec(rank_file: str, pattern: str, cached: int = CACHED_PIECES) -> ByteBpe:
    name = ("byte_bpe", rank_file, pattern, cached)
    return kept(name, lambda: ByteBpe(rank_file, pattern, cached))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from the ids, for each row.

    A null text counts as empty and has no ids. Any text of any length comes back as it
    was. ``rank_file`` must be readable on every executor.
    """

    def encode(part: pa.RecordBatch) -> dict[str, object]:
        bpe = codec(rank_file, pattern)
        ids = bpe.encode_all(strings(part["text"]))
        return {
            "doc_id": part["doc_id"],
            "n_tokens": pa.array(map(len, ids), pa.int64()),
            "ids": pa.array(ids, pa.list_(pa.int32())),
            "decoded": pa.array((bpe.decode(x).decode() for x in ids), pa.string()),
        }

    return map_slices(texts(docs), TOKENS, encode, keeps=True)


def encode_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """As ``encode_documents``, with digests in place of the ids and the decoded text."""

    def encode(part: pa.RecordBatch) -> dict[str, object]:
        bpe = codec(rank_file, pattern, DIGESTS_PIECES)
        decimals = _decimals(len(bpe.tokens))
        counts, id_digests, text_digests = [], [], []
        for ids in bpe.encode_all(strings(part["text"])):
            joined = " ".join(map(decimals.__getitem__, ids))
            counts.append(len(ids))
            id_digests.append(hashlib.sha256(joined.encode()).hexdigest())
            text_digests.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return {
            "doc_id": part["doc_id"],
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(id_digests, pa.string()),
            "decoded_sha256": pa.array(text_digests, pa.string()),
        }

    return map_slices(texts(docs), DIGESTS, encode, keeps=True, gather=DIGESTS_BYTES)


@functools.lru_cache(maxsize=2)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]
