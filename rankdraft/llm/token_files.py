"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents (integers little-endian):

    magic "PFR1", then n_docs, n_ids, n_blocks as u64
    doc_id i64 and a null flag u8 for each document, number of ids u64 for each
    start of each block in the payload, and the payload's length, as u64
    payload: the blocks

A block holds up to 1,024 ids: minimum u32, number of ids u16, width u8, number of
exceptions u16; then the ids less the minimum in ``width`` bits each, low bit first;
then positions u16 and values u32 of the exceptions, which are the ids that do not
fit. The width is that of a percentile of the block.

Documents are range-partitioned and sorted by id, each task writes its own files, and a
manifest names the files of the tasks that ended well, so that a lost executor leaves
at most files that nobody reads. The readers use Spark's binary file source.
"""

from __future__ import annotations

import array
import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankdraft.llm.byte_bpe import SPACE_RUN
from rankdraft.llm.common import (
    gathered,
    in_arrow,
    kept,
    shared_folder,
    slices,
    strings,
    texts,
    to_batch,
)

MAGIC = b"PFR1"
HEAD = struct.Struct("<4s3Q")
BLOCK_HEAD = struct.Struct("<IHBH")
BLOCK = 1024
PERCENTILE = 95
# A file ends with the document that takes it over so many ids.
FILE_IDS = 2 << 20
END_ID = 2
# Parts up to this length are remembered, so many in each generation.
CACHED_LENGTH = 48
CACHED_PARTS = 400_000
# Bytes of the texts that are encoded together, and parts that one call encodes.
GATHERED_BYTES = 12 << 20
BATCH = 4096

MANIFEST = "partition int, sequence int, file string, n_docs long, n_ids long"
DOCUMENTS = "file string, position long, doc_id long, before long, n_tokens long, ids_crc32 long"


# ---------------------------------------------------------------- blocks


def pack(ids: np.ndarray) -> tuple[list[int], bytes]:
    """Starts of the blocks, with the length at the end, and the blocks."""
    out, starts, at = [], [0], 0
    for first in range(0, len(ids), BLOCK):
        block = _pack_block(ids[first : first + BLOCK])
        at += len(block)
        out.append(block)
        starts.append(at)
    return starts, b"".join(out)


def _pack_block(ids: np.ndarray) -> bytes:
    least = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(least)
    typical = np.partition(rest, k := (len(rest) - 1) * PERCENTILE // 100)[k]
    width = int(typical).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    kept = rest.copy()
    kept[over] = 0
    # Only the bytes that hold the width.
    low = kept.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : (width + 7) // 8]
    bits = np.unpackbits(low, axis=1, bitorder="little")
    packed = np.packbits(bits[:, :width], bitorder="little").tobytes()
    head = BLOCK_HEAD.pack(least, len(ids), width, len(over))
    return head + packed + over.astype("<u2").tobytes() + rest[over].astype("<u4").tobytes()


@functools.cache
def _places(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each id of a block, and its first bit there."""
    bit = np.arange(BLOCK) * width
    return bit >> 3, (bit & 7).astype(np.uint64)


def unpack(block: bytes) -> np.ndarray:
    least, n, width, n_over = BLOCK_HEAD.unpack_from(block)
    at = BLOCK_HEAD.size
    size = (n * width + 7) // 8
    # An id lies inside the eight bytes from its first one on; past the end they are zeros.
    padded = block[at : at + size] + bytes(8)
    windows = np.ndarray(size + 1, "<u8", padded, strides=(1,))
    first, shift = _places(width)
    ids = ((windows[first[:n]] >> shift[:n]) & np.uint64((1 << width) - 1)).astype(np.uint32)
    at += size
    over = np.frombuffer(block, "<u2", n_over, at)
    ids[over] = np.frombuffer(block, "<u4", n_over, at + 2 * n_over)
    return ids + np.uint32(least)


# ---------------------------------------------------------------- files


def file_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    starts, payload = pack(ids)
    nulls = bytes(d is None for d in doc_ids)
    return b"".join(
        (
            HEAD.pack(MAGIC, len(doc_ids), len(ids), len(starts) - 1),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            nulls,
            np.array(counts, "<u8").tobytes(),
            np.array(starts, "<u8").tobytes(),
            payload,
        )
    )


class TokenFile:
    """A file's documents; ``ids(a, b)`` unpacks only the blocks it needs."""

    def __init__(self, content: bytes) -> None:
        magic, n_docs, self.n_ids, n_blocks = HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = HEAD.size
        values = np.frombuffer(content, "<i8", n_docs, at).tolist()
        at += 8 * n_docs
        nulls = content[at : at + n_docs]
        self.doc_ids = [None if gone else d for d, gone in zip(values, nulls)]
        at += n_docs
        self.ends = np.cumsum(np.frombuffer(content, "<u8", n_docs, at).astype(np.int64))
        at += 8 * n_docs
        self.starts = np.frombuffer(content, "<u8", n_blocks + 1, at).astype(np.int64)
        self.payload, self.content = at + 8 * (n_blocks + 1), content

    def ids(self, first: int, stop: int) -> np.ndarray:
        if first >= stop:
            return np.empty(0, np.uint32)
        blocks = range(first // BLOCK, (stop - 1) // BLOCK + 1)
        parts = [
            unpack(self.content[self.payload + self.starts[b] : self.payload + self.starts[b + 1]])
            for b in blocks
        ]
        return np.concatenate(parts)[first - blocks[0] * BLOCK : stop - blocks[0] * BLOCK]


# ---------------------------------------------------------------- encoding


class Encoder:
    """Ids of whole texts by the library, which sees every different part of a slice once.

    The byte-level pre-tokenizer never joins a word to the space before the next, letters
    to what is not a letter, or a line end to what is not white space. So the parts of a
    text cut there give the same ids apart as together. Arrow cuts the texts and finds
    the different parts; what the cache does not know of them is encoded as one text, where
    the bytes of the tokens tell the parts' ids apart. Parts that begin with a space follow
    each other there as they are, others as lines.
    """

    # Marks a word that no space stands before; texts that hold it are encoded whole.
    MARK = "\x00"
    # It begins with the line end, so that the search goes from one to the next.
    LINE = re.compile(r"\n(?<=\S\n)(?=\S)")
    PLAIN = re.compile(r" ?\S+")
    LETTERS = r"(?s)^(?P<letters> ?\p{L}+)(?P<rest>[^\s\p{L}].*)$"
    # The same for Latin letters before another ASCII character, in a tenth of the time.
    LATIN = (
        r"(?s)^(?P<letters> ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)"
        r"(?P<rest>[!-@\[-`{-~].*)$"
    )

    def __init__(self, tokenizer_file: str) -> None:
        # Tasks share the cores already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = tokenizers.Tokenizer.from_file(tokenizer_file)
        # Bytes of each token: the byte-level alphabet has one character for each.
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        # Ids of parts, in two generations: a full young one becomes the old one.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end_id`` behind it, and the number of each."""
        mark, line = self.MARK, f" \n {self.MARK}"
        whole = strings(texts)
        # Texts with runs of white space that begin with a space are left whole.
        odd = [bool(SPACE_RUN.search(text)) or mark in text for text in whole]
        plain = [mark if o else mark + self.LINE.sub(line, t) for o, t in zip(odd, whole)]
        left = [self._ids(t) if o else np.empty(0, np.uint32) for o, t in zip(odd, whole)]
        plain, n = pa.array(plain, pa.large_string()), len(whole)
        del whole
        lists = pc.split_pattern(plain, " ")
        at, words = np.asarray(lists.offsets), lists.flatten().dictionary_encode()
        del plain, lists
        word = words.dictionary
        spaced = pc.binary_join_element_wise(pa.scalar(" ", word.type), word, pa.scalar("", word.type))
        spaced = pc.if_else(pc.equal(word, "\n"), word, spaced)
        marked = pc.starts_with(word, mark)
        known, sizes = self._words(pc.if_else(marked, pc.utf8_slice_codeunits(word, 1), spaced))
        values = np.concatenate([known, *left, np.full(1, end_id, np.uint32)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, left), np.int64, n), [1]])

        own = np.flatnonzero(odd)
        index = np.array(words.indices)
        index[at[own]] = len(word) + own
        index = np.insert(index, at[1:], len(sizes) - 1)
        del words, word
        ids, sizes = _taken(values, sizes, index)
        return ids, np.add.reduceat(sizes, at[:-1] + np.arange(n))

    def _words(self, column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, put together from those of their parts, and the number of each."""
        # Words of letters alone, which most are, stay whole without a pattern.
        first, second = column, pa.repeat(pa.scalar("", column.type), len(column))
        uncut = pc.invert(pc.utf8_is_alpha(pc.utf8_ltrim(column, " ")))
        for pattern in (self.LATIN, self.LETTERS):
            cut = pc.extract_regex(column.filter(uncut), pattern)
            found = pc.replace_with_mask(uncut, uncut, pc.is_valid(cut))
            letters, rest = cut.drop_null().flatten()
            first = pc.replace_with_mask(first, found, letters.cast(column.type))
            second = pc.replace_with_mask(second, found, rest.cast(column.type))
            uncut = pc.and_not(uncut, found)
        parts = pa.concat_arrays([first, second]).dictionary_encode()
        ids = self._parts(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        # The parts of a word follow each other.
        order = np.asarray(parts.indices).reshape(2, len(column)).T.ravel()
        values, sizes = _taken(np.frombuffer(b"".join(ids), "<u4"), sizes, order)
        return values, sizes.reshape(-1, 2).sum(axis=1)

    def _parts(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.young.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh = []
        for i in missing:
            found[i] = self.old.get(parts[i])
            if found[i] is None:
                fresh.append(i)
        # Parts without white space inside or behind go to the library together.
        plain = [i for i in fresh if self.PLAIN.fullmatch(parts[i])]
        for between in ("", "\n"):
            rows = [i for i in plain if parts[i].startswith(" ") != bool(between)]
            for begin in range(0, len(rows), BATCH):
                some = rows[begin : begin + BATCH]
                for i, ids in zip(some, self._apart([parts[i] for i in some], between)):
                    found[i] = ids
        for i in fresh:
            if found[i] is None:
                found[i] = self._ids(parts[i]).tobytes()
        if len(self.young) + len(missing) > CACHED_PARTS:
            self.young, self.old = {}, self.young
        self.young.update((parts[i], found[i]) for i in missing if len(parts[i]) <= CACHED_LENGTH)
        return found

    def _apart(self, parts: list[str], between: str) -> list[bytes | None]:
        """Ids of each part of one text, or nothing where a token is in two parts."""
        ids = self._ids(between.join(parts))
        lengths = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
        stops = np.cumsum(lengths + len(between)) - len(between)
        ends = np.append(0, np.cumsum(self.bytes[ids]))
        starts = stops - lengths
        first, stop = np.searchsorted(ends, starts), np.searchsorted(ends, stops)
        if ends[-1] != stops[-1] or (ends[first] != starts).any() or (ends[stop] != stops).any():
            return [None] * len(parts)
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip((first * 4).tolist(), (stop * 4).tolist())]

    def _ids(self, text: str) -> np.ndarray:
        # The fast call leaves out the places of tokens in the text, which nobody reads.
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, np.uint32)


def _taken(
    values: np.ndarray, sizes: np.ndarray, index: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of ``sizes`` in ``values``, those at ``index`` in a row, and their sizes."""
    total = int(sizes @ np.bincount(index, minlength=len(sizes)))
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    sizes = sizes.astype(kind)
    taken = sizes[index]
    # From the place among all that are taken to the one in the values.
    ahead = (np.cumsum(sizes, dtype=kind) - sizes)[index]
    ahead -= np.cumsum(taken, dtype=kind)
    ahead += taken
    place = np.repeat(ahead, taken)
    place += np.arange(total, dtype=kind)
    return values[place], taken


def _encoder(tokenizer_file: str) -> Encoder:
    return kept(("token_files", tokenizer_file), lambda: Encoder(tokenizer_file))


# ---------------------------------------------------------------- Spark


def write_token_files(
    docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = END_ID
) -> DataFrame:
    """Write the ids of all documents in ascending order of doc_id; return the manifest.

    Null ids come first, rows of one id in the order of their texts; a null text counts
    as empty and holds the end id only.
    """
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ids alone decide the ranges; a text takes part in the order of its id's rows only.
    ordered = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        files, path = pa.fs.FileSystem.from_uri(f"{folder}/data")
        task, sequence = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        encoded: list[np.ndarray] = []
        counts: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{task:08d}-{sequence:08d}-{uuid.uuid4().hex}.pfr"
            content = file_bytes(doc_ids, counts, np.concatenate(encoded))
            with files.open_output_stream(f"{path}/{name}") as out:
                out.write(content)
            row = (task, sequence, name, len(doc_ids), size)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            names = ("partition", "sequence", "file", "n_docs", "n_ids")
            return to_batch({n: pa.array([v], k) for n, v, k in zip(names, row, kinds)})

        files.create_dir(path, recursive=True)
        for part in gathered(slices(batches), GATHERED_BYTES):
            ids, sizes = encoder.encode(part["text"], end_id)
            starts = np.append(0, np.cumsum(sizes))
            listed, begin = part["doc_id"].to_pylist(), 0
            while begin < len(listed):
                # A file ends with the document that takes it over its size.
                stop = int(np.searchsorted(starts, starts[begin] + FILE_IDS - size)) or 1
                stop = min(max(stop, begin + 1), len(listed))
                doc_ids += listed[begin:stop]
                counts += sizes[begin:stop].tolist()
                encoded.append(ids[starts[begin] : starts[stop]])
                size += int(starts[stop] - starts[begin])
                begin = stop
                if size >= FILE_IDS:
                    yield flush()
                    doc_ids, encoded, counts, size, sequence = [], [], [], 0, sequence + 1
        if doc_ids:
            yield flush()

    in_arrow(ordered, write, MANIFEST, keeps=True).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone.

    ``start`` counts the ids of all documents before. The offsets of files are running
    sums over the manifest, which has one narrow row per file.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    earlier = Window.orderBy("partition", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))
    offsets = manifest.select("file", offset.alias("offset"))
    if manifest.isEmpty():
        found = spark.createDataFrame([], DOCUMENTS)
    else:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.pfr")
            .load(f"{folder}/data")
            .select("path", "content")
        )
        found = in_arrow(files, _documents, DOCUMENTS)
    return found.join(offsets, "file").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            file = TokenFile(content.as_py())
            starts = np.concatenate(([0], file.ends[:-1])) if len(file.ends) else file.ends
            ids = file.ids(0, file.n_ids).astype("<u4")
            n = len(file.doc_ids)
            yield to_batch(
                {
                    "file": pa.array([path.as_py().rsplit("/", 1)[-1]] * n, pa.string()),
                    "position": pa.array(range(n), pa.int64()),
                    "doc_id": pa.array(file.doc_ids, pa.int64()),
                    "before": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(file.ends - starts, pa.int64()),
                    "ids_crc32": pa.array(
                        [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, file.ends)],
                        pa.int64(),
                    ),
                }
            )


def token_files(docs: DataFrame, tokenizer_file: str, folder: str | None = None) -> DataFrame:
    """Write the files, by default to a new shared folder, and read them back."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    write_token_files(docs, tokenizer_file, folder)
    return read_token_files(spark, folder)
