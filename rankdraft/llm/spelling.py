"""Spelling variants by a dictionary of pairs of trie nodes.

The words, sorted, are numbered; so are the nodes of their trie, in the order in which
the sorted words reach them, and the nodes of the trie of the reversed words. A word
with a letter skipped is a pair of integers, the node of what stands before and that of
what follows; a word with a gap between two letters is such a pair too. Then

* words that share a pair with a skipped letter differ by one replaced letter;
* a word whose pair with a gap is another's pair with a skipped letter lacks that letter.

All neighbours are found and no others are. A pair fixes all letters of a word but one,
so that no group has more words than the alphabet has letters. A node that one word
alone reaches cannot be shared; pairs with such a node are left out, which for most
words is all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankdraft.functions.arrays import let
from rankdraft.llm.common import in_arrow, slices, stored, strings, texts
from rankdraft.session import fits_broadcast

SHORTEST = 7
LEAST_COUNT = 2
RATIO = 10
TYPO_EVERY = 31
# Fixed value: runs of letters, A-Z already in lower case.
RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")
# Words that a task counts before it hands them on.
HELD_WORDS = 200_000

COUNTS = "word string, n long"
NUMBERED = (
    "part int, place long, nodes array<long>, like_first int, ends array<long>, size long"
)


# ---------------------------------------------------------------- words


def typed(doc_id: int | None, run: str) -> str:
    """The run as the document has it: of some, one letter is left out."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % TYPO_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        words = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
        batch = pa.RecordBatch.from_arrays(words, names=["word", "n"])
        counts.clear()
        return batch

    for part in slices(batches):
        for doc_id, text in zip(part["doc_id"].to_pylist(), strings(part["text"])):
            # bytes.lower() changes A-Z only.
            runs = Counter(RUN.findall(text.encode().lower().decode()))
            for run, n in runs.items():
                word = typed(doc_id, run)
                if len(word) >= SHORTEST:
                    counts[word] += n
        if len(counts) >= HELD_WORDS:
            yield flush()
    yield flush()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): letter runs of seven letters or more that occur twice or more."""
    counts = in_arrow(texts(docs), _counted, COUNTS)
    total = counts.groupBy("word").agg(F.sum("n").alias("n"))
    return total.filter(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- tries


def common(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 16:
        # Halve long words by comparing slices, then go letter by letter.
        half = (low + n) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            n = half
    while low < n and a[low] == b[low]:
        low += 1
    return low


class Trie:
    """Numbers of the nodes that sorted words reach, for the words of one partition.

    ``stack[d]`` is the node of the current word's first d letters.
    """

    def __init__(self) -> None:
        self.stack: list[int] = []
        self.size = 0
        self.last: str | None = None

    def add(self, word: str, shared: int) -> None:
        """``shared`` letters are common with the last word."""
        del self.stack[shared + 1 if self.last is not None else 0 :]
        new = len(word) + 1 - len(self.stack)
        self.stack.extend(range(self.size, self.size + new))
        self.size += new
        self.last = word


def _numbered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Add to sorted rows: part, place, nodes (of as many letters as a neighbour in this
    partition shares, counted from none), like_first (letters shared with the first
    word), and for the last row ``ends``, the nodes of all its letters, and ``size``."""
    part, place = TaskContext.get().partitionId(), 0
    trie, first, before = Trie(), "", 0
    held: pa.RecordBatch | None = None

    def out(batch: pa.RecordBatch, following: str | None) -> pa.RecordBatch:
        nonlocal place, first, before
        n = batch.num_rows
        words = batch[key].to_pylist()
        if trie.last is None:
            first = words[0]
        nodes, like_first, shared = [], [], before
        for i, word in enumerate(words):
            after = words[i + 1] if i + 1 < n else following
            trie.add(word, shared)
            next_shared = common(word, after) if after is not None else -1
            nodes.append(trie.stack[: max(shared if place + i else -1, next_shared) + 1])
            like_first.append(common(first, word))
            shared = max(next_shared, 0)
        before = shared
        ends: list[list[int] | None] = [None] * n
        if following is None:
            ends[-1] = list(trie.stack)
        columns = [
            pa.array(np.full(n, part, np.int32)),
            pa.array(np.arange(place, place + n)),
            pa.array(nodes, pa.list_(pa.int64())),
            pa.array(like_first, pa.int32()),
            pa.array(ends, pa.list_(pa.int64())),
            pa.array(np.full(n, trie.size, np.int64)),
        ]
        place += n
        names = ["part", "place", "nodes", "like_first", "ends", "size"]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, *columns], names=[*batch.schema.names, *names]
        )

    for batch in slices(batches):
        if held is not None:
            yield out(held, batch[key][0].as_py())
        held = batch
    if held is not None:
        yield out(held, None)


def _borders(numbered: DataFrame, key: str) -> list[dict]:
    """For each partition that has words, in order: how many words and nodes come before,
    how many letters its first and last word share with the neighbours beyond, and the
    nodes of those letters of its first word. One row per partition is read for it."""
    last = numbered.filter("ends IS NOT NULL")
    last = last.select("part", F.col(key).alias("last"), "ends", "size", "place", "like_first")
    first = numbered.filter("place = 0").select("part", F.col(key).alias("first"))
    rows = sorted(first.join(last, "part").collect(), key=lambda r: r["part"])
    out, words, nodes, carried, previous = [], 0, 0, [], None
    for row in rows:
        shared = common(previous, row["first"]) if previous is not None else -1
        if out:
            out[-1]["after"] = shared
        own = carried[: shared + 1]
        out.append(
            {"part": row["part"], "words": words, "nodes": nodes, "before": shared, "after": -1,
             "carried": own}
        )
        # Letters shared with the first word and, through it, with the word before have
        # the nodes of that one.
        kept = min(shared, row["like_first"]) + 1
        carried = own[:kept] + [n + nodes for n in row["ends"][kept:]]
        words, nodes, previous = words + row["place"] + 1, nodes + row["size"], row["last"]
    return out


BORDERS = "part int, words long, nodes long, before int, after int, carried array<long>"


def number_trie(words: DataFrame, key: str, number: str, nodes: str) -> DataFrame:
    """Add the number of each word in the order of ``key`` (distinct strings), and the
    trie nodes of its first 0, 1, ... letters as far as another word shares them."""
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = words.repartitionByRange(partitions, key).sortWithinPartitions(key)
    schema = StructType(words.schema.fields + StructType.fromDDL(NUMBERED).fields)
    found = stored(in_arrow(ordered, lambda b: _numbered(b, key), schema), "trie")
    borders = _borders(found, key)
    spark = words.sparkSession
    table = spark.createDataFrame([tuple(b.values()) for b in borders], BORDERS)
    table = table.withColumnsRenamed({"part": "_part", "nodes": "_nodes"})

    kept = F.least("before", "like_first") + 1
    own = F.transform("nodes", lambda n: n + F.col("_nodes"))
    # Words at a border share letters with words beyond it, which no neighbour here has.
    at_border = F.greatest(
        F.when(F.col("place") == 0, F.col("before")).otherwise(-1),
        F.when(F.col("ends").isNotNull(), F.col("after")).otherwise(-1),
    )
    whole = F.transform(
        F.slice(F.col("ends"), F.lit(1), F.greatest(F.size("nodes"), at_border + 1)),
        lambda n: n + F.col("_nodes"),
    )
    # All letters of a first word that the word before shares have nodes already.
    fresh = F.when(F.col("ends").isNotNull(), whole).otherwise(own)
    size = F.greatest(F.size(fresh), F.when(F.col("place") == 0, F.col("before") + 1).otherwise(0))
    start = F.slice(F.col("carried"), F.lit(1), F.least(kept, size))
    rest = F.slice(fresh, F.size(start) + 1, F.greatest(F.size(fresh) - F.size(start), F.lit(0)))
    joined = found.join(F.broadcast(table) if fits_broadcast(table) else table, F.col("part") == F.col("_part"))
    return joined.select(
        *words.columns,
        (F.col("words") + F.col("place")).alias(number),
        F.concat(start, rest).alias(nodes),
    )


# ---------------------------------------------------------------- neighbours


def _pairs(words: DataFrame) -> DataFrame:
    """(front, back, kind, minus_n, no, counts): pairs of nodes of each word, with a
    letter skipped or with a gap. Of letters that repeat, skipping the first counts."""
    length = F.length("word")
    front, back = F.size("front") - 1, F.size("back") - 1

    def pair(kind: str, i: Column, rest: Column, counts: Column) -> Column:
        return F.struct(
            F.get("front", i).alias("front"),
            F.get("back", rest).alias("back"),
            F.lit(kind).alias("kind"),
            counts.alias("counts"),
        )

    def listed(first: Column, last: Column, make) -> Column:
        nothing = F.array().cast("array<int>")
        at = F.when(first <= last, F.sequence(first, last)).otherwise(nothing)
        return F.transform(at, make)

    zero = F.lit(0)
    # A long word is cut into its letters once.
    skips = let(
        F.split("word", ""),
        lambda letters: listed(
            F.greatest(length - 1 - back, zero),
            F.least(front, length - 1),
            lambda i: pair(
                "skip",
                i,
                length - 1 - i,
                (i == 0) | (F.get(letters, i - 1) != F.get(letters, i)),
            ),
        ),
    )
    gaps = listed(
        F.greatest(length - back, zero),
        F.least(front, length),
        lambda i: pair("gap", i, length - i, F.lit(True)),
    )
    each = words.select((-F.col("n")).alias("minus_n"), "no", F.explode(F.concat(skips, gaps)).alias("p"))
    return each.select("p.front", "p.back", "p.kind", "minus_n", "no", "p.counts")


def neighbours(words: DataFrame) -> DataFrame:
    """(no, n_near, minus_n, best): how many words are near each word that has any, and
    of those the one with the largest n, the first in order of ties."""
    member = F.struct("minus_n", "no", "counts")
    groups = (
        _pairs(words)
        .groupBy("front", "back")
        .agg(
            # As many as the alphabet has letters at most, and one word with a gap.
            F.sort_array(F.collect_list(F.when(F.col("kind") == "skip", member))).alias("skips"),
            F.max(F.when(F.col("kind") == "gap", F.struct("minus_n", "no"))).alias("gap"),
        )
        .filter((F.size("skips") > 1) | (F.col("gap").isNotNull() & (F.size("skips") > 0)))
    )
    skips, gap = F.col("skips"), F.col("gap")

    def one(no: Column, n: Column, word: Column) -> Column:
        return F.struct(
            no.alias("no"),
            n.cast("long").alias("n_near"),
            F.struct(word["minus_n"].alias("minus_n"), word["no"].alias("no")).alias("best"),
        )

    def replaced(x: Column) -> Column:
        first = F.get(skips, F.lit(0))
        other = F.when(first["no"] == x["no"], F.get(skips, F.lit(1))).otherwise(first)
        return one(x["no"], F.size(skips) - 1, other)

    counted = F.filter(skips, lambda x: x["counts"] & gap.isNotNull())
    found = F.concat(
        F.when(F.size(skips) > 1, F.transform(skips, replaced)).otherwise(
            F.slice(F.transform(skips, replaced), F.lit(1), F.lit(0))
        ),
        F.transform(counted, lambda x: one(x["no"], F.lit(1), gap)),
        F.transform(
            F.slice(counted, F.lit(1), F.least(F.size(counted), F.lit(1))),
            lambda x: one(gap["no"], F.size(counted), x),
        ),
    )
    each = groups.select(F.explode(found).alias("f")).select("f.no", "f.n_near", "f.best")
    near = each.groupBy("no").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return near.select("no", "n_near", F.col("best.minus_n").alias("minus_n"), F.col("best.no").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(no, root) of words (no, form, form_n) that have a form, by doubling steps.

    Each step goes to a word at least ten times as frequent, so that the length of a
    chain, and with it the number of rounds, follows from the largest frequency.
    """
    most = forms.agg(F.max("form_n")).first()[0] or 1
    chains = forms.select("no", F.col("form").alias("root"))
    steps = 1
    while RATIO**steps <= most:
        after = chains.select(F.col("no").alias("root"), F.col("root").alias("_next"))
        chains = stored(
            chains.join(after, "root", "left").select(
                "no", F.coalesce("_next", "root").alias("root")
            ),
            "chains",
        )
        steps *= 2
    return chains


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word.

    Words are letter runs of seven letters or more, A-Z in lower case, that occur twice
    or more; from some runs a letter is left out first, by a hash of id and run (a null
    id counts as an empty text there). Null and empty texts have no words, repeated rows
    count each time. A word without near words has n_near 0 and a null form, and is its
    own root.
    """
    words = stored(count_words(docs), "words")
    words = number_trie(words, "word", "no", "front")
    words = words.withColumn("reversed", F.reverse("word"))
    words = number_trie(words, "reversed", "_back_no", "back").drop("reversed", "_back_no")
    words = stored(words, "nodes")

    names = words.select("no", "word", "n")
    near = stored(neighbours(words), "near")
    form = (-F.col("minus_n") >= RATIO * F.col("n")) & F.col("minus_n").isNotNull()
    found = stored(
        names.join(near, "no", "left").select(
            "no",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(form, F.col("best")).alias("form"),
            F.when(form, -F.col("minus_n")).alias("form_n"),
        ),
        "forms",
    )
    changed = found.filter("form IS NOT NULL").select("no", "form", "form_n")
    named = changed.join(roots(changed), "no")
    for role in ("form", "root"):
        own = names.select(F.col("no").alias(role), F.col("word").alias(f"{role}_word"))
        named = named.join(own, role)
    named = named.select("no", "form_word", "root_word")
    return found.join(named, "no", "left").select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        "n_near",
        "form_n",
    )
