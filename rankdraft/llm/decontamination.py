"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every window of 10 words a text keeps the 5-word grams with the least hash; windows
that follow each other mostly keep the same one, so that about a quarter of the grams
stay. A text and a benchmark item that share a window keep the same gram of it, at the
same place in the window. The grams that texts keep are looked up among those that items
keep, and a hit is extended to the window around it, which is compared word for word.

An item of fewer than 10 words is one window of its own length, whose kept gram is a
single word, the one with the least hash; where there are such items, all words of the
texts are looked up too. One pass over the texts does for all lengths and the counts.

Texts do not move unless the benchmark is too large to broadcast; then the words around
each kept gram do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankdraft.llm.common import free_name, stored, texts
from rankdraft.session import BROADCAST_BYTES, fits_broadcast

WINDOW = 10
GRAM = 5
# Grams in a window.
GRAMS = WINDOW - GRAM + 1
# Fixed value: a run of digits, ASCII letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows that one step of repeating a row makes at most.
REPEATED = 1 << 16


def words(text: Column) -> Column:
    """The words of a text as it stands; a null text has none."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _places(n: Column) -> Column:
    """0 to n - 1; nothing for n of 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_words(rows: DataFrame) -> DataFrame:
    """``words``, A-Z in lower case, and the ``hashes`` of them, in place of the text."""
    rows = rows.withColumn("words", words(F.translate("text", UPPER, LOWER))).drop("text")
    return rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def with_grams(rows: DataFrame) -> DataFrame:
    """Add ``grams``, the hash of each gram, and ``least``, that of each window."""
    n = F.size("words")

    def gram(i: Column) -> Column:
        return F.xxhash64(*(F.get("hashes", i + k) for k in range(GRAM)))

    def least(i: Column) -> Column:
        return F.least(*(F.get("grams", i + k) for k in range(GRAMS)))

    rows = rows.withColumn("grams", F.transform(_places(n - GRAM + 1), gram))
    return rows.withColumn("least", F.transform(_places(n - WINDOW + 1), least))


def kept_grams(rows: DataFrame) -> DataFrame:
    """Add ``kept``: the hash of each gram that is least in a window, null for others.

    No window holds less than its least gram, so that a gram is least in one of its
    windows if the largest least hash of those is its own.
    """

    def kept(h: Column, i: Column) -> Column:
        most = F.greatest(*(F.get("least", i - k) for k in range(GRAMS)))
        return F.when(most == h, h)

    return rows.withColumn("kept", F.transform("grams", kept))


def _window(start: Column, length: Column) -> Column:
    return F.concat_ws(" ", F.slice("words", start + 1, length))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window, length, by_word, hash, before): the windows of the items, and
    the kept gram, or word, of each, which begins ``before`` words after the window. Of
    several grams with the same least hash, each has a row."""
    known = with_words(items.filter("item_id IS NOT NULL").select("item_id", "text"))
    item = F.col("item_id").cast("string").alias("item_id")
    long = with_grams(known.filter(F.size("words") >= WINDOW))
    each = long.select(item, "words", "grams", _exploded("least").alias("start", "hash"))
    each = each.filter("hash IS NOT NULL")
    each = each.withColumn("before", F.explode(F.array(*map(F.lit, range(GRAMS)))))
    each = each.filter(F.get("grams", F.col("start") + F.col("before")) == F.col("hash")).select(
        "item_id",
        _window(F.col("start"), F.lit(WINDOW)).alias("window"),
        F.lit(WINDOW).alias("length"),
        F.lit(False).alias("by_word"),
        "hash",
        "before",
    )
    short = known.filter((F.size("words") > 0) & (F.size("words") < WINDOW))
    least = F.array_min("hashes")
    short = short.select(
        item,
        F.concat_ws(" ", "words").alias("window"),
        F.size("words").alias("length"),
        F.lit(True).alias("by_word"),
        least.alias("hash"),
        (F.array_position("hashes", least) - 1).cast("int").alias("before"),
    )
    return each.unionByName(short).distinct()


def _exploded(*arrays: str) -> Column:
    """Places and values of arrays, one after the other, and a null at last. (Of a plain
    array the optimizer would derive a filter, and compute all that leads to it again
    for each element.)"""
    return F.posexplode(F.concat(*arrays, F.array(F.lit(None).cast("long"))))


def _looked_up(rows: DataFrame, any_short: bool, counts: bool) -> DataFrame:
    """(doc_id, digest, words, key, by_word, at): what each row looks up, and with
    ``counts`` one row more without a key."""
    rows = kept_grams(with_grams(with_words(rows)))
    keys = ["kept", "hashes"] if any_short else ["kept"]
    n = F.size("kept")
    each = rows.select(
        "doc_id", "digest", "words", n.alias("n"), _exploded(*keys).alias("at", "key")
    )
    by_word = F.col("at") >= F.col("n")
    counting = F.col("at") == F.col("n") + (F.size("words") if any_short else F.lit(0))
    each = each.withColumn("counting", counting if counts else F.lit(False))
    at = F.when(by_word, F.col("at") - F.col("n")).otherwise(F.col("at"))
    return each.filter(F.col("key").isNotNull() | F.col("counting")).select(
        "doc_id", "digest", "words", "key", by_word.alias("by_word"), at.alias("at"), "counting"
    )


def hits(rows: DataFrame, items: DataFrame, counts: bool = False) -> DataFrame:
    """(doc_id, digest, start, length, item_id): windows of the texts that items hold.

    With ``counts`` there is, for each row, one row more with n_words and a null item.
    """
    listed = stored(item_windows(items), "benchmark")
    index = listed.select("hash", "by_word", "before", "length").distinct()
    index = stored(index, "benchmark-index").withColumnRenamed("by_word", "_by_word")
    any_short = not listed.filter("by_word").isEmpty()
    exact = listed.select(
        "item_id", F.col("window").alias("_window"), F.col("length").alias("_length")
    ).distinct()
    same = (F.col("key") == F.col("hash")) & (F.col("by_word") == F.col("_by_word"))
    start = F.col("at") - F.col("before")
    fits = (start >= 0) & (start + F.col("length") <= F.size("words"))
    n_words = F.when(F.col("counting"), F.size("words"))

    if fits_broadcast(listed, BROADCAST_BYTES):
        looked_up = _looked_up(rows, any_short, counts)
        found = looked_up.join(F.broadcast(index), same, "left")
        found = found.filter(F.col("hash").isNotNull() | F.col("counting")).select(
            "doc_id",
            "digest",
            n_words.alias("n_words"),
            start.alias("start"),
            "length",
            F.when(fits, _window(start, F.col("length"))).alias("window"),
        )
        equal = (F.col("window") == F.col("_window")) & (F.col("length") == F.col("_length"))
        found = found.join(F.broadcast(exact), equal, "left")
        found = found.filter("item_id IS NOT NULL OR n_words IS NOT NULL")
        return found.select("doc_id", "digest", "n_words", "start", "length", "item_id")

    # Only the words around a kept gram move, from the first of a window that it can
    # end to the last of one that it can begin.
    begin = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    around = F.slice("words", begin + 1, F.lit(2 * WINDOW - 1))
    near = _looked_up(rows, any_short, False).select(
        "doc_id", "digest", "key", "by_word", begin.alias("begin"), around.alias("words"),
        (F.col("at") - begin).alias("at"),
    )
    found = near.join(index, same).filter(fits)
    found = found.select(
        "doc_id",
        "digest",
        F.lit(None).cast("int").alias("n_words"),
        (F.col("begin") + start).alias("start"),
        "length",
        _window(start, F.col("length")).alias("window"),
    ).distinct()
    equal = (F.col("window") == F.col("_window")) & (F.col("length") == F.col("_length"))
    columns = ["doc_id", "digest", "n_words", "start", "length", "item_id"]
    found = found.join(exact, equal).select(*columns)
    if counts:
        size = F.regexp_count("text", F.lit(WORD)).alias("n_words")
        found = found.unionByName(rows.select("doc_id", "digest", size), allowMissingColumns=True)
    return found


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row.

    A word is hit if it lies in any occurrence of a window of any item. Null texts have
    no words; items with a null id or without words match nothing. Repeated rows have
    equal results; items that share an id count once.
    """
    found = hits(with_digest(docs), benchmark.select("item_id", "text"), counts=True)
    is_hit = F.col("item_id").isNotNull()
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    result = found.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("rows"),
        F.array_sort(F.collect_set(F.when(is_hit, span))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("ids"),
    )
    # Rows that repeat are one group; each has its own row in the result.
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / REPEATED))
    result = result.withColumn("step", F.explode(steps))
    left = F.least(F.col("rows") - F.col("step") * REPEATED, F.lit(REPEATED)).cast("int")
    result = result.withColumn("_", F.explode(F.sequence(F.lit(1), left)))
    return result.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        _covered(F.col("spans")).alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.size("ids") > 0).alias("contaminated"),
    )


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a digest of the text, which tells rows that share
    an id apart."""
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("digest", F.xxhash64("text"))


def _covered(spans: Column) -> Column:
    """Words covered by spans sorted by start."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, span: Column) -> Column:
        begin = F.greatest(span["start"], acc["end"])
        more = F.greatest(span["end"] - begin, F.lit(0))
        return F.struct(
            (acc["n"] + more).alias("n"), F.greatest(acc["end"], span["end"]).alias("end")
        )

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an item."""
    found = hits(with_digest(docs), benchmark.select("item_id", "text"))
    own_id, own_digest = free_name(docs, "_id"), free_name(docs, "_digest")
    found = found.select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest))
    found = stored(found.distinct(), "contaminated")
    if fits_broadcast(found):
        found = F.broadcast(found)
    digest = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(F.col(own_id)) & (digest == F.col(own_digest))
    return docs.join(found, same, "left_anti")
