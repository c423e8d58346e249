import random
import re

from pyspark.sql import functions as F

from rankdraft.functions.arrays import scan
from rankdraft.functions import pytext as T

SPACES = [" ", "\t", "\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000"]


def strings(alphabet, n=400, longest=14, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, longest))) for _ in range(n)]


def test_strip_and_word_count_follow_python(apply):
    values = strings(["a", "b", "é", *SPACES])
    assert apply(T.strip, values) == [v.strip() for v in values]
    assert apply(T.word_count, values) == [len(v.split()) for v in values]


def test_space_class_is_pythons(spark):
    every = {chr(i) for i in range(0x20000) if chr(i).isspace()}
    assert set(T.SPACE_CHARS) == every
    codes = [i for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    chars = spark.createDataFrame([(chr(i),) for i in codes], "c string")
    matching = chars.where(F.rlike("c", F.lit(rf"(?U)\A{T.SPACE}\z")))
    assert {r["c"] for r in matching.collect()} == every


def test_find_between(apply):
    values = ["a=1|b", "a= x |", "a=1", "b=1", "a=1a=2|", "", "a=", "xa=\n y\t|z"]
    expected = ["1", "x", "1", None, "1", None, "", "y"]
    assert apply(lambda c: T.find_between(c, "a=", "|"), values) == expected


def test_replace_first_counts(apply):
    values = strings(["[", "|", "a", "]"], longest=40)
    got = apply(lambda c: T.replace_first(c, r"\[[^\]\[|]*\|", "[", 8), values)
    assert got == [re.sub(r"\[[^\]\[|]*\|", "[", v, count=8) for v in values]


def test_match_start_is_anchored_and_ignores_case(apply):
    values = ["Gen1 x", "a gen1", "\ngen1", "", "GEN"]
    assert apply(lambda c: T.match_start(c, "gen|x"), values) == [True, False, False, False, True]
    assert apply(lambda c: T.match_start(c, ""), values) == [True] * 5


def test_any_phrase_takes_phrases_literally(apply):
    assert apply(lambda c: T.any_phrase(c, ["a.b", "(x"]), ["a.b", "axb", "(x", ""]) == [
        True,
        False,
        True,
        False,
    ]


def test_percent_rounds_like_python(spark):
    pairs = [(1, 800), (203, 20000), (1, 3), (2, 3), (5, 5), (0, 7), (1, 6), (7, 16), (3, 800)]
    pairs += [(s, t) for t in range(1, 130) for s in range(0, t + 1)]
    rows = spark.createDataFrame(pairs, "s bigint, t bigint")
    got = rows.select("s", "t", T.percent(F.col("s"), F.col("t")).alias("p")).collect()
    assert all(r["p"] == round(100 * r["s"] / r["t"], 2) for r in got)
    empty = spark.createDataFrame([(0, 0)], "s bigint, t bigint")
    assert empty.select(T.percent(F.col("s"), F.col("t"))).first()[0] is None


def test_scan_equals_a_loop_over_one_block_many_and_many_groups(spark):
    for n in (0, 1, 31, 32, 33, 1023, 1024, 1025, 5000):
        row = spark.range(1).withColumn("s", F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: i * 7 % 11))
        items = F.slice("s", F.lit(1), F.lit(n))
        # Not commutative, so that an item out of order shows.
        found = row.select(scan(items, F.lit(1), lambda acc, x: (acc * 3 + x) % 9973)).first()[0]
        acc, expected = 1, [1]
        for i in range(n):
            acc = (acc * 3 + i * 7 % 11) % 9973
            expected.append(acc)
        assert found == expected, n
