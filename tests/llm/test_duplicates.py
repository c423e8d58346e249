"""Near duplicates, repeated passages and fingerprints against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankdraft.llm import (
    components,
    fingerprints,
    near_duplicates,
    recompression,
    substring_dedup,
)
from rankdraft.llm.words import (
    FOLDED,
    SPACED,
    counted,
    mix,
    other_table,
    rehashed,
    shingles,
    split_words,
)

SCHEMA = "doc_id long, text string, key string, node int"


def frame(spark, rows, partitions=4):
    rows = [(*r, "clash", 1) for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def words_of(draw, n, size=3000):
    return [f"w{draw.randrange(size)}" for _ in range(n)]


# ---------------------------------------------------------------- words


def test_words_and_their_hashes():
    texts = ["Ab, b é x", None, "", "  \n", "ab b", "\x0bAB\x0c"]
    words = split_words(pa.array(texts), FOLDED)
    got = [
        [
            words.data[a:b].tobytes().decode().lower()
            for a, b in zip(words.starts[i:j], words.ends[i:j])
        ]
        for i, j in zip(words.first, words.first[1:])
    ]
    assert got == [["ab", "b é", "x"], [], [], [], ["ab", "b"], ["ab"]]
    assert words.hashes[0] == words.hashes[3] == words.hashes[5]
    spaced = split_words(pa.array(texts).slice(1), SPACED)
    assert np.diff(spaced.first).tolist() == [0, 0, 0, 2, 1]


# ---------------------------------------------------------------- components


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    roots = {r.node: r.root for r in found.collect()}
    assert {roots[i] for i in range(41)} == {0} and {roots[i] for i in range(100, 140)} == {100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- near duplicates


def brute_classes(rows):
    def folded(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        return re.findall("[0-9a-z\x80-\U0010ffff]+", lower)

    def of(text):
        w = folded(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    usable = [(d, t, of(t)) for d, t in rows if d is not None and t is not None]
    for i, (d, t, s) in enumerate(usable):
        for e, u, r in usable[:i]:
            if t == u or s and r and len(s & r) >= 0.8 * len(s | r):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: find(d) for d in parent}


def near_copies(seed=1):
    draw = random.Random(seed)
    rows = []
    for group in range(12):
        base = words_of(draw, draw.choice([5, 30, 120, 400]))
        for _ in range(draw.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(int(len(copy) * draw.choice([0, 0.005, 0.02, 0.05]))):
                copy[draw.randrange(len(copy))] = f"edit{draw.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [rows[0]] * 40 + ["", "", "!!", "??", "one two", "One, two", "one three"]
    draw.shuffle(rows)
    return list(enumerate(rows, start=5))


def test_classes_are_those_of_brute_force(spark):
    rows = near_copies()
    found = near_duplicates.near_duplicate_classes(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == brute_classes(rows)
    assert len(found) == len(rows)


def test_links_between_members_that_no_hub_meets(spark):
    # A chain: neighbours are alike, members further apart are not.
    draw = random.Random(3)
    words, rows = words_of(draw, 200), []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = words[8:] + words_of(draw, 8)
    found = near_duplicates.near_duplicate_classes(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == brute_classes(rows)
    assert {r.class_id for r in found} == {0}


def test_classes_of_odd_rows(spark):
    rows = [(3, None), (4, None), (None, "a b"), (6, "a b"), (6, "a b"), (2, "a b"), (9, "w " * 99999)]
    found = near_duplicates.near_duplicate_classes(frame(spark, rows)).collect()
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in found)
    assert got == [(-1, -1), (2, 2), (3, 3), (4, 4), (6, 2), (6, 2), (9, 9)]
    kept = near_duplicates.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "node"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 4, 9]
    assert near_duplicates.near_duplicate_classes(frame(spark, [])).count() == 0


def test_pairs_whose_own_shingles_repeat(spark):
    # 112 shared shingles; each side has 4 own ones at the border and 10 that come 500
    # times, so that the similarity is 0.8 and that of the weighted shingles 0.42.
    draw = random.Random(7)
    rows = []
    for pair in range(20):
        common = words_of(draw, 116, 10**9)
        for side in range(2):
            own = [f"own{pair}x{side}x{i}" for i in range(10)]
            rows.append((2 * pair + side, " ".join(common + own * 500 + own[:4])))
    found = near_duplicates.near_duplicate_classes(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i - i % 2 for i in range(40)}


def test_signatures_estimate_probability_jaccard():
    draw = random.Random(5)
    common, own = words_of(draw, 700, 10**6), [words_of(draw, 150, 10**6) for _ in range(2)]
    texts = [" ".join(common + o) for o in own] * 1
    hashes, text, counts = counted(*shingles(split_words(pa.array(texts), FOLDED), 5))
    signature = near_duplicates.sketch(hashes, text, counts.astype(float), 2)
    sets = [set(hashes[text == i].tolist()) for i in range(2)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.15
    alone = near_duplicates.sketch(hashes[text == 0], text[text == 0], counts[text == 0], 1)
    assert np.array_equal(alone[0], signature[0])


# ---------------------------------------------------------------- repeated passages


def brute_repeats(rows, size=50):
    words = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages(seed=2):
    draw = random.Random(seed)
    shared = [words_of(draw, n) for n in (50, 51, 70, 200, 49)]
    shared += [["a"] * 80, ["a", "b"] * 40, ["x"] * 30 + words_of(draw, 30) + ["y"] * 60]
    rows = []
    for i in range(60):
        w = words_of(draw, draw.randrange(120))
        for _ in range(draw.randrange(3)):
            p, at = draw.choice(shared), draw.randrange(len(w) + 1)
            cut = draw.choice([0, 0, 1, 5])
            w[at:at] = p[cut : len(p) - draw.choice([0, 0, 3])]
        rows.append((i * 3, draw.choice([" ", "  ", "\n"]).join(w)))
    rows += [(500 + i, rows[7][1]) for i in range(9)] + [(1, rows[11][1] + " more")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [2, 9])
def test_removed_words_are_those_of_brute_force(spark, seed):
    rows = passages(seed)
    found = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, found)) == sorted(brute_repeats(rows))


def test_removal_in_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, None), (None, long), (3, ""), (4, long), (4, long), (0, "k " * 70)]
    found = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    key = lambda r: (r[0] is not None, *(x or 0 for x in r[:3]))
    assert sorted(map(tuple, found), key=key) == sorted(brute_repeats(rows), key=key)
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_equal_windows_have_equal_keys():
    draw = random.Random(8)
    texts = [t for _, t in passages(4)] + [" ".join(draw.choices("ab", k=400)) for _ in range(6)]
    words = split_words(pa.array(texts), SPACED)
    text, key, at, n = recompression.anchors(words, 50)
    keys = defaultdict(set)
    for t, k, first, count in zip(text, key, at, n):
        own = texts[t].split()
        for p in range(first, first + count):
            keys[tuple(own[p : p + 50])].add(k)
    assert sum(map(len, keys.values())) == len(keys)
    windows = {tuple(w[i : i + 50]) for w in map(str.split, texts) for i in range(len(w) - 49)}
    assert keys.keys() == windows


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_edit_and_follow_documents(spark):
    draw = random.Random(6)
    texts = [" ".join(words_of(draw, draw.randrange(3, 200), 400)) for _ in range(80)]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(3, None), (4, "é🙂" * 50), (8, texts[5])]
    rows += [(None, "no id"), (None, "none either")]
    found = fingerprints.fingerprint_documents(frame(spark, rows, 6)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    own = defaultdict(set)
    for i, (doc_id, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1] or ""
        text = text or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + after[:third]
        row = next(
            r for r in found if r.doc_id == doc_id and r.n_chars == len(text)
        )
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        own[text].add(row.fingerprint)
        if changed == text:
            assert row.fingerprint == row.edited_fingerprint and row.near_edited == 1
    assert len(found) == len(rows) and all(len(v) == 1 for v in own.values())
    mean = lambda name: sum(r[name] for r in found) / len(found)
    assert mean("near_edited") > 4 * mean("near_next")


def test_the_lexicon_is_the_band_of_all_texts(spark):
    rows = [(i, f"all {'half ' * (i % 2)} rare{i} tenth{i % 10} tenth{i % 10}") for i in range(1000)]
    terms = fingerprints.lexicon(frame(spark, rows, 7))
    known = split_words(pa.array(["all half rare1 " + " ".join(f"tenth{i}" for i in range(10))]), FOLDED)
    inside = fingerprints.contains(terms, known.hashes).tolist()
    assert inside == [False, False, False] + [True] * 10 and len(terms) == 10


def test_fingerprints_of_one_or_no_document(spark):
    (only,) = fingerprints.fingerprint_documents(frame(spark, [(1, "alone here")])).collect()
    assert only.near_next == 1
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0


def test_fingerprint_bytes_and_likeness_follow_the_terms_of_each_subset():
    """Brute force: which terms a subset holds decides on its byte, and the likeness is
    the weighted share of equal ones."""
    rnd = random.Random(5)
    vocabulary = [f"t{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 5, 40, 300]))) for _ in range(30)]
    texts += [texts[7], "", " ".join(sorted(texts[9].split()) * 2)]
    column = pa.array(texts)
    known = split_words(pa.array([" ".join(vocabulary[::2])]), FOLDED)
    rows = fingerprints.fingerprints(column, np.sort(known.hashes))
    sets = []
    for text in texts:
        terms = split_words(pa.array([text]), FOLDED).hashes
        inside = np.isin(terms, known.hashes)
        sets.append(sorted({int(h) for h in (terms[inside] if inside.any() else terms)}))
    seeds = mix(np.arange(1, fingerprints.DRAWS + 1, dtype=np.uint64) * fingerprints.STEP)
    for draw in (0, fingerprints.DRAWS - 1):
        for place, scale in enumerate(fingerprints.SCALES):
            at = fingerprints.WHOLE + draw * len(fingerprints.SCALES) + place
            byte_of = {}
            for own, row in zip(sets, rows):
                values = mix(np.array(own, np.uint64) ^ seeds[draw])
                chosen = tuple(t for t, v in zip(own, values) if int(v) < 1 << (64 - scale))
                assert (row[at] == 0) == (not chosen)
                assert byte_of.setdefault(chosen, row[at]) == row[at]
    for i, j in [(0, 1), (7, 30), (9, 32), (31, 31), (3, 31), (4, 9), (12, 20)]:
        a, b = rows[i], rows[j]
        some = a[: fingerprints.WHOLE].any() or b[: fingerprints.WHOLE].any()
        total = shared = fingerprints.DENSE_WEIGHT * some
        if not (a[: fingerprints.WHOLE] == b[: fingerprints.WHOLE]).all():
            shared = 0.0
        n = len(fingerprints.SCALES)
        for place in range(n):
            x, y = a[fingerprints.WHOLE + place :: n], b[fingerprints.WHOLE + place :: n]
            held = (x != 0) | (y != 0)
            weight = fingerprints.DENSE_WEIGHT + 1 - held.mean()
            total += weight * held.sum()
            shared += weight * (held & (x == y)).sum()
        expected = shared / total if total else 1.0
        (found,) = fingerprints.likeness(rows[i : i + 1], rows[j : j + 1])
        assert found == pytest.approx(expected)
    assert fingerprints.likeness(rows[7:8], rows[30:31])[0] == 1
    assert fingerprints.likeness(rows[9:10], rows[32:33])[0] == 1


def test_edited_texts_stand_apart_from_next_documents(spark):
    rnd = random.Random(8)
    weights = [1 / (i + 1) for i in range(3000)]
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(30, 400)))) for i in range(400)]
    found = fingerprints.fingerprint_documents(frame(spark, rows, 4)).toPandas()
    apart = found.near_edited > found.near_next.quantile(0.95)
    assert apart.mean() >= 0.95
    assert (found.near_edited > found.near_next).mean() >= 0.98


def test_hot_keys_join_like_all_others(spark):
    rows = spark.range(4000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7L WHEN id % 3 = 1 THEN 8L ELSE id END AS h1", "id AS node"
    )
    held = "count(*) AS held"
    keyed = rows.filter("h1 < 900").groupBy("h1").agg(F.min("node").alias("low"), F.expr(held))
    expected = sorted(map(tuple, rows.join(keyed, "h1").select("h1", "node", "low").collect()))
    for hot_rows in (0, 100, 10_000):
        found = substring_dedup._join_keys(rows, keyed, ["h1"], hot_rows)
        assert found.columns == ["h1", "node", "low"]
        assert sorted(map(tuple, found.collect())) == expected
    # Most rows of hot keys never reach the shuffle.
    plan = substring_dedup._join_keys(rows, keyed, ["h1"], 100)
    assert plan._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 2


def test_words_that_agree_in_one_hash_differ_in_the_other():
    """The second hash shares neither values nor steps with the first."""
    first = split_words(pa.array(["aa ab ba bb aa"]), SPACED)
    second = rehashed(first, other_table(SPACED))
    assert len(set(second.tolist())) == 4 and second[0] == second[4]
    assert not set(first.hashes.tolist()) & set(second.tolist())
    # A byte's value enters the first hash as itself; the other table has no such steps.
    table = other_table(SPACED)
    kept = SPACED != 0
    assert (table[~kept] == 0).all() and len(set(table[kept].tolist())) == kept.sum()
