"""Merkle manifest, license scan and spelling variants against SQL and brute force."""

import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest

from rankdraft.llm import licenses, merkle, spelling
from rankdraft.llm.oracles import MERKLE_MANIFEST, SPELLING_VARIANTS

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "idx int, n int, name string, block string, word string, words string, no int"
)
CLASH = (1, 2, "x", "y", "z", "w", 3)


def documents(spark, rows, partitions=3):
    """Rows (doc_id, source, lang, n_chars, text), with extra columns of clashing names."""
    rows = [(d, t, lang, s, n, *CLASH) for d, s, lang, n, t in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def same_as_sql(frame, sql, rows):
    fields = [("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()),
              ("n_chars", pa.int64()), ("text", pa.string())]
    columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
    con = duckdb.connect()
    con.register("documents", pa.table(columns, schema=pa.schema(fields)))
    twin = con.sql(sql)
    order = sorted(frame.columns)
    assert order == sorted(twin.columns)
    places = [twin.columns.index(c) for c in order]
    got = sorted(str([r[c] for c in order]) for r in frame.collect())
    assert got == sorted(str([r[i] for i in places]) for r in twin.fetchall())
    return got


# ---------------------------------------------------------------- manifest

EDGE = [
    (1, None, None, None, None),
    (None, None, "en", 3, "ABC"),
    (2, "", "", 0, ""),
    (3, "a", "-", 1, "-"),
    (3, "a", "-", 1, "-"),
    (3, "a", "fr", 1, "É"),
    (4, "é", "en", 200_000, "Long TEXT " * 20_000),
    (-5, "z", "en", 1, "Q"),
]


def test_manifest_of_odd_rows_equals_sql(spark):
    same_as_sql(merkle.merkle_manifest(documents(spark, EDGE)), MERKLE_MANIFEST, EDGE)


@pytest.mark.parametrize("rows", [[], EDGE[:1], EDGE[:2], [EDGE[3]] * 17])
def test_manifest_of_few_rows_equals_sql(spark, rows):
    same_as_sql(merkle.merkle_manifest(documents(spark, rows)), MERKLE_MANIFEST, rows)


def test_manifest_of_a_hot_source_and_many_small_ones_equals_sql(spark):
    # The hot source spans several blocks, the others are more than one run of subroots.
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(9000)]
    rows += [(i, f"s{i % 40}", None, None, f"Own {i}") for i in range(9000, 9300)]
    rows += [(i, None, "en", 1, "Aa") for i in range(9300, 9317)]
    found = same_as_sql(merkle.merkle_manifest(documents(spark, rows)), MERKLE_MANIFEST, rows)
    assert any("True" in r for r in found) and any("False" in r for r in found)


def test_versions_share_what_they_do_not_copy():
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).hexdigest() for i in range(700)]
    root, height = merkle.grow(leaves, False)
    new = merkle.version(root, height, 300, "f" * 64)
    assert merkle.grow([*leaves[:300], "f" * 64, *leaves[301:]], False)[0] == new

    def count(a, b):
        return 0 if a is b else 1 + sum(map(count, a.children, b.children))

    assert count(root, new) == height + 1
    path = list(merkle.paths(root, height))[300]
    assert merkle.climb("f" * 64, path) == merkle.spine(new, height, 300)
    assert merkle.climb(leaves[300], path)[-1] == root.hash


def test_blocks_of_a_longer_row_have_full_height():
    assert merkle.grow(["a" * 64], False)[1] == 0
    root, height = merkle.grow(["a" * 64], True)
    assert height == merkle.LEVELS and next(merkle.paths(root, height)) == [("", "")] * height


# ---------------------------------------------------------------- licenses


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def places(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


LICENSED = [
    None,
    "",
    "Released UNDER the MIT-License. Under the MIT License, under the mit license",
    "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "CC BY-NC 4.0; cc by cc by nc",
    "by nc cc by",
    "This work is licensed under the GNU General Public License, version 3.",
    "the gnu general public license version 3 alone has a smaller share",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
    "mit license under the",
    "under thé mit license 2",
    "cc by nc " * 3000 + "x " * 100_000 + "under the mit license",
    "nothing here " * 50,
]


def test_license_scan_against_brute_force(spark):
    rows = [(i % 9, None, None, None, t) for i, t in enumerate(LICENSED)]
    rows.append((None, None, None, None, LICENSED[2]))
    found = licenses.scan_licenses(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = []
    for doc_id, *_, text in rows:
        words = words_of(text)
        own = [(p, r.label) for r in licenses.BASE for p in places(words, r.notice)]
        starts = [p for p, _ in own]
        base = ",".join(sorted({label for _, label in own}))
        first, last = (min(starts), max(starts)) if own else (None, None)
        expected.append((doc_id, len(words), len(own), first, last, base))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    for r in found:
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)
        assert bool(r.labels) == (r.score > 0)


def test_notices_need_a_key_phrase_and_their_share(spark):
    rows = [(i, None, None, None, t) for i, t in enumerate(LICENSED)]
    found = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert found[6].labels == "gpl-3" and found[6].score == 1
    # All words that come after the key phrase are missing, still most of the notice stands.
    assert found[7].labels == "gpl-3" and 0.5 <= found[7].score < 1
    assert found[8].labels == "mit" and found[8].score < 1
    assert found[9].labels == found[10].labels == found[12].labels == ""


def test_license_scan_of_no_documents(spark):
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- spelling


def test_spelling_of_odd_texts_equals_sql(spark):
    texts = [None, "", "123", "ABCDEFG abcdefg ÀBCDEFG", "abcdefg abcdefh abcdefgh " * 9,
             "aaaaaaaa aaaaaaa aaaaaaaaa " * 4, "×÷×÷×÷×", "×÷×÷×÷×", "z" * 5000, "z" * 5001]
    rows = [(i if i != 4 else None, None, None, None, t) for i, t in enumerate(texts * 2)]
    same_as_sql(spelling.spelling_variants(documents(spark, rows)), SPELLING_VARIANTS, rows)
    assert spelling.spelling_variants(documents(spark, [])).count() == 0


def test_spelling_of_many_near_words_equals_sql(spark):
    draw = random.Random(5)
    bases = ["".join(draw.choice("abé") for _ in range(draw.randrange(7, 11))) for _ in range(60)]

    def edited(word):
        i = draw.randrange(len(word))
        kind = draw.randrange(3)
        return word[:i] + ("" if kind == 0 else draw.choice("abé")) + word[i + (kind != 1) :]

    rows = []
    for i in range(300):
        words = [draw.choice(bases[:3] if draw.random() < 0.7 else bases) for _ in range(40)]
        words = [edited(w) if draw.random() < 0.1 else w for w in words]
        rows.append((i, None, None, None, " ".join(words)))
    frame = spelling.spelling_variants(documents(spark, rows))
    same_as_sql(frame, SPELLING_VARIANTS, rows)
    found = frame.collect()
    assert any(r.form for r in found) and any(r.n_near > 3 for r in found)


def test_roots_of_long_chains(spark):
    forms = [(i, i + 1, 10 ** (i + 1)) for i in range(9)] + [(20, 3, 1000)]
    found = spelling.roots(spark.createDataFrame(forms, "no long, form long, form_n long"))
    assert {r.no: r.root for r in found.collect()} == {**{i: 9 for i in range(9)}, 20: 9}


def test_trie_nodes_are_shared_across_partitions(spark):
    words = sorted({"abcdefg" + c + d for c in "abcdef" for d in ("", "x", "yy")} | {"zzzzzzz"})
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
    found = {r.word: r for r in spelling.number_trie(frame, "word", "no", "front").collect()}
    assert [found[w].no for w in words] == list(range(len(words)))
    nodes = {}
    for w in words:
        shared = max(len(common) for v in words if v != w for common in [prefix(v, w)])
        assert len(found[w].front) == shared + 1
        for depth, node in enumerate(found[w].front):
            assert nodes.setdefault(w[:depth], node) == node
    assert len(set(nodes.values())) == len(nodes)


def prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]
