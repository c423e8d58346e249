"""License scans by a positional index of rare words, in DataFrame functions only.

A rule is a notice and the key phrases in it that are mandatory. The index lists, for
the word of a key phrase with the highest inverse document frequency, the rules and the
word's place in each. Every text looks up its own such words, so that most texts end
here. A posting says where the notice would begin; it is kept if the phrase's next rarest
word stands at its relative place too, and then if the whole phrase does. What else of
the notice stands at its place, weighted by document frequency, is the match's share.

A rule whose notice is its key phrase is found at all its places, without exception. All
of it happens inside a text's row, so that nothing is shuffled but document frequencies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankdraft.functions.arrays import let
from rankdraft.llm.decontamination import LOWER, UPPER, words

# Least share of a notice for a label of the method.
LEAST_SHARE = 0.5


@dataclass(frozen=True)
class Rule:
    """A license label, a notice's words, and its mandatory key phrases (one suffices)."""

    label: str
    notice: str
    keys: tuple[str, ...] = ()

    @property
    def phrases(self) -> tuple[str, ...]:
        return self.keys or (self.notice,)


# The phrases that are counted place by place, and their labels.
BASE = (
    Rule("mit", "under the mit license"),
    Rule("apache-2", "apache license version 2"),
    Rule("cc-by-nc", "cc by nc"),
)

# Notices of the method's own, as licenses ask for them, in words of lower case.
NOTICES = (
    Rule("mit", "licensed under the terms of the mit license", ("the mit license",)),
    Rule("mit", "spdx license identifier mit", ("identifier mit",)),
    Rule(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("hereby granted free of charge",),
    ),
    Rule(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file",
        ("the apache license",),
    ),
    Rule("apache-2", "spdx license identifier apache 2 0", ("identifier apache 2",)),
    Rule(
        "gpl-2",
        "licensed under the gnu general public license version 2",
        ("gnu general public license version 2", "gnu gpl version 2"),
    ),
    Rule(
        "gpl-3",
        "licensed under the gnu general public license version 3",
        ("gnu general public license version 3", "gnu gpl version 3"),
    ),
    Rule("agpl-3", "licensed under the gnu affero general public license", ("gnu affero general",)),
    Rule("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general",)),
    Rule(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("source and binary forms",),
    ),
    Rule("bsd", "released under the bsd license", ("the bsd license",)),
    Rule(
        "mpl-2",
        "subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Rule(
        "cc-by-nc",
        "licensed under a creative commons attribution noncommercial license",
        ("attribution noncommercial", "attribution non commercial"),
    ),
    Rule(
        "cc-by-sa",
        "licensed under a creative commons attribution sharealike license",
        ("attribution sharealike", "attribution share alike"),
    ),
    Rule("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Rule("cc0", "dedicated to the public domain under cc0", ("cc0",)),
    Rule(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
    Rule("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


def lower_words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case; a null text has none."""
    return words(F.translate(text, UPPER, LOWER))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each word of the rules, over all documents."""
    listed = F.array_intersect(lower_words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), listed)).alias("word"))
    # Each document counts once under the empty word. As many rows as the rules have words.
    found = {r["word"]: r["count"] for r in counts.groupBy("word").count().collect()}
    total = found.get("", 0)
    return {w: math.log((total + 2) / (found.get(w, 0) + 1)) for w in vocabulary}


def _literal(rule: Rule, phrase: str, base: bool, idf: dict[str, float]) -> tuple[str, Column]:
    """The rarest word of a phrase, and the posting that the index has for it."""
    own, notice = phrase.split(), rule.notice.split()
    # Where the phrase is not in the notice (another wording of it), it is the notice.
    before = next(
        (i for i in range(len(notice)) if notice[i : i + len(own)] == own), None
    )
    if before is None:
        before, notice = 0, own
    rare = sorted(range(len(own)), key=lambda i: (-idf[own[i]], i))
    first, second = rare[0], rare[min(1, len(rare) - 1)]
    total = sum(idf[w] for w in notice)
    posting = F.struct(
        F.lit(rule.label).alias("label"),
        F.lit(base).alias("base"),
        F.lit(first).alias("place"),
        F.lit(second - first).alias("next_place"),
        F.lit(own[second]).alias("next_word"),
        F.array(*map(F.lit, own)).alias("phrase"),
        F.lit(before).alias("before"),
        F.array(
            *(
                F.struct(F.lit(w).alias("word"), F.lit(idf[w] / total).alias("weight"))
                for w in notice
            )
        ).alias("notice"),
    )
    return own[first], posting


def find_licenses(
    docs: DataFrame, notices: tuple[Rule, ...] = NOTICES, base: tuple[Rule, ...] = BASE
) -> DataFrame:
    """doc_id, words, matches (label, base, start and end of the phrase, share) of each row.

    Matches are of the base rules at all their places, and of the notices where a key
    phrase stands and the share is 0.5 or more. ``start`` counts words from 0.
    """
    rules = [(rule, True) for rule in base] + [(rule, False) for rule in notices]
    vocabulary = sorted({w for r, _ in rules for p in (r.notice, *r.phrases) for w in p.split()})
    idf = frequencies(docs, vocabulary)
    index: dict[str, list[Column]] = {}
    for rule, is_base in rules:
        for phrase in rule.phrases:
            word, posting = _literal(rule, phrase, is_base, idf)
            index.setdefault(word, []).append(posting)
    rare = sorted(index)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_words(F.col("text")).alias("words"))

    # The places of the words that the index lists.
    place = F.transform(
        F.col("words"), lambda w, i: F.when(w.isin(rare), F.struct(w.alias("word"), i.alias("at")))
    )
    rows = rows.withColumn("places", F.array_compact(place))

    def at(i: Column) -> Column:
        return F.get(F.col("words"), i)

    def match(posting: Column, start: Column) -> Column:
        def weight(i: Column, x: Column) -> Column:
            stands = at(start - posting["before"] + i) == x["word"]
            return F.when(stands, x["weight"]).otherwise(0.0)

        share = F.aggregate(
            F.transform(posting["notice"], lambda x, i: weight(i, x)),
            F.lit(0.0),
            lambda a, b: a + b,
        )
        return F.struct(
            posting["label"].alias("label"),
            posting["base"].alias("base"),
            start.alias("start"),
            (start + F.size(posting["phrase"])).alias("end"),
            F.least(F.round(share, 6), F.lit(1.0)).alias("share"),
        )

    def looked_up(place: Column) -> Column:
        postings = F.lit(None)
        for word in rare:
            postings = F.when(place["word"] == word, F.array(*index[word])).otherwise(postings)

        def stands(posting: Column) -> Column:
            start = place["at"] - posting["place"]
            phrase = posting["phrase"]
            near = at(place["at"] + posting["next_place"]) == posting["next_word"]
            return near & (start >= 0) & (
                F.slice(F.col("words"), F.greatest(start, F.lit(0)) + 1, F.size(phrase)) == phrase
            )

        found = F.filter(postings, stands)
        return F.transform(found, lambda p: match(p, place["at"] - p["place"]))

    kept = F.filter(
        F.flatten(F.transform(F.col("places"), looked_up)),
        lambda m: m["base"] | (m["share"] >= LEAST_SHARE),
    )
    return rows.select("doc_id", "words", kept.alias("matches"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One row per row of ``docs``; a null text counts as empty and has no words, zero
    places, null first and last word, empty labels and score 0. Repeated rows have equal
    results. The score is the largest share of a notice, 1 for a base phrase.
    """
    found = find_licenses(docs)

    def labels(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(matches["label"])), ",")

    base = F.filter("matches", lambda m: m["base"])
    found = found.select("doc_id", F.size("words").alias("n_words"), "matches", base.alias("base"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["start"]).cast("long").alias("first_word"),
        F.array_max(F.col("base")["start"]).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.col("matches")["share"]), F.lit(0.0)).alias("score"),
    )
