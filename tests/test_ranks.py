import itertools
import random
import re
from statistics import multimode

import pytest
from pyspark.sql import functions as F

from rankdraft.corpus import Corpus
from rankdraft.functions import describe as D
from rankdraft.functions import ranks as R
from rankdraft.functions import wikitext as W
from rankdraft.profiles import DEFAULT, LONG_NOUN

B, I = "'" * 5, "'" * 2


@pytest.mark.parametrize(
    "names, expected",
    [
        (["algae genera"], "Genus"),
        (["algae subgenera", "algae genera"], "Subgenus"),
        (["algae superfamilies"], "Superfamily"),
        (["algae suborders"], "Suborder"),
        (["human disorders"], "Order"),
        (["general topics"], "Genus"),
        (["a suborder", "b orders"], "Suborder"),
        (["algae phyla"], "Phylum"),
        (["algae"], None),
        ([], None),
    ],
)
def test_category_rank(spark, names, expected):
    row = spark.createDataFrame([(names,)], "names array<string>")
    rank = R.rank_from_category(lambda part: R.in_category(F.col("names"), part))
    assert row.select(rank).first()[0] == expected


LEADS = {
    "It is an order of fungi in the class Tremellomycetes": "Order",
    "Abacetus is an alga of the north and of the south": "Species",
    "It is a large group in the order X": None,
    "It is a widespread family and order of things": None,
    "It is a freshwater species of things": "Species",
    "It is a well known subspecies of things": None,
    "Xyz is a species of genus Yz. It was a genus": "Species",
    "X. It is a genus": "Genus",
    "It is\xa0a\xa0genus of x": "Genus",
    "They are a group of phylum x": None,
    "It was an informal group here": "Informal group",
    "grows on rocks": None,
    "It is a nice family of the x genus": None,
    "": None,
}


def test_lead_rank(apply):
    assert dict(zip(LEADS, apply(lambda c: R.rank_from_lead(c, "alga"), LEADS))) == LEADS


def test_lead_searches_equal_one_search_per_stem(apply):
    rnd = random.Random(11)
    parts = ["is a ", "was an ", "are a ", " in the ", "nice ", "x\n", " species", " genus", "order ",
             " family", "phylum ", "class", " informal group", "infraorder", "y" * 24, " subspecies"]
    leads = ["".join(rnd.choices(parts, k=rnd.randint(1, 9))) for _ in range(1500)]
    # The openings of the tight and of the loose search.
    tight_start = r"(is\sa|is\san|was\sa|was\san)\s"
    loose_start = r"(is\sa|are\sa|was\sa|were\sa)(?:(?!\sin\sthe).){0,50}\s"

    def tight(lead):
        hits = [r for r, stem in R.LEAD_STEMS.items() if re.search(tight_start + stem, lead)]
        return hits[0] if hits else None

    def loose(lead):
        hits = [
            r
            for r, stem in R.LEAD_STEMS.items()
            if re.search((tight_start if r in R.TIGHT_ONLY else loose_start) + stem, lead)
        ]
        return hits[0] if len(hits) == 1 else None

    assert apply(R.rank_lead_tight, leads) == [tight(x) for x in leads]
    assert apply(R.rank_lead_loose, leads) == [loose(x) for x in leads]


def test_speciesbox(apply):
    texts = {
        "{{speciesbox|x": "Species",
        "{{subspeciesbox|x": "Subspecies",
        "{{infraspeciesbox|varietas=é": "Variety",
        "{{infraspeciesbox|variety=x": "Variety",
        "{{infraspeciesbox|subspecies=x": "Subspecies",
        "{{infraspeciesbox|subspecies=|": None,
        "{{taxobox": None,
    }
    assert apply(R.rank_from_speciesbox, texts) == list(texts.values())


TAXOBOXES = [
    ("Gen", f"{{{{taxobox|genus={B}gen{B}", "Genus"),
    ("123", f"{{{{taxobox|genus={B}x{B}|ordo={B}123{B}", "Order"),
    ("Gen", "{{taxobox|'varietas=''x", "Variety"),
    ("Gen", "{{taxobox|'subspecies=''x", "Subspecies"),
    ("Gen", f"{{{{taxobox|familia={B}x{B}|ordo={B}y{B}", "Family"),
    ("Gen", f"{{{{taxobox|genus={B}x{B}|'subgenus={B}y{B}", "Subgenus"),
    ("Gen", f"{{{{taxobox|binomial={I}x{I}", "Species"),
    ("Gen", f"{{{{taxobox|genus={B}x{B}|species={B}y{B}", "Genus"),
    ("Gen", f"{{{{taxobox|genus={B}x{B}|binomial={I}y{I}", "Genus"),
    ("Gen", f"{{{{taxobox|familia={B}x{B}|species={B}y{B}", "Species"),
    ("Gen", f"{{{{taxobox|subphylum={B}x{B}|familia={B}y{B}", "Subphylum"),
    ("Gen", "{{taxobox|genus=x", None),
    ("Gen", f"{{{{speciesbox|genus={B}x{B}", None),
]


def test_taxobox(spark):
    rows = spark.createDataFrame(TAXOBOXES, "nobra string, tc string, expected string")
    rank = R.rank_from_taxobox(F.col("nobra"), F.col("tc"), R.bold_keys(F.col("tc")))
    for row in rows.withColumn("rank", rank).collect():
        assert row["rank"] == row["expected"], row


def test_corpus_has_every_taxobox_branch(spark):
    corpus = Corpus(spark, "/root/testdata/sf0.01")
    rows = corpus.articles.selectExpr("title", "replace(lower(text), ' ', '') AS tc").collect()
    boxes = [(r["title"], r["tc"]) for r in rows if "{{taxobox" in r["tc"]]

    def held(part, extra=""):
        return sum(part in tc and extra in tc for _, tc in boxes)

    for key in R.TAXOBOX_RANKS:
        assert held(f"|{key}={B}"), key
        assert any(f"|{key}={B}{title}{B}" in tc for title, tc in boxes), key
    parameters = {rank: key for key, rank in R.TAXOBOX_RANKS.items()}
    for base, key in R.TAXOBOX_REFINEMENTS:
        assert held(f"|'{key}={B}", f"|{parameters[base]}={B}"), key
    for key in ("varietas", "variety", "subspecies"):
        assert held(f"|'{key}={I}"), key
    assert held(f"|binomial={I}") and held(f"|genus={B}", f"|species={B}")


def test_autobox(apply):
    values = [
        "{{automatictaxobox|taxon=abc|x",
        "{{automatictaxobox|taxon=\nabc_d\n|",
        "{{automatictaxobox|x=1",
        "{{taxobox|taxon=abc|",
        "{{automatictaxobox|taxon=a|taxon=b|",
    ]
    assert apply(lambda c: R.autobox_key(R.autobox_taxon(c)), values) == [
        "Template:Taxonomy/Abc",
        "Template:Taxonomy/Abc d",
        None,
        None,
        "Template:Taxonomy/A",
    ]
    ranks = ["|rank=genus\n|x", "|rank=trinomial|", "|rank=informalgroup|", "|x", "rank=genus"]
    assert apply(R.taxonomy_rank, ranks) == ["Genus", None, "Informal group", None, "Genus"]


def test_modes_equal_multimode(spark):
    names = [None, "Genus", "Species", "Order"]
    votes = list(itertools.product(names, repeat=5))
    rows = spark.createDataFrame(votes, "a string, b string, c string, d string, e string")
    modes = R.modes(F.array_compact(F.array("a", "b", "c", "d", "e")))
    for row in rows.withColumn("modes", modes).collect():
        assert row["modes"] == multimode([v for v in row[:5] if v is not None])


CASES = [
    # title, ranks, lead, monotypic category, ok, message
    ("A", ["Genus"] * 2 + [None] * 3, "", False, True, "Genus of algae"),
    ("A", ["Species", None, None, None, None], "a monotypic thing", False, True, "Genus of algae"),
    ("A", ["Species", None, None, None, None], "", True, True, "Genus of algae"),
    ("A", ["Species", None, None, None, None], "", False, True, "Species of alga"),
    ("A", ["Variety", None, None, None, None], "", False, False, "*** : Variety of alga"),
    ("A b", ["Genus", None, None, None, None], "", False, False, "*** : Genus of algae"),
    ("(x)", ["Genus", None, None, None, None], "", False, False, "*** : Genus of algae"),
    ("A b", ["Subspecies", None, None, None, None], "", False, True, "Subspecies of alga"),
    ("A", [None] * 5, "", False, False, "***** : NO MATCHING RANKS"),
    ("A", ["Family", "Order", None, None, None], "", False, False, "***** : CAN'T GET BEST RANK"),
    ("A", [None, "Family", None, None, "Order"], "", False, True, "Family of algae"),
    ("A", ["Family", "Family", "Clade", "Clade", "Order"], "", False, False, "***** :  AUTOTAXOBOX HAS Order"),
    ("A", ["Genus", "Species", None, None, None], "", False, True, "Genus of algae"),
    ("A b", ["Genus", "Species", None, None, None], "", False, True, "Species of alga"),
    ("A b c", ["Subspecies", "Species", None, None, None], "", False, True, "Subspecies of alga"),
    ("A b c", ["Variety", "Species", None, None, None], "", False, True, "Variety of alga"),
    ("A b", ["Clade", "Species", None, None, None], "", False, True, "Species of alga"),
    ("A b c", ["Clade", "Species", None, None, None], "", False, False, "***** : CAN'T GET BEST RANK"),
    ("A b var. c", [None] * 5, "", False, True, "Variety of alga"),
    ("A sect. b", [None] * 5, "", False, True, "Group of algae"),
    ("A subsp. b", [None] * 5, "", False, True, "Subspecies of alga"),
    ("A subg. b", [None] * 5, "", False, True, "Subgenus of algae"),
    ("A sp. b", [None] * 5, "is a fossil", False, True, "Extinct species of alga"),
]


def facts(spark, cases):
    ranks = ", ".join(f"{c} string" for c in D.RANK_COLUMNS)
    schema = (
        f"title string, {ranks}, lead string, monotypic_category boolean, ok boolean, message string"
    )
    rows = spark.createDataFrame([(t, *r, lead, m, ok, msg) for t, r, lead, m, ok, msg in cases], schema)
    return rows.withColumn("autobox_extinct", F.lit(False)).withColumn(
        "category_extinct", F.lit(False)
    )


def test_vote_and_rules(spark):
    for row in D.with_description(facts(spark, CASES), DEFAULT).collect():
        assert (row["gen_ok"], row["gen_msg"]) == (row["ok"], row["message"]), row


def test_long_descriptions_are_not_prefixed(spark):
    case = [("A", ["Genus"] + [None] * 4, "it is a fossil", False, True, "")]
    long = D.with_description(facts(spark, case), LONG_NOUN).first()["gen_msg"]
    assert long == "Genus of algae of the northern hemisphere"
    short = D.with_description(facts(spark, case), DEFAULT).first()["gen_msg"]
    assert short == "Extinct genus of algae"


def test_monotypic(spark):
    row = spark.createDataFrame([("[[category:monotypicgenera", "")], "tc string, lead string")
    assert row.select(R.monotypic_category(F.col("tc"))).first()[0]
    assert W.LEAD_LENGTH == 150
