"""Article tables derived from the ``documents`` table.

The given tables hold no wikitext, so titles, boxes, leads and lookup rows are
built around each document by rules on its number. The expressions are plain SQL
that Spark and DuckDB read alike; ``ctes`` gives the same tables as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankdraft.plans.stage import WikiTables

NL = "chr(10)"
Q2, Q5 = "repeat(chr(39), 2)", "repeat(chr(39), 5)"


def _case(value: str, branches: dict[int, str], other: str = "''") -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in branches.items())
    return f"CASE {value} {whens} ELSE {other} END"


def _num(value: str) -> str:
    return f"CAST({value} AS STRING)"


_MARKER = _case(
    "d % 5",
    {
        0: "'var. alba'",
        1: "'subsp. alba'",
        2: "'sect. alba'",
        3: "'subg. alba'",
        4: "'sp. alba'",
    },
)
TITLE = _case(
    "k % 16",
    {
        # A title without letters is the only one that a taxobox can name.
        5: _num("k"),
        **{i: "b || ' minor'" for i in (6, 7, 8, 9, 15)},
        10: "b || ' (alga)'",
        11: "b || ' minor alba'",
        12: f"b || ' minor ' || {_MARKER}",
        13: "'List of ' || b",
        14: "'\"' || b || ' \"\"alba\"\"\"'",
    },
    "b",
)
# Taxobox parameters, pairs of one and another that refines it, and parameters of low ranks.
BOX_KEYS = (
    "genus varietas variety tribus superfamilia subtribus subspecies trinomial classis subfamilia "
    "species subordo subgenus ordo subclassis familia informalgroup stemgroup localgroup clade "
    "cladus phylum subphylum"
).split()
BOX_PAIRS = [
    ("genus", "subgenus"),
    ("familia", "subfamilia"),
    ("familia", "superfamilia"),
    ("tribus", "subtribus"),
    ("classis", "subclassis"),
    ("ordo", "subordo"),
]
BOX_LOW = ["varietas", "variety", "subspecies"]


def _pick(names: list[str], place: str) -> str:
    """SQL of one of the names, counted from 1."""
    return f"split_part('{' '.join(names)}', ' ', CAST({place} AS INT))"


def _field(key: str, value: str, quotes: str = Q5) -> str:
    return f"'| ' || {key} || ' = ' || {quotes} || {value} || {quotes} || ' '"


# An empty box, one for each parameter, for each pair and for each low rank, the last two
# with a stray quote in front.
_KIND = "CAST(floor(k / 5) AS BIGINT) % 33"
_FIRST = _pick(["x", *BOX_KEYS, *(base for base, _ in BOX_PAIRS), *["genus"] * 3], f"{_KIND} + 1")
_SECOND = _pick([*(key for _, key in BOX_PAIRS), *BOX_LOW], f"greatest({_KIND} - 23, 1)")
_QUOTES = f"CASE WHEN {_KIND} >= 30 THEN {Q2} ELSE {Q5} END"
_BOX_KIND = (
    f"'{{{{Taxobox ' || CASE WHEN {_KIND} > 0 THEN {_field(_FIRST, chr(39) + 'Xa' + chr(39))} ELSE '' END || "
    f"CASE WHEN {_KIND} > 23 THEN {_field('chr(39) || ' + _SECOND, chr(39) + 'xb' + chr(39), _QUOTES)} "
    "ELSE '' END || '}}'"
)
# A box that names the title under one parameter, between two others.
_BOX_TITLED = (
    f"'{{{{Taxobox | ordo = ' || {Q5} || 'Xa' || {Q5} || ' ' || "
    f"{_field(_pick(BOX_KEYS, 'd % 23 + 1'), _num('k'))} || "
    f"'| clade = ' || {Q5} || 'Xb' || {Q5} || ' }}}}'"
)
_BOX_PLAIN = _case(
    "d % 12",
    {
        1: "'{{Speciesbox | genus = Gen | species = minor }}'",
        2: "'{{Subspeciesbox | genus = Gen }}'",
        3: "'{{Infraspeciesbox | varietas = alba }}'",
        4: "'{{Infraspeciesbox | subspecies = alba }}'",
        5: f"'{{{{Taxobox | genus = ' || {Q5} || 'Gen' || {Q5} || ' }}}}'",
        6: f"'{{{{Taxobox | binomial = ' || {Q2} || 'Gen minor' || {Q2} || ' }}}}'",
        7: f"'{{{{Taxobox | genus = ' || {Q5} || 'Gen' || {Q5} || ' | species = ' || {Q5}"
        f" || 'minor' || {Q5} || ' }}}}'",
        8: f"'{{{{Taxobox | familia = ' || {Q5} || 'Genaceae' || {Q5} || ' }}}}'",
        **{
            i: f"'{{{{Automatic taxobox | taxon = Tax' || {_num('k % 20')} || ' | authority = X }}}}'"
            for i in (9, 10, 11)
        },
    },
)
BOX = (
    f"CASE WHEN k % 16 = 5 THEN {_BOX_TITLED} WHEN k % 5 = 3 THEN {_BOX_KIND} ELSE {_BOX_PLAIN} END"
)
LEAD = _case(
    "k % 11",
    {
        0: "b || ' is a genus of algae in the family Genaceae.'",
        1: "b || ' is an extinct family of algae known worldwide in seas.'",
        2: "b || ' is an alga of cold northern seas.'",
        3: "b || ' is a freshwater species of green alga.'",
        4: "b || ' is a large group in the order Genales and the class Genophyceae.'",
        5: "b || ' is a widespread family and order of algae.'",
        6: "b || ' grows on rocks near cold water.'",
        7: "b || ' is a monotypic genus containing a single species.'",
        8: "b || ' was a species of alga and is a fossil.'",
        9: "b || ' is a well known subspecies with a long opening sentence that runs on and on"
        " through many words about ponds and lakes and rivers and seas until it is well past"
        " the limit.'",
    },
)
PREFIX = _case(
    "k % 13",
    {
        1: "'[[File:x.jpg]] '",
        2: "'[[File:x.jpg|thumb|A caption]] '",
        5: "'{{Italic title|{{PAGENAME}}}} '",
        8: "'{ '",
        10: "repeat(chr(39), 3) || b || repeat(chr(39), 3) || ' '",
        11: "'[ '",
    },
)
SUFFIX = _case(
    "k % 13",
    {
        0: "' With ' || repeat('[[Aa|a]] ', 10)",
        3: "'<ref name=\"a\" /> more'",
        4: "'<ref>Some source</ref> more'",
        6: "'&nbsp;&ndash;  &mdash; more'",
        7: "' Wow!<ref>x</ref>'",
        9: "' About ~5 cm<ref>x</ref>'",
    },
)
_OLD = f"'hort description|Old desc ' || {_num('k % 3')} || '}}}}'"
SD = _case(
    "k % 7",
    {
        1: f"'{{{{S' || {_OLD} || {NL}",
        2: f"'{{{{s' || {_OLD} || {NL}",
        4: f"'{{{{S' || {_OLD}",
    },
)
BOTS = _case(
    "k % 31",
    {
        1: "'{{nobots}}'",
        2: "'{{bots|deny=all}}'",
        3: "'{{bots|allow=none}}'",
        4: "'{{bots|allow=descbot}}'",
        5: "'{{bots|deny=OtherBot}}'",
    },
)
# Pages without a heading, whose lead is the document itself, with templates, references,
# images and links spread through it, and the categories behind it.
_LINE_END = (
    "'{{cite|a={{b|c}} d}}<ref name=\"s\">Source [[x|y]]</ref> "
    "[[File:m.jpg|thumb|A [[c]] caption]] <ref name=\"t\" />'"
)
REAL_TEXT = (
    f"replace(replace(replace(text, {NL}, {_LINE_END} || {NL}), ' with ', ' [[Alga|with]] '), "
    "' que ', ' [[que]] {{lang|es|que}} ')"
)
REAL_PAGE = (
    f"{SD} || {BOX} || {NL} || {PREFIX} || {LEAD} || ' ' || {REAL_TEXT} || {NL} || {NL} || "
    f"'[[Category:Algae]]' || {NL} || '[[ category : Genera|x]] '"
)
PAGE_TEXT = (
    "CASE WHEN k % 41 = 1 THEN '' WHEN k % 29 = 3 THEN '#redirect [[X]]' "
    f"WHEN k % 11 = 10 OR k % 23 = 6 THEN {REAL_PAGE} ELSE "
    f"{SD} || {BOX} || {NL} || {PREFIX} || {LEAD} || {SUFFIX} || {NL} || {NL} || "
    f"'== Description ==' || {NL} || text || {NL} || {BOTS} || "
    "CASE WHEN k % 17 = 10 THEN '[[Category:Monotypic algae genera]]' ELSE '' END END"
)
SHORTDESC = (
    "CASE WHEN k % 7 = 5 THEN '' WHEN k % 7 = 1 AND k % 3 = 2 THEN 'Other desc' "
    f"ELSE 'Old desc ' || {_num('k % 3')} END"
)
CATEGORY = _case(
    "k % 17",
    {
        0: "'Category:Algae genera'",
        1: "'Category:Algae families'",
        2: "'Category:Algae superfamilies'",
        3: "'Category:Algae suborders'",
        4: "'Category:Fossil algae'",
        5: "'Category:Algae species'",
        6: "'Category:Algae genera stubs'",
        7: "'Category:Algae subgenera'",
        8: "'Category:Human disorders'",
        9: "'Category:Prehistoric algae'",
        10: "'Category:Monotypic algae genera'",
    },
)
_RANKS = {
    0: "'genus'",
    1: "'familia'",
    2: "'species'",
    3: "'ordo'",
    4: "'clade'",
    5: "'classis'",
    6: "'subspecies'",
    7: "'unknownrank'",
}
TAXON_TEXT = (
    f"'{{{{Taxonomy' || {NL} || '|rank = ' || {_case('j % 8', _RANKS)} || {NL} || "
    f"CASE WHEN j % 3 = 0 THEN '|extinct = yes' || {NL} ELSE '' END || '|parent = Algae}}}}'"
)
ROOT_CATEGORY = "Category:Algae"


class Corpus:
    """The derived tables of one scale factor as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
        self.spark = spark
        numbers = documents.selectExpr(
            "doc_id AS k",
            "CAST(floor(doc_id / 16) AS BIGINT) AS d",
            "concat('Gen', CAST(doc_id AS STRING)) AS b",
            "text",
        )
        self.docs = numbers.selectExpr("k", "d", "b", "text", f"{TITLE} AS title")

    @property
    def targets(self) -> DataFrame:
        return self.docs.selectExpr("k AS seq", "title AS raw_title")

    @property
    def articles(self) -> DataFrame:
        kept = self.docs.where("k % 37 <> 0")
        return kept.selectExpr("k", "title", f"{PAGE_TEXT} AS text")

    @property
    def pages(self) -> DataFrame:
        return self.articles.select("title", "text")

    @property
    def page_props(self) -> DataFrame:
        kept = self.docs.where("k % 7 BETWEEN 1 AND 5")
        return kept.selectExpr("title", f"{SHORTDESC} AS shortdesc")

    @property
    def page_categories(self) -> DataFrame:
        own = self.docs.where("k % 17 <= 10").selectExpr(
            "title", f"{CATEGORY} AS category", "k % 17 = 6 AS hidden"
        )
        common = self.docs.selectExpr("title", "'Category:All articles' AS category", "true AS hidden")
        return own.unionByName(common)

    @property
    def taxonomy(self) -> DataFrame:
        numbers = self.docs.selectExpr("k % 20 AS j").distinct().where("j % 5 <> 4")
        return numbers.selectExpr(
            f"'Template:Taxonomy/Tax' || {_num('j')} AS title", f"{TAXON_TEXT} AS text"
        )

    @property
    def wikidata(self) -> DataFrame:
        return self.docs.where("k % 4 <> 0").select(
            "title", F.expr(f"map('en', 'wd ' || {_num('k')}, 'de', 'x')").alias("descriptions")
        )

    @property
    def links(self) -> DataFrame:
        seen = self.page_categories.where("NOT hidden")
        top = seen.selectExpr(f"'{ROOT_CATEGORY}' AS parent", "category AS child", "14 AS child_ns")
        members = seen.selectExpr("category AS parent", "title AS child", "0 AS child_ns")
        back = seen.where("category = 'Category:Algae genera'").selectExpr(
            "category AS parent", f"'{ROOT_CATEGORY}' AS child", "14 AS child_ns"
        )
        return top.distinct().unionByName(members).unionByName(back.distinct())

    @property
    def tables(self) -> WikiTables:
        return WikiTables(
            self.pages, self.page_props, self.page_categories, self.taxonomy, self.wikidata
        )


# The same tables as SQL, for checking results with another engine.
CTES = {
    "docs": "SELECT doc_id AS k, CAST(floor(doc_id / 16) AS BIGINT) AS d, "
    "concat('Gen', CAST(doc_id AS STRING)) AS b, text FROM documents",
    "tgt": f"SELECT k AS seq, {TITLE} AS raw_title FROM docs",
    "art": f"SELECT k, {TITLE} AS title, {PAGE_TEXT} AS text FROM docs WHERE k % 37 <> 0",
    "props": f"SELECT {TITLE} AS title, {SHORTDESC} AS shortdesc FROM docs "
    "WHERE k % 7 BETWEEN 1 AND 5",
    "cats": f"SELECT {TITLE} AS title, {CATEGORY} AS category, k % 17 = 6 AS hidden FROM docs "
    f"WHERE k % 17 <= 10 UNION ALL SELECT {TITLE}, 'Category:All articles', true FROM docs",
    "taxo": f"SELECT 'Template:Taxonomy/Tax' || {_num('j')} AS title, {TAXON_TEXT} AS text "
    "FROM (SELECT DISTINCT k % 20 AS j FROM docs) WHERE j % 5 <> 4",
    "wd": f"SELECT {TITLE} AS title, 'wd ' || {_num('k')} AS desc_en FROM docs WHERE k % 4 <> 0",
    "links": f"SELECT DISTINCT '{ROOT_CATEGORY}' AS parent, category AS child, 14 AS child_ns "
    "FROM cats WHERE NOT hidden UNION ALL SELECT category, title, 0 FROM cats WHERE NOT hidden "
    f"UNION ALL SELECT DISTINCT category, '{ROOT_CATEGORY}', 14 FROM cats "
    "WHERE category = 'Category:Algae genera' AND NOT hidden",
}
