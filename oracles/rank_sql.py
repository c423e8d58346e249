"""SQL fragments for the five rank sources and the rules over them.

The word lists are written out here, so that a wrong entry on either side shows.
"""

from __future__ import annotations

from oracles.text_sql import WS, compress, contains_any, find_between, first_case, q

Q5, Q2 = "'" * 5, "'" * 2
LOW = "('Species', 'Subspecies', 'Variety')"

# Fragments of category names, first hit wins.
CATEGORY = [
    ("subspecies", "Subspecies"),
    ("subgenera", "Subgenus"),
    ("genera", "Genus"),
    ("subfamilies", "Subfamily"),
    ("families", "Family"),
    ("superfamilies", "Superfamily"),
    ("orders", "Order"),
    ("suborders", "Suborder"),
    ("phyla", "Phylum"),
]
# Stems in the lead, first hit wins.
STEMS = [
    ("subgenu", "Subgenus"),
    ("genus", "Genus"),
    ("superfami", "Superfamily"),
    ("famil", "Family"),
    ("subfami", "Subfamily"),
    ("tribe", "Tribe"),
    ("subtrib", "Subtribe"),
    ("class", "Class"),
    ("subclas", "Subclass"),
    ("order", "Order"),
    ("suborde", "Suborder"),
    ("infraorde", "Infraorder"),
    ("clade", "Clade"),
    ("variet", "Variety"),
    ("species", "Species"),
    ("informal group", "Informal group"),
    ("phylum", "Phylum"),
    ("subphylu", "Subphylum"),
]
# Ranks whose stem follows the verb directly in both searches.
DIRECT = ["Infraorder", "Phylum", "Subphylum"]
# Taxobox parameters, in this order.
TAXOBOX = [
    ("genus", "Genus"),
    ("varietas", "Variety"),
    ("variety", "Variety"),
    ("tribus", "Tribe"),
    ("superfamilia", "Superfamily"),
    ("subtribus", "Subtribe"),
    ("subspecies", "Subspecies"),
    ("trinomial", "Subspecies"),
    ("classis", "Class"),
    ("subfamilia", "Subfamily"),
    ("species", "Species"),
    ("subordo", "Suborder"),
    ("subgenus", "Subgenus"),
    ("ordo", "Order"),
    ("subclassis", "Subclass"),
    ("familia", "Family"),
    ("informalgroup", "Informal group"),
    ("stemgroup", "Group"),
    ("localgroup", "Group"),
    ("clade", "Clade"),
    ("cladus", "Clade"),
    ("phylum", "Phylum"),
    ("subphylum", "Subphylum"),
]
# Rank, parameter behind a stray quote, better rank.
REFINED = [
    ("Genus", "subgenus", "Subgenus"),
    ("Family", "subfamilia", "Subfamily"),
    ("Family", "superfamilia", "Superfamily"),
    ("Tribe", "subtribus", "Subtribe"),
    ("Class", "subclassis", "Subclass"),
    ("Order", "subordo", "Suborder"),
]
# Markers in titles, first hit wins.
MARKERS = [
    ("var.", "Variety"),
    ("subsp.", "Subspecies"),
    ("sect.", "Group"),
    ("subg.", "Subgenus"),
    (" sp.", "Species"),
]
# Leads of genera with one species.
MONOTYPIC = [
    "monotypic",
    "monospecific",
    " a single species",
    " the single species",
    " single-species",
    " only one species",
    " only the one species",
    " the only species",
    " its only species",
]
# Leads and category names of extinct taxa.
EXTINCT_LEADS = [
    "is a fossil",
    "is an extinct",
    "was a species",
    "was a genus",
    "was a family",
    "was a class",
    "was an order",
    "known from fossil",
]
EXTINCT_CATEGORIES = ["fossil", "prehistoric", "extinctions"]

START = f"(is{WS}a|is{WS}an|was{WS}a|was{WS}an){WS}"
LOOSE = rf"(is{WS}a|are{WS}a|was{WS}a|were{WS}a)[^\x01\n]{{0,50}}{WS}"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def category_rank(names: str) -> str:
    """Rank from a list of lower-case visible category names."""

    def has(part: str) -> str:
        return f"len(list_filter({names}, lambda c: contains(c, {q(part)}))) > 0"

    first = first_case([(has(p), q(r)) for p, r in CATEGORY])
    return first_case(
        [
            (f"({first}) = 'Family' AND {has('superfamilies')}", "'Superfamily'"),
            (f"({first}) = 'Order' AND {has('suborder')}", "'Suborder'"),
        ],
        first,
    )


def category_extinct(names: str) -> str:
    return f"len(list_filter({names}, lambda c: {contains_any('c', EXTINCT_CATEGORIES)})) > 0"


def sentence(lead: str) -> str:
    first = f"split_part({lead}, '.', 1)"
    return f"CASE WHEN length({first}) > 26 THEN {first} ELSE {lead} END"


def lead_tight(s: str) -> str:
    return first_case([(matches(s, START + stem), q(rank)) for stem, rank in STEMS])


def lead_noun(s: str, noun: str) -> str:
    return first_case([(matches(s, START + noun), "'Species'")])


def lead_loose(s: str) -> str:
    cut = f"regexp_replace({s}, {q(f'{WS}in{WS}the')}, chr(1), 'g')"
    found = ", ".join(
        first_case(
            [(matches(s, START + stem) if rank in DIRECT else matches(cut, LOOSE + stem), q(rank))]
        )
        for stem, rank in STEMS
    )
    kept = f"list_filter([{found}], lambda r: r IS NOT NULL)"
    return f"CASE WHEN len({kept}) = 1 THEN {kept}[1] END"


def lead_rank(lead: str, noun: str) -> str:
    s = f"({sentence(lead)})"
    return f"coalesce({lead_tight(s)}, {lead_noun(s, noun)}, {lead_loose(s)})"


def speciesbox(tc: str) -> str:
    word = r"[\p{L}\p{N}_]"
    return first_case(
        [
            (f"contains({tc}, '{{{{speciesbox')", "'Species'"),
            (f"contains({tc}, '{{{{subspeciesbox')", "'Subspecies'"),
            (
                f"contains({tc}, '{{{{infraspeciesbox')",
                first_case(
                    [
                        (matches(tc, rf"\|varietas={word}"), "'Variety'"),
                        (matches(tc, rf"\|variety={word}"), "'Variety'"),
                        (matches(tc, rf"\|subspecies={word}"), "'Subspecies'"),
                    ]
                ),
            ),
        ]
    )


def taxobox(nobra: str, tc: str) -> str:
    def has(text: str) -> str:
        return f"contains({tc}, {q(text)})"

    titled = [
        (f"contains({tc}, {q(f'|{key}={Q5}')} || {nobra} || {q(Q5)})", q(rank))
        for key, rank in TAXOBOX
    ]
    last = first_case([(has(f"|{key}={Q5}"), q(rank)) for key, rank in reversed(TAXOBOX)])
    stray = [
        (has(f"|'varietas={Q2}"), "'Variety'"),
        (has(f"|'variety={Q2}"), "'Variety'"),
        (has(f"|'subspecies={Q2}"), "'Subspecies'"),
    ]
    refined = [
        (f"({last}) = {q(base)} AND {has(f'|{chr(39)}{key}={Q5}')}", q(rank))
        for base, key, rank in REFINED
    ]
    genus = has(f"|genus={Q5}")
    species = f"({has(f'|species={Q5}')} OR {has(f'|binomial={Q2}')})"
    oddities = [
        (f"NOT {genus} AND {species}", "'Species'"),
        (f"{genus} AND {species}", "'Genus'"),
    ]
    rank = first_case(titled + stray + refined + oddities, last)
    return f"CASE WHEN contains({tc}, '{{{{taxobox') THEN {rank} END"


def autobox_key(tc: str) -> str:
    taxon = find_between(tc, "taxon=", "|")
    return (
        f"CASE WHEN contains({tc}, '{{{{automatictaxobox') THEN 'Template:Taxonomy/' || "
        f"upper({taxon}[1:1]) || {taxon}[2:] END"
    )


TAXONOMY_CTE = (
    "SELECT title AS autobox_key, rank AS rank_autobox, extinct AS autobox_extinct FROM ("
    "SELECT title, "
    + first_case(
        [(f"stated = {q(key)}", q(rank)) for key, rank in TAXOBOX if key != "trinomial"]
    )
    + " AS rank, extinct FROM (SELECT title, "
    + find_between(compress("text"), "rank=", "|")
    + " AS stated, "
    + contains_any(compress("text"), ["|extinct=yes", "|extinct=true"])
    + " AS extinct FROM taxo)) WHERE rank IS NOT NULL"
)


def marker(title: str) -> str:
    return first_case([(f"contains({title}, {q(m)})", q(r)) for m, r in MARKERS])


def monotypic(tc: str, lead: str) -> str:
    return f"(contains({tc}, '[[category:monotypic') OR {contains_any(f'lower({lead})', MONOTYPIC)})"


def noun(rank: str, singular: str, plural: str) -> str:
    return f"CASE WHEN {rank} IN {LOW} THEN {q(singular)} ELSE {q(plural)} END"


def draft(rank: str, singular: str, plural: str) -> str:
    return f"{rank} || ' of ' || {noun(rank, singular, plural)}"


def adjust(desc: str, lead: str, auto: str, cat: str) -> str:
    extinct = f"({auto} OR {cat} OR {contains_any(f'lower({lead})', EXTINCT_LEADS)})"
    return (
        f"CASE WHEN length('Extinct ' || {desc}) > 40 THEN {desc} "
        f"WHEN {extinct} THEN 'Extinct ' || lower({desc}) ELSE {desc} END"
    )
