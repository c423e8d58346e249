"""The five rank sources, the vote over them and the rules that settle it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankdraft.functions.pytext import (
    SPACE,
    WORD,
    any_phrase,
    contains_any,
    find_between,
    first_reason,
)
from rankdraft.functions.wikitext import first_sentence

# Category name fragments, first hit wins.
CATEGORY_RANKS = {
    "subspecies": "Subspecies",
    "subgenera": "Subgenus",
    "genera": "Genus",
    "subfamilies": "Subfamily",
    "families": "Family",
    "superfamilies": "Superfamily",
    "orders": "Order",
    "suborders": "Suborder",
    "phyla": "Phylum",
}
# A later fragment that changes an earlier hit.
CATEGORY_OVERRIDES = {
    ("Family", "superfamilies"): "Superfamily",
    ("Order", "suborder"): "Suborder",
}
# Word stems looked for in the lead, first hit wins.
LEAD_STEMS = {
    "Subgenus": "subgenu",
    "Genus": "genus",
    "Superfamily": "superfami",
    "Family": "famil",
    "Subfamily": "subfami",
    "Tribe": "tribe",
    "Subtribe": "subtrib",
    "Class": "class",
    "Subclass": "subclas",
    "Order": "order",
    "Suborder": "suborde",
    "Infraorder": "infraorde",
    "Clade": "clade",
    "Variety": "variet",
    "Species": "species",
    "Informal group": "informal group",
    "Phylum": "phylum",
    "Subphylum": "subphylu",
}
# Stems that must follow the verb directly, even in the loose search.
TIGHT_ONLY = ["Infraorder", "Phylum", "Subphylum"]
# Taxobox parameters, in this order.
TAXOBOX_RANKS = {
    "genus": "Genus",
    "varietas": "Variety",
    "variety": "Variety",
    "tribus": "Tribe",
    "superfamilia": "Superfamily",
    "subtribus": "Subtribe",
    "subspecies": "Subspecies",
    "trinomial": "Subspecies",
    "classis": "Class",
    "subfamilia": "Subfamily",
    "species": "Species",
    "subordo": "Suborder",
    "subgenus": "Subgenus",
    "ordo": "Order",
    "subclassis": "Subclass",
    "familia": "Family",
    "informalgroup": "Informal group",
    "stemgroup": "Group",
    "localgroup": "Group",
    "clade": "Clade",
    "cladus": "Clade",
    "phylum": "Phylum",
    "subphylum": "Subphylum",
}
# Fixed values: (rank, parameter) pairs that refine a taxobox rank.
TAXOBOX_REFINEMENTS = {
    ("Genus", "subgenus"): "Subgenus",
    ("Family", "subfamilia"): "Subfamily",
    ("Family", "superfamilia"): "Superfamily",
    ("Tribe", "subtribus"): "Subtribe",
    ("Class", "subclassis"): "Subclass",
    ("Order", "subordo"): "Suborder",
}
# Markers in a title, first hit wins.
TITLE_MARKERS = {
    "var.": "Variety",
    "subsp.": "Subspecies",
    "sect.": "Group",
    "subg.": "Subgenus",
    " sp.": "Species",
}
# Wordings of a one-species genus.
MONOTYPIC_CATEGORY = "[[category:monotypic"
MONOTYPIC_PHRASES = [
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
LOW_RANKS = ["Species", "Subspecies", "Variety"]
TAXONOMY_PREFIX = "Template:Taxonomy/"
BOLD_ITALIC = "'" * 5
ITALIC = "'" * 2


# ---------------------------------------------------------------- categories


def in_category(categories: Column, fragment: str) -> Column:
    """True where one of the lower-case category names contains the fragment."""
    return F.exists(categories, lambda name: name.contains(fragment.lower()))


def rank_from_category(has: Callable[[str], Column]) -> Column:
    """``has(fragment)`` tells whether a visible category contains a fragment."""
    rank = first_reason(*((has(part), rank) for part, rank in CATEGORY_RANKS.items()))
    for (base, fragment), better in CATEGORY_OVERRIDES.items():
        rank = F.when((rank == base) & has(fragment), better).otherwise(rank)
    return rank


# ---------------------------------------------------------------- lead

_IS_A = rf"(?U)(?:is|was){SPACE}an?{SPACE}"
_IN_THE = f"(?U){SPACE}in{SPACE}the"
# Stands for "in the": the loose search stops at a line end, and no stem follows it.
_STOP = "\n'"


def _loose(stems: list[str]) -> str:
    """Stems up to 50 characters behind "is a", "are a", "was a" or "were a"."""
    either = "|".join(stems)
    behind = rf"(?<=(?:is|are|was|were){SPACE}a[^\n]{{0,50}})"
    return f"(?U)(?={SPACE}(?:{either})){behind}{SPACE}({either})"


def rank_lead_tight(sentence: Column) -> Column:
    """First rank of the list whose stem directly follows "is a" or the like.

    No stem starts another one, so one pass finds every stem there is.
    """
    stems = "|".join(LEAD_STEMS.values())
    found = F.regexp_extract_all(sentence, F.lit(f"{_IS_A}({stems})"), F.lit(1))
    places = F.transform(found, lambda stem: F.array_position(_words(LEAD_STEMS.values()), stem))
    return F.get(_words(LEAD_STEMS), F.array_min(places).cast("int") - 1)


def rank_lead_noun(sentence: Column, noun: str) -> Column:
    return F.when(F.rlike(sentence, F.lit(_IS_A + noun)), "Species")


def rank_lead_loose(sentence: Column) -> Column:
    """The rank whose stem follows within a few words; null if several do."""
    loose = [stem for rank, stem in LEAD_STEMS.items() if rank not in TIGHT_ONLY]
    tight = "|".join(LEAD_STEMS[rank] for rank in TIGHT_ONLY)
    cut = F.regexp_replace(sentence, _IN_THE, _STOP)
    found = F.array_distinct(
        F.concat(
            F.regexp_extract_all(cut, F.lit(_loose(loose)), F.lit(1)),
            F.regexp_extract_all(sentence, F.lit(f"{_IS_A}({tight})"), F.lit(1)),
        )
    )
    place = F.array_position(_words(LEAD_STEMS.values()), F.get(found, F.lit(0)))
    return F.when(F.size(found) == 1, F.get(_words(LEAD_STEMS), place.cast("int") - 1))


def rank_from_sentence(sentence: Column, noun: str) -> Column:
    """Rank from the first sentence of a lead, by the tight, noun and loose searches."""
    return F.coalesce(
        rank_lead_tight(sentence), rank_lead_noun(sentence, noun), rank_lead_loose(sentence)
    )


def rank_from_lead(lead: Column, noun: str) -> Column:
    return rank_from_sentence(first_sentence(lead), noun)


def _words(values) -> Column:
    """Constant array of strings without a bar."""
    return F.split(F.lit("|".join(values)), r"\|")


# ---------------------------------------------------------------- infoboxes


def rank_from_speciesbox(compressed: Column) -> Column:
    varietas = F.rlike(compressed, F.lit(rf"\|(?:varietas|variety)={WORD}"))
    subspecies = F.rlike(compressed, F.lit(rf"\|subspecies={WORD}"))
    infra = F.when(varietas, "Variety").when(subspecies, "Subspecies")
    return (
        F.when(compressed.contains("{{speciesbox"), "Species")
        .when(compressed.contains("{{subspeciesbox"), "Subspecies")
        .when(compressed.contains("{{infraspeciesbox"), infra)
    )


def bold_keys(compressed: Column) -> Column:
    """Taxobox parameters whose value starts in bold italics; null without a taxobox."""
    keys = "|".join(TAXOBOX_RANKS)
    found = F.regexp_extract_all(compressed, F.lit(rf"\|({keys})={BOLD_ITALIC}"), F.lit(1))
    return F.when(compressed.contains("{{taxobox"), found)


def _place_in_taxobox(key: Column) -> Column:
    return F.array_position(_words(TAXOBOX_RANKS), key)


def _taxobox_rank(place: Column) -> Column:
    return F.get(_words(TAXOBOX_RANKS.values()), place.cast("int") - 1)


def rank_from_taxobox(nobra: Column, compressed: Column, bold: Column) -> Column:
    """Rank of a hand-made taxobox, from what it sets in bold italics (``bold_keys``).

    Three kinds of literal carry a stray quote after the bar and so hardly ever
    match. The title keeps its case and spaces while the text has lost both, so
    only caseless one-word titles match. Both are part of the results.
    """
    in_bold = F.concat(F.lit(BOLD_ITALIC), nobra, F.lit(BOLD_ITALIC))
    holding = F.filter(
        _words(TAXOBOX_RANKS),
        lambda key: F.contains(compressed, F.concat(F.lit("|"), key, F.lit("="), in_bold)),
    )
    titled = F.array_min(F.transform(holding, _place_in_taxobox))
    # The last parameter of the list decides, not the last one of the page.
    last = _taxobox_rank(F.array_max(F.transform(bold, _place_in_taxobox)))

    def stray(key: str, quotes: str) -> Column:
        return compressed.contains(f"|'{key}={quotes}")

    refined = first_reason(
        *(
            (stray(key, BOLD_ITALIC) & (last == base), better)
            for (base, key), better in TAXOBOX_REFINEMENTS.items()
        )
    )
    low = (
        F.when(stray("varietas", ITALIC) | stray("variety", ITALIC), "Variety")
        .when(stray("subspecies", ITALIC), "Subspecies")
        .otherwise(refined)
    )
    species = F.array_contains(bold, "species") | compressed.contains(f"|binomial={ITALIC}")
    genus = F.when(F.array_contains(bold, "genus"), "Genus").otherwise("Species")
    rank = F.coalesce(
        F.when(F.contains(compressed, F.concat(F.lit("="), in_bold)), _taxobox_rank(titled)),
        F.when(compressed.contains("|'"), low),
        F.when(species, genus),
        last,
    )
    return F.when(bold.isNotNull(), rank)


def autobox_taxon(compressed: Column) -> Column:
    """Taxon named by an automatic taxobox, null without one."""
    taxon = find_between(compressed, "taxon=", "|")
    return F.when(compressed.contains("{{automatictaxobox"), taxon)


def autobox_key(taxon: Column) -> Column:
    """Title of the taxonomy template of a taxon."""
    capital = F.upper(F.substring(taxon, 1, 1))
    title = F.concat(F.lit(TAXONOMY_PREFIX), capital, F.substr(taxon, F.lit(2)))
    return F.btrim(F.regexp_replace(title, "[ _]+", " "))


def taxonomy_rank(compressed: Column) -> Column:
    """Rank stated by a taxonomy template; null when unknown or absent."""
    known = {k: v for k, v in TAXOBOX_RANKS.items() if k != "trinomial"}
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    stated = find_between(compressed, "rank=", "|")
    return F.try_element_at(F.create_map(*pairs), stated)


def taxonomy_extinct(compressed: Column) -> Column:
    return contains_any(compressed, ["|extinct=yes", "|extinct=true"])


# ---------------------------------------------------------------- titles


def title_marker_rank(title: Column) -> Column:
    return first_reason(*((title.contains(m), rank) for m, rank in TITLE_MARKERS.items()))


def monotypic_category(compressed: Column) -> Column:
    return compressed.contains(MONOTYPIC_CATEGORY)


def is_monotypic_genus(has_category: Column, lead: Column) -> Column:
    return has_category | any_phrase(F.lower(lead), MONOTYPIC_PHRASES)


# ---------------------------------------------------------------- vote


def modes(votes: Column) -> Column:
    """Most common ranks of an array without nulls, in order of first appearance."""

    def count(rank: Column) -> Column:
        return F.size(F.filter(votes, lambda v: v == rank))

    distinct = F.array_distinct(votes)
    top = F.array_max(F.transform(distinct, count))
    return F.filter(distinct, lambda rank: count(rank) == top)


def best_rank(mode_list: Column) -> Column:
    """The single most common rank, null when there is a tie or nothing."""
    return F.when(F.size(mode_list) == 1, mode_list[0])


def rank_noun(rank: Column, singular: str, plural: str) -> Column:
    return F.when(rank.isin(LOW_RANKS), singular).otherwise(plural)


def draft(rank: Column, singular: str, plural: str) -> Column:
    return F.concat(rank, F.lit(" of "), rank_noun(rank, singular, plural))


def settled_rank(best: Column, single_word: Column, monotypic: Column) -> tuple[Column, Column]:
    """(ok, rank) where the vote has one winner."""
    genus = single_word & (best == "Species") & monotypic
    low = best.isin(LOW_RANKS)
    odd = (single_word & best.isin("Subspecies", "Variety")) | (~single_word & ~low)
    return ~odd, F.when(genus, "Genus").otherwise(best)


NO_RANKS = "***** : NO MATCHING RANKS"
AUTOBOX_LEFT = "***** :  AUTOTAXOBOX HAS "
UNDECIDED = "***** : CAN'T GET BEST RANK"


def conflict_rank(votes: Column, mode_list: Column, autobox: Column, words: Column) -> Column:
    """Rank chosen where the vote has no single winner, null if none can be."""

    def has(rank: str) -> Column:
        return F.array_contains(votes, rank)

    others = F.array_remove(mode_list, autobox)
    species = (
        F.when(has("Genus"), F.when(words == 1, "Genus").otherwise("Species"))
        .when(has("Subspecies"), "Subspecies")
        .when(has("Variety"), "Variety")
        .when(words == 2, "Species")
    )
    left = F.when(F.size(others) == 1, F.get(others, F.lit(0)))
    return F.coalesce(F.when(has("Species"), species), left)


def conflict_error(votes: Column, autobox: Column) -> Column:
    return (
        F.when(F.size(votes) == 0, NO_RANKS)
        .when(autobox.isNotNull(), F.concat(F.lit(AUTOBOX_LEFT), autobox))
        .otherwise(UNDECIDED)
    )
