"""Lookups by title. Each per-page request of a sequential job is a join here.

Lookup tables hold one row per title, but one title, taxon or category may be
asked for by a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankdraft.functions import ranks as R
from rankdraft.functions.describe import EXTINCT_CATEGORIES
from rankdraft.functions.pytext import contains_any
from rankdraft.functions.wikitext import compress_text, existing_shortdesc, has_shortdesc_template
from rankdraft.functions.wikitext import normalize_title
from rankdraft.session import BROADCAST_BYTES, fits_broadcast

# A title asked for by more rows than this is spread over SALTS tasks.
HOT_ROWS = 1_000_000
# Tables are pruned by the hashes of up to this many titles, about 120 MB once
# broadcast. A longer list covers much of the tables anyway.
PRUNE_TITLES = 2_000_000
SALTS = 32
# Words of 64 bits in the bitmap for longer lists; about 100 MB once broadcast.
BITMAP_WORDS = 1 << 21


def with_key(df: DataFrame, raw: str = "title") -> DataFrame:
    return df.withColumn("title", normalize_title(F.col(raw)))


def salted_left_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, salts: int = SALTS
) -> DataFrame:
    """Left join with a narrow table that is unique by ``key``, safe for hot keys.

    Left rows of one key are spread by a hash of another column, which a repeated
    task computes alike. Every right row is copied ``salts`` times, so the right
    side should be much smaller than the left. Rows without a key match nothing and are
    spread over all tasks.
    """
    chance = F.xxhash64(spread_by)
    salt = F.when(F.col(key).isNull(), chance).otherwise(F.pmod(chance, F.lit(salts)))
    salted = left.withColumn("_salt", salt)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def salted_semi_join(
    left: DataFrame, keys: DataFrame, key: str, spread_by: str, salts: int = SALTS
) -> DataFrame:
    """Rows whose key is in a distinct list; rows of one key are spread over tasks."""
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    copies = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return left.withColumn("_salt", salt).join(copies, [key, "_salt"], "left_semi").drop("_salt")


def distinct_titles(targets: DataFrame) -> DataFrame:
    """(title, n_targets): each title once, with the number of rows asking for it."""
    return targets.groupBy("title").agg(F.count("*").alias("n_targets"))


def join_back(
    targets: DataFrame,
    results: DataFrame,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Left join targets to results by title, splitting titles with many targets.

    ``results`` holds one row per title and ``n_targets``. At most
    ``rows / hot_rows`` titles are hot, so their list is short and only they are
    copied.
    """
    hot = (
        distinct_titles(targets)
        .where(F.col("n_targets") > hot_rows)
        .select("title", F.lit(salts).alias("_salts"))
    )
    spread = F.pmod(F.xxhash64("seq"), F.coalesce("_salts", F.lit(1)))
    left = (
        targets.join(F.broadcast(hot), "title", "left")
        .withColumn("_salt", spread.cast("int"))
        .drop("_salts")
    )
    copies = F.when(F.col("n_targets") > hot_rows, salts).otherwise(1)
    right = results.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), copies - 1))
    ).drop("n_targets")
    return left.join(right, ["title", "_salt"], "left").drop("_salt")


def by_title(
    targets: DataFrame, lookup: Callable[[DataFrame], DataFrame], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Targets (seq, title) with what ``lookup`` adds to a frame of distinct titles.

    Each title is looked up once, and a title that many targets ask for is split.
    """
    return join_back(targets, lookup(distinct_titles(targets)), hot_rows)


# ---------------------------------------------------------------- pages


def lookup_pages(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets with ``text`` ('' when missing) and ``page_exists``."""
    found = pages.select("title", "text", F.lit(True).alias("page_exists"))
    return (
        targets.join(found, "title", "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("page_exists", F.coalesce("page_exists", F.lit(False)))
    )


def only_titles(table: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows of a table whose title may be in a list of checked size.

    Hashes of the titles are broadcast, so nothing is shuffled. Titles that share a
    hash by chance stay in; the join that follows compares the titles themselves.
    """
    hashes = titles.select(F.xxhash64("title").alias("_hash"))
    keyed = table.withColumn("_hash", F.xxhash64("title"))
    return keyed.join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")


def maybe_titles(table: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows of a table whose title may be in a list of any length.

    A bitmap of BITMAP_WORDS words at most is broadcast, whatever the length of the
    list. Titles that share a bit by chance stay in: one in ten with 14 million titles,
    half with 90 million. The join that follows compares the titles themselves.
    """

    def place(df: DataFrame) -> DataFrame:
        chance = F.xxhash64("title")
        return df.withColumn("_word", F.pmod(chance, F.lit(BITMAP_WORDS))).withColumn(
            "_bit", F.pmod(F.shiftright(chance, 40), F.lit(64)).cast("int")
        )

    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    words = place(titles.select("title")).groupBy("_word").agg(F.bit_or(bits).alias("_bits"))
    found = place(table).join(F.broadcast(words), "_word")
    return found.where(F.getbit("_bits", "_bit") == 1).drop("_word", "_bit", "_bits")


def lookup_shortdesc(titles: DataFrame, page_props: DataFrame) -> DataFrame:
    """Titles with the ``shortdesc`` page property, null when absent."""
    return titles.join(page_props.select("title", "shortdesc"), "title", "left")


def page_props_from_json(responses: DataFrame, column: str = "response") -> DataFrame:
    """(title, shortdesc) from raw page-property responses, one page per response."""
    schema = (
        "query struct<pages:map<string,struct<title:string,pageprops:map<string,string>>>>"
    )
    parsed = responses.select(F.from_json(column, schema).alias("r"))
    page = parsed.select(F.explode(F.map_values("r.query.pages")).alias("page"))
    return page.select(
        F.col("page.title").alias("title"),
        F.try_element_at("page.pageprops", F.lit("wikibase-shortdesc")).alias("shortdesc"),
    )


def lookup_existing(titles: DataFrame, pages: DataFrame, page_props: DataFrame) -> DataFrame:
    """Titles with ``existing_desc`` and ``existing_type``; no text is shuffled."""
    manual = pages.select("title", has_shortdesc_template(F.col("text")).alias("_manual"))
    found = lookup_shortdesc(titles.join(manual, "title", "left"), page_props)
    desc, kind = existing_shortdesc(F.col("shortdesc"), F.coalesce("_manual", F.lit(False)))
    return found.select(*titles.columns, desc.alias("existing_desc"), kind.alias("existing_type"))


def english_descriptions(wikidata: DataFrame) -> DataFrame:
    """(title, wikidata_sd) from items with a map of descriptions by language."""
    english = F.try_element_at("descriptions", F.lit("en"))
    return wikidata.select("title", english.alias("wikidata_sd"))


def lookup_wikidata(titles: DataFrame, wikidata: DataFrame) -> DataFrame:
    """Titles with ``wikidata_sd``, '' when the item or its description is missing."""
    found = english_descriptions(wikidata)
    return titles.join(found, "title", "left").fillna({"wikidata_sd": ""})


# ---------------------------------------------------------------- categories

# A missing flag counts as visible.
VISIBLE = "NOT coalesce(hidden, false)"
SIGNALS = [*R.CATEGORY_RANKS, *(fragment for _, fragment in R.CATEGORY_OVERRIDES)]


def visible_categories(page_categories: DataFrame) -> DataFrame:
    """Distinct (title, category) of the categories that are not hidden, lower case."""
    return (
        page_categories.where(VISIBLE)
        .select("title", F.lower("category").alias("category"))
        .distinct()
    )


def lookup_categories(titles: DataFrame, page_categories: DataFrame) -> DataFrame:
    """(title, category) of each distinct title; a null category where it has none.

    The list of a page stays rows, so a page may have any number of categories.
    """
    asked = titles.select("title").distinct()
    visible = visible_categories(page_categories)
    found = visible.join(asked, "title", "left_semi")
    without = asked.join(visible.select("title").distinct(), "title", "left_anti")
    return found.unionByName(without, allowMissingColumns=True)


def category_signals(page_categories: DataFrame) -> DataFrame:
    """What the visible categories of each title say: ``rank_category``, ``category_extinct``.

    Only flags are aggregated, so a title with any number of categories costs one
    row per map task and never a collected list.
    """
    category = F.lower("category")
    fragments = list(dict.fromkeys(SIGNALS))
    flags = [F.bool_or(category.contains(f)).alias(f"_{f}") for f in fragments]
    extinct = F.bool_or(contains_any(category, EXTINCT_CATEGORIES))
    telling = contains_any(category, fragments + EXTINCT_CATEGORIES)
    seen = (
        page_categories.where(VISIBLE)
        .where(telling)
        .groupBy("title")
        .agg(*flags, extinct.alias("category_extinct"))
    )
    rank = R.rank_from_category(lambda f: F.col(f"_{f}"))
    return seen.select("title", rank.alias("rank_category"), "category_extinct")


def titles_in_category(
    titles: DataFrame, page_categories: DataFrame, fragment: str
) -> DataFrame:
    """Titles with a visible category whose name contains the fragment."""
    match = F.lower("category").contains(fragment.lower())
    members = page_categories.where(VISIBLE).where(match).select("title").distinct()
    return titles.join(members, "title", "left_semi")


# ---------------------------------------------------------------- taxonomy


def parse_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """(autobox_key, rank_autobox, autobox_extinct) of templates with a known rank."""
    compressed = taxonomy.select(
        normalize_title(F.col("title")).alias("autobox_key"),
        compress_text(F.col("text")).alias("_tc"),
    )
    return compressed.select(
        "autobox_key",
        R.taxonomy_rank(F.col("_tc")).alias("rank_autobox"),
        R.taxonomy_extinct(F.col("_tc")).alias("autobox_extinct"),
    ).where(F.col("rank_autobox").isNotNull())


def lookup_taxonomy(
    pages: DataFrame, taxonomy: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Add ``rank_autobox`` and ``autobox_extinct`` by ``autobox_key``.

    Many pages may share one taxon. A taxonomy of checked size is broadcast;
    beyond it pages are spread over salts.
    """
    parsed = parse_taxonomy(taxonomy)
    if fits_broadcast(taxonomy.select("title"), broadcast_bytes):
        found = pages.join(F.broadcast(parsed), "autobox_key", "left")
    else:
        found = salted_left_join(pages, parsed, "autobox_key", spread_by="title")
    return found.withColumn("autobox_extinct", F.coalesce("autobox_extinct", F.lit(False)))
