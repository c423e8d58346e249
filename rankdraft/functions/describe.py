"""From five ranks to a description or a coded failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankdraft.config import JobConfig
from rankdraft.functions import ranks as R
from rankdraft.functions.pytext import any_phrase
from rankdraft.functions.wikitext import title_word_count

MAX_EXTINCT_LENGTH = 40
# Lead wordings and category fragments of extinct taxa.
EXTINCT_PHRASES = [
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

RANK_COLUMNS = ["rank_category", "rank_lead", "rank_speciesbox", "rank_taxobox", "rank_autobox"]


def adjust_desc(
    description: Column, lead: Column, autobox_extinct: Column, category_extinct: Column
) -> Column:
    """Prefix "Extinct" where the taxon is, unless that gets too long."""
    extinct = (
        autobox_extinct | any_phrase(F.lower(lead), EXTINCT_PHRASES) | category_extinct
    )
    longer = F.length(F.concat(F.lit("Extinct "), description))
    fits = longer <= MAX_EXTINCT_LENGTH
    prefixed = F.concat(F.lit("Extinct "), F.lower(description))
    return F.when(fits & extinct, prefixed).otherwise(description)


def with_description(df: DataFrame, cfg: JobConfig) -> DataFrame:
    """Add ``modes``, ``best_rank``, ``gen_ok`` and ``gen_msg``.

    Needs ``title``, ``lead``, the five rank columns, ``autobox_extinct``,
    ``category_extinct`` and ``monotypic_category``.
    """
    voted = (
        df.withColumn("votes", F.array_compact(F.array(*RANK_COLUMNS)))
        .withColumn("_words", title_word_count(F.col("title")))
        .withColumn("_marker", R.title_marker_rank(F.col("title")))
        .withColumn("modes", R.modes(F.col("votes")))
        .withColumn("best_rank", R.best_rank(F.col("modes")))
    )
    best, words, autobox = F.col("best_rank"), F.col("_words"), F.col("rank_autobox")
    settled_ok, settled = R.settled_rank(
        best, words == 1, R.is_monotypic_genus(F.col("monotypic_category"), F.col("lead"))
    )
    chosen = (
        voted.withColumn(
            "_chosen",
            F.coalesce(
                F.col("_marker"),
                F.when(best.isNotNull(), settled).otherwise(
                    R.conflict_rank(F.col("votes"), F.col("modes"), autobox, words)
                ),
            ),
        )
        .withColumn(
            "gen_ok",
            F.col("_marker").isNotNull()
            | F.when(best.isNotNull(), settled_ok).otherwise(F.col("_chosen").isNotNull()),
        )
        .withColumn(
            "_adjusted",
            adjust_desc(
                R.draft(F.col("_chosen"), cfg.name_singular, cfg.name_plural),
                F.col("lead"),
                F.col("autobox_extinct"),
                F.col("category_extinct"),
            ),
        )
    )
    message = (
        F.when(F.col("gen_ok"), F.col("_adjusted"))
        .when(best.isNotNull(), F.concat(F.lit("*** : "), F.col("_adjusted")))
        .otherwise(R.conflict_error(F.col("votes"), autobox))
    )
    return chosen.withColumn("gen_msg", message).drop("votes", "_words", "_marker", "_chosen", "_adjusted")
