"""Stage: from a target list and page tables to reviewable drafts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankdraft.config import JobConfig
from rankdraft.functions import checks as C
from rankdraft.functions import ranks as R
from rankdraft.functions import wikitext as W
from rankdraft.functions.describe import RANK_COLUMNS, with_description
from rankdraft.functions.pytext import first_reason
from rankdraft.operators import lookups as L
from rankdraft.operators import ordered as O

# Targets in the first stretch when a limit is set, at least; each further stretch is
# twice as long. What a run returns ends where the limit is met, so it does not depend
# on this number.
MIN_STRETCH = 1_000


@dataclass(frozen=True)
class WikiTables:
    """Input tables.

    pages (title, text), page_props (title, shortdesc), page_categories (title,
    category, hidden), taxonomy (title, text), wikidata (title, descriptions);
    titles are canonical and, but for page_categories, unique.
    """

    pages: DataFrame
    page_props: DataFrame
    page_categories: DataFrame
    taxonomy: DataFrame
    wikidata: DataFrame

    def pruned(self, titles: DataFrame) -> WikiTables:
        """Only the rows of the given titles; the list must be of checked size."""
        return WikiTables(
            L.only_titles(self.pages, titles),
            L.only_titles(self.page_props, titles),
            L.only_titles(self.page_categories, titles),
            self.taxonomy,
            L.only_titles(self.wikidata, titles),
        )


def page_features(pages: DataFrame, cfg: JobConfig) -> DataFrame:
    """One narrow row per page: all that staging needs to know of its text.

    The text itself is dropped here, before any shuffle.
    """
    text, compressed = F.col("text"), F.col("_tc")
    infobox = C.has_infobox(text, cfg.infobox_strings) if cfg.require_infobox else F.lit(None)
    infoboxes = W.count_infoboxes(text) if cfg.sole_infobox else F.lit(None)
    featured = pages.select(
        "title",
        "text",
        W.compress_text(text).alias("_tc"),
        W.title_nobra(F.col("title")).alias("_nobra"),
    ).select(
        "*",
        R.bold_keys(compressed).alias("_bold"),
        R.autobox_taxon(compressed).alias("_taxon"),
    )
    featured = featured.select(
        "title",
        "text",
        C.is_redirect(text).alias("redirect"),
        W.has_shortdesc_template(text).alias("has_template"),
        infobox.cast("boolean").alias("infobox"),
        infoboxes.cast("int").alias("infoboxes"),
        R.monotypic_category(compressed).alias("monotypic_category"),
        R.rank_from_speciesbox(compressed).alias("rank_speciesbox"),
        R.rank_from_taxobox(F.col("_nobra"), compressed, F.col("_bold")).alias("rank_taxobox"),
        R.autobox_key(F.col("_taxon")).alias("autobox_key"),
    )
    lead_rank = R.rank_from_sentence(F.col("_sentence"), cfg.name_singular)
    return (
        W.with_lead(featured)
        .withColumn("_sentence", W.first_sentence(F.col("lead")))
        .withColumn("rank_lead", lead_rank)
        .drop("text", "_sentence")
    )


# What missing rows look like: a page with empty text, no item, no category.
MISSING_PAGE = {
    "redirect": False,
    "has_template": False,
    "infobox": False,
    "infoboxes": 0,
    "monotypic_category": False,
    "lead": "",
    "wikidata_sd": "",
    "category_extinct": False,
}


def with_facts(titles: DataFrame, tables: WikiTables, cfg: JobConfig) -> DataFrame:
    """Rows with a ``title``, and everything the tables say about it."""
    joined = titles.join(page_features(tables.pages, cfg), "title", "left")
    joined = L.lookup_shortdesc(joined, tables.page_props)
    joined = joined.join(L.category_signals(tables.page_categories), "title", "left")
    joined = L.lookup_wikidata(joined, tables.wikidata)
    joined = L.lookup_taxonomy(joined, tables.taxonomy).fillna(MISSING_PAGE)
    desc, kind = W.existing_shortdesc(F.col("shortdesc"), F.col("has_template"))
    return joined.select("*", desc.alias("existing_desc"), kind.alias("existing_type"))


def with_verdict(facts: DataFrame, cfg: JobConfig) -> DataFrame:
    """Add ``skip_reason``, ``ok`` and ``description``, a draft or a coded failure."""
    page = {c: F.col(c) for c in ("title", "redirect", "infobox", "infoboxes")}
    page["kind"] = F.col("existing_type")
    criteria = C.criteria_checks(
        F.col("existing_desc"), F.col("existing_type"), F.col("lead"), F.col("title"), cfg
    )
    checked = facts.withColumn("skip_reason", first_reason(*C.page_checks(page, cfg)))
    checked = checked.withColumn("criteria_error", first_reason(*criteria))
    judged = with_description(checked, cfg)
    ok = F.col("skip_reason").isNull() & F.col("criteria_error").isNull() & F.col("gen_ok")
    return judged.withColumn("ok", ok).withColumn(
        "description", F.coalesce("criteria_error", "gen_msg")
    )


VERDICT = [
    "skip_reason",
    "ok",
    "description",
    "wikidata_sd",
    "lead",
    *RANK_COLUMNS,
    "modes",
    "best_rank",
]


def judge(titles: DataFrame, tables: WikiTables, cfg: JobConfig) -> DataFrame:
    """One verdict per row with a ``title``."""
    return with_verdict(with_facts(titles, tables, cfg), cfg).select(*titles.columns, *VERDICT)


def judge_targets(
    targets: DataFrame,
    tables: WikiTables,
    cfg: JobConfig,
    hot_rows: int = L.HOT_ROWS,
    prune_titles: int = L.PRUNE_TITLES,
) -> DataFrame:
    """One verdict per target row (seq, title).

    Each title is judged once, however many targets ask for it, and a list article is
    ruled out by its title alone: nothing is looked up for it. A list of checked length
    prunes the tables before their texts are read further, which changes no result.
    """
    listed = C.is_list_article(F.col("title"))
    titles = L.distinct_titles(targets.where(~listed))
    if targets.count() <= prune_titles:
        tables = tables.pruned(titles)
    reason = F.when(listed, C.LIST_ARTICLE).otherwise(F.col("skip_reason"))
    verdicts = L.join_back(targets, judge(titles, tables, cfg), hot_rows)
    verdicts = verdicts.withColumn("skip_reason", reason).fillna({"ok": False})
    return verdicts.withColumn("title", W.clean_title(F.col("title")))


@dataclass(frozen=True)
class Staging:
    """A staging run. ``verdicts`` is a finished table in target order, up to the row
    after which the run stops; the others are cheap views of it."""

    verdicts: DataFrame
    articles: DataFrame
    successes: DataFrame
    stop: int | None

    def staged(self) -> DataFrame:
        """The staging table: drafts and recorded failures, numbered from 1."""
        failed = ~F.col("ok")
        code = F.when(failed, F.regexp_extract("description", r"^\*+", 0))
        rows = self.articles.withColumn("code", code)
        return rows.select(
            "n", "title", "description", "wikidata_sd", "lead", "ok", "code"
        )

    def skipped(self) -> DataFrame:
        rows = self.verdicts.where(F.col("skip_reason").isNotNull())
        return rows.select("seq", "title", "skip_reason")


def run(
    targets: DataFrame,
    tables: WikiTables,
    cfg: JobConfig,
    hot_rows: int = L.HOT_ROWS,
    prune_titles: int = L.PRUNE_TITLES,
) -> Staging:
    """Judge all given targets (seq, title) and cut the result at the first limit."""
    judged = judge_targets(O.ranged(targets), tables, cfg, hot_rows, prune_titles)
    return numbered(O.in_ranges(judged), cfg)


def numbered(
    verdicts: DataFrame, cfg: JobConfig, n_before: int = 0, successes_before: int = 0
) -> Staging:
    """Number the rows of a finished table, after those of earlier ones, and cut it."""
    articles = O.number_rows(verdicts, F.col("skip_reason").isNull(), "n")
    articles = articles.withColumn("n", F.col("n") + n_before)
    successes = O.number_rows(verdicts, F.col("ok"), "success_no")
    successes = successes.withColumn("success_no", F.col("success_no") + successes_before)
    stop = O.stop_after(articles, successes, cfg)
    return Staging(*(O.upto(rows, stop) for rows in (verdicts, articles, successes)), stop)


def run_in_stretches(
    targets: DataFrame,
    tables: WikiTables,
    cfg: JobConfig,
    hot_rows: int = L.HOT_ROWS,
    prune_titles: int = L.PRUNE_TITLES,
) -> Staging:
    """As ``run``, for limits that are met early: stretches of the list, each twice as
    long as the one before, are judged once each, until one meets a limit."""
    ordered = O.ranged(targets)
    placed = O.number_rows(ordered, F.lit(True), "_no")
    total, done = ordered.count(), 0
    size = max(MIN_STRETCH, 4 * max(cfg.max_arts, cfg.max_stage))
    parts: list[Staging] = []
    n = successes = 0
    while True:
        stretch = placed.where(F.col("_no").between(done + 1, done + size)).drop("_no")
        judged = judge_targets(stretch, tables, cfg, hot_rows, prune_titles)
        parts.append(numbered(O.in_ranges(judged), cfg, n, successes))
        done, size = done + size, 2 * size
        if parts[-1].stop is not None or done >= total:
            break
        n += parts[-1].articles.count()
        successes += parts[-1].successes.count()
    tables_of = ((p.verdicts, p.articles, p.successes) for p in parts)
    return Staging(*(reduce(DataFrame.unionByName, t) for t in zip(*tables_of)), parts[-1].stop)


def stage(targets: DataFrame, tables: WikiTables, cfg: JobConfig, **sizes) -> Staging:
    """Run the stage phase over a target list (seq, raw_title); ``seq`` is unique.

    With limits set, the list is judged in stretches that end where a limit is met.
    """
    keyed = targets.select("seq", W.normalize_title(F.col("raw_title")).alias("title"))
    if cfg.partial:
        keyed = O.from_startpoint(keyed, W.clean_title(F.col("title")), cfg.startpoint)
    limited = cfg.max_arts or cfg.max_stage
    return (run_in_stretches if limited else run)(keyed, tables, cfg, **sizes)
