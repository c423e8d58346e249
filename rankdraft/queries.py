"""One runnable query per operator, over tables derived from the given documents."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankdraft import profiles as P
from rankdraft.config import JobConfig
from rankdraft.corpus import ROOT_CATEGORY, Corpus
from rankdraft.functions import checks as C
from rankdraft.functions import describe as D
from rankdraft.functions import pytext as T
from rankdraft.functions import ranks as R
from rankdraft.functions import wikitext as W
from rankdraft.operators import category_tree, voting
from rankdraft.operators import lookups as L
from rankdraft.operators import ordered as O
from rankdraft.plans import edit as E
from rankdraft.plans import stage as S
from rankdraft.session import scratch_dir
from rankdraft.sinks import staging as K
from rankdraft.sources import lines, staged, targets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_TIME = datetime.datetime(2026, 1, 2, 3, 4)


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _new_folder(spark: SparkSession, kind: str) -> str:
    return f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ scalar functions


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).pages


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).targets.withColumnRenamed("raw_title", "title")


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_lead(_articles(spark, sf_dir)).select("title", "lead")


def _scalar(name: str, source, **columns: Callable[[], Column]) -> None:
    """Register a query that adds columns to the rows of a source."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = [make().alias(alias) for alias, make in columns.items()]
        return source(spark, sf_dir).select("title", *made)

    QUERIES[name] = run


def _big(c: Column) -> Column:
    return c.cast("bigint")


_scalar("title_nobra", _targets, nobra=lambda: W.title_nobra(F.col("title")))
_scalar("title_word_count", _targets, words=lambda: _big(W.title_word_count(F.col("title"))))
_scalar("clean_title", _targets, clean=lambda: W.clean_title(F.col("title")))
_scalar("title_url", _targets, url=lambda: W.title_url(F.col("title")))
_scalar("compress_text", _articles, compressed=lambda: W.compress_text(F.col("text")))
_scalar("count_infoboxes", _articles, n=lambda: _big(W.count_infoboxes(F.col("text"))))
_scalar("clean_text_page", _articles, cleaned=lambda: W.clean_text(F.col("text")))
_scalar("find_between", _articles, part=lambda: T.find_between(F.col("text"), "genus = ", "|"))
_scalar("first_sentence", _leads, sentence=lambda: W.first_sentence(F.col("lead")))

for _step, _name in (
    (W.lead_section, "lead_section"),
    (W.mask_templates, "mask_templates"),
    (W.shorten_piped_links, "shorten_piped_links"),
    (W.mask_images, "mask_images"),
    (W.drop_selfclosing_refs, "drop_selfclosing_refs"),
    (W.mask_refs, "mask_refs"),
    (W.clean_text, "clean_text"),
    (W.truncate_lead, "get_lead"),
):

    def _run_lead(spark: SparkSession, sf_dir: str, step=_step) -> DataFrame:
        return W.with_lead(_articles(spark, sf_dir), upto=step).select("title", "lead")

    QUERIES[_name] = _run_lead

_scalar("truncate_lead", _articles, start=lambda: W.truncate_lead(F.col("text")))


@query("bracket_pairs")
def bracket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of matching braces in each lead section; unbalanced ones have none."""
    sections = W.with_lead(_articles(spark, sf_dir), upto=W.lead_section)
    pairs = W.bracket_pairs(W.single_braces(F.col("lead")), "{", "}")
    rows = sections.select("title", pairs.alias("pairs"))
    return rows.select(
        "title",
        F.col("pairs").isNotNull().alias("balanced"),
        F.explode_outer("pairs").alias("pair"),
    ).select(
        "title",
        "balanced",
        _big(F.col("pair.open_pos")).alias("open_pos"),
        _big(F.col("pair.close_pos")).alias("close_pos"),
    )


# ------------------------------------------------------------------ sources


@query("scan_targets")
def scan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.scan_targets(spark, _target_file(spark, sf_dir))


@query("reject_targets")
def reject_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = targets.rejected_targets(lines.read_lines(spark, _target_file(spark, sf_dir)))
    return found.select(F.col("line_no").alias("seq"), "line")


def _target_file(spark: SparkSession, sf_dir: str) -> str:
    """The targets as a TSV, with headers and broken lines in between."""
    tsv = F.concat_ws("\t", "seq", "raw_title")
    line = (
        F.when(F.col("seq") % 50 == 7, "number\ttitle\tpageid")
        .when(F.col("seq") % 61 == 5, F.concat(F.lit("broken "), "seq"))
        .otherwise(tsv)
    )
    path = _new_folder(spark, "targets")
    Corpus(spark, sf_dir).targets.orderBy("seq").select(line.alias("value")).write.text(path)
    return path


@query("scan_category_recursive")
def scan_category_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_tree.category_members(Corpus(spark, sf_dir).links, ROOT_CATEGORY)


@query("scan_category_flat")
def scan_category_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = Corpus(spark, sf_dir).links
    return category_tree.category_members(links, "Category:Algae genera", recurse=False)


@query("category_targets")
def category_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each article of the tree in the title order of the target list."""
    found = category_tree.targets_from_category(Corpus(spark, sf_dir).links, ROOT_CATEGORY)
    numbered = O.number_rows(O.in_order(found), F.lit(True), "place")
    return numbered.select("place", F.col("raw_title").alias("title"))


@query("lookup_page_text")
def lookup_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    rows = L.with_key(c.targets, "raw_title").drop("raw_title")
    return L.by_title(rows, lambda titles: L.lookup_pages(titles, c.pages))


@query("lookup_shortdesc")
def lookup_shortdesc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    rows = _targets(spark, sf_dir)
    return L.by_title(rows, lambda titles: L.lookup_shortdesc(titles, c.page_props))


@query("shortdesc_from_json")
def shortdesc_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page property read out of raw responses, one per target."""
    c = Corpus(spark, sf_dir)
    rows = _targets(spark, sf_dir)
    answers = L.by_title(rows, lambda titles: L.lookup_shortdesc(titles, c.page_props))
    props = F.when(
        F.col("shortdesc").isNotNull(), F.create_map(F.lit("wikibase-shortdesc"), "shortdesc")
    )
    page = F.struct("title", props.alias("pageprops"))
    pages = F.create_map(F.col("seq").cast("string"), page)
    body = F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query")))
    return L.page_props_from_json(answers.select(body.alias("response")))


@query("lookup_wikidata_desc")
def lookup_wikidata_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, items = _targets(spark, sf_dir), Corpus(spark, sf_dir).wikidata
    return L.by_title(rows, lambda titles: L.lookup_wikidata(titles, items))


@query("page_category_array")
def page_category_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category list of each page, one row per category."""
    c = Corpus(spark, sf_dir)
    return L.lookup_categories(_targets(spark, sf_dir), c.page_categories)


@query("lookup_taxonomy")
def lookup_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    taxon = R.autobox_taxon(W.compress_text(F.col("text")))
    keyed = c.pages.select("title", R.autobox_key(taxon).alias("autobox_key"))
    return L.lookup_taxonomy(keyed, c.taxonomy)


@query("scan_staged")
def scan_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging lines written as text, with a wiki table and blanks in between."""
    tsv = F.concat_ws("\t", "seq", F.concat(F.lit(" "), "raw_title"), F.lit("Species of alga "))
    line = (
        F.when(F.col("seq") % 40 == 3, "{| class=wikitable")
        .when(F.col("seq") % 40 == 4, " \t ")
        .when(F.col("seq") % 40 == 5, F.concat(tsv, F.lit("\tx |}")))
        .otherwise(tsv)
    )
    path = _new_folder(spark, "reviewed")
    Corpus(spark, sf_dir).targets.orderBy("seq").select(line.alias("value")).write.text(path)
    return staged.scan_staged(spark, path)


@query("reject_staged")
def reject_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a reviewed file that lack the description, or hold no tab at all."""
    line = (
        F.when(F.col("seq") % 40 == 6, F.concat_ws("\t", "seq", "raw_title"))
        .when(F.col("seq") % 40 == 7, F.concat(F.lit("note "), "seq"))
        .when(F.col("seq") % 40 == 8, F.lit("|} note"))
        .otherwise(F.concat_ws("\t", "seq", "raw_title", F.lit("Species of alga")))
    )
    path = _new_folder(spark, "reviewed")
    Corpus(spark, sf_dir).targets.orderBy("seq").select(line.alias("value")).write.text(path)
    rejected = staged.rejected_staged(lines.read_lines(spark, path))
    return rejected.select(F.col("line_no").alias("seq"), "line")


# ------------------------------------------------------------------ facts per target


def _facts(spark: SparkSession, sf_dir: str, cfg: JobConfig = P.DEFAULT) -> DataFrame:
    rows, tables = _targets(spark, sf_dir), Corpus(spark, sf_dir).tables
    return L.by_title(rows, lambda titles: S.with_facts(titles, tables, cfg))


@query("existing_shortdesc")
def existing_shortdesc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    rows = L.with_key(c.targets, "raw_title").select("seq", "title")
    found = L.by_title(rows, lambda titles: L.lookup_existing(titles, c.pages, c.page_props))
    return found.drop("seq")


@query("filter_list_articles")
def filter_list_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _targets(spark, sf_dir)
    return rows.where(~C.is_list_article(F.col("title")))


@query("filter_existing_desc")
def filter_existing_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose existing description forbids a new one, with the reason."""
    rows = existing_shortdesc(spark, sf_dir)
    reason = T.first_reason(*C.existing_checks(F.col("existing_type"), P.DEFAULT))
    return rows.select("title", reason.alias("reason")).where(F.col("reason").isNotNull())


@query("filter_redirects")
def filter_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).where(C.is_redirect(F.col("text"))).select("title")


@query("filter_require_infobox")
def filter_require_infobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = C.has_infobox(F.col("text"), P.STRICT.infobox_strings)
    return _articles(spark, sf_dir).where(wanted).select("title")


@query("filter_sole_infobox")
def filter_sole_infobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with at most one infobox, counted on a text with two more of them in some."""
    more = F.when(F.col("text").contains("Taxobox"), "{{Infobox a}}{{infobox b|c}}").otherwise("")
    text = F.concat("text", more)
    return _articles(spark, sf_dir).where(W.count_infoboxes(text) <= 1).select("title")


@query("check_page")
def check_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_reasons(spark, sf_dir, P.DEFAULT)


@query("check_page_strict")
def check_page_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_reasons(spark, sf_dir, P.STRICT)


def _page_reasons(spark: SparkSession, sf_dir: str, cfg: JobConfig) -> DataFrame:
    facts = _facts(spark, sf_dir, cfg)
    page = {c: F.col(c) for c in ("title", "redirect", "infobox", "infoboxes")}
    page["kind"] = F.col("existing_type")
    return facts.select("title", T.first_reason(*C.page_checks(page, cfg)).alias("reason"))


@query("override_gate")
def override_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = existing_shortdesc(spark, sf_dir)
    manual_only = JobConfig(override_manual=True)
    return rows.select(
        "title",
        C.is_override(F.col("existing_type"), manual_only).alias("manual_only"),
        C.is_override(F.col("existing_type"), P.OVERRIDE).alias("either"),
    )


def _desc_reason(**settings) -> Query:
    cfg = JobConfig(override_manual=True, override_embedded=True, **settings)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checks = C.override_checks(
            F.col("existing_desc"), F.col("existing_type"), cfg, C.FAILED
        )
        rows = existing_shortdesc(spark, sf_dir)
        return rows.select("title", T.first_reason(*checks).alias("reason"))

    return run


QUERIES["desc_regex"] = _desc_reason(existing_desc_regex="old")
QUERIES["desc_required_words"] = _desc_reason(existing_desc_required_words=("desc", "1"))
QUERIES["desc_excluded_words"] = _desc_reason(existing_desc_excluded_words=("2", "Other"))


def _lead_reason(**settings) -> Query:
    cfg = JobConfig(**settings)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checks = C.lead_checks(F.col("lead"), F.col("title"), cfg)
        return _leads(spark, sf_dir).select("title", T.first_reason(*checks).alias("reason"))

    return run


QUERIES["filter_empty_lead"] = _lead_reason()
QUERIES["lead_required_words"] = _lead_reason(required_words=("is", "alga"))
QUERIES["lead_excluded_words"] = _lead_reason(excluded_words=("genus", "rocks"))
QUERIES["lead_some_words"] = _lead_reason(some_words=("alga", "moss"))
QUERIES["lead_regex"] = _lead_reason(text_regex_tf=True, text_regex=r"gen\d+ (is|was) an?")
QUERIES["title_regex"] = _lead_reason(title_regex_tf=True, title_regex=r"gen\d+ MINOR")


@query("check_criteria")
def check_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = JobConfig(
        override_manual=True,
        override_embedded=True,
        existing_desc_regex="old",
        existing_desc_required_words=("desc",),
        existing_desc_excluded_words=("2",),
        required_words=("is",),
        excluded_words=("rocks",),
        title_regex_tf=True,
        title_regex="gen",
    )
    checks = C.criteria_checks(
        F.col("existing_desc"), F.col("existing_type"), F.col("lead"), F.col("title"), cfg
    )
    return _facts(spark, sf_dir, cfg).select("title", T.first_reason(*checks).alias("reason"))


_scalar("allow_bots", _articles, allowed=lambda: C.allow_bots(F.col("text"), "descbot"))


@query("in_category")
def in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return L.titles_in_category(_targets(spark, sf_dir), c.page_categories, "Genera").select("title")


@query("is_monotypic_genus")
def is_monotypic_genus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = W.with_lead(_articles(spark, sf_dir))
    category = R.monotypic_category(W.compress_text(F.col("text")))
    return pages.select("title", R.is_monotypic_genus(category, F.col("lead")).alias("monotypic"))


# ------------------------------------------------------------------ ranks


@query("rank_from_category")
def rank_from_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    signals = L.category_signals(c.page_categories)
    return _targets(spark, sf_dir).select("title").join(signals, "title", "left").fillna(
        {"category_extinct": False}
    )


def _sentence() -> Column:
    return W.first_sentence(F.col("lead"))


_scalar("rank_lead_tight", _leads, rank=lambda: R.rank_lead_tight(_sentence()))
_scalar("rank_lead_noun", _leads, rank=lambda: R.rank_lead_noun(_sentence(), "alga"))
_scalar("rank_lead_loose", _leads, rank=lambda: R.rank_lead_loose(_sentence()))
_scalar("rank_from_lead", _leads, rank=lambda: R.rank_from_lead(F.col("lead"), "alga"))


def _compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("title", W.compress_text(F.col("text")).alias("tc"))


_scalar("rank_from_speciesbox", _compressed, rank=lambda: R.rank_from_speciesbox(F.col("tc")))


@query("rank_from_taxobox")
def rank_from_taxobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _compressed(spark, sf_dir).withColumn("bold", R.bold_keys(F.col("tc")))
    nobra = W.title_nobra(F.col("title"))
    rank = R.rank_from_taxobox(nobra, F.col("tc"), F.col("bold"))
    return pages.select("title", rank.alias("rank"))


@query("info_from_autobox")
def info_from_autobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_taxonomy(spark, sf_dir).select("title", "rank_autobox", "autobox_extinct")


@query("rank_trace")
def rank_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five ranks of each target, the most common ones and the winner."""
    judged = S.with_verdict(_facts(spark, sf_dir), P.DEFAULT)
    return judged.select(
        "title", *D.RANK_COLUMNS, F.array_join("modes", ",").alias("modes"), "best_rank"
    )


@query("rank_vote")
def rank_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = F.array_compact(F.array(*D.RANK_COLUMNS))
    rows = _facts(spark, sf_dir).select("title", R.modes(votes).alias("modes"))
    return rows.select(
        "title", F.array_join("modes", ",").alias("modes"), R.best_rank(F.col("modes")).alias("best_rank")
    )


@query("rank_vote_relational")
def rank_vote_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.modes_by_rows(_facts(spark, sf_dir), D.RANK_COLUMNS)


_scalar("title_marker_rank", _targets, rank=lambda: R.title_marker_rank(F.col("title")))


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = F.array_compact(F.array(*D.RANK_COLUMNS))
    rows = _facts(spark, sf_dir).withColumn("votes", votes)
    return rows.withColumn("modes", R.modes(F.col("votes"))).withColumn(
        "words", W.title_word_count(F.col("title"))
    )


@query("best_rank_rules")
def best_rank_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the winner of each vote; null where there is none."""
    rows = _voted(spark, sf_dir).withColumn("best", R.best_rank(F.col("modes")))
    monotypic = R.is_monotypic_genus(F.col("monotypic_category"), F.col("lead"))
    ok, rank = R.settled_rank(F.col("best"), F.col("words") == 1, monotypic)
    settled = F.when(F.col("best").isNotNull(), ok)
    return rows.select("title", settled.alias("ok"), rank.alias("rank"))


@query("conflict_rules")
def conflict_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each vote without a winner; null where there is one."""
    rows = _voted(spark, sf_dir)
    autobox, open_vote = F.col("rank_autobox"), F.size("modes") != 1
    rank = R.conflict_rank(F.col("votes"), F.col("modes"), autobox, F.col("words"))
    error = R.conflict_error(F.col("votes"), autobox)
    rows = rows.select(
        "title", F.when(open_vote, rank).alias("rank"), F.when(open_vote, error).alias("error")
    )
    return rows.withColumn("error", F.when(F.col("rank").isNull(), F.col("error")))


_scalar(
    "shortdesc_end",
    _leads,
    noun=lambda: R.rank_noun(R.rank_from_lead(F.col("lead"), "alga"), "alga", "algae"),
)
_scalar(
    "draft_description",
    _leads,
    draft=lambda: R.draft(R.rank_from_lead(F.col("lead"), "alga"), "alga", "algae"),
)


def _adjusted(cfg: JobConfig) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = _facts(spark, sf_dir).withColumn(
            "draft", R.draft(F.col("rank_category"), cfg.name_singular, cfg.name_plural)
        )
        adjusted = D.adjust_desc(
            F.col("draft"), F.col("lead"), F.col("autobox_extinct"), F.col("category_extinct")
        )
        return facts.select("title", adjusted.alias("description"))

    return run


QUERIES["adjust_desc"] = _adjusted(P.DEFAULT)
QUERIES["adjust_desc_long"] = _adjusted(P.LONG_NOUN)


@query("generate_shortdesc")
def generate_shortdesc(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = S.with_verdict(_facts(spark, sf_dir), P.DEFAULT)
    return judged.select("title", F.col("gen_ok").alias("ok"), F.col("gen_msg").alias("message"))


# ------------------------------------------------------------------ stage


def _stage(spark: SparkSession, sf_dir: str, cfg: JobConfig) -> S.Staging:
    c = Corpus(spark, sf_dir)
    return S.stage(c.targets, c.tables, cfg)


def _staged(cfg: JobConfig) -> Query:
    return lambda spark, sf_dir: _stage(spark, sf_dir, cfg).staged()


QUERIES["stage_pipeline"] = _staged(P.DEFAULT)
QUERIES["stage_pipeline_override"] = _staged(P.OVERRIDE)
QUERIES["stage_pipeline_strict"] = _staged(P.STRICT)
QUERIES["stage_pipeline_words"] = _staged(P.WORDS)
QUERIES["stage_pipeline_limits"] = _staged(P.LIMITS)
QUERIES["limit_articles"] = _staged(P.MAX_ARTS)
QUERIES["limit_successes"] = _staged(P.MAX_STAGE)
QUERIES["range_endpoint"] = _staged(P.RANGE)


@query("stage_pipeline_distinct")
def stage_pipeline_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run the way a very long target list takes: every page's facts first,
    each title judged once, titles with several targets spread over salts."""
    c = Corpus(spark, sf_dir)
    twice = c.targets.selectExpr("2 * seq AS seq", "raw_title").unionByName(
        c.targets.selectExpr("2 * seq + 1 AS seq", "raw_title")
    )
    run = S.stage(twice, c.tables, P.DEFAULT, hot_rows=1, prune_titles=0)
    return run.staged()


@query("stage_rows")
def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging file, written and read back as plain text."""
    run = _stage(spark, sf_dir, P.DEFAULT)
    path = K.write_staging(run.staged(), _new_folder(spark, "staging"), P.DEFAULT, RUN_TIME)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("stage_summary")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _stage(spark, sf_dir, P.DEFAULT)
    return K.stage_summary(run.verdicts)


@query("example_report")
def example_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.example_report(_stage(spark, sf_dir, P.LIMITS).successes, P.LIMITS)


@query("running_article_no")
def running_article_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, P.DEFAULT).articles.select("seq", "n")


@query("running_success_no")
def running_success_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, P.DEFAULT).successes.select("seq", "success_no")


@query("range_startpoint")
def range_startpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _targets(spark, sf_dir)
    return O.from_startpoint(rows, W.clean_title(F.col("title")), "Gen100")


# ------------------------------------------------------------------ edit


def _reviewed(spark: SparkSession, sf_dir: str, cfg: JobConfig) -> DataFrame:
    """The staged drafts as the edit phase reads them back from the reviewed file."""
    run = _stage(spark, sf_dir, cfg)
    path = K.write_staging(run.staged(), _new_folder(spark, "staging"), cfg, RUN_TIME)
    return staged.scan_staged(spark, path)


def _plan(spark: SparkSession, sf_dir: str, cfg: JobConfig = P.REPLACE) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return E.plan_edits(_reviewed(spark, sf_dir, cfg), c.pages, c.page_props, cfg)


@query("edit_revalidate")
def edit_revalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts made under one policy, checked under a stricter one."""
    c = Corpus(spark, sf_dir)
    rows = _reviewed(spark, sf_dir, P.REPLACE)
    decided = E.decide(rows, c.pages, c.page_props, P.OVERRIDE)
    return decided.drop("page_desc", "page_type")


@query("ok_to_edit")
def ok_to_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target as if staged, with the default policy; some titles not canonical."""
    c = Corpus(spark, sf_dir)
    title = F.when(F.col("seq") % 9 == 2, F.lower("raw_title")).otherwise(F.col("raw_title"))
    draft = F.when(F.col("seq") % 23 == 7, "*** : Genus of algae").otherwise("Genus of algae")
    rows = c.targets.select("seq", title.alias("title"), draft.alias("description"))
    decided = E.decide(rows, c.pages, c.page_props, P.DEFAULT)
    return decided.select("seq", "title", "reason")


@query("edit_pipeline")
def edit_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select(
        "seq", "title", "description", "action", "status", "reason", "edit_summary"
    )


@query("edit_pipeline_repeats")
def edit_pipeline_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rows of each page, the third with another description, under two policies."""
    c = Corpus(spark, sf_dir)
    draft = F.col("description")
    four = F.array(draft, draft, F.concat(draft, F.lit(" again")), draft)
    rows = _reviewed(spark, sf_dir, P.REPLACE).select(
        "seq", "title", F.posexplode(four).alias("i", "description")
    )
    rows = rows.select((F.col("seq") * 4 + F.col("i")).alias("seq"), "title", "description")
    plans = [
        E.plan_edits(rows, c.pages, c.page_props, cfg).select(
            F.lit(policy).alias("policy"),
            *("seq", "title", "description", "action", "status", "reason", "edit_summary", "new_text"),
        )
        for policy, cfg in {"default": P.DEFAULT, "replace": P.REPLACE}.items()
    ]
    return plans[0].unionByName(plans[1])


@query("edit_plan")
def edit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir).where(F.col("status") == "success")
    return plan.select("title", "new_text", "edit_summary")


@query("edit_plan_long")
def edit_plan_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan the way a very long list of edits takes."""
    c = Corpus(spark, sf_dir)
    rows = _reviewed(spark, sf_dir, P.REPLACE)
    plan = E.plan_edits(rows, c.pages, c.page_props, P.REPLACE, broadcast_bytes=0, prune_titles=0)
    return plan.where(F.col("status") == "success").select("title", "new_text", "edit_summary")


@query("edit_log")
def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.edit_log(_plan(spark, sf_dir))


@query("edit_summary")
def edit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.edit_summary(_plan(spark, sf_dir))


_scalar("rewrite_add", _articles, new_text=lambda: W.rewrite_add(F.col("text"), F.lit("Genus of algae")))


@query("rewrite_replace")
def rewrite_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    pages = c.pages.join(c.page_props, "title")
    text = W.rewrite_replace(F.col("text"), F.lit("Genus of algae"), F.col("shortdesc"))
    return pages.select("title", text.alias("new_text"))


@query("edit_summary_text")
def edit_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of each kind of edit, by the bot and by another account."""
    rows = existing_shortdesc(spark, sf_dir)
    kind, draft = F.col("existing_type"), F.lit("Genus of algae")
    action = F.when(kind.isNull(), "add").when(kind == "embedded", "override").otherwise("replace")
    person = JobConfig(username="someone")
    texts = {"by_bot": P.DEFAULT, "by_person": person}
    return rows.select(
        "title",
        *(
            E.edit_summary_text(action, draft, F.col("existing_desc"), cfg).alias(alias)
            for alias, cfg in texts.items()
        ),
    )
