"""Edit: from the reviewed staging table to page rewrites and logs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankdraft.config import JobConfig
from rankdraft.functions import checks as C
from rankdraft.functions import wikitext as W
from rankdraft.functions.pytext import first_reason
from rankdraft.operators import lookups as L
from rankdraft.session import BROADCAST_BYTES, durable, fits_broadcast
from rankdraft.sinks.staging import summary

# Link text of edit summaries.
POLICY_LINK = "[[Wikipedia:Short description|short description]]"
BAD_LINE = "ERROR: line without a title and a description"
NO_TEMPLATE = "ERROR: Cannot locate SD template, though it should exist"
# The rows of a page that has more than this are spread over tasks.
HOT_ROWS = 10_000


def edit_summary_text(action: Column, description: Column, existing: Column, cfg: JobConfig) -> Column:
    """Summary of an edit; the bot account is named in front."""
    by_bot = cfg.username == cfg.bot_user
    bot = f"[[User:{cfg.bot_user}|{cfg.bot_user}]] "

    def opening(verb: str, rest: str = "") -> Column:
        lead_in = bot + verb.lower() if by_bot else verb
        return F.lit(f"{lead_in} {POLICY_LINK}{rest} \"")

    new = F.concat(description, F.lit('"'))
    return (
        F.when(action == "add", F.concat(opening("Adding"), new))
        .when(action == "override", F.concat(opening("Overriding", " from infobox with"), new))
        .when(
            action == "replace",
            F.concat(opening("Changing", " from"), existing, F.lit('" to "'), new),
        )
    )


def edit_features(pages: DataFrame, cfg: JobConfig) -> DataFrame:
    """One narrow row per page: what decides on an edit, without the text."""
    text = F.col("text")
    return pages.select(
        "title",
        F.lit(True).alias("page_exists"),
        C.is_redirect(text).alias("redirect"),
        (text == "").alias("blank"),
        W.has_shortdesc_template(text).alias("has_template"),
        C.allow_bots(text, cfg.username).alias("bots_ok"),
    )


def decide(
    staged: DataFrame,
    pages: DataFrame,
    page_props: DataFrame,
    cfg: JobConfig,
    prune_titles: int = L.PRUNE_TITLES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Staged rows (seq, title, description) with ``reason``, null where an edit may go on.

    Rows of one page are checked in the order of the file, each against what those
    before it leave there. ``page_desc`` and ``page_type`` are the given state.
    """
    keyed = staged.select(
        "seq",
        W.normalize_title(F.col("title")).alias("title"),
        F.col("title").alias("staged_title"),
        "description",
    )
    if staged.count() <= prune_titles:
        pages = L.only_titles(pages, keyed)
        page_props = L.only_titles(page_props, keyed)
    titles, features = L.distinct_titles(keyed), edit_features(pages, cfg)
    facts = (
        titles.join(features, "title", "left")
        .join(page_props.select("title", "shortdesc"), "title", "left")
        .fillna({"page_exists": False, "redirect": False, "has_template": False, "bots_ok": True})
        .fillna({"blank": True})
        .withColumn("n_rows", F.col("n_targets"))
    )
    repeated = keyed.groupBy("title").count().where("count > 1")
    n_repeated, most = repeated.agg(F.count("*"), F.max("count")).first()
    stuck = None
    if n_repeated:
        several = repeated.select("title")
        stuck = _without_template(several, pages, page_props, n_repeated <= prune_titles)
    if stuck is None:
        facts = facts.withColumn("stuck", F.lit(False))
    else:
        facts = facts.join(stuck.withColumn("stuck", F.lit(True)), "title", "left").fillna({"stuck": False})
    known = L.join_back(keyed, facts)
    desc, kind = W.existing_shortdesc(F.col("shortdesc"), F.col("has_template"))
    known = known.withColumn("page_desc", desc).withColumn("page_type", kind)
    state = _in_file_order(known, cfg, split=(most or 0) > hot_rows)
    return state.select(
        "seq",
        F.col("staged_title").alias("title"),
        "description",
        "existing_desc",
        "existing_type",
        first_reason(*C.edit_checks(_page(), cfg)).alias("reason"),
        "page_desc",
        "page_type",
    )


def _without_template(
    titles: DataFrame, pages: DataFrame, page_props: DataFrame, few: bool
) -> DataFrame:
    """Those titles whose text does not hold the template of their description.

    A manual description there cannot be replaced. Of a text only what follows the
    openings of the template moves, as long as the longest description.
    """
    desc = W.existing_shortdesc(F.col("shortdesc"), F.lit(True))[0]
    given = titles.join(page_props.select("title", "shortdesc"), "title")
    given = durable(given.select("title", F.concat(desc, F.lit("}}")).alias("_desc")))
    longest = given.agg(F.max(F.length("_desc"))).first()[0] or 0
    texts = pages.select("title", "text")
    texts = (L.only_titles if few else L.maybe_titles)(texts, titles)
    texts = texts.select("title", W.after_openings(F.col("text"), longest).alias("_after"))
    held = F.exists("_after", lambda after: after.startswith(F.col("_desc")))
    missing = ~F.coalesce(held, F.lit(False))
    return texts.join(given, "title").where(missing).select("title").distinct()


def _page() -> dict[str, Column]:
    return {
        "kind": F.col("existing_type"),
        "existing": F.col("existing_desc"),
        "redirect": F.col("redirect"),
        "exists": F.col("page_exists"),
        "blank": F.col("blank"),
        "description": F.col("description"),
        "bots_ok": F.col("bots_ok"),
        "title": F.col("staged_title"),
        "page_title": F.col("title"),
    }


def _in_file_order(rows: DataFrame, cfg: JobConfig, split: bool = False) -> DataFrame:
    """Add ``existing_desc`` and ``existing_type`` as each row finds them.

    A row that may edit its page leaves its own description there, as a manual one, for
    the rows of that page behind it; one that repeats the description in place leaves it
    as it is. So a row finds the description of the last row before it that may edit,
    up to the first description that the policy does not let anyone change. Only titles
    of several rows need an order, and only narrow rows are sorted for it.

    That is a scan whose state has three parts: the first row that changes the given
    description, the last description left, and the first one left that stays. Each
    combines by a minimum or maximum over rows. With ``split``, the rows are sorted by
    title and seq into ranges, which cut long runs of one title; the parts are found for
    each title and range first, then carried from range to range, then put beside the rows.
    """
    single = rows.where("n_rows = 1").select(
        "*", F.col("page_desc").alias("existing_desc"), F.col("page_type").alias("existing_type")
    )
    # Where the template to replace is not found, every edit fails and leaves nothing.
    fails = F.col("stuck") & F.coalesce(F.col("page_type") == "manual", F.lit(False))
    may_edit = first_reason(*C.page_state_checks(_page())).isNull() & ~fails
    fixed = lambda desc, kind: first_reason(*C.replacing_checks(desc, kind, cfg)).isNotNull()
    several = (
        rows.where("n_rows > 1")
        .withColumn("_edits", may_edit)
        # From the first row on that changes the given description, there is another.
        .withColumn("_changes", may_edit & (F.col("description") != F.col("page_desc")))
        .withColumn("_fixed", fixed(F.col("page_desc"), F.col("page_type")))
    )
    run = ["title"]
    if split:
        several = durable(several.orderBy("title", "seq"))
        several = several.withColumn("_range", F.spark_partition_id())
        run = ["title", "_range"]
    order = Window.partitionBy(*run).orderBy("seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    first_change = F.min(F.when(F.col("_changes"), F.col("seq")))

    if split:
        of_range = several.groupBy(*run).agg(first_change.alias("_first"))
        of_title = Window.partitionBy("title")
        of_range = of_range.withColumn("_first", F.min("_first").over(of_title))
        several = several.join(of_range, run)
    else:
        several = several.withColumn("_first", first_change.over(Window.partitionBy("title")))
    left = F.when(F.col("_edits") & (F.col("seq") >= F.col("_first")), F.col("description"))
    several = several.withColumn("_left", left).withColumn(
        "_stays", F.when(fixed(left, F.lit("manual")), F.struct("seq", left.alias("left")))
    )
    several = several.withColumn("_last", F.last("_left", ignorenulls=True).over(earlier))
    if split:
        before = Window.partitionBy("title").orderBy("_range")
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        left_at = F.when(F.col("_left").isNotNull(), F.struct("seq", F.col("_left").alias("left")))
        of_range = (
            several.groupBy(*run)
            .agg(F.max(left_at).alias("_before"), F.min("_stays").alias("_end"))
            .withColumn("_before", F.max("_before").over(before)["left"])
            .withColumn("_end", F.min("_end").over(Window.partitionBy("title")))
        )
        several = several.join(of_range, run).withColumn("_last", F.coalesce("_last", "_before"))
    else:
        several = several.withColumn("_end", F.min("_stays").over(Window.partitionBy("title")))
    end = F.when(F.col("_end.seq") < F.col("seq"), F.col("_end.left"))
    found = F.when(~F.col("_fixed"), F.coalesce(end, "_last"))
    several = several.withColumn("existing_desc", F.coalesce(found, "page_desc")).withColumn(
        "existing_type", F.when(found.isNotNull(), "manual").otherwise(F.col("page_type"))
    )
    several = several.drop(*(c for c in several.columns if c.startswith("_")))
    return single.unionByName(several)


def _given() -> Column:
    """The text as the first edit leaves it, but for the template in front."""
    return F.when(
        F.col("page_type") == "manual", W.without_shortdesc(F.col("text"), F.col("page_desc"))
    ).otherwise(F.col("text"))


def _without(text: Column, cuts: Column) -> Column:
    return F.aggregate(cuts, text, lambda t, c: W.cut_shortdesc(t, c["description"]))


def _in_order(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns)))


def earlier_cuts(
    open_rows: DataFrame, pruned: Callable[[DataFrame], DataFrame]
) -> DataFrame | None:
    """(title, seq, description): the cuts that change a text which several rows edit.

    An edit takes the template of the edit before it out of the whole text, so it can
    meet templates that the page had all along. Those are few, whatever the number of
    rows: they are read from the text and joined with the first row that wrote the same.
    A cut can bring about a template out of what stood around it. The replay of a text
    stops there, and a further round goes on behind that row. None if no page has two rows.
    """
    several = durable(
        open_rows.groupBy("title")
        .agg(
            F.count("*").alias("n"),
            F.max(F.length("description")).alias("longest"),
            F.first("page_desc").alias("page_desc"),
            F.first("page_type").alias("page_type"),
        )
        .where("n > 1")
    )
    longest = several.agg(F.max("longest")).first()[0]
    if longest is None:
        return None
    lines = lambda text: W.shortdesc_lines(text, longest)
    written = open_rows.groupBy("title", "description").agg(F.min("seq").alias("seq"))
    none = F.array().cast("array<struct<seq:bigint,description:string>>")
    state = several.select("title", "page_desc", "page_type", none.alias("cuts"))
    rounds = []
    while True:
        body = _without(_given(), F.col("cuts"))
        # A text without the name of the template has none, whatever is cut; it does not move.
        texts = pruned(state).where(W.names_shortdesc(F.col("text")))
        bodies = texts.join(state, "title").withColumn("body", body)
        held = bodies.select("title", F.explode(lines(F.col("body"))).alias("description"))
        first = durable(
            written.join(held, ["title", "description"])
            .groupBy("title")
            .agg(_in_order("seq", "description").alias("next"))
        )
        replay = _replay(F.col("body"), F.col("next"), lines)
        done = durable(
            bodies.join(first, "title")
            .withColumn("end", replay)
            .select(
                "title",
                "page_desc",
                "page_type",
                F.slice("next", F.lit(1), F.col("end.n")).alias("next"),
                "cuts",
                F.col("end.stopped").alias("stopped"),
            )
        )
        rounds.append(done.select("title", F.explode("next").alias("c")).select("title", "c.*"))
        state = done.where("stopped").select(
            "title", "page_desc", "page_type", F.concat("cuts", "next").alias("cuts")
        )
        if state.isEmpty():
            return durable(reduce(DataFrame.unionByName, rounds))
        # Behind the first round a row may repeat what an earlier one wrote.
        last = state.select("title", F.array_max("cuts.seq").alias("_last"))
        written = (
            open_rows.join(last, "title")
            .where("seq > _last")
            .groupBy("title", "description")
            .agg(F.min("seq").alias("seq"))
        )


def _replay(body: Column, cuts: Column, lines: Callable[[Column], Column]) -> Column:
    """(n, stopped): how many cuts to make until one brings about a new template."""

    def step(state: Column, cut: Column) -> Column:
        text = W.cut_shortdesc(state["text"], cut["description"])
        known = F.array_remove(state["known"], cut["description"])
        return F.when(state["stopped"], state).otherwise(
            F.struct(
                text.alias("text"),
                known.alias("known"),
                (state["n"] + 1).alias("n"),
                (F.size(F.array_except(lines(text), known)) > 0).alias("stopped"),
            )
        )

    start = F.struct(
        body.alias("text"),
        lines(body).alias("known"),
        F.lit(0).alias("n"),
        F.lit(False).alias("stopped"),
    )
    end = lambda s: F.struct(s["n"].alias("n"), s["stopped"].alias("stopped"))
    return F.aggregate(cuts, start, step, end)


def _with_texts(edits: DataFrame, texts: DataFrame, small: bool, hot_rows: int) -> DataFrame:
    """Edits joined with the texts of their pages, those of hot pages spread over tasks.

    Fewer than ``rows / hot_rows`` titles are hot, so that their list is short.
    """
    sent = F.broadcast if small else lambda df: df
    counts = edits.groupBy("title").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    salts = F.ceil(F.col("n") / hot_rows).cast("int")
    hot = durable(counts.select("title", salts.alias("_salts")))
    if hot.isEmpty():
        return texts.join(sent(edits), "title")
    names = F.broadcast(hot.select("title"))
    rest = texts.join(names, "title", "left_anti").join(
        sent(edits.join(names, "title", "left_anti")), "title"
    )
    salt = F.pmod(F.xxhash64("seq"), F.col("_salts")).cast("int")
    spread = edits.join(F.broadcast(hot), "title").withColumn("_salt", salt)
    copies = texts.join(F.broadcast(hot), "title").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    )
    many = copies.hint("shuffle_hash").join(spread.drop("_salts"), ["title", "_salt"])
    return rest.unionByName(many.drop("_salt", "_salts"))


def plan_edits(
    staged: DataFrame,
    pages: DataFrame,
    page_props: DataFrame,
    cfg: JobConfig,
    broadcast_bytes: int = BROADCAST_BYTES,
    prune_titles: int = L.PRUNE_TITLES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The edit plan: every staged row with its status and, for edits, the new text.

    Rows of one page edit it one after the other, in the order of the file. Decisions
    are taken on narrow rows first. Only pages that will be edited are read in full, and
    only their text, or none, is shuffled. The rewrites of a page with more than
    ``hot_rows`` of them are made in many tasks, with a copy of the page for that many rows.
    """
    decisions = durable(decide(staged, pages, page_props, cfg, prune_titles, hot_rows))
    if cfg.on_mismatch == "fail" and not decisions.where(F.col("reason") == C.MISMATCH).isEmpty():
        raise ValueError("a staged title is not the title of its page")
    skipped = decisions.where(F.col("reason").isNotNull()).drop("page_desc", "page_type")
    open_rows = decisions.where(F.col("reason").isNull())
    kind = F.col("existing_type")
    action = (
        F.when(kind.isNull(), "add").when(kind == "embedded", "override").otherwise("replace")
    )
    edits = open_rows.withColumn("action", action)
    texts = pages.select("title", "text")
    pruned = lambda titles: (
        L.only_titles if titles.count() <= prune_titles else L.maybe_titles
    )(texts, titles)
    cuts = earlier_cuts(open_rows, pruned)
    small = fits_broadcast(open_rows, broadcast_bytes)
    if not small:
        texts = pruned(open_rows)
    if cuts is None:
        body = _given()
    else:
        of_title = cuts.groupBy("title").agg(_in_order("seq", "description").alias("_cuts"))
        if fits_broadcast(cuts, broadcast_bytes):
            of_title = F.broadcast(of_title)
        texts = texts.join(of_title, "title", "left")
        before = F.filter("_cuts", lambda c: c["seq"] < F.col("seq"))
        body = F.when(F.col("_cuts").isNull(), _given()).otherwise(_without(_given(), before))
    rewritten = (
        _with_texts(edits, texts, small, hot_rows)
        .withColumn("new_text", W.rewrite_add(body, F.col("description")))
        .drop("text", "_cuts", "page_desc", "page_type")
    )
    found = F.col("new_text").isNotNull()
    summary_text = edit_summary_text(
        F.col("action"), F.col("description"), F.col("existing_desc"), cfg
    )
    rewritten = (
        rewritten.withColumn("status", F.when(found, "success").otherwise("error"))
        .withColumn("reason", F.when(~found, NO_TEMPLATE))
        .withColumn("edit_summary", F.when(found, summary_text))
    )
    failed = F.when(F.col("reason") == C.MISMATCH, "error").otherwise("skipped")
    return rewritten.unionByName(skipped.withColumn("status", failed), allowMissingColumns=True)


def rejected_rows(lines: DataFrame) -> DataFrame:
    """Plan rows for lines (line_no, line) that hold no title and description."""
    return lines.select(
        F.col("line_no").alias("seq"),
        F.col("line").alias("title"),
        F.lit("").alias("description"),
        F.lit("error").alias("status"),
        F.lit(BAD_LINE).alias("reason"),
    )


def edit_log(plan: DataFrame) -> DataFrame:
    """Log lines of finished and failed edits; skipped rows are not logged."""
    line = F.when(
        F.col("status") == "success", F.concat("title", F.lit("\t"), "description")
    ).otherwise(F.concat("title", F.lit("\t FAILED: "), "description"))
    logged = plan.where(F.col("status") != "skipped")
    return logged.select("seq", "title", "status", line.alias("line"))


def log_name(cfg: JobConfig, status: str, rows: int, stamp: str) -> str:
    """Name of a log; edits by another account than the bot say so."""
    if status != "success":
        return f"log_fail ({rows}) {stamp}.tsv"
    prefix = "" if cfg.username == cfg.bot_user else f"{cfg.username} non-bot "
    return f"{prefix}log_success ({rows}) {stamp}.tsv"


def write_logs(plan: DataFrame, folder: str, cfg: JobConfig, stamp: str) -> list[str]:
    """Write one folder of text parts per outcome that occurs, in row order."""
    log = durable(edit_log(plan).orderBy("seq"))
    paths = []
    for row in log.groupBy("status").count().orderBy(F.desc("status")).collect():
        path = f"{folder}/{log_name(cfg, row['status'], row['count'], stamp)}"
        log.where(F.col("status") == row["status"]).select("line").write.text(path)
        paths.append(path)
    return paths


def write_plan(plan: DataFrame, path: str) -> None:
    """The rewritten pages, one folder per status."""
    plan.write.partitionBy("status").parquet(path)


def edit_summary(plan: DataFrame) -> DataFrame:
    counts = plan.agg(
        F.count_if(F.col("status") == "success").alias("s"),
        F.count_if(F.col("status") == "error").alias("f"),
        F.count_if(F.col("status") == "skipped").alias("k"),
    )
    return counts.select(*summary("edit", F.col("s"), F.col("f"), F.col("k")))
