"""What a staging run leaves behind."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankdraft.config import JobConfig
from rankdraft.functions.pytext import percent

# Fixed value: top of the example page.
EXAMPLE_HEADER = """The bot does not use Wikidata's short description in any way. \
It is listed here for reference only
{{| class="wikitable"
|+
{bot} proposed short descriptions
!Article
!Proposed SD
!(Wikidata SD)
!Opening words of the lead
"""
STAGED_COLUMNS = ["n", "title", "description", "wikidata_sd", "lead"]


def tsv_line(*columns: str) -> Column:
    """Tab-separated line; missing values are empty fields."""
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def write_lines(rows: DataFrame, path: str, *columns: str) -> None:
    """Write columns as a folder of tab-separated text parts."""
    rows.select(tsv_line(*columns).alias("value")).write.text(path)


def staging_lines(staged: DataFrame) -> DataFrame:
    return staged.select(tsv_line(*STAGED_COLUMNS).alias("value"))


def run_stamp(now: datetime.datetime) -> str:
    return f"{now:%Y-%m-%d (%H %M)}"


def staging_name(cfg: JobConfig, successes: int, articles: int, now: datetime.datetime) -> str:
    stem = cfg.staging_path.split(".")[0]
    return f"{stem} ({successes} of {articles}) {run_stamp(now)}.tsv"


def write_staging(staged: DataFrame, folder: str, cfg: JobConfig, now: datetime.datetime) -> str | None:
    """Write the reviewable TSV as a folder of text parts; None if there are no rows.

    The parts are in input order, because the staged rows are.
    """
    counts = staged.agg(F.count("*").alias("articles"), F.count_if("ok").alias("successes")).first()
    if counts["articles"] == 0:
        return None
    path = f"{folder}/{staging_name(cfg, counts['successes'], counts['articles'], now)}"
    staging_lines(staged).write.text(path)
    return path


def example_rows(successes: DataFrame, cfg: JobConfig) -> DataFrame:
    """Wiki table rows of the first drafts; one more than the stated maximum."""
    row = F.concat(
        F.lit("|-\n| [["),
        F.col("title"),
        F.lit("]] || "),
        F.col("description"),
        F.lit(" || "),
        F.col("wikidata_sd"),
        F.lit(" || "),
        F.col("lead"),
        F.lit("\n"),
    )
    first = successes.where(F.col("success_no") <= cfg.max_examples + 1)
    return first.select("success_no", row.alias("row"))


def example_report(successes: DataFrame, cfg: JobConfig) -> DataFrame:
    """The example page as one text; no row when there is no draft."""
    rows = F.expr("listagg(row, '') WITHIN GROUP (ORDER BY success_no)")
    report = example_rows(successes, cfg).agg(rows.alias("rows"))
    text = F.concat(F.lit(EXAMPLE_HEADER.format(bot=cfg.bot_user)), F.col("rows"), F.lit("|}"))
    return report.where(F.col("rows").isNotNull()).select(text.alias("report"))


def summary(phase: str, success: Column, failure: Column, skipped: Column) -> list[Column]:
    """Columns of a run summary from three counts; percentages are null without targets."""
    targets = success + failure
    return [
        F.lit(phase).alias("phase"),
        targets.alias("targets"),
        success.alias("success"),
        failure.alias("failure"),
        skipped.alias("skipped"),
        percent(success, targets).alias("success_pct"),
        percent(failure, targets).alias("failure_pct"),
        F.when(targets == 0, "No target articles found").alias("message"),
    ]


def stage_summary(verdicts: DataFrame) -> DataFrame:
    """Run summary of the verdicts up to the stop row."""
    recorded = F.col("skip_reason").isNull()
    counts = verdicts.agg(
        F.count_if(recorded & F.col("ok")).alias("s"),
        F.count_if(recorded & ~F.col("ok")).alias("f"),
        F.count_if(~recorded).alias("k"),
    )
    return counts.select(*summary("stage", F.col("s"), F.col("f"), F.col("k")))
