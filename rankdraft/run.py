"""The two runs, from input files to output files."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankdraft.config import JobConfig
from rankdraft.operators.category_tree import targets_from_category
from rankdraft.plans import edit, stage
from rankdraft.sinks import staging
from rankdraft.sources.lines import read_lines
from rankdraft.sources.staged import parse_staged, rejected_staged
from rankdraft.sources.targets import parse_targets, rejected_targets


@dataclass(frozen=True)
class Outcome:
    """Files a run wrote, its summary, and how many lines it could not use."""

    files: list[str]
    summary: DataFrame
    examples: DataFrame | None = None
    rejected: int = 0


def run_stage(
    spark: SparkSession,
    cfg: JobConfig,
    tables: stage.WikiTables,
    folder: str,
    now: datetime.datetime,
    category_links: DataFrame | None = None,
) -> Outcome:
    """Stage drafts for the target file, or for the target category of ``category_links``.

    Beside the staging file there are, where there is anything to write, the skipped
    titles with their reasons, the target lines without a title, and the example page.
    """
    stamp, rejects = staging.run_stamp(now), None
    if cfg.use_basefile:
        lines = read_lines(spark, cfg.base_path)
        targets, rejects = parse_targets(lines), rejected_targets(lines)
    else:
        targets = targets_from_category(category_links, cfg.targetcat, cfg.recurse_cats)
    run = stage.stage(targets, tables, cfg)
    path = staging.write_staging(run.staged(), folder, cfg, now)
    examples = staging.example_report(run.successes, cfg) if cfg.write_examples else None
    files, rejected = [path] if path else [], 0
    skipped = run.skipped()
    if not skipped.isEmpty():
        files.append(f"{folder}/skipped {stamp}.tsv")
        staging.write_lines(skipped, files[-1], "title", "skip_reason")
    if rejects is not None and (rejected := rejects.count()):
        files.append(f"{folder}/rejected {stamp}.tsv")
        staging.write_lines(rejects, files[-1], "line_no", "line")
    if examples is not None and not examples.isEmpty():
        files.append(f"{folder}/examples {stamp}.txt")
        examples.write.text(files[-1])
    return Outcome(files, staging.stage_summary(run.verdicts), examples, rejected)


def run_edit(
    spark: SparkSession,
    cfg: JobConfig,
    pages: DataFrame,
    page_props: DataFrame,
    folder: str,
    now: datetime.datetime,
    staged_path: str = "staged.tsv",
) -> Outcome:
    """Plan the edits of a reviewed staging file, and write them and their logs.

    A line that cannot be used is a failed row of the plan.
    """
    lines = read_lines(spark, staged_path)
    plan = edit.plan_edits(parse_staged(lines), pages, page_props, cfg)
    rejects = edit.rejected_rows(rejected_staged(lines))
    plan = plan.unionByName(rejects, allowMissingColumns=True)
    stamp = staging.run_stamp(now)
    path = f"{folder}/edit_plan {stamp}"
    edit.write_plan(plan, path)
    written = spark.read.parquet(path)
    logs = edit.write_logs(written, folder, cfg, stamp)
    rejected = written.where(F.col("reason") == edit.BAD_LINE).count()
    return Outcome([path, *logs], edit.edit_summary(written), rejected=rejected)


def runner(cfg: JobConfig):
    """The run that ``mode_flag`` asks for."""
    return {"stage": run_stage, "edit": run_edit}[cfg.mode_flag]
