import datetime
import glob

import pytest
from pyspark.sql import functions as F

from rankdraft import profiles as P
from rankdraft.config import JobConfig
from rankdraft.corpus import Corpus
from rankdraft.plans import stage as S
from rankdraft.sinks import staging as K

SF = "/root/testdata/sf0.001"
NOW = datetime.datetime(2026, 1, 2, 3, 4)


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, SF)


@pytest.fixture(scope="module")
def default_run(corpus):
    return S.stage(corpus.targets, corpus.tables, P.DEFAULT)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_every_target_is_skipped_failed_or_staged(corpus, default_run):
    staged, skipped = default_run.staged(), default_run.skipped()
    assert staged.count() + skipped.count() == corpus.targets.count()
    assert default_run.verdicts.where("ok AND skip_reason IS NOT NULL").count() == 0
    numbers = [r["n"] for r in staged.collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))
    assert staged.where("ok AND description LIKE '*%'").count() == 0
    assert staged.where("NOT ok AND code NOT LIKE '***%'").count() == 0


def test_long_target_lists_give_the_same_verdicts(corpus, default_run):
    wide = S.run(keyed(corpus), corpus.tables, P.DEFAULT, hot_rows=0, prune_titles=0)
    columns = default_run.verdicts.columns
    assert rows(wide.verdicts, *columns) == rows(default_run.verdicts, *columns)
    assert rows(wide.skipped(), "seq", "title", "skip_reason") == rows(
        default_run.skipped(), "seq", "title", "skip_reason"
    )
    assert rows(wide.staged(), "n", "title", "description", "lead") == rows(
        default_run.staged(), "n", "title", "description", "lead"
    )


def keyed(corpus):
    return corpus.targets.select("seq", F.col("raw_title").alias("title"))


def test_limits_cut_the_unlimited_run(corpus, default_run):
    whole = rows(default_run.staged(), "n", "title", "ok")
    arts = S.stage(corpus.targets, corpus.tables, JobConfig(max_arts=10))
    assert rows(arts.staged(), "n", "title", "ok") == whole[:10]
    good = S.stage(corpus.targets, corpus.tables, JobConfig(max_stage=5))
    fifth = [n for n, _, ok in whole if ok][4]
    assert rows(good.staged(), "n", "title", "ok") == whole[:fifth]
    columns = good.verdicts.columns
    cut = default_run.verdicts.where(F.col("seq") <= good.stop)
    assert rows(good.verdicts, *columns) == rows(cut, *columns)
    both = S.stage(corpus.targets, corpus.tables, JobConfig(max_stage=5, max_arts=2))
    assert rows(both.staged(), "n", "title", "ok") == whole[:2]
    too_many = S.stage(corpus.targets, corpus.tables, JobConfig(max_arts=10_000))
    assert rows(too_many.staged(), "n", "title", "ok") == whole


def test_limits_beyond_the_first_stretch(corpus, default_run, monkeypatch):
    monkeypatch.setattr(S, "MIN_STRETCH", 3)
    run = S.stage(corpus.targets, corpus.tables, JobConfig(max_arts=1, max_stage=0))
    assert run.staged().count() == 1
    late = S.stage(corpus.targets, corpus.tables, JobConfig(max_stage=45))
    assert late.successes.count() == 45


def test_unknown_startpoint_gives_nothing(corpus):
    run = S.stage(corpus.targets, corpus.tables, JobConfig(partial=True, startpoint="nowhere"))
    assert run.staged().count() == 0
    row = K.stage_summary(run.verdicts).first()
    assert row["message"] == "No target articles found" and row["success_pct"] is None
    assert K.example_report(run.successes, P.DEFAULT).count() == 0


def test_missing_and_repeated_targets(spark, corpus):
    targets = spark.createDataFrame(
        [(1, "nowhere_at all"), (2, "Gen21"), (3, "gen21"), (4, "List of x")],
        "seq bigint, raw_title string",
    )
    run = S.stage(targets, corpus.tables, P.DEFAULT)
    got = {r["n"]: (r["title"], r["ok"]) for r in run.staged().collect()}
    assert got == {1: ("Nowhere at all", False), 2: ("Gen21", True), 3: ("Gen21", True)}
    assert [r["skip_reason"] for r in run.skipped().collect()] == ["Is a list article"]


def test_staging_file(spark, tmp_path, default_run):
    path = K.write_staging(default_run.staged(), str(tmp_path), P.DEFAULT, NOW)
    assert path.endswith("staged algae (45 of 77) 2026-01-02 (03 04).tsv")
    lines = []
    for part in sorted(glob.glob(glob.escape(path) + "/part-*")):
        lines += open(part, encoding="utf-8").read().splitlines()
    assert [int(line.split("\t")[0]) for line in lines] == list(range(1, 78))
    assert all(line.count("\t") == 4 for line in lines)
    empty = default_run.staged().where("n < 0")
    assert K.write_staging(empty, str(tmp_path), P.DEFAULT, NOW) is None


def test_example_report_has_one_row_more(default_run):
    cfg = JobConfig(max_examples=5)
    report = K.example_report(default_run.successes, cfg).first()["report"]
    assert report.count("|-\n| [[") == 6 and report.endswith("|}")


def plan_text(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_page_text_is_not_shuffled(spark, corpus, tmp_path):
    path = str(tmp_path / "pages")
    corpus.pages.write.parquet(path)
    tables = S.WikiTables(
        spark.read.parquet(path),
        corpus.page_props,
        corpus.page_categories,
        corpus.taxonomy,
        corpus.wikidata,
    )
    for limit in (0, 1000):
        judged = S.judge_targets(keyed(corpus), tables, P.DEFAULT, prune_titles=limit)
        plan = plan_text(judged)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
        assert "Exchange SinglePartition" not in plan
        for line in plan.splitlines():
            assert not ("Exchange" in line and "text#" in line)


def test_no_ranges_are_sampled_from_judged_rows(corpus, monkeypatch):
    plans, durable = [], S.O.durable
    monkeypatch.setattr(S.O, "durable", lambda df: plans.append(plan_text(df)) or durable(df))
    S.stage(corpus.targets, corpus.tables, P.DEFAULT)
    joined = [plan for plan in plans if "Join" in plan]
    assert joined and not any("rangepartitioning" in plan for plan in joined)


def test_a_limit_judges_no_row_twice(corpus, monkeypatch):
    monkeypatch.setattr(S, "MIN_STRETCH", 10)
    judged, judge = [], S.judge_targets
    monkeypatch.setattr(
        S, "judge_targets", lambda t, *a: judged.extend(r.seq for r in t.collect()) or judge(t, *a)
    )
    run = S.stage(corpus.targets, corpus.tables, JobConfig(max_stage=4))
    assert run.successes.count() == 4
    assert len(judged) == len(set(judged)) < corpus.targets.count()
