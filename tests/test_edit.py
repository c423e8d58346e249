import dataclasses
import datetime
import glob
import random
import re

import pytest
from pyspark.sql import functions as F

from rankdraft import profiles as P
from rankdraft.config import JobConfig
from rankdraft.corpus import ROOT_CATEGORY, Corpus
from rankdraft.functions import checks as C
from rankdraft.operators import lookups as L
from rankdraft.plans import edit as E
from rankdraft.run import run_edit, run_stage, runner

PAGES = [
    ("A", "Text of A"),
    ("B", "{{Short description|Old}}\nText"),
    ("C", "{{Infobox}} text"),
    ("D", "#Redirect [[A]]"),
    ("E", ""),
    ("G", "{{bots|deny=all}}"),
    ("H", "{{short description|Other}}\nText"),
    ("I", "{{Short description|Same}}\nText"),
]
PROPS = [("B", "Old"), ("C", "Box"), ("H", "Old"), ("I", "Same")]
STAGED = [(t, "Genus of algae") for t in "ABCDEFGH"] + [("I", "Same"), ("A", "*** : x"), ("a", "x"), ("A", "Twice")]


@pytest.fixture(scope="module")
def tables(spark):
    staged = spark.createDataFrame(
        [(i, t, d) for i, (t, d) in enumerate(STAGED)], "seq bigint, title string, description string"
    )
    pages = spark.createDataFrame(PAGES, "title string, text string")
    return staged, pages, spark.createDataFrame(PROPS, "title string, shortdesc string")


def outcome(plan):
    return {r["seq"]: (r["action"], r["status"], r["reason"]) for r in plan.collect()}


def test_default_policy(tables):
    got = outcome(E.plan_edits(*tables, P.DEFAULT))
    no = "NO EDIT MADE: "
    assert got == {
        0: ("add", "success", None),
        1: (None, "skipped", no + "Page now has a manual description"),
        2: (None, "skipped", no + "Page now has an embedded description"),
        3: (None, "skipped", no + "Page has been converted to a redirect"),
        4: (None, "skipped", no + "Page blanked or a blank page has been served"),
        5: (None, "skipped", no + "Page does not exist"),
        6: (None, "skipped", no + "Bot is excluded by the Bots template"),
        7: (None, "skipped", no + "Page now has a manual description"),
        8: (None, "skipped", no + "Page now has a manual description"),
        9: (None, "skipped", no + "Page now has a manual description"),
        10: (None, "skipped", no + "Page now has a manual description"),
        11: (None, "skipped", no + "Page now has a manual description"),
    }


def test_replacing_policy(tables):
    plan = E.plan_edits(*tables, P.REPLACE).cache()
    got = outcome(plan)
    assert got[1] == ("replace", "success", None)
    assert got[2] == ("override", "success", None)
    assert got[7] == ("replace", "error", E.NO_TEMPLATE)
    assert got[8][2] == 'NO EDIT MADE: No change to "Same"'
    assert got[9][2] == 'NO EDIT MADE: Description starts with "*"'
    assert got[10] == (None, "error", C.MISMATCH)
    assert got[11] == ("replace", "success", None)
    texts = {r["seq"]: (r["new_text"], r["edit_summary"]) for r in plan.where("status = 'success'").collect()}
    bot = "[[User:descbot|descbot]] "
    link = "[[Wikipedia:Short description|short description]]"
    new = "{{Short description|Genus of algae}}\n"
    assert texts == {
        0: (new + "Text of A", f'{bot}adding {link} "Genus of algae"'),
        1: (new + "Text", f'{bot}changing {link} from "Old" to "Genus of algae"'),
        2: (new + "{{Infobox}} text", f'{bot}overriding {link} from infobox with "Genus of algae"'),
        11: (
            "{{Short description|Twice}}\nText of A",
            f'{bot}changing {link} from "Genus of algae" to "Twice"',
        ),
    }
    lines = {r["seq"]: r["line"] for r in E.edit_log(plan).collect()}
    assert lines[0] == "A\tGenus of algae" and lines[7] == "H\t FAILED: Genus of algae"
    summary = E.edit_summary(plan).first()
    assert (summary["targets"], summary["success"], summary["failure"], summary["skipped"]) == (6, 4, 2, 6)


def test_sizes_do_not_change_the_plan(tables):
    small = E.plan_edits(*tables, P.REPLACE)
    large = E.plan_edits(*tables, P.REPLACE, broadcast_bytes=0, prune_titles=0)
    columns = small.columns
    pruned = E.plan_edits(*tables, P.REPLACE, broadcast_bytes=0)
    whole = sorted(map(str, small.select(columns).collect()))
    assert len(whole) == len(STAGED)
    for other in (large, pruned):
        assert sorted(map(str, other.select(columns).collect())) == whole


def test_long_lists_are_pruned_by_a_bitmap(spark):
    pages = spark.range(3000).selectExpr("concat('T', id) AS title", "id")
    asked = spark.range(0, 3000, 100).selectExpr("concat('T', id) AS title")
    kept = L.maybe_titles(pages, asked)
    assert kept.columns == pages.columns
    assert asked.join(kept, "title", "left_anti").count() == 0 and kept.count() < 100


def test_mismatch_can_stop_the_run(tables):
    with pytest.raises(ValueError):
        E.plan_edits(*tables, dataclasses.replace(P.REPLACE, on_mismatch="fail"))


def test_second_run_edits_nothing(spark, tables):
    staged, pages, props = tables
    staged = staged.where("seq < 9")
    plan = E.plan_edits(staged, pages, props, P.REPLACE).where("status = 'success'")
    edited = plan.select("title", F.col("new_text").alias("text"), "description")
    rest = pages.join(edited.select("title"), "title", "left_anti")
    pages_after = rest.unionByName(edited.select("title", "text"))
    props_after = props.join(edited.select("title"), "title", "left_anti").unionByName(
        edited.select("title", F.col("description").alias("shortdesc"))
    )
    again = E.plan_edits(staged, pages_after, props_after, P.REPLACE)
    assert again.where("status = 'success'").count() == 0
    assert again.where("reason LIKE '%No change%'").count() == 4


def test_logs(tmp_path, tables):
    plan = E.plan_edits(*tables, P.REPLACE)
    paths = E.write_logs(plan, str(tmp_path), P.REPLACE, "2026")
    assert [p.split("/")[-1] for p in paths] == ["log_success (4) 2026.tsv", "log_fail (2) 2026.tsv"]
    parts = glob.glob(glob.escape(paths[0]) + "/part-*")
    assert sum(len(open(p).read().splitlines()) for p in parts) == 4
    person = JobConfig(username="someone")
    assert E.log_name(person, "success", 1, "x") == "someone non-bot log_success (1) x.tsv"
    E.write_plan(plan, str(tmp_path / "plan"))
    assert glob.glob(str(tmp_path / "plan" / "status=success"))


def test_runs_from_file_to_file(spark, tmp_path):
    corpus = Corpus(spark, "/root/testdata/sf0.001")
    now = datetime.datetime(2026, 1, 2, 3, 4)
    base = str(tmp_path / "targets")
    corpus.targets.orderBy("seq").selectExpr("concat_ws('\t', seq, raw_title) AS value").write.text(base)
    cfg = JobConfig(base_file=base, write_examples=True, max_examples=2, mode_flag="stage")
    assert runner(cfg) is run_stage and runner(JobConfig()) is run_edit
    staged = run_stage(spark, cfg, corpus.tables, str(tmp_path), now)
    assert staged.summary.first()["success"] == 45
    assert staged.examples.count() == 1
    edited = run_edit(spark, cfg, corpus.pages, corpus.page_props, str(tmp_path), now, staged.files[0])
    row = edited.summary.first()
    assert row["success"] + row["failure"] + row["skipped"] == 77
    assert [f.split("/")[-1].split(" ")[0] for f in edited.files] == ["edit_plan", "log_success"]
    names = [f.split("/")[-1].split(" ")[0] for f in staged.files]
    assert names[-2:] == ["skipped", "examples"] and staged.rejected == 0
    by_category = JobConfig(use_basefile=False, targetcat=ROOT_CATEGORY)
    staged = run_stage(spark, by_category, corpus.tables, str(tmp_path / "c"), now, corpus.links)
    assert staged.summary.first()["targets"] > 0


def loop(staged, texts, props, cfg):
    """The rows one after the other, as (action, new text), or the reason."""
    out, rule = {}, re.compile(cfg.existing_desc_regex)
    for seq, title, new in staged:
        text, old = texts.get(title, ""), props.get(title, "")
        manual = "{{Short description|" in text or "{{short description|" in text
        kind = ("manual" if manual else "embedded") if old else None
        if kind and not getattr(cfg, f"override_{kind}"):
            out[seq] = f"Page now has a{'n' * (kind == 'embedded')} {kind} description"
        elif kind and not rule.match(old):
            out[seq] = "Existing description does not match regex"
        elif kind and any(w in old for w in cfg.existing_desc_excluded_words):
            out[seq] = "Excluded word present in existing SD"
        elif not text:
            out[seq] = "Page does not exist"
        elif new == old:
            out[seq] = "No change to"
        elif "*" in new:
            out[seq] = "Description starts with"
        else:
            cut = text
            if kind == "manual":
                for name in ("Short", "short"):
                    cut = cut.replace("{{" + name + " description|" + old + "}}\n", "")
            texts[title] = "{{Short description|" + new + "}}\n" + cut
            props[title] = new
            action = {None: "add", "embedded": "override", "manual": "replace"}[kind]
            out[seq] = (action, texts[title])
    return out


@pytest.mark.parametrize("policy", ["default", "replace", "words"])
def test_rows_of_one_page_follow_each_other(spark, policy):
    cfg = {
        "default": JobConfig(),
        "replace": JobConfig(override_manual=True, override_embedded=True),
        "words": JobConfig(
            override_manual=True,
            override_embedded=True,
            existing_desc_regex="[DE]",
            existing_desc_excluded_words=("2",),
        ),
    }[policy]
    draw = random.Random(policy)
    texts, props = {}, {}
    for i in range(60):
        old = draw.choice(["D1", "D2", "E1", "X", ""])
        manual = "{{%short description|%s}}\n" % (draw.choice("Ss") + "", old)
        manual = manual.replace("{{Sshort", "{{Short").replace("{{sshort", "{{short")
        texts[f"P{i}"] = (manual if old and draw.random() < 0.6 else "") + f"Text {i}"
        if old:
            props[f"P{i}"] = old
    staged = [
        (n, f"P{draw.randrange(62)}", draw.choice(["D1", "D2", "E1", "X", "* x", "E2"]))
        for n in range(400)
    ]
    frames = (
        spark.createDataFrame(staged, "seq bigint, title string, description string"),
        spark.createDataFrame(list(texts.items()), "title string, text string"),
        spark.createDataFrame(list(props.items()), "title string, shortdesc string"),
    )
    # With a bound of 3 rows nearly all pages are hot.
    plan = E.plan_edits(*frames, cfg).collect()
    split = E.plan_edits(*frames, cfg, hot_rows=3).collect()
    assert sorted(r["seq"] for r in plan) == sorted(r["seq"] for r in split) == list(range(400))
    expected = loop(staged, dict(texts), dict(props), cfg)
    for row in plan + split:
        want = expected[row["seq"]]
        if row["status"] == "success":
            assert (row["action"], row["new_text"]) == want
        else:
            assert want in row["reason"]


def test_many_rows_of_one_page_carry_no_list_of_those_before(spark):
    text = "".join(("{{Short description|D%d}}\n" % i) + "x" for i in (900, 3, 44, 3))
    # Cutting D7 brings about D20, which a later row cuts.
    text += "{{Short description|D2{{short description|D7}}\n0}}\nend"
    texts, props = {"P": text, "Q": "{{Short description|D1}}\nQ"}, {"Q": "D1"}
    staged = [(i, "P", f"D{i}") for i in range(1000)]
    staged += [(1000 + i, "Q", f"D{i % 3}") for i in range(6)]
    frames = (
        spark.createDataFrame(staged, "seq bigint, title string, description string"),
        spark.createDataFrame(list(texts.items()), "title string, text string"),
        spark.createDataFrame(list(props.items()), "title string, shortdesc string"),
    )
    cfg = JobConfig(override_manual=True, override_embedded=True)
    expected = loop(staged, dict(texts), dict(props), cfg)
    for limits in ({}, {"broadcast_bytes": 0, "prune_titles": 0}):
        plan = E.plan_edits(*frames, cfg, **limits)
        assert "collect_set" not in plan._jdf.queryExecution().optimizedPlan().toString()
        rows = plan.collect()
        assert len(rows) == len(staged)
        for row in rows:
            want = expected[row["seq"]]
            if row["status"] == "success":
                assert (row["action"], row["new_text"]) == want
            else:
                assert want in row["reason"]


def test_a_failed_replacement_leaves_the_page_as_it_is(spark):
    texts, props = {"P": "{{Short description|Old}}\nText"}, {"P": "Other"}
    staged = [(0, "P", "D"), (1, "P", "D"), (2, "P", "Other"), (3, "P", "E")]
    frames = (
        spark.createDataFrame(staged, "seq bigint, title string, description string"),
        spark.createDataFrame(list(texts.items()), "title string, text string"),
        spark.createDataFrame(list(props.items()), "title string, shortdesc string"),
    )
    for limits in ({}, {"broadcast_bytes": 0, "prune_titles": 0}):
        plan = E.plan_edits(*frames, P.REPLACE, **limits).orderBy("seq").collect()
        assert [r["status"] for r in plan] == ["error", "error", "skipped", "error"]
        assert plan[1]["reason"] == E.NO_TEMPLATE


def test_lines_that_cannot_be_used_are_failed_rows(spark, tmp_path):
    (tmp_path / "staged.tsv").write_text("1\tA\tGenus\t\t\n2\tB\njunk\n\n{| x\n")
    pages = spark.createDataFrame([("A", "Text")], "title string, text string")
    props = spark.createDataFrame([], "title string, shortdesc string")
    now = datetime.datetime(2026, 1, 2, 3, 4)
    path = str(tmp_path / "staged.tsv")
    done = run_edit(spark, JobConfig(), pages, props, str(tmp_path / "out"), now, path)
    row = done.summary.first()
    assert (row["success"], row["failure"], row["skipped"], done.rejected) == (1, 2, 0, 2)


def test_rows_of_a_hot_page_are_spread_over_tasks(spark, monkeypatch):
    """A third of all rows edit one page: no task gets most of them."""
    # These rows are so few that Spark would give all shuffled ones to one task.
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalescing, "false")
    try:
        _check_hot_page(spark, monkeypatch)
    finally:
        spark.conf.unset(coalescing)


def _check_hot_page(spark, monkeypatch):
    n, cfg = 6000, JobConfig(override_manual=True, override_embedded=True)
    staged = spark.range(n).selectExpr(
        "id AS seq",
        "CASE WHEN id % 3 = 0 THEN 'Hot' ELSE concat('P', id) END AS title",
        "concat('D', id % 7) AS description",
    )
    pages = staged.select("title").distinct().selectExpr("title", "concat('Text ', title) AS text")
    props = spark.createDataFrame([("Hot", "Given")], "title string, shortdesc string")
    sorted_rows, durable = [], E.durable
    monkeypatch.setattr(E, "durable", lambda df: sorted_rows.append(durable(df)) or sorted_rows[-1])
    plan = E.plan_edits(staged, pages, props, cfg, hot_rows=20)
    monkeypatch.undo()
    # The first finished table is that of the rows in order, a range of which is a run.
    runs = sorted_rows[0].groupBy("title", F.spark_partition_id()).count().agg(F.max("count"))
    assert runs.first()[0] < n / 4
    at = plan.where("title = 'Hot'").groupBy(F.spark_partition_id().alias("task")).count()
    shares = [r["count"] for r in at.collect()]
    assert sum(shares) == n / 3 and len(shares) >= 6 and max(shares) < n / 9
    columns = ["seq", "status", "reason", "existing_desc", "new_text", "edit_summary"]
    whole = E.plan_edits(staged, pages, props, cfg).select(*columns)
    assert sorted(map(str, plan.select(*columns).collect())) == sorted(map(str, whole.collect()))


def test_templates_are_looked_up_by_what_follows_their_openings(spark):
    template = "{{%s description|%s}}"
    rows = [
        ("A", template % ("Short", "old"), "old"),
        ("B", "x " + template % ("short", "other") + template % ("short", "old") + " y", "old"),
        ("C", template % ("Short", "older"), "old"),
        ("D", "no template", "old"),
        ("E", None, "old"),
        ("F", template % ("Short", "two\nlines"), "two\nlines"),
        ("G", template % ("Short", ""), None),
        ("H", template % ("SHORT", "old"), "old"),
        ("I", "{{Short description|old", "old"),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "title string, text string")
    props = spark.createDataFrame([r[::2] for r in rows], "title string, shortdesc string")
    for few in (True, False):
        found = E._without_template(pages.select("title"), pages, props, few)
        assert sorted(r.title for r in found.collect()) == ["C", "D", "E", "H", "I"]
        # Of a text nothing else goes into the join.
        assert "Join" in (plan := found._jdf.queryExecution().optimizedPlan().toString())
        joined = plan[plan.index("Join") :].splitlines()[1]
        assert "_after" in joined and not re.search(r"\btext#\d+\]", joined)
