import pytest
from pyspark.sql import functions as F

from rankdraft.config import JobConfig
from rankdraft.functions import checks as C
from rankdraft.functions.pytext import first_reason


@pytest.mark.parametrize(
    "text, allowed",
    [
        ("none here", True),
        ("{{nobots}}", False),
        ("{{Nobots}}", False),
        ("{{bots}}", True),
        ("{{bots|allow=none}}", False),
        ("{{bots|allow=Descbot, x}}", True),
        ("{{bots|allow=other}}", True),
        ("{{bots|deny=none}}", True),
        ("{{bots|deny=all}}", False),
        ("{{bots|deny=a, DESCBOT }}", False),
        ("{{bots|deny=a}}", True),
        ("{{bots|allow=all|deny=all}}", True),
        ("{{bots|deny=all|allow=all}}", False),
        ("{{nobots|x}}", True),
        ("{{robots}}", True),
        ("{{bots\n|deny=all}} {{nobots}}", False),
        ("{{bots|deny=a=descbot}}", True),
    ],
)
def test_allow_bots(apply, text, allowed):
    assert apply(lambda c: C.allow_bots(c, " Descbot"), [text]) == [allowed]


def test_redirect_anywhere(apply):
    assert apply(C.is_redirect, ["#redirect [[x]]", "a #Redirect", "redirect", "#", ""]) == [
        True,
        True,
        False,
        False,
        False,
    ]


def page_reason(spark, cfg, **facts):
    page = {
        "title": "A",
        "kind": None,
        "redirect": False,
        "infobox": True,
        "infoboxes": 1,
        **facts,
    }
    row = spark.createDataFrame(
        [tuple(page.values())],
        "title string, kind string, redirect boolean, infobox boolean, infoboxes int",
    )
    checks = C.page_checks({k: F.col(k) for k in page}, cfg)
    return row.select(first_reason(*checks)).first()[0]


def test_page_checks_in_order(spark):
    plain, strict = JobConfig(), JobConfig(require_infobox=True, sole_infobox=True)
    assert page_reason(spark, plain) is None
    assert page_reason(spark, plain, title="A List of b", kind="manual") == "Is a list article"
    assert page_reason(spark, plain, kind="manual") == "Already has manual short description"
    assert page_reason(spark, plain, kind="embedded", redirect=True) == (
        "Already has embedded short description"
    )
    assert page_reason(spark, JobConfig(override_manual=True), kind="manual") is None
    assert page_reason(spark, plain, redirect=True) == "Is a redirect"
    assert page_reason(spark, plain, infobox=False) is None
    assert page_reason(spark, strict, infobox=False) == "Does not have an infobox"
    assert page_reason(spark, strict, infoboxes=2) == "Has multiple infoboxes"
    only_sole = JobConfig(sole_infobox=True)
    assert page_reason(spark, only_sole, infoboxes=2) is None


def criteria(spark, cfg, desc="", kind=None, lead="An alga", title="Gen"):
    row = spark.createDataFrame(
        [(desc, kind, lead, title)], "d string, k string, lead string, title string"
    )
    checks = C.criteria_checks(F.col("d"), F.col("k"), F.col("lead"), F.col("title"), cfg)
    return row.select(first_reason(*checks)).first()[0]


def test_criteria(spark):
    assert criteria(spark, JobConfig()) is None
    assert criteria(spark, JobConfig(), lead="") == "**** Could not create lead (unpaired delimiters)"
    words = JobConfig(required_words=("An", "moss"), excluded_words=("alga",))
    assert criteria(spark, words) == "**** Required word missing - moss"
    assert criteria(spark, JobConfig(excluded_words=("alga",))) == "**** Excluded word present - alga"
    assert criteria(spark, JobConfig(some_words=("moss",))) == "**** None of the words present"
    assert criteria(spark, JobConfig(text_regex_tf=True, text_regex="alga")) == (
        "**** Lead does not match regex"
    )
    assert criteria(spark, JobConfig(title_regex_tf=True, title_regex="GEN$")) is None
    override = JobConfig(override_manual=True, existing_desc_regex="old", existing_desc_required_words=("1",))
    assert criteria(spark, override, "New", "manual") == (
        "**** Existing description does not match regex"
    )
    assert criteria(spark, override, "Old 2", "manual") == (
        "**** Required word missing from existing SD - 1"
    )
    assert criteria(spark, override, "New", "embedded") is None
