"""Predicates on titles, texts, leads and existing descriptions.

Each check is a pair ``(condition that fails the row, reason)``; a chain of
checks reports the first one that fails and is null where all pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankdraft.config import JobConfig
from rankdraft.functions.pytext import contains_any, match_start, strip

LIST_ARTICLE = "Is a list article"
Check = tuple[Column, "Column | str"]


def is_list_article(title: Column) -> Column:
    return F.lower(title).contains("list of")


def is_redirect(text: Column) -> Column:
    # The plain search spares pages without the sign the upper-case copy.
    return text.contains("#") & F.upper(text).contains("#REDIRECT")


def has_infobox(text: Column, names: tuple[str, ...]) -> Column:
    return contains_any(F.lower(text), [n.lower() for n in names])


def is_override(kind: Column, cfg: JobConfig) -> Column:
    """True where an existing description may be changed; never null."""
    allowed = [
        name
        for name, on in (("manual", cfg.override_manual), ("embedded", cfg.override_embedded))
        if on
    ]
    return F.coalesce(kind.isin(allowed), F.lit(False)) if allowed else F.lit(False)


def _kind_checks(kind: Column, cfg: JobConfig, texts: dict[str, str]) -> list[Check]:
    blocked = {"manual": not cfg.override_manual, "embedded": not cfg.override_embedded}
    return [(F.lit(blocked[k]) & (kind == k), text) for k, text in texts.items()]


def page_checks(page: dict[str, Column], cfg: JobConfig) -> list[Check]:
    """Checks for wanted pages; keys title, kind, redirect, infobox, infoboxes."""
    checks = [(is_list_article(page["title"]), LIST_ARTICLE)]
    checks += existing_checks(page["kind"], cfg)
    checks.append((page["redirect"], "Is a redirect"))
    if cfg.require_infobox:
        checks.append((~page["infobox"], "Does not have an infobox"))
        if cfg.sole_infobox:
            checks.append((page["infoboxes"] > 1, "Has multiple infoboxes"))
    return checks


def existing_checks(kind: Column, cfg: JobConfig) -> list[Check]:
    return _kind_checks(
        kind,
        cfg,
        {
            "manual": "Already has manual short description",
            "embedded": "Already has embedded short description",
        },
    )


def _word_checks(c: Column, required, excluded, missing: str, present: str) -> list[Check]:
    checks = [(~c.contains(w), missing + w) for w in required]
    return checks + [(c.contains(w), present + w) for w in excluded]


def override_checks(desc: Column, kind: Column, cfg: JobConfig, mark: str) -> list[Check]:
    """Checks of an existing description that is about to be changed."""
    override = is_override(kind, cfg)
    regex = ~match_start(desc, cfg.existing_desc_regex)
    checks = [(regex, mark + "Existing description does not match regex")]
    checks += _word_checks(
        desc,
        cfg.existing_desc_required_words,
        cfg.existing_desc_excluded_words,
        mark + "Required word missing from existing SD - ",
        mark + "Excluded word present in existing SD - ",
    )
    return [(override & cond, text) for cond, text in checks]


FAILED = "**** "
# Reasons as reported.
NO_EDIT = "NO EDIT MADE: "
NOW_MANUAL = NO_EDIT + "Page now has a manual description"
MISMATCH = "ERROR: title mismatch"


def lead_checks(lead: Column, title: Column, cfg: JobConfig) -> list[Check]:
    checks: list[Check] = [(lead == "", FAILED + "Could not create lead (unpaired delimiters)")]
    checks += _word_checks(
        lead,
        cfg.required_words,
        cfg.excluded_words,
        FAILED + "Required word missing - ",
        FAILED + "Excluded word present - ",
    )
    if cfg.some_words:
        checks.append(
            (~contains_any(lead, cfg.some_words), FAILED + "None of the words present")
        )
    if cfg.text_regex_tf:
        checks.append(
            (~match_start(lead, cfg.text_regex), FAILED + "Lead does not match regex")
        )
    if cfg.title_regex_tf:
        checks.append(
            (~match_start(title, cfg.title_regex), FAILED + "Title does not match regex")
        )
    return checks


def criteria_checks(
    desc: Column, kind: Column, lead: Column, title: Column, cfg: JobConfig
) -> list[Check]:
    return override_checks(desc, kind, cfg, FAILED) + lead_checks(lead, title, cfg)


def replacing_checks(desc: Column, kind: Column, cfg: JobConfig) -> list[Check]:
    """Checks before an edit of the description in place."""
    texts = {
        "manual": NOW_MANUAL,
        "embedded": NO_EDIT + "Page now has an embedded description",
    }
    return _kind_checks(kind, cfg, texts) + override_checks(desc, kind, cfg, NO_EDIT)


def page_state_checks(page: dict[str, Column]) -> list[Check]:
    """Checks before an edit that have nothing to do with the description in place."""
    no_edit = NO_EDIT
    return [
        (page["redirect"], no_edit + "Page has been converted to a redirect"),
        (~page["exists"], no_edit + "Page does not exist"),
        (page["blank"], no_edit + "Page blanked or a blank page has been served"),
        (page["description"].contains("*"), no_edit + 'Description starts with "*"'),
        (~page["bots_ok"], no_edit + "Bot is excluded by the Bots template"),
        (page["title"] != page["page_title"], MISMATCH),
    ]


def edit_checks(page: dict[str, Column], cfg: JobConfig) -> list[Check]:
    """Checks before an edit, in the order in which their texts are reported.

    Keys kind, existing, redirect, exists, blank, description, bots_ok, title,
    page_title.
    """
    description = page["description"]
    same = F.concat(F.lit(NO_EDIT + 'No change to "'), description, F.lit('"'))
    state = page_state_checks(page)
    return (
        replacing_checks(page["existing"], page["kind"], cfg)
        + state[:3]
        + [(description == page["existing"], same)]
        + state[3:]
    )


BOTS_TEMPLATE = r"(?s)\{\{\s*((?:[Nn]ob|[Bb])ots)\s*((?:\|[^{}]*)?)\}\}"


def allow_bots(text: Column, user: str) -> Column:
    """Whether the first bots template of a page lets a user edit it."""
    name = F.lower(F.regexp_extract(text, BOTS_TEMPLATE, 1))
    params = F.regexp_extract(text, BOTS_TEMPLATE, 2)
    who = [user.lower().strip(), "all"]

    def decision(param: Column) -> Column:
        key = F.substring_index(param, "=", 1)
        value = F.substr(param, F.length(key) + 2)
        names = F.transform(F.split(value, ","), lambda x: strip(F.lower(x)))
        none = F.array_join(names, "") == "none"
        named = F.exists(names, lambda n: n.isin(who))
        return (
            F.when((key == "allow") & none, False)
            .when((key == "allow") & named, True)
            .when((key == "deny") & none, True)
            .when((key == "deny") & named, False)
        )

    decided = F.get(F.array_compact(F.transform(F.split(params, r"\|"), decision)), F.lit(0))
    bare = (name == "nobots") & (params == "")
    verdict = F.coalesce(decided, ~bare)
    # Few pages hold the template at all; a plain search settles the others.
    return F.when(text.contains("ots"), verdict).otherwise(True)
