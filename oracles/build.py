"""One SQL statement per registered query, put together from shared tables."""

from __future__ import annotations

import re

from oracles import rank_sql as R
from oracles.text_sql import (
    LEAD_CTES,
    allow_bots,
    clean_text,
    clean_title,
    compress,
    contains_any,
    find_between,
    first_case,
    nobra,
    q,
    strip,
    words,
)
from rankdraft import profiles as P
from rankdraft.config import JobConfig
from rankdraft.corpus import CTES, ROOT_CATEGORY
from rankdraft.sinks.staging import EXAMPLE_HEADER

RANKS = ["rank_category", "rank_lead", "rank_speciesbox", "rank_taxobox", "rank_autobox"]
TABLES = {**CTES, **LEAD_CTES, "taxonomy": R.TAXONOMY_CTE}


def statement(select: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """The select with the tables it needs, directly or through others, in front."""
    tables = {**TABLES, **(extra or {})}
    order = list(tables)
    needed: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in order:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(tables[name])
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({tables[name]})" for name in order if name in needed)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


# ------------------------------------------------------------------ checks


def word_checks(x: str, required, excluded, missing: str, present: str):
    checks = [(f"NOT contains({x}, {q(w)})", q(missing + w)) for w in required]
    return checks + [(f"contains({x}, {q(w)})", q(present + w)) for w in excluded]


def not_at_start(x: str, regex: str) -> str:
    if not regex:  # matches everything
        return "false"
    return f"NOT regexp_matches({x}, {q(f'^(?i:{regex})')})"


def override(cfg: JobConfig) -> str:
    kinds = [k for k, on in (("manual", cfg.override_manual), ("embedded", cfg.override_embedded)) if on]
    parts = [f"coalesce(existing_type, '') = {q(k)}" for k in kinds]
    return "(" + (" OR ".join(parts) or "false") + ")"


def override_checks(cfg: JobConfig, mark: str):
    checks = [(not_at_start("existing_desc", cfg.existing_desc_regex),
               q(mark + "Existing description does not match regex"))]
    checks += word_checks(
        "existing_desc", cfg.existing_desc_required_words, cfg.existing_desc_excluded_words,
        mark + "Required word missing from existing SD - ",
        mark + "Excluded word present in existing SD - ",
    )
    return [(f"{override(cfg)} AND {cond}", text) for cond, text in checks]


def lead_checks(cfg: JobConfig):
    m = "**** "
    checks = [("lead = ''", q(m + "Could not create lead (unpaired delimiters)"))]
    checks += word_checks(
        "lead", cfg.required_words, cfg.excluded_words,
        m + "Required word missing - ", m + "Excluded word present - ",
    )
    if cfg.some_words:
        checks.append((f"NOT {contains_any('lead', cfg.some_words)}", q(m + "None of the words present")))
    if cfg.text_regex_tf:
        checks.append((not_at_start("lead", cfg.text_regex), q(m + "Lead does not match regex")))
    if cfg.title_regex_tf:
        checks.append((not_at_start("title", cfg.title_regex), q(m + "Title does not match regex")))
    return checks


def existing_checks(cfg: JobConfig):
    blocked = {"manual": not cfg.override_manual, "embedded": not cfg.override_embedded}
    return [
        (f"existing_type = {q(kind)}", q(f"Already has {kind} short description"))
        for kind, on in blocked.items()
        if on
    ]


REDIRECT = "contains(upper(text), '#REDIRECT')"
INFOBOXES = r"CAST(len(regexp_extract_all({x}, '(?i)\{{\{{[^{{}}|]*infobox')) AS BIGINT)"


def infobox(x: str, cfg: JobConfig) -> str:
    return contains_any(f"lower({x})", [n.lower() for n in cfg.infobox_strings])


def page_checks(cfg: JobConfig):
    checks = [("contains(lower(title), 'list of')", q("Is a list article"))]
    checks += existing_checks(cfg)
    checks.append((REDIRECT, q("Is a redirect")))
    if cfg.require_infobox:
        checks.append((f"NOT {infobox('text', cfg)}", q("Does not have an infobox")))
        if cfg.sole_infobox:
            checks.append((f"{INFOBOXES.format(x='text')} > 1", q("Has multiple infoboxes")))
    return checks


def edit_checks(cfg: JobConfig):
    m = "NO EDIT MADE: "
    blocked = {"manual": not cfg.override_manual, "embedded": not cfg.override_embedded}
    article = {"manual": "a manual", "embedded": "an embedded"}
    checks = [
        (f"existing_type = {q(kind)}", q(f"{m}Page now has {article[kind]} description"))
        for kind, on in blocked.items()
        if on
    ]
    checks += override_checks(cfg, m)
    return checks + [
        (REDIRECT, q(m + "Page has been converted to a redirect")),
        ("NOT page_exists", q(m + "Page does not exist")),
        ("text = ''", q(m + "Page blanked or a blank page has been served")),
        ("description = existing_desc", f"{q(m + 'No change to ')} || chr(34) || description || chr(34)"),
        ("contains(description, '*')", q(m + 'Description starts with "*"')),
        (f"NOT ({allow_bots('text', cfg.username)})", q(m + "Bot is excluded by the Bots template")),
        ("staged_title <> title", q("ERROR: title mismatch")),
    ]


# ------------------------------------------------------------------ facts and verdicts

EXISTING = """
    CASE WHEN coalesce(shortdesc, '') = '' THEN '' ELSE shortdesc END AS existing_desc,
    CASE WHEN coalesce(shortdesc, '') = '' THEN NULL
         WHEN contains(text, '{{short description') OR contains(text, '{{Short description')
         THEN 'manual' ELSE 'embedded' END AS existing_type"""

PAGES = f"""
    SELECT *, {EXISTING} FROM (
        SELECT t.seq, t.raw_title AS title, coalesce(a.text, '') AS text,
               a.title IS NOT NULL AS page_exists, p.shortdesc
        FROM tgt t LEFT JOIN art a ON a.title = t.raw_title
        LEFT JOIN props p ON p.title = t.raw_title)"""


def chain(cfg: JobConfig) -> dict[str, str]:
    """Tables from page facts to numbered verdicts, staged rows and edits."""
    sing, plur = cfg.name_singular, cfg.name_plural
    mode_rows = ", ".join(f"({i}, {r})" for i, r in enumerate(RANKS))
    best_low = f"best_rank IN {R.LOW}"
    mono = R.monotypic("tc", "lead")
    settled = f"CASE WHEN words = 1 AND best_rank = 'Species' AND {mono} THEN 'Genus' ELSE best_rank END"
    odd = (
        "((words = 1 AND best_rank IN ('Subspecies', 'Variety')) OR "
        f"(words <> 1 AND NOT ({best_low})))"
    )

    def has(rank: str) -> str:
        return f"list_contains(votes, {q(rank)})"

    others = "list_filter(modes, lambda m: m <> rank_autobox)"
    conflict = first_case(
        [
            (f"{has('Genus')} AND {has('Species')} AND words <> 1", "'Species'"),
            (f"{has('Genus')} AND {has('Species')}", "'Genus'"),
            (f"{has('Subspecies')} AND {has('Species')}", "'Subspecies'"),
            (f"{has('Variety')} AND {has('Species')}", "'Variety'"),
            (f"{has('Species')} AND words = 2", "'Species'"),
            (f"rank_autobox IS NOT NULL AND len({others}) = 1", f"{others}[1]"),
        ]
    )
    error = first_case(
        [
            ("len(votes) = 0", q("***** : NO MATCHING RANKS")),
            ("rank_autobox IS NOT NULL", "'***** :  AUTOTAXOBOX HAS ' || rank_autobox"),
        ],
        q("***** : CAN'T GET BEST RANK"),
    )

    stops = []
    if cfg.max_arts:
        stops.append(f"(SELECT min(seq) FROM articles WHERE n >= {cfg.max_arts})")
    if cfg.max_stage:
        stops.append(f"(SELECT min(seq) FROM articles WHERE ok AND successes >= {cfg.max_stage})")
    if cfg.partial:
        stops.append(f"(SELECT min(seq) FROM articles WHERE ok AND contains(title, {q(cfg.endpoint)}))")
    stop = f"coalesce(least({', '.join(stops)}), 9223372036854775807)" if stops else "9223372036854775807"
    start = (
        f"seq >= (SELECT min(seq) FROM tgt WHERE contains({clean_title('raw_title')}, {q(cfg.startpoint)}))"
        if cfg.partial
        else "true"
    )
    return {
        "target_pages": PAGES,
        "categories": "SELECT title, list(DISTINCT lower(category)) AS names FROM cats "
        "WHERE NOT hidden GROUP BY title",
        "described": f"""
            SELECT t.*, coalesce(l.lead, '') AS lead, coalesce(w.desc_en, '') AS wikidata_sd,
                   coalesce(c.names, []) AS names, {compress('t.text')} AS tc,
                   {nobra('t.title')} AS nobra, {words(nobra('t.title'))} AS words
            FROM target_pages t LEFT JOIN leads l ON l.title = t.title
            LEFT JOIN wd w ON w.title = t.title LEFT JOIN categories c ON c.title = t.title""",
        "facts": f"""
            SELECT s.*, x.rank_autobox, coalesce(x.autobox_extinct, false) AS autobox_extinct FROM (
                SELECT *, {R.category_rank('names')} AS rank_category,
                       {R.category_extinct('names')} AS category_extinct,
                       {R.lead_rank('lead', sing)} AS rank_lead,
                       {R.speciesbox('tc')} AS rank_speciesbox,
                       {R.taxobox('nobra', 'tc')} AS rank_taxobox,
                       {R.autobox_key('tc')} AS autobox_key
                FROM described) s
            LEFT JOIN taxonomy x ON x.autobox_key = s.autobox_key""",
        "rank_rows": f"""
            SELECT seq, title, rank, count(*) AS votes, min(pos) AS first_pos FROM (
                SELECT seq, title, r.pos, r.rank
                FROM facts, LATERAL (VALUES {mode_rows}) r(pos, rank) WHERE r.rank IS NOT NULL)
            GROUP BY ALL""",
        "mode_rows": "SELECT * FROM rank_rows QUALIFY votes = max(votes) OVER (PARTITION BY seq)",
        "voted": f"""
            SELECT f.*, coalesce(m.modes, []) AS modes, coalesce(v.votes, []) AS votes,
                   CASE WHEN len(m.modes) = 1 THEN m.modes[1] END AS best_rank
            FROM facts f
            LEFT JOIN (SELECT seq, list(rank ORDER BY first_pos) AS modes FROM mode_rows GROUP BY seq) m
                ON m.seq = f.seq
            LEFT JOIN (SELECT seq, list(rank) AS votes FROM rank_rows GROUP BY seq) v ON v.seq = f.seq""",
        "ruled": f"""
            SELECT *, {R.marker('title')} AS marker, {settled} AS settled, NOT {odd} AS settled_ok,
                   {conflict} AS conflict, {error} AS error FROM voted""",
        "chosen": """
            SELECT *, coalesce(marker, CASE WHEN best_rank IS NOT NULL THEN settled ELSE conflict END) AS chosen,
                   marker IS NOT NULL OR CASE WHEN best_rank IS NOT NULL THEN settled_ok
                       ELSE conflict IS NOT NULL END AS gen_ok FROM ruled""",
        "drafted": f"""
            SELECT *, {R.adjust('raw_draft', 'lead', 'autobox_extinct', 'category_extinct')} AS draft
            FROM (SELECT *, {R.draft('chosen', sing, plur)} AS raw_draft FROM chosen)""",
        "generated": """
            SELECT *, CASE WHEN gen_ok THEN draft WHEN best_rank IS NOT NULL THEN '*** : ' || draft
                ELSE error END AS gen_msg FROM drafted""",
        "verdicts": f"""
            SELECT seq, {clean_title('title')} AS title, skip_reason, wikidata_sd, lead, text,
                   skip_reason IS NULL AND criteria_error IS NULL AND gen_ok AS ok,
                   coalesce(criteria_error, gen_msg) AS description
            FROM (SELECT *, {first_case(page_checks(cfg))} AS skip_reason,
                         {first_case(override_checks(cfg, '**** ') + lead_checks(cfg))} AS criteria_error
                  FROM generated) WHERE {start}""",
        "articles": """
            SELECT *, row_number() OVER (ORDER BY seq) AS n,
                   sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS successes
            FROM verdicts WHERE skip_reason IS NULL""",
        "stop": f"SELECT {stop} AS seq",
        "staged": """
            SELECT seq, n, title, description, wikidata_sd, lead, ok,
                   CASE WHEN ok THEN NULL ELSE regexp_extract(description, '^[*]+') END AS code
            FROM articles WHERE seq <= (SELECT seq FROM stop)""",
        "staged_lines": """
            SELECT n, concat(n, chr(9), title, chr(9), description, chr(9), wikidata_sd, chr(9), lead)
                AS line FROM staged""",
        "reviewed": f"""
            SELECT n - 1 AS seq, {strip('split_part(line, chr(9), 2)')} AS title,
                   {strip('split_part(line, chr(9), 3)')} AS description
            FROM staged_lines WHERE NOT contains(line, '{{|') AND NOT contains(line, '|}}')""",
    }


def decisions(source: str, cfg: JobConfig) -> dict[str, str]:
    """Tables (edit_facts, decided) for a source of (seq, title, description)."""
    key = "upper(r.title[1:1]) || r.title[2:]"
    return {
        "edit_facts": f"""
            SELECT *, {EXISTING} FROM (
                SELECT r.seq, r.title AS staged_title, {key} AS title, r.description,
                       coalesce(a.text, '') AS text, a.title IS NOT NULL AS page_exists, p.shortdesc
                FROM {source} r LEFT JOIN art a ON a.title = {key}
                LEFT JOIN props p ON p.title = {key})""",
        "decided": f"SELECT *, {first_case(edit_checks(cfg))} AS reason FROM edit_facts",
    }


def summary_text(action: str, existing: str, desc: str, prefix: str) -> str:
    link = "[[Wikipedia:Short description|short description]]"
    verbs = {"add": ("Adding", ""), "override": ("Overriding", " from infobox with"),
             "replace": ("Changing", " from")}
    opening = {
        k: q(f"{prefix}{verb.lower() if prefix else verb} {link}{rest} \"")
        for k, (verb, rest) in verbs.items()
    }
    return first_case(
        [
            (f"{action} = 'add'", f"{opening['add']} || {desc} || chr(34)"),
            (f"{action} = 'override'", f"{opening['override']} || {desc} || chr(34)"),
            (
                f"{action} = 'replace'",
                f"{opening['replace']} || {existing} || chr(34) || ' to ' || chr(34) || {desc} || chr(34)",
            ),
        ]
    )


BOT = "[[User:descbot|descbot]] "
ACTION = ("CASE WHEN existing_type IS NULL THEN 'add' WHEN existing_type = 'embedded' "
          "THEN 'override' ELSE 'replace' END")


def template(name: str, value: str) -> str:
    return f"'{{{{{name} description|' || {value} || '}}}}'"


def added(text: str, desc: str) -> str:
    return f"{template('Short', desc)} || chr(10) || {text}"


def replaced(text: str, desc: str, old: str) -> str:
    first, second = template("Short", old), template("short", old)
    cut = f"replace(replace({text}, {first} || chr(10), ''), {second} || chr(10), '')"
    return (
        f"CASE WHEN contains({text}, {first}) OR contains({text}, {second}) "
        f"THEN {added(cut, desc)} END"
    )


def edits(cfg: JobConfig) -> dict[str, str]:
    new_text = (
        f"CASE WHEN action = 'replace' THEN {replaced('text', 'description', 'existing_desc')} "
        f"ELSE {added('text', 'description')} END"
    )
    return {
        **chain(cfg),
        **decisions("reviewed", cfg),
        "actions": f"SELECT *, CASE WHEN reason IS NULL THEN {ACTION} END AS action FROM decided",
        "rewritten": f"""
            SELECT *, CASE WHEN reason IS NULL THEN {new_text} END AS new_text FROM actions""",
        "plan": f"""
            SELECT seq, staged_title AS title, description, action, new_text,
                   CASE WHEN new_text IS NOT NULL THEN 'success'
                        WHEN reason IS NULL OR reason = 'ERROR: title mismatch' THEN 'error'
                        ELSE 'skipped' END AS status,
                   CASE WHEN reason IS NULL AND new_text IS NULL
                        THEN 'ERROR: Cannot locate SD template, though it should exist'
                        ELSE reason END AS reason,
                   CASE WHEN new_text IS NOT NULL
                        THEN {summary_text('action', 'existing_desc', 'description', BOT)} END AS edit_summary
            FROM rewritten""",
    }


def repeated_edits(policies: dict[str, JobConfig]) -> tuple[str, dict[str, str]]:
    """The loop over four rows of each page: each row finds the text and the description
    that the row before it has saved."""
    drafts = ["draft", "draft", "draft || ' again'", "draft"]
    tables, parts = {}, []
    for policy, cfg in policies.items():
        of = edits(cfg)
        name = lambda table, i: f"{policy}_{table}_{i}"
        tables[name("state", 0)] = """
            SELECT seq, staged_title, title, description AS draft, text, page_exists, shortdesc
            FROM edit_facts"""
        for i, draft in enumerate(drafts):
            tables[name("facts", i)] = f"""
                SELECT *, {EXISTING} FROM (
                    SELECT * REPLACE (seq * {len(drafts)} + {i} AS seq), {draft} AS description
                    FROM {name("state", i)})"""
            before = "edit_facts", name("facts", i)
            for table in ("decided", "actions", "rewritten", "plan"):
                tables[name(table, i)] = of[table].replace(f"FROM {before[0]}", f"FROM {before[1]}")
                before = table, name(table, i)
            parts.append(
                f"SELECT {q(policy)} AS policy, seq, title, description, action, status, reason, "
                f"edit_summary, new_text FROM {name('plan', i)}"
            )
            tables[name("state", i + 1)] = f"""
                SELECT seq // {len(drafts)} AS seq, staged_title, title, draft,
                       coalesce(new_text, text) AS text, page_exists,
                       CASE WHEN new_text IS NULL THEN shortdesc ELSE description END AS shortdesc
                FROM {name("rewritten", i)}"""
    return " UNION ALL ".join(parts), tables


def run_summary(phase: str, source: str) -> str:
    def pct(x: str) -> str:
        return f"CASE WHEN s + f > 0 THEN CAST(printf('%.2f', 100 * {x} / (s + f)) AS DOUBLE) END"

    return (
        f"SELECT {q(phase)} AS phase, s + f AS targets, s AS success, f AS failure, k AS skipped, "
        f"{pct('s')} AS success_pct, {pct('f')} AS failure_pct, "
        f"CASE WHEN s + f = 0 THEN 'No target articles found' END AS message FROM ({source})"
    )


# ------------------------------------------------------------------ one entry per query

ORACLES: dict[str, str] = {}


def _on(table: str, **columns: str) -> str:
    made = ", ".join(f"{expr} AS {alias}" for alias, expr in columns.items())
    return statement(f"SELECT title, {made} FROM {table}")


TARGETS = "(SELECT seq, raw_title AS title FROM tgt)"
SENTENCE = f"({R.sentence('lead')})"
TC = "(SELECT title, " + compress("text") + " AS tc FROM art)"

ORACLES |= {
    "title_nobra": _on(TARGETS, nobra=nobra("title")),
    "title_word_count": _on(TARGETS, words=words(nobra("title"))),
    "clean_title": _on(TARGETS, clean=clean_title("title")),
    "title_url": _on(TARGETS, url="replace(title, ' ', '_')"),
    "compress_text": _on("art", compressed=compress("text")),
    "count_infoboxes": _on("art", n=INFOBOXES.format(x="text")),
    "clean_text_page": _on("art", cleaned=clean_text("text")),
    "find_between": _on("art", part=find_between("text", "genus = ", "|")),
    "first_sentence": _on("leads", sentence=R.sentence("lead")),
    "lead_section": _on("lead_section", lead="x"),
    "mask_templates": _on("mask_templates", lead="x"),
    "shorten_piped_links": _on("shorten_piped_links", lead="x"),
    "mask_images": _on("mask_images", lead="x"),
    "drop_selfclosing_refs": _on("drop_selfclosing_refs", lead="x"),
    "mask_refs": _on("mask_refs", lead="x"),
    "clean_text": _on("clean_text", lead="x"),
    "get_lead": statement("SELECT title, lead FROM leads"),
    "truncate_lead": _on("art", start=strip("substr(text, 1, 150)")),
    "bracket_pairs": statement(
        """SELECT s.title, s.balanced, p.open_pos, p.close_pos FROM sections s
        LEFT JOIN pairs p ON p.title = s.title AND s.balanced""",
        {
            "signs": """
                SELECT title, pos - 1 AS pos, c, sum(CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END)
                    OVER (PARTITION BY title ORDER BY pos) AS depth
                FROM (SELECT title, unnest(string_split(x, '')) AS c,
                             generate_subscripts(string_split(x, ''), 1) AS pos
                      FROM lead_braces WHERE x <> '')""",
            "sections": """
                SELECT b.title, coalesce(d.low >= 0 AND d.last = 0, true) AS balanced FROM lead_braces b
                LEFT JOIN (SELECT title, min(depth) AS low, arg_max(depth, pos) AS last
                           FROM signs GROUP BY title) d ON d.title = b.title""",
            "pairs": """
                SELECT o.title, o.pos AS open_pos, min(e.pos) AS close_pos
                FROM signs o JOIN signs e ON e.title = o.title AND e.c = '}' AND o.c = '{'
                    AND e.pos > o.pos AND e.depth = o.depth - 1
                GROUP BY o.title, o.pos""",
        },
    ),
    # sources
    "scan_targets": statement(
        "SELECT seq, raw_title FROM tgt WHERE seq % 50 <> 7 AND NOT (seq % 61 = 5)"
    ),
    "reject_targets": statement(
        "SELECT seq, concat('broken ', seq) AS line FROM tgt WHERE seq % 61 = 5 AND seq % 50 <> 7"
    ),
    "lookup_page_text": statement(
        "SELECT seq, title, text, page_exists FROM target_pages", {"target_pages": PAGES}
    ),
    "lookup_shortdesc": statement(
        f"SELECT t.seq, t.title, p.shortdesc FROM {TARGETS} t LEFT JOIN props p ON p.title = t.title"
    ),
    "shortdesc_from_json": statement(
        f"SELECT t.title, p.shortdesc FROM {TARGETS} t LEFT JOIN props p ON p.title = t.title"
    ),
    "lookup_wikidata_desc": statement(
        f"SELECT t.seq, t.title, coalesce(w.desc_en, '') AS wikidata_sd FROM {TARGETS} t "
        "LEFT JOIN wd w ON w.title = t.title"
    ),
    "page_category_array": statement(
        f"SELECT t.title, c.category FROM {TARGETS} t LEFT JOIN (SELECT DISTINCT title, "
        "lower(category) AS category FROM cats WHERE NOT hidden) c ON c.title = t.title"
    ),
    "lookup_taxonomy": statement(
        f"""SELECT a.title, a.autobox_key, x.rank_autobox,
            coalesce(x.autobox_extinct, false) AS autobox_extinct
        FROM (SELECT title, {R.autobox_key('tc')} AS autobox_key FROM {TC}) a
        LEFT JOIN taxonomy x ON x.autobox_key = a.autobox_key"""
    ),
    "info_from_autobox": statement(
        f"""SELECT a.title, x.rank_autobox, coalesce(x.autobox_extinct, false) AS autobox_extinct
        FROM (SELECT title, {R.autobox_key('tc')} AS autobox_key FROM {TC}) a
        LEFT JOIN taxonomy x ON x.autobox_key = a.autobox_key"""
    ),
    "reject_staged": statement(
        "SELECT seq, CASE seq % 40 WHEN 6 THEN concat(seq, chr(9), raw_title) "
        "ELSE concat('note ', seq) END AS line FROM tgt WHERE seq % 40 IN (6, 7)"
    ),
    "scan_staged": statement(
        "SELECT seq, raw_title AS title, 'Species of alga' AS description FROM tgt "
        "WHERE seq % 40 NOT IN (3, 4, 5)"
    ),
}

_CLOSURE = f"""reached(category) AS (
    SELECT {q(ROOT_CATEGORY)} UNION
    SELECT l.child FROM links l JOIN reached r ON r.category = l.parent WHERE l.child_ns = 14)"""
_MEMBERS = "SELECT DISTINCT l.child AS title FROM links l JOIN reached r ON r.category = l.parent WHERE l.child_ns = 0"
_closed = statement("SELECT * FROM links", recursive=True).rsplit("\n", 1)[0]
ORACLES |= {
    "scan_category_recursive": f"{_closed},\n{_CLOSURE}\n{_MEMBERS}",
    "category_targets": f"{_closed},\n{_CLOSURE}\n"
    f"SELECT row_number() OVER (ORDER BY title) AS place, title FROM ({_MEMBERS})",
    "scan_category_flat": statement(
        "SELECT DISTINCT child AS title FROM links WHERE parent = 'Category:Algae genera' AND child_ns = 0"
    ),
}

_pages = {"target_pages": PAGES}


def _reason(table: str, checks, extra=None) -> str:
    return statement(f"SELECT title, {first_case(checks)} AS reason FROM {table}", extra)


def _desc_cfg(**settings) -> JobConfig:
    return JobConfig(override_manual=True, override_embedded=True, **settings)


_criteria = _desc_cfg(
    existing_desc_regex="old",
    existing_desc_required_words=("desc",),
    existing_desc_excluded_words=("2",),
    required_words=("is",),
    excluded_words=("rocks",),
    title_regex_tf=True,
    title_regex="gen",
)
_more = "text || CASE WHEN contains(text, 'Taxobox') THEN '{{Infobox a}}{{infobox b|c}}' ELSE '' END"
ORACLES |= {
    "existing_shortdesc": statement("SELECT title, existing_desc, existing_type FROM target_pages", _pages),
    "filter_list_articles": statement(
        f"SELECT seq, title FROM {TARGETS} WHERE NOT contains(lower(title), 'list of')"
    ),
    "filter_existing_desc": statement(
        f"SELECT title, {first_case(existing_checks(P.DEFAULT))} AS reason FROM target_pages "
        "WHERE existing_type IS NOT NULL",
        _pages,
    ),
    "filter_redirects": statement(f"SELECT title FROM art WHERE {REDIRECT}"),
    "filter_require_infobox": statement(f"SELECT title FROM art WHERE {infobox('text', P.STRICT)}"),
    "filter_sole_infobox": statement(
        f"SELECT title FROM (SELECT title, {_more} AS more FROM art) WHERE {INFOBOXES.format(x='more')} <= 1"
    ),
    "check_page": _reason("target_pages", page_checks(P.DEFAULT), _pages),
    "check_page_strict": _reason("target_pages", page_checks(P.STRICT), _pages),
    "override_gate": statement(
        f"SELECT title, {override(JobConfig(override_manual=True))} AS manual_only, "
        f"{override(P.OVERRIDE)} AS either FROM target_pages",
        _pages,
    ),
    "desc_regex": _reason("target_pages", override_checks(_desc_cfg(existing_desc_regex="old"), "**** "), _pages),
    "desc_required_words": _reason(
        "target_pages",
        override_checks(_desc_cfg(existing_desc_required_words=("desc", "1")), "**** "),
        _pages,
    ),
    "desc_excluded_words": _reason(
        "target_pages",
        override_checks(_desc_cfg(existing_desc_excluded_words=("2", "Other")), "**** "),
        _pages,
    ),
    "filter_empty_lead": _reason("leads", lead_checks(P.DEFAULT)),
    "lead_required_words": _reason("leads", lead_checks(JobConfig(required_words=("is", "alga")))),
    "lead_excluded_words": _reason("leads", lead_checks(JobConfig(excluded_words=("genus", "rocks")))),
    "lead_some_words": _reason("leads", lead_checks(JobConfig(some_words=("alga", "moss")))),
    "lead_regex": _reason(
        "leads", lead_checks(JobConfig(text_regex_tf=True, text_regex=r"gen\d+ (is|was) an?"))
    ),
    "title_regex": _reason(
        "leads", lead_checks(JobConfig(title_regex_tf=True, title_regex=r"gen\d+ MINOR"))
    ),
    "check_criteria": _reason(
        "described", override_checks(_criteria, "**** ") + lead_checks(_criteria), chain(_criteria)
    ),
    "allow_bots": _on("art", allowed=allow_bots("text", "descbot")),
    "in_category": statement(
        f"SELECT t.title FROM {TARGETS} t WHERE EXISTS (SELECT 1 FROM cats c WHERE c.title = t.title "
        "AND NOT c.hidden AND contains(lower(c.category), 'genera'))"
    ),
    "is_monotypic_genus": _on("leads", monotypic=R.monotypic(compress("text"), "lead")),
    # ranks
    "rank_from_category": statement(
        f"SELECT t.title, {R.category_rank('coalesce(c.names, [])')} AS rank_category, "
        f"{R.category_extinct('coalesce(c.names, [])')} AS category_extinct "
        f"FROM {TARGETS} t LEFT JOIN categories c ON c.title = t.title",
        chain(P.DEFAULT),
    ),
    "rank_lead_tight": _on("leads", rank=R.lead_tight(SENTENCE)),
    "rank_lead_noun": _on("leads", rank=R.lead_noun(SENTENCE, "alga")),
    "rank_lead_loose": _on("leads", rank=R.lead_loose(SENTENCE)),
    "rank_from_lead": _on("leads", rank=R.lead_rank("lead", "alga")),
    "rank_from_speciesbox": _on(TC, rank=R.speciesbox("tc")),
    "rank_from_taxobox": _on(TC, rank=R.taxobox(f"({nobra('title')})", "tc")),
    "title_marker_rank": _on(TARGETS, rank=R.marker("title")),
    "shortdesc_end": _on(
        f"(SELECT title, {R.lead_rank('lead', 'alga')} AS rank FROM leads)",
        noun=R.noun("rank", "alga", "algae"),
    ),
    "draft_description": _on(
        f"(SELECT title, {R.lead_rank('lead', 'alga')} AS rank FROM leads)",
        draft=R.draft("rank", "alga", "algae"),
    ),
}

_default = chain(P.DEFAULT)
_trace = f"SELECT title, {', '.join(RANKS)}, array_to_string(modes, ',') AS modes, best_rank FROM voted"
_adjust = "SELECT title, {d} AS description FROM (SELECT *, {raw} AS raw FROM facts)"


def _adjusted(cfg: JobConfig) -> str:
    raw = R.draft("rank_category", cfg.name_singular, cfg.name_plural)
    desc = R.adjust("raw", "lead", "autobox_extinct", "category_extinct")
    return statement(_adjust.format(d=desc, raw=raw), _default)


ORACLES |= {
    "rank_trace": statement(_trace, _default),
    "rank_vote": statement(
        "SELECT title, array_to_string(modes, ',') AS modes, best_rank FROM voted", _default
    ),
    "rank_vote_relational": statement("SELECT title, rank, votes FROM mode_rows", _default),
    "best_rank_rules": statement(
        "SELECT title, CASE WHEN best_rank IS NOT NULL THEN settled_ok END AS ok, settled AS rank "
        "FROM ruled",
        _default,
    ),
    "conflict_rules": statement(
        "SELECT title, CASE WHEN best_rank IS NULL THEN conflict END AS rank, "
        "CASE WHEN best_rank IS NULL AND conflict IS NULL THEN error END AS error FROM ruled",
        _default,
    ),
    "adjust_desc": _adjusted(P.DEFAULT),
    "adjust_desc_long": _adjusted(P.LONG_NOUN),
    "generate_shortdesc": statement(
        "SELECT title, gen_ok AS ok, gen_msg AS message FROM generated", _default
    ),
}

# stage
_STAGED = "SELECT n, title, description, wikidata_sd, lead, ok, code FROM staged"
for _name, _cfg in {
    "stage_pipeline": P.DEFAULT,
    "stage_pipeline_override": P.OVERRIDE,
    "stage_pipeline_strict": P.STRICT,
    "stage_pipeline_words": P.WORDS,
    "stage_pipeline_limits": P.LIMITS,
    "limit_articles": P.MAX_ARTS,
    "limit_successes": P.MAX_STAGE,
    "range_endpoint": P.RANGE,
}.items():
    ORACLES[_name] = statement(_STAGED, chain(_cfg))

_HEADER = EXAMPLE_HEADER.format(bot="descbot")
ORACLES |= {
    "stage_pipeline_distinct": statement(
        "SELECT 2 * n - 1 + b AS n, title, description, wikidata_sd, lead, ok, code FROM staged, "
        "(VALUES (0), (1)) v(b)",
        _default,
    ),
    "stage_rows": statement("SELECT line FROM staged_lines", _default),
    "stage_summary": statement(
        run_summary(
            "stage",
            "SELECT count(*) FILTER (WHERE skip_reason IS NULL AND ok) AS s, "
            "count(*) FILTER (WHERE skip_reason IS NULL AND NOT ok) AS f, "
            "count(*) FILTER (WHERE skip_reason IS NOT NULL) AS k FROM verdicts",
        ),
        _default,
    ),
    "example_report": statement(
        f"SELECT {q(_HEADER)} || string_agg(concat('|-', chr(10), '| [[', title, ']] || ', description, "
        "' || ', wikidata_sd, ' || ', lead, chr(10)), '' ORDER BY seq) || '|}' AS report "
        f"FROM articles WHERE ok AND successes <= {P.LIMITS.max_examples + 1} "
        "AND seq <= (SELECT seq FROM stop)",
        chain(P.LIMITS),
    ),
    "running_article_no": statement("SELECT seq, n FROM articles", _default),
    "running_success_no": statement(
        "SELECT seq, CAST(successes AS BIGINT) AS success_no FROM articles WHERE ok", _default
    ),
    "range_startpoint": statement(
        f"SELECT seq, title FROM {TARGETS} WHERE seq >= (SELECT min(seq) FROM tgt "
        f"WHERE contains({clean_title('raw_title')}, 'Gen100'))"
    ),
}

# edit
_edits = edits(P.REPLACE)
_repeats, _repeat_tables = repeated_edits({"default": P.DEFAULT, "replace": P.REPLACE})
_all = {
    "every": "SELECT seq, CASE WHEN seq % 9 = 2 THEN lower(raw_title) ELSE raw_title END AS title, "
    "CASE WHEN seq % 23 = 7 THEN '*** : Genus of algae' ELSE 'Genus of algae' END AS description FROM tgt",
    **decisions("every", P.DEFAULT),
}
ORACLES |= {
    "edit_revalidate": statement(
        "SELECT seq, staged_title AS title, description, existing_desc, existing_type, reason FROM decided",
        {**chain(P.REPLACE), **decisions("reviewed", P.OVERRIDE)},
    ),
    "ok_to_edit": statement("SELECT seq, staged_title AS title, reason FROM decided", _all),
    "edit_pipeline": statement(
        "SELECT seq, title, description, action, status, reason, edit_summary FROM plan", _edits
    ),
    "edit_pipeline_repeats": statement(_repeats, {**_edits, **_repeat_tables}),
    "edit_plan": statement(
        "SELECT title, new_text, edit_summary FROM plan WHERE status = 'success'", _edits
    ),
    "edit_plan_long": statement(
        "SELECT title, new_text, edit_summary FROM plan WHERE status = 'success'", _edits
    ),
    "edit_log": statement(
        "SELECT seq, title, status, CASE WHEN status = 'success' THEN title || chr(9) || description "
        "ELSE title || chr(9) || ' FAILED: ' || description END AS line FROM plan WHERE status <> 'skipped'",
        _edits,
    ),
    "edit_summary": statement(
        run_summary(
            "edit",
            "SELECT count(*) FILTER (WHERE status = 'success') AS s, "
            "count(*) FILTER (WHERE status = 'error') AS f, "
            "count(*) FILTER (WHERE status = 'skipped') AS k FROM plan",
        ),
        _edits,
    ),
    "rewrite_add": _on("art", new_text=added("text", "'Genus of algae'")),
    "rewrite_replace": statement(
        f"SELECT a.title, {replaced('a.text', chr(39) + 'Genus of algae' + chr(39), 'p.shortdesc')} AS new_text "
        "FROM art a JOIN props p ON p.title = a.title"
    ),
    "edit_summary_text": statement(
        "SELECT title, "
        + summary_text("action", "existing_desc", "'Genus of algae'", BOT)
        + " AS by_bot, "
        + summary_text("action", "existing_desc", "'Genus of algae'", "")
        + f" AS by_person FROM (SELECT *, {ACTION} AS action FROM target_pages)",
        _pages,
    ),
}
