"""SQL fragments for text: white space, masks, the lead and page facts."""

from __future__ import annotations

# White space as Python sees it, as a regex class and as characters.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_WS_CODES = [
    *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WS_CHARS = "concat(" + ", ".join(f"chr({c})" for c in _WS_CODES) + ")"
TICK = "chr(96)"


def q(text: str) -> str:
    """SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def contains_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def first_case(pairs, otherwise: str = "NULL") -> str:
    """CASE with one branch per (condition, value expression)."""
    whens = " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs)
    return f"CASE {whens} ELSE {otherwise} END" if whens else otherwise


def nobra(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\([^\\n]+?\\)', '', 'g')")


def words(x: str) -> str:
    spaced = f"string_split_regex({x}, {q(WS + '+')})"
    return f"CAST(len(list_filter({spaced}, lambda w: w <> '')) AS BIGINT)"


def clean_title(x: str) -> str:
    r = f"replace({x}, '\"\"', '\"')"
    return f"CASE WHEN contains({x}, '\"\"') THEN substr({r}, 2, length({r}) - 2) ELSE {x} END"


def compress(x: str) -> str:
    return f"replace(lower({x}), ' ', '')"


def find_between(x: str, start: str, end: str) -> str:
    part = f"string_split(string_split({x}, {q(start)})[2], {q(end)})[1]"
    return strip(part)


def tokens(x: str, marks: str) -> str:
    """The marks of a text and what stands between them, in order."""
    return f"regexp_extract_all({x}, {q('[' + marks + ']|[^' + marks + ']+')})"


def fold_mask(x: str, op: str, cl: str) -> str:
    """Every bracketed character as a backtick; null when unbalanced."""
    step = (
        "{'d': a.d + CASE WHEN t = " + q(op) + " THEN 1 WHEN t = " + q(cl) + " THEN -1 ELSE 0 END, "
        "'ok': a.ok AND NOT (t = " + q(cl) + " AND a.d = 0), "
        f"'o': a.o || CASE WHEN t = {q(op)} OR t = {q(cl)} OR a.d > 0 "
        f"THEN repeat({TICK}, CAST(length(t) AS BIGINT)) ELSE t END}}"
    )
    fold = (
        f"list_reduce({tokens(x, op + cl)}, lambda a, t: {step}, "
        "{'d': 0, 'ok': true, 'o': ''})"
    )
    return (
        f"CASE WHEN {x} = '' THEN '' ELSE (SELECT CASE WHEN f.ok AND f.d = 0 THEN f.o END "
        f"FROM (SELECT {fold} AS f)) END"
    )


def fold_images(x: str) -> str:
    """Image spans as backticks over a stack of open brackets; null when unbalanced."""
    top, below = "a.s[-1]", "a.s[-2]"
    head = f"substr({top}, 1, 6)"
    span = (
        f"CASE WHEN contains({head}, 'File:') OR contains({head}, 'Image:') "
        f"THEN repeat({TICK}, CAST(length({top}) + 2 AS BIGINT)) ELSE '[' || {top} || ']' END"
    )
    step = (
        "{'ok': a.ok AND NOT (t = ']' AND len(a.s) = 1), 's': "
        "CASE WHEN t = '[' THEN list_append(a.s, '') "
        f"WHEN t = ']' AND len(a.s) > 1 THEN list_append(a.s[1:len(a.s) - 2], {below} || {span}) "
        f"ELSE list_append(a.s[1:len(a.s) - 1], {top} || t) END}}"
    )
    marks = tokens(x, "\\[\\]")
    fold = f"list_reduce({marks}, lambda a, t: {step}, {{'ok': true, 's': ['']}})"
    return (
        f"CASE WHEN {x} = '' THEN '' ELSE (SELECT CASE WHEN f.ok AND len(f.s) = 1 THEN "
        f"CASE WHEN contains({x}, '[]File:') THEN replace(f.s[1], '[]', repeat({TICK}, 2)) "
        f"ELSE f.s[1] END END FROM (SELECT {fold} AS f)) END"
    )


def first_eight(x: str, pattern: str, new: str) -> str:
    """Eight single replacements through a sign that the pattern does not match."""
    for _ in range(8):
        x = f"regexp_replace({x}, {q(pattern)}, chr(1))"
    return f"replace({x}, chr(1), {q(new)})"


def clean_text(x: str) -> str:
    for part in ["`", "'''", "''", "[", "]", "{", "}", "__NOTOC__"]:
        x = f"replace({x}, {q(part)}, '')"
    for part in ["chr(9)", "chr(10)", "'  '", "'&nbsp;'"]:
        x = f"replace({x}, {part}, ' ')"
    return f"replace(replace({x}, '&ndash;', '–'), '&mdash;', '—')"


_HEADING = r"(?m)^=+[^=\n][^\n]*=[ \t]*$"
_CATEGORIES = r"(\[\[\s*[Cc]ategory\s*:[^\]\[]*\]\]\s*)+$"

# Each step of the lead as a table (title, text, x) on top of the one before.
LEAD_CTES = {
    "lead_section": f"""
        SELECT title, text, CASE WHEN h <> ''
            THEN substr(text, 1, strpos(chr(10) || text, chr(10) || h) - 1)
            ELSE regexp_replace(text, {q(_CATEGORIES)}, '') END AS x
        FROM (SELECT title, text, regexp_extract(text, {q(_HEADING)}) AS h FROM art)""",
    "lead_braces": "SELECT title, text, replace(replace(x, '{{', '{'), '}}', '}') AS x "
    "FROM lead_section",
    "mask_templates": f"SELECT title, text, coalesce({fold_mask('x', '{', '}')}, x) AS x "
    "FROM lead_braces",
    "shorten_piped_links": "SELECT title, text, "
    + first_eight("x", r"\[[^\]\[|\x01]*\|", "[")
    + " AS x FROM mask_templates",
    "lead_brackets": "SELECT title, text, replace(replace(x, '[[', '['), ']]', ']') AS x "
    "FROM shorten_piped_links",
    "mask_images": f"SELECT title, text, coalesce({fold_images('x')}, x) AS x FROM lead_brackets",
    "drop_selfclosing_refs": "SELECT title, text, "
    + first_eight("x", rf"<ref[^\n\x01]{{1,40}}/{WS}{{0,3}}>", "")
    + " AS x FROM mask_images",
    "lead_signs": "SELECT title, text, "
    "replace(replace(replace(x, '<ref', '!'), 'ref>', '~'), 'ref >', '~') AS x "
    "FROM drop_selfclosing_refs",
    "mask_refs": f"SELECT title, text, coalesce({fold_mask('x', '!', '~')}, "
    "replace(replace(x, '!', '<ref'), '~', 'ref>')) AS x FROM lead_signs",
    "clean_text": f"SELECT title, text, {clean_text('x')} AS x FROM mask_refs",
    "leads": f"SELECT title, text, {strip('substr(x, 1, 150)')} AS lead FROM clean_text",
}


def allow_bots(x: str, user: str) -> str:
    """Decision of the first bots template, parameter by parameter."""
    pattern = q(r"\{\{\s*([Bb]ots|[Nn]obots)\s*((\|[^{}]*)?)\}\}")
    params = f"string_split(regexp_extract({x}, {pattern}, 2), '|')"
    names = "list_transform(string_split(split_part(p, '=', 2), ','), lambda b: trim(lower(b)))"
    who = f"list_has_any({names}, [{q(user)}, 'all'])"
    none = f"array_to_string({names}, '') = 'none'"
    key = "split_part(p, '=', 1)"
    verdict = first_case(
        [
            (f"{key} = 'allow' AND {none}", "'no'"),
            (f"{key} = 'allow' AND {who}", "'yes'"),
            (f"{key} = 'deny' AND {none}", "'yes'"),
            (f"{key} = 'deny' AND {who}", "'no'"),
        ],
        "''",
    )
    decided = f"list_filter(list_transform({params}, lambda p: {verdict}), lambda v: v <> '')"
    bare = (
        f"(lower(regexp_extract({x}, {pattern}, 1)) = 'nobots' "
        f"AND regexp_extract({x}, {pattern}, 2) = '')"
    )
    return f"CASE WHEN len({decided}) > 0 THEN {decided}[1] = 'yes' ELSE NOT {bare} END"
