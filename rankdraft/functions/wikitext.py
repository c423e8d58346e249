"""Titles, templates, leads and page rewrites as column expressions.

The lead is cleaned in eight steps. Each step reads its input several times, so
``with_lead`` stacks one projection per step instead of nesting the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankdraft.functions.arrays import let, scan
from rankdraft.functions.pytext import SPACE, replace, replace_first, strip, word_count

MASK = "`"
LEAD_LENGTH = 150
MIN_SENTENCE = 26
# The clean-up patterns of the lead act on this many matches, not on all.
MATCH_LIMIT = 8
# Spans that are nested up to this depth are found by a pattern, deeper ones by a scan.
PATTERN_DEPTH = 6

HEADING = r"=+[^=\n].*=[ \t]*"
TRAILING_CATEGORIES = (
    r"(?i)\[\[\s*+category\s*+:[^\]\[]*+\]\]\s*+"
    r"(?:\[\[\s*+category\s*+:[^\]\[]*+\]\]\s*+)*+\z"
)
PIPED_LINK = r"\[[^\]\[|]*\|"
SELF_CLOSING_REF = rf"(?dU)<ref.{{1,40}}/{SPACE}{{0,3}}>"

# Removed from the lead in this order.
DELETED = ["`", "'''", "''", "[", "]", "{", "}", "__NOTOC__"]
# Replaced by one space, in this order, one pass each.
SPACED = ["\t", "\n", "  ", "&nbsp;"]
# Replaced last.
DASHES = {"&ndash;": "–", "&mdash;": "—"}

# Spellings of the template that holds a manual description.
SHORTDESC_OPENINGS = ["{{short description", "{{Short description"]


# ---------------------------------------------------------------- titles


def normalize_title(c: Column) -> Column:
    """Canonical page title: spaces for underscores, first letter upper case."""
    t = F.btrim(F.regexp_replace(c, "[ _]+", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def title_nobra(title: Column) -> Column:
    return strip(F.regexp_replace(title, r"(?d)\(.+?\)", ""))


def title_word_count(title: Column) -> Column:
    return word_count(title_nobra(title))


def clean_title(title: Column) -> Column:
    """Undo the doubled quotes of a raw TSV title."""
    single = replace(title, '""', '"')
    inner = F.substring(single, F.lit(2), F.length(single) - 2)
    return F.when(title.contains('""'), inner).otherwise(title)


def title_url(title: Column) -> Column:
    return replace(title, " ", "_")


# ---------------------------------------------------------------- page text


def compress_text(text: Column) -> Column:
    return replace(F.lower(text), " ", "")


def count_infoboxes(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)\{\{[^{}|]*infobox"))


def has_shortdesc_template(text: Column) -> Column:
    lower, upper = SHORTDESC_OPENINGS
    return text.contains(lower) | text.contains(upper)


def existing_shortdesc(shortdesc: Column, has_template: Column) -> tuple[Column, Column]:
    """(description, kind) of the page property; ``('', null)`` without one."""
    present = F.coalesce(shortdesc, F.lit("")) != ""
    kind = F.when(has_template, "manual").otherwise("embedded")
    return F.when(present, shortdesc).otherwise(""), F.when(present, kind)


# ---------------------------------------------------------------- lead


def lead_section(text: Column) -> Column:
    """Text before the first heading.

    On a page without headings the category links at the end are not part of it.
    Nearly always the first line that starts with "=" is a heading, which a plain
    search finds; only other pages are searched by a regex.
    """
    before = F.substring_index(text, "\n=", 1)
    line = F.substring_index(F.substr(text, F.length(before) + 2), "\n", 1)
    parts = F.split(text, f"(?md)^{HEADING}$", 2)
    whole = F.regexp_replace(text, TRAILING_CATEGORIES, "")
    searched = F.when(F.size(parts) > 1, parts[0]).otherwise(whole)
    return (
        F.when(text.startswith("="), searched)
        .when(~text.contains("\n="), whole)
        .when(F.rlike(line, F.lit(rf"(?d)\A{HEADING}\z")), F.concat(before, F.lit("\n")))
        .otherwise(searched)
    )


def _tokens(c: Column, opening: str, closing: str) -> Column:
    """Split before and after each bracket; the brackets are tokens of their own."""
    either = "[" + "".join("\\" + b if b in "[]" else b for b in (opening, closing)) + "]"
    return F.split(c, f"(?<={either})|(?={either})")


def _depths(tokens: Column, opening: str, closing: str) -> Column:
    """Open brackets before each token, and at last after all."""
    return scan(
        tokens,
        F.lit(0),
        lambda depth, t: depth + (t == opening).cast("int") - (t == closing).cast("int"),
    )


def _balanced(depths: Column) -> Column:
    return (F.array_min(depths) >= 0) & (F.element_at(depths, -1) == 0)


def _masked(token: Column) -> Column:
    return F.repeat(F.lit(MASK), F.length(token))


def _other(opening: str, closing: str) -> str:
    """Pattern of a character that is neither bracket."""
    return "[^" + "".join("\\" + b for b in (opening, closing)) + "]"


def _span(opening: str, closing: str, begin: str = "") -> str:
    """Pattern of a balanced span with spans up to ``PATTERN_DEPTH`` deep in it.

    Possessive throughout, so that it takes linear time and no stack for long spans.
    """
    other = _other(opening, closing)
    inside = f"{other}*+"
    for _ in range(PATTERN_DEPTH - 1):
        inside = rf"(?:{other}++|\{opening}{inside}\{closing})*+"
    return rf"\{opening}{begin}{inside}\{closing}"


def _uneven(c: Column, opening: str, closing: str) -> Column:
    """Whether there are more brackets of one kind, which never balance."""
    return F.length(replace(c, opening, "")) != F.length(replace(c, closing, ""))


def _shallow(c: Column, opening: str, closing: str) -> Column:
    """Whether the brackets balance, as spans that the pattern finds."""
    rest = F.regexp_replace(c, _span(opening, closing), "")
    return ~rest.contains(opening) & ~rest.contains(closing)


def _mask_found(c: Column, span: str, opening: str, closing: str) -> Column:
    """Overwrite the spans of a pattern; other brackets stay."""
    either = "".join("\\" + b for b in (opening, closing))
    parts = F.regexp_extract_all(c, F.lit(f"{span}|{_other(opening, closing)}++|[{either}]"), F.lit(0))
    spanned = lambda t: t.startswith(opening) & (F.length(t) > 1)
    return F.array_join(F.transform(parts, lambda t: F.when(spanned(t), _masked(t)).otherwise(t)), "")


def mask_balanced(c: Column, opening: str, closing: str) -> Column:
    """Overwrite every bracketed span by as many mask characters.

    Null when the brackets do not balance.
    """

    def masked(p: Column) -> Column:
        written = F.zip_with(
            p["tokens"],
            F.slice(p["depths"], F.lit(1), F.size(p["tokens"])),
            lambda t, depth: F.when((t == opening) | (t == closing) | (depth > 0), _masked(t))
            .otherwise(t),
        )
        return F.when(_balanced(p["depths"]), F.array_join(written, ""))

    parts = let(
        _tokens(c, opening, closing),
        lambda t: F.struct(t.alias("tokens"), _depths(t, opening, closing).alias("depths")),
    )
    return (
        F.when(~c.contains(opening) & ~c.contains(closing), c)
        .when(_uneven(c, opening, closing), F.lit(None))
        .when(
            _shallow(c, opening, closing),
            _mask_found(c, _span(opening, closing), opening, closing),
        )
        .otherwise(let(parts, masked))
    )


def bracket_pairs(c: Column, opening: str, closing: str) -> Column:
    """Array of (open_pos, close_pos) from 0, in closing order; null if unbalanced.

    Among the brackets of one level, opening and closing ones take turns. So with the
    brackets sorted by level and position, every two neighbours are a pair.
    """

    def pairs(p: Column) -> Column:
        tokens, depths, places = p["tokens"], p["depths"], p["places"]
        numbers = F.sequence(F.lit(0), F.size(tokens) - 1)
        bracket = lambda i: (tokens[i] == opening) | (tokens[i] == closing)
        level = lambda i: F.greatest(depths[i], depths[i + 1])
        levels = F.array_sort(
            F.transform(
                F.filter(numbers, bracket),
                lambda i: F.struct(level(i).alias("level"), places[i].alias("place")),
            )
        )
        return F.when(_balanced(depths), let(levels, in_closing_order))

    def in_closing_order(levels: Column) -> Column:
        half = F.size(levels) / 2
        found = F.transform(
            F.sequence(F.lit(0), half.cast("int") - 1),
            lambda i: F.struct(
                levels[2 * i + 1]["place"].alias("close_pos"),
                levels[2 * i]["place"].alias("open_pos"),
            ),
        )
        none = F.array().cast("array<struct<open_pos:int,close_pos:int>>")
        ordered = F.transform(
            F.array_sort(found),
            lambda x: F.struct(x["open_pos"].alias("open_pos"), x["close_pos"].alias("close_pos")),
        )
        return F.when(half > 0, ordered).otherwise(none)

    parts = let(
        _tokens(c, opening, closing),
        lambda t: F.struct(
            t.alias("tokens"),
            _depths(t, opening, closing).alias("depths"),
            scan(t, F.lit(0), lambda at, x: at + F.length(x)).alias("places"),
        ),
    )
    return let(parts, pairs)


def mask_templates(c: Column) -> Column:
    single = single_braces(c)
    return F.coalesce(mask_balanced(single, "{", "}"), single)


def single_braces(c: Column) -> Column:
    return replace(replace(c, "{{", "{"), "}}", "}")


def shorten_piped_links(c: Column) -> Column:
    return replace_first(c, PIPED_LINK, "[", MATCH_LIMIT)


def mask_images(c: Column) -> Column:
    """Mask ``[File:..]`` and ``[Image:..]`` spans, inner spans first.

    The name stands right behind the bracket, or for files one character later. Masks
    are as long as what they cover, so what counts is the outermost image that is open.
    """
    single = replace(replace(c, "[[", "["), "]]", "]")

    def image(token: Column) -> Column:
        return (
            token.startswith("File:")
            | (F.substring(token, 2, 5) == "File:")
            | token.startswith("Image:")
        )

    # Open brackets, and how many were open within the outermost image, 0 for none.
    def step(state: Column, x: Column) -> Column:
        opens, closes = x["token"] == "[", x["token"] == "]"
        depth, within = state["depth"], state["within"]
        return F.struct(
            (depth + opens.cast("int") - closes.cast("int")).alias("depth"),
            F.when(opens & x["image"] & (within == 0), depth + 1)
            .when(closes & (within == depth), F.lit(0))
            .otherwise(within)
            .alias("within"),
        )

    def masked(p: Column) -> Column:
        tokens, states = p["tokens"], p["states"]
        hidden = lambda i: (states[i]["within"] > 0) | (states[i + 1]["within"] > 0)
        written = F.transform(
            tokens, lambda x, i: F.when(hidden(i), _masked(x["token"])).otherwise(x["token"])
        )
        depths = F.transform(states, lambda s: s["depth"])
        return F.when(_balanced(depths), F.array_join(written, ""))

    named = let(
        _tokens(single, "[", "]"),
        lambda t: F.transform(
            t,
            lambda x, i: F.struct(
                x.alias("token"),
                F.coalesce(image(F.get(t, i + 1)), F.lit(False)).alias("image"),
            ),
        ),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("within"))
    parts = let(
        named, lambda t: F.struct(t.alias("tokens"), scan(t, start, step).alias("states"))
    )
    masked_text = let(parts, masked)
    # The look at six characters reaches past an empty pair into the text behind it.
    masked_text = F.when(
        single.contains("[]File:"), replace(masked_text, "[]", MASK * 2)
    ).otherwise(masked_text)
    image_span = _span("[", "]", begin=r"(?=[^\[\]]?File:|Image:)")
    return (
        F.when(~single.contains("File:") & ~single.contains("Image:"), single)
        .when(_uneven(single, "[", "]"), single)
        .when(
            ~single.contains("[]File:") & _shallow(single, "[", "]"),
            _mask_found(single, image_span, "[", "]"),
        )
        .otherwise(F.coalesce(masked_text, single))
    )


def drop_selfclosing_refs(c: Column) -> Column:
    return replace_first(c, SELF_CLOSING_REF, "", MATCH_LIMIT)


def mask_refs(c: Column) -> Column:
    """Mask reference bodies; ``!`` and ``~`` stand for the tags meanwhile.

    When the tags do not pair up, every such sign turns into a tag, prose included.
    """
    marked = replace(replace(replace(c, "<ref", "!"), "ref>", "~"), "ref >", "~")
    restored = replace(replace(marked, "!", "<ref"), "~", "ref>")
    return F.coalesce(mask_balanced(marked, "!", "~"), restored)


def clean_text(c: Column) -> Column:
    for part in DELETED:
        c = replace(c, part, "")
    for part in SPACED:
        c = replace(c, part, " ")
    for entity, dash in DASHES.items():
        c = replace(c, entity, dash)
    return c


def truncate_lead(c: Column) -> Column:
    return strip(F.substring(c, 1, LEAD_LENGTH))


LEAD_STEPS = (
    lead_section,
    mask_templates,
    shorten_piped_links,
    mask_images,
    drop_selfclosing_refs,
    mask_refs,
    clean_text,
    truncate_lead,
)


def with_lead(pages: DataFrame, text: str = "text", upto=truncate_lead) -> DataFrame:
    """Add ``lead``; ``upto`` stops after an earlier step."""
    out = pages.withColumn("lead", F.col(text))
    for step in LEAD_STEPS:
        out = out.withColumn("lead", step(F.col("lead")))
        if step is upto:
            return out
    raise ValueError(f"{upto} is not a lead step")


def first_sentence(lead: Column) -> Column:
    """The first sentence, unless it is unreasonably short."""
    sentence = F.substring_index(lead, ".", 1)
    return F.when(F.length(sentence) > MIN_SENTENCE, sentence).otherwise(lead)


# ---------------------------------------------------------------- rewrites


def shortdesc_template(description: Column, name: str = "Short") -> Column:
    return F.concat(F.lit("{{" + name + " description|"), description, F.lit("}}"))


def rewrite_add(text: Column, description: Column) -> Column:
    return F.concat(shortdesc_template(description), F.lit("\n"), text)


def cut_shortdesc(text: Column, existing: Column) -> Column:
    """The text without the manual template, where that stands at the end of a line."""
    for name in ("Short", "short"):
        template = F.concat(shortdesc_template(existing, name), F.lit("\n"))
        text = F.replace(text, template, F.lit(""))
    return text


def after_openings(text: Column, longest: int) -> Column:
    """Up to ``longest`` characters behind each opening of a manual template."""
    pattern = rf"(?s)\{{\{{[Ss]hort description\|(?=(.{{0,{longest}}}))"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(names_shortdesc(text), found)


def shortdesc_lines(text: Column, longest: int) -> Column:
    """Distinct descriptions of up to ``longest`` characters that ``cut_shortdesc`` finds:
    all that stand between an opening and the end of its line."""
    opening = r"\{\{[Ss]hort description\|"
    pattern = rf"{opening}(?=([^\n]{{0,{longest}}})\}}\}}\n)"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def names_shortdesc(text: Column) -> Column:
    """Whether a text may hold an opening of the template, also after other text was cut."""
    return text.contains("hort description|")


def without_shortdesc(text: Column, existing: Column) -> Column:
    """As ``cut_shortdesc``; null when the page does not hold the template."""
    first, second = (shortdesc_template(existing, name) for name in ("Short", "short"))
    held = text.contains(first) | text.contains(second)
    return F.when(held, cut_shortdesc(text, existing))


def rewrite_replace(text: Column, description: Column, existing: Column) -> Column:
    """Swap the manual template; null when the page does not hold it."""
    return rewrite_add(without_shortdesc(text, existing), description)
