import random
import re
import time

import pytest
from pyspark.sql import functions as F

from rankdraft.functions import wikitext as W


def texts(alphabet, n=500, longest=24, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, longest))) for _ in range(n)]


def spans(text, opening, closing):
    """Matching bracket positions in closing order, None when unbalanced."""
    waiting, found = [], []
    for place, sign in enumerate(text):
        if sign == opening:
            waiting.append(place)
        elif sign == closing:
            if not waiting:
                return None
            found.append((waiting.pop(), place))
    return None if waiting else found


def masked(text, opening, closing, wanted=lambda text, start: True):
    """Brute force: overwrite each wanted span, and every equal string, in turn."""
    found = spans(text, opening, closing)
    for start, end in found or []:
        if wanted(text, start):
            text = text.replace(text[start : end + 1], "`" * (end - start + 1))
    return text if found is not None else None


def is_image(text, start):
    head = text[start + 1 : start + 7]
    return "File:" in head or "Image:" in head


def test_mask_balanced_equals_brute_force(apply):
    values = texts(["{", "}", "a", "b\n", "é", "𝕏"])
    got = apply(lambda c: W.mask_balanced(c, "{", "}"), values)
    assert got == [masked(v, "{", "}") for v in values]


def test_mask_templates_keeps_single_braces_when_unbalanced(apply):
    values = ["{{a T", "{{a}} T", "x {{a|{{b}}}} y", "{| t |}", "}}{{", ""]
    expected = ["{a T", "``` T", "x ``````` y", "```````", "}{", ""]
    assert apply(W.mask_templates, values) == expected


def test_mask_images_equals_brute_force(apply):
    values = texts(["[", "]", "File:", "Image:", "a", "`", "]File:", "[["], n=3000)

    def expected(text):
        single = text.replace("[[", "[").replace("]]", "]")
        out = masked(single, "[", "]", is_image)
        return single if out is None else out

    assert apply(W.mask_images, values) == [expected(v) for v in values]


def test_mask_refs_equals_brute_force(apply):
    values = texts(["<ref", "ref>", "ref >", "</ref>", ">", "!", "~", "a", " name=x"], n=1500)

    def expected(text):
        marked = text.replace("<ref", "!").replace("ref>", "~").replace("ref >", "~")
        out = masked(marked, "!", "~")
        return marked.replace("!", "<ref").replace("~", "ref>") if out is None else out

    assert apply(W.mask_refs, values) == [expected(v) for v in values]


def test_selfclosing_refs_first_eight(apply):
    values = texts(["<ref", "/", ">", " ", "\xa0", "a", "\n", "x" * 20], longest=50)
    pattern = r"<ref.{1,40}/\s{0,3}>"
    assert apply(W.drop_selfclosing_refs, values) == [
        re.sub(pattern, "", v, count=8) for v in values
    ]


def test_nine_piped_links(apply):
    assert apply(W.shorten_piped_links, ["[[A|b]]" * 9]) == ["[[b]]" * 8 + "[[A|b]]"]


def test_clean_text_order(apply):
    values = ["a'''b''c", "a    b", "&nbsp;&ndash;&mdash;", "x\t\n y", "'[]'", "`'`'", "__NOTOC__[x]"]
    assert apply(W.clean_text, values) == ["abc", "a  b", " –—", "x  y", "''", "", "x"]


LEADS = {
    "[[File:x|thumb|cap]] T": "thumb|cap T",
    "{{a T": "a T",
    "Wow! T<ref>x</ref>": "Wow<ref T<ref>x</ref>",
    "T<ref>x</ref> y": "T y",
    "'''A''' is [[b|c]].\n== H ==\nrest": "A is c.",
    "== H ==\nrest": "",
    "A\n[[Category:X]]\n[[Category:Y]]": "A",
    "A\n[[Category:X]]\n== H ==": "A Category:X",
    "A\n=not a heading\nB\n===H===\nC": "A =not a heading B",
    "": "",
    "x" * 200: "x" * 150,
}


def test_leads(spark):
    pages = spark.createDataFrame(list(LEADS.items()), "text string, expected string")
    rows = W.with_lead(pages).collect()
    assert {r["text"]: r["lead"] for r in rows} == LEADS


def test_lead_section_equals_heading_search(apply):
    values = texts(["=", "a", "\n", " ", "[[Category:x]]"], n=1500, longest=20)

    def expected(text):
        heading = re.search(r"(?m)^=+[^=\n].*=[ \t]*$", text)
        if heading:
            return text[: heading.start()]
        return re.sub(r"(\[\[Category:x\]\]\s*)+\Z", "", text)

    assert apply(W.lead_section, values) == [expected(v) for v in values]


def test_bracket_pairs(apply):
    values = texts(["{", "}", "a"], n=400)
    got = apply(lambda c: W.bracket_pairs(c, "{", "}"), values)
    assert [None if g is None else [tuple(p) for p in g] for g in got] == [
        spans(v, "{", "}") for v in values
    ]


def test_titles(apply):
    assert apply(W.title_nobra, ["A (b) c (d)", "(x)", "A ()", " A "]) == ["A  c", "", "A ()", "A"]
    assert apply(W.title_word_count, ["A (b)", "A b", "(x)", ""]) == [1, 2, 0, 0]
    assert apply(W.clean_title, ['"A ""b"""', "A", '""', '"a"']) == ['A "b"', "A", "", '"a"']
    assert apply(W.normalize_title, ["a__b ", "A b", "", "éa"]) == ["A b", "A b", "", "Éa"]
    assert apply(W.title_url, ["A b c"]) == ["A_b_c"]


@pytest.mark.parametrize(
    "shortdesc, template, expected",
    [
        (None, True, ("", None)),
        ("", True, ("", None)),
        ("d", True, ("d", "manual")),
        ("d", False, ("d", "embedded")),
    ],
)
def test_existing_shortdesc(spark, shortdesc, template, expected):
    row = spark.createDataFrame([(shortdesc, template)], "s string, t boolean")
    desc, kind = W.existing_shortdesc(F.col("s"), F.col("t"))
    assert tuple(row.select(desc, kind).first()) == expected


def test_infoboxes_and_first_sentence(apply):
    assert apply(W.count_infoboxes, ["{{Infobox a}} {{Taxobox}} {{my infobox|x}}", "infobox"]) == [2, 0]
    values = ["A. b", "A long enough first sentence x. rest", ""]
    assert apply(W.first_sentence, values) == ["A. b", "A long enough first sentence x", ""]


def test_rewrites(spark):
    rows = spark.createDataFrame(
        [
            ("{{Short description|E}}\nT", "E"),
            ("{{short description|E}}T", "E"),
            ("{{Short description|X}}\nT", "E"),
        ],
        "text string, old string",
    )
    got = rows.select(W.rewrite_replace(F.col("text"), F.lit("N"), F.col("old")).alias("t"))
    assert [r["t"] for r in got.collect()] == [
        "{{Short description|N}}\nT",
        "{{Short description|N}}\n{{short description|E}}T",
        None,
    ]


# ---------------------------------------------------------------- against a plain stack


def _plain_mask(text, opening, closing):
    depth, out = 0, []
    for c in text:
        depth -= c == closing
        if depth < 0:
            return None
        out.append(W.MASK if depth or c in (opening, closing) else c)
        depth += c == opening
    return None if depth else "".join(out)


def _plain_pairs(text):
    stack, pairs = [], []
    for i, c in enumerate(text):
        if c == "{":
            stack.append(i)
        elif c == "}":
            if not stack:
                return None
            pairs.append((stack.pop(), i))
    return None if stack else pairs


def _plain_images(text):
    single = text.replace("[[", "[").replace("]]", "]")
    stack = [""]
    for c in single:
        if c == "[":
            stack.append("")
        elif c == "]":
            if len(stack) == 1:
                return single
            top = stack.pop()
            image = "File:" in top[:6] or "Image:" in top[:6]
            stack[-1] += W.MASK * (len(top) + 2) if image else f"[{top}]"
        else:
            stack[-1] += c
    if len(stack) > 1:
        return single
    return stack[0].replace("[]", W.MASK * 2) if "[]File:" in single else stack[0]


def _bracket_texts(parts, n, seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(n)]
    # Balanced texts, which chance alone makes too seldom.
    for _ in range(n):
        text = ""
        for _ in range(draw.randrange(12)):
            a, b = draw.choice([(0, 1), (0, 1), (2, 2)])
            inner = draw.choice(parts[2:])
            text = draw.choice([parts[a] + inner + text + parts[b], text + inner])
        texts.append(text * draw.choice([1, 1, 5, 40]))
    return texts


def test_masks_and_pairs_are_those_of_a_stack(apply):
    texts = _bracket_texts(["{", "}", "ab", "é🙂", " ", "\n"], 150, 1)
    got = apply(lambda c: W.mask_balanced(c, "{", "}"), texts)
    assert got == [_plain_mask(t, "{", "}") for t in texts]
    pairs = apply(lambda c: W.bracket_pairs(c, "{", "}"), texts)
    assert [p and [tuple(x) for x in p] for p in pairs] == [_plain_pairs(t) for t in texts]


def test_images_are_those_of_a_stack(apply):
    parts = ["[", "]", "File:x", ":File:", "Image:a|b", "aImage:", "text", "é", "[[File:q", "]]"]
    texts = _bracket_texts(parts, 200, 2)
    assert apply(W.mask_images, texts) == [_plain_images(t) for t in texts]


def test_long_leads_take_time_in_proportion(spark):
    def seconds(lines):
        text = "A line with [[a link|link]] and {{a|template}} and some more words in it.\n"
        frame = spark.createDataFrame([(text * lines,)], "text string")
        start = time.perf_counter()
        W.with_lead(frame).collect()
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(16_000) < 2.5 * seconds(8_000) + 0.5


def test_shallow_spans_are_found_without_a_scan(spark):
    def seconds(depth):
        span = "{a" * depth + "}" * depth
        frame = spark.createDataFrame([(span * (120_000 // depth) + " end",)] * 8, "text string")
        start = time.perf_counter()
        (end,) = {r[0][-5:] for r in frame.select(W.mask_balanced(F.col("text"), "{", "}")).collect()}
        assert end == "` end"
        return time.perf_counter() - start

    seconds(W.PATTERN_DEPTH)
    assert 1.5 * seconds(W.PATTERN_DEPTH) < seconds(W.PATTERN_DEPTH + 2)
