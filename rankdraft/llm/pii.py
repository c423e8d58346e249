"""Personal data by patterns, checksums and context, in DataFrame functions only.

Patterns propose spans. Checksums confirm them: Luhn for card numbers, modulo 97 for
international bank account numbers; octets and digit counts are checked as well. Words
next to a span that speak of its kind raise its score, a plain number without any keeps
the low one of its kind.

The base patterns are those of the contract, written so that no text makes them search
twice: a match can only begin where a run begins or the match before ended, and what a
loop has taken it keeps. Account numbers may be grouped by spaces, so that only their
length tells them from the words behind. They are proposed at every start that looks
like one, and looked for in the at most 30 characters that can follow.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankdraft.functions.arrays import let, scan
from rankdraft.llm.common import free_name, texts

LOCAL = "A-Za-z0-9._%+-"
LABEL = "[A-Za-z0-9-]++"
# Code points on each side of a span in which its context is looked for.
CONTEXT = 40
CONTEXT_BONUS = 0.3
CONFIDENT = 0.6


@dataclass(frozen=True)
class Kind:
    """A pattern, its confirmation, what must occur for it to match at all, the score
    of a confirmed span without context, and words that raise it."""

    name: str
    pattern: str
    needs: str
    score: float
    context: tuple[str, ...]

    def confirmed(self, found: Column) -> Column:
        return CHECKS[self.name](found)


EMAIL = Kind(
    "email",
    rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@{LABEL}(?:\.{LABEL})++",
    "@",
    0.9,
    ("mail", "contact", "write"),
)
IP = Kind(
    "ip",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    ".",
    0.5,
    ("ip", "address", "host", "server"),
)
CARD = Kind(
    "card",
    r"[0-9](?:[\x20-]?+[0-9])++",
    "",
    0.5,
    ("card", "credit", "visa", "payment"),
)
PHONE = Kind(
    "phone",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    "+",
    0.6,
    ("phone", "tel", "call", "mobile", "fax"),
)
# Takes the first four characters only; what can follow them is group 1, the context
# behind that group 2.
IBAN = Kind(
    "iban",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])"
    rf"((?s:.{{0,{CONTEXT}}})))",
    "",
    0.8,
    ("iban", "account", "bank"),
)
# The length of an account number by country, from the IBAN registry.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO",
        16: "BE",
        18: "DK FK FO FI GL NL SD",
        19: "MK SI",
        20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST",
        26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA",
        30: "JO KW MU YE",
        31: "MT SC",
        32: "LC",
        33: "RU",
    }.items()
    for country in countries.split()
}
# The value behind a key word and = or :, without quotes. What it must look like is
# asked first, so that few places are searched for the word before them.
SECRET = Kind(
    "secret",
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})"
    r"(?<=(?i:token|secret|passw(?:or)?d|key)[\x22']?\x20{0,2}[:=]\x20{0,2}[\x22']?)"
    r"[A-Za-z0-9+/_-]++",
    "",
    0.9,
    ("token", "secret", "password", "key"),
)
# A secret has at least so many different characters, digits and letters among them.
DIFFERENT = 10
BASE = (EMAIL, IP, CARD, PHONE)
KINDS = (*BASE, IBAN, SECRET)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _octets(c: Column) -> Column:
    # Without leading zeros a part of more than three digits is too large.
    parts = F.transform(F.split(c, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def _luhn(c: Column) -> Column:
    number = digits(c)
    n = F.length(number)
    return F.when((n >= 14) & (n <= 19), F.call_function("luhn_check", number)).otherwise(False)


def _phone_digits(c: Column) -> Column:
    return F.length(digits(c)).between(10, 15)


def _random(c: Column) -> Column:
    different = F.size(F.array_distinct(F.split(c, ""))) >= DIFFERENT
    return different & c.rlike("[0-9]") & c.rlike("[A-Za-z]")


def _mod97(plain: Column) -> Column:
    """Modulo 97 of country and check digits moved to the end, A as 10 up to Z as 35."""
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest: Column, character: Column) -> Column:
        code = F.ascii(character)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise(
            (rest * 100 + code - 55) % 97
        )

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _account_size(head: Column, tail: Column) -> Column:
    """How many code points an account number takes; null if there is none.

    It ends where a group of the tail ends. Its country fixes its length; that of a
    country that is not in the registry is the longest one that modulo 97 confirms.
    """
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    asked = F.try_element_at(lengths, F.left(head, F.lit(2)))
    fits = lambda n: F.coalesce(n == asked, n.between(15, 34))

    def confirmed(end: Column) -> Column:
        plain = F.concat(head, F.replace(F.left(tail, end), F.lit(" "), F.lit("")))
        return let(plain, lambda p: F.when(fits(F.length(p)), _mod97(p)).otherwise(False))

    ends = F.filter(
        F.sequence(F.lit(1), F.length(tail)),
        lambda e: F.substr(tail, e + 1, F.lit(1)).isin("", " ") & confirmed(e),
    )
    return F.length(head) + F.array_max(ends)


CHECKS = {
    "email": lambda c: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": _phone_digits,
    "secret": _random,
}


SPAN = "struct<start:int,kind:int,end:int,score:double>"


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind in order: start, end (exclusive) in code points.

    Texts are split at the proposals, and the lengths of the parts added up. The context
    of a proposal reaches up to its neighbours of the same kind.
    """
    number = KINDS.index(kind)
    parts = F.struct(
        F.split(text, kind.pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"),
    )

    def located(p: Column) -> Column:
        found, between = p["found"], p["between"]
        steps = F.zip_with(
            F.slice(between, F.lit(1), F.size(found)),
            found,
            lambda b, f: F.struct(F.length(b).alias("gap"), F.length(f).alias("size")),
        )
        return F.filter(
            F.transform(
                _starts(steps),
                lambda start, i: F.when(
                    kind.confirmed(found[i]),
                    F.struct(
                        start.alias("start"),
                        F.lit(number).alias("kind"),
                        (start + F.length(found[i])).alias("end"),
                        _score(kind, between[i], between[i + 1]).alias("score"),
                    ),
                ),
            ),
            lambda s: s.isNotNull(),
        )

    none = F.array().cast(f"array<{SPAN}>")
    if kind is SECRET:
        words = [w for word in kind.context for w in (word, word.upper(), word.title())]
        possible = reduce(lambda a, b: a | b, (text.contains(w) for w in words))
    else:
        possible = text.contains(kind.needs) if kind.needs else text.rlike("[0-9]")
    return F.when(possible, let(parts, located)).otherwise(none)


def accounts_of(text: Column) -> Column:
    """Confirmed account numbers, in order; one that begins inside another is left out."""
    group = lambda n: F.regexp_extract_all(text, F.lit(IBAN.pattern), F.lit(n))
    parts = F.struct(
        F.split(text, IBAN.pattern, -1).alias("between"),
        group(0).alias("heads"),
        group(1).alias("tails"),
        group(2).alias("after"),
    )

    def span(p: Column, start: Column, i: Column) -> Column:
        head, tail = p["heads"][i], p["tails"][i]

        def sized(size: Column) -> Column:
            after = F.concat(F.substr(tail, size - F.length(head) + 1), p["after"][i])
            return F.when(
                size.isNotNull(),
                F.struct(
                    start.alias("start"),
                    F.lit(KINDS.index(IBAN)).alias("kind"),
                    (start + size).alias("end"),
                    _score(IBAN, p["between"][i], after).alias("score"),
                ),
            )

        return let(_account_size(head, tail), sized)

    def located(p: Column) -> Column:
        steps = F.zip_with(
            F.slice(p["between"], F.lit(1), F.size(p["heads"])),
            p["heads"],
            lambda b, h: F.struct(F.length(b).alias("gap"), F.length(h).alias("size")),
        )
        spans = F.transform(_starts(steps), lambda start, i: span(p, start, i))
        return let(F.filter(spans, lambda s: s.isNotNull()), apart)

    def apart(spans: Column) -> Column:
        # Where the last one that was kept ends, before each of them.
        ends = scan(
            spans,
            F.lit(0),
            lambda end, s: F.when(s["start"] >= end, s["end"]).otherwise(end),
        )
        return let(ends, lambda e: F.filter(spans, lambda s, i: s["start"] >= e[i]))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(IBAN.pattern), let(parts, located)).otherwise(none)


def _starts(steps: Column) -> Column:
    """Where each proposal begins, from (gap before, size)."""
    ends = scan(steps, F.lit(0), lambda at, x: at + x["gap"] + x["size"])
    return let(ends, lambda e: F.transform(steps, lambda x, i: e[i] + x["gap"]))


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat_ws(" ", F.right(before, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT))))
    spoken = near.rlike(r"\b(?:" + "|".join(kind.context) + ")")
    return F.lit(kind.score) + F.when(spoken, CONTEXT_BONUS * (1 - kind.score)).otherwise(0.0)


def with_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Add all spans by start, then kind; a null text has none."""
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = (spans_of(whole, kind) for kind in (*BASE, SECRET))
    found = F.array_sort(F.concat(*plain, accounts_of(whole)))
    return docs.withColumn(into, found)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(kind.name) for kind in KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])
        ),
        ",",
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each kind, base_sha256, spans, n_confident for each row.

    A null text counts as empty. ``base_sha256`` covers the four base kinds, ``spans``
    all; spans of different kinds may overlap. ``n_confident`` counts the spans whose
    score, with context, is 0.6 or more.
    """
    rows = with_spans(texts(docs))
    count = lambda kind: F.size(
        F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))
    ).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return rows.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind.name}") for kind in KINDS),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["score"] >= CONFIDENT))
        .cast("long")
        .alias("n_confident"),
    )


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets.

    Overlapping spans become one, named by the first. ``n_chars`` follows the text, if
    there is one. A null text stays null.
    """
    spans = free_name(docs, "_spans")
    rows = with_spans(docs, "text", into=spans)
    changed = F.size(spans) > 0
    masked = _masked(F.col("text"), F.col(spans))
    rows = rows.withColumn("text", F.when(changed, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn(
            "n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return rows.select(*docs.columns)


def _masked(text: Column, spans: Column) -> Column:
    masks = F.array(*(F.lit(f"<{kind.name}>") for kind in KINDS))
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    part = lambda chars, a, b: F.array_join(F.slice(chars, a + 1, b - a), "")

    def written(p: Column) -> Column:
        chars, before = p["chars"], p["before"]
        pieces = F.transform(
            spans,
            lambda s, i: F.when(
                s["start"] >= before[i],
                F.concat(part(chars, before[i], s["start"]), masks[s["kind"]]),
            ).otherwise(""),
        )
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), part(chars, last, F.size(chars)))

    # How far the spans before each one reach.
    before = scan(spans, F.lit(0), lambda end, s: F.greatest(end, s["end"]))
    return let(F.struct(characters.alias("chars"), before.alias("before")), written)
