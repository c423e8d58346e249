"""Personal data and benchmark contamination against brute force."""

import hashlib
import random
import re
import time

import pytest

from rankdraft.llm import decontamination, near_duplicates, pii

# ---------------------------------------------------------------- personal data

# The base patterns of the contract.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NAMES = list(PATTERNS)
PARTS = [
    "a", "b.", "@", "c.d", "1", "22", ".", " ", "-", "+", "(", "4111 1111 1111 1111", "_", "%",
    "+1 389 555-5010", "x@y.zz", "1.2.3.4", "é", "🙂", "\n", "000", "999", "GB82WEST12345698765432",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [
        (m.start(), n, m.end())
        for n, kind in enumerate(NAMES)
        for m in re.finditer(PATTERNS[kind], text or "")
        if confirmed(kind, m[0])
    ]
    return sorted(found)


def some_texts():
    draw = random.Random(5)
    made = ["".join(draw.choices(PARTS, k=draw.randint(0, 30))) for _ in range(600)]
    odd = [None, "", "1.2.3.4 " * 300, "a@b.c_d@e.f", "a" * 100_000, "1" * 100_000]
    return made + odd + ["+" + "1 " * 20_000, "1.1." * 1500, "x@y.zz " * 700]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(some_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)


def test_base_spans_are_those_of_the_patterns(docs):
    texts = some_texts()
    for row in pii.find_personal_data(docs).collect():
        expected = base_spans(texts[row.doc_id])
        written = ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in expected)
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), texts[row.doc_id]
        counts = [sum(k == n for _, k, _ in expected) for n in range(4)]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        base = [s for s in row.spans.split(",") if s and not s.startswith("iban")]
        assert ",".join(base) == written


def test_checksums_and_context(spark):
    rows = [
        (1, "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33"),
        (2, "server 10.0.0.1 of version 10.0.0.1.2 or 256.1.1.1 and 010.000.0.255"),
        (3, "10.0.0.1"),
    ]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.with_spans(found).collect()}
    iban = [s for s in spans[1] if pii.KINDS[s.kind].name == "iban"]
    assert [(s.start, s.end) for s in iban] == [(5, 32)] and iban[0].score > 0.8
    assert [rows[1][1][s.start : s.end] for s in spans[2]] == [
        "10.0.0.1", "10.0.0.1", "010.000.0.255",
    ]
    assert spans[2][0].score > spans[3][0].score == 0.5


ACCOUNTS = [
    "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32",
    "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "XX57 1234 5678 9012 345",
]
BEHIND = ["", " Please pay", " Bank", " PAY NOW", " 2024", " 2024 A 1 B", ", and", " and", "\nNEXT"]


def test_account_numbers_end_by_their_length_whatever_follows(spark):
    rows, expected = [], {}
    for account in ACCOUNTS:
        for before in ("", "IBAN ", "Ref AB12 ", "é🙂 "):
            for behind in BEHIND:
                expected[len(rows)] = [(len(before), len(before) + len(account))]
                rows.append((len(rows), before + account + behind))
    # One behind the other, broken ones, and one that goes on.
    expected[len(rows)] = [(0, 22), (23, 50)]
    rows.append((len(rows), f"{ACCOUNTS[1]} {ACCOUNTS[2]} X"))
    for text in ("DE88 3704 0044 0532 0130 00 Please", "DE89370400440532013000x", "GB82WEST"):
        expected[len(rows)] = []
        rows.append((len(rows), text))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    iban = pii.KINDS.index(pii.IBAN)
    for row in pii.with_spans(frame).collect():
        got = [(s.start, s.end) for s in row.spans if s.kind == iban]
        assert got == expected[row.doc_id], row.text
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(frame).collect()}
    assert masked[1] == "<iban> Please pay" and masked[4] == "<iban> 2024"


def test_many_account_numbers_take_time_in_proportion(spark):
    def seconds(n):
        frame = spark.createDataFrame([(1, f"{ACCOUNTS[2]} AB12 " * n)], "doc_id long, text string")
        start = time.perf_counter()
        (row,) = pii.find_personal_data(frame).collect()
        assert row.n_iban == n
        return time.perf_counter() - start

    seconds(10)
    assert seconds(10_000) < 10 * max(0.5, seconds(2_000))


def test_masks_cover_all_spans_and_nothing_else(docs):
    texts = some_texts()
    spans = {r.doc_id: r.spans for r in pii.with_spans(docs.drop("spans")).collect()}
    masked = pii.mask_personal_data(docs)
    assert masked.columns == docs.columns
    for row in masked.collect():
        text = texts[row.doc_id]
        if text is None:
            assert row.text is None
            continue
        out, at = "", 0
        for s in spans[row.doc_id]:
            if s.start >= at:
                out += text[at : s.start] + f"<{pii.KINDS[s.kind].name}>"
            at = max(at, s.end)
        assert row.text == out + text[at:]


def test_many_spans_take_time_in_proportion(spark):
    def seconds(n):
        frame = spark.createDataFrame([(1, "x@y.zz and 1.2.3.4, " * n)], "doc_id long, text string")
        start = time.perf_counter()
        pii.mask_personal_data(frame).collect()
        return time.perf_counter() - start

    seconds(10)
    assert seconds(20_000) < 10 * max(0.5, seconds(4_000))


def test_no_rows(docs):
    assert pii.find_personal_data(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- contamination


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(rows, items):
    windows = {}
    for item_id, text in items:
        w = words_of(text)
        size = min(10, len(w))
        if item_id is not None and w:
            for i in range(len(w) - size + 1):
                windows.setdefault(tuple(w[i : i + size]), set()).add(str(item_id))
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in rows:
        w, hit, ids = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    ids |= found
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return out


def corpus(seed=1):
    draw = random.Random(seed)
    word = lambda: draw.choice(["É", "é", "K", "k", "Ab", "ab", "x1", "İ", "the", "of"]) + draw.choice(
        ["", "a", "b", "ß", "7"]
    )
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([10, 25, 12, 9, 4, 1, 40])]
    items += [(2, "Repeated id " * 8), (None, "never " * 12), (9, ""), (10, None), (11, items[0][1])]
    rows = []
    for i in range(150):
        w = [word() for _ in range(draw.randrange(60))]
        if draw.random() < 0.4:
            passage = draw.choice(items[:8])[1].split()
            at, cut = draw.randrange(len(w) + 1), draw.randrange(4)
            w[at:at] = [x.upper() if draw.random() < 0.2 else x for x in passage[cut:]]
        rows.append((i, draw.choice([" ", ", ", "\n"]).join(w)))
    return rows + [(3, rows[3][1]), (3, "other text"), (None, items[1][1]), (7000, None), (7001, "")], items


def test_hits_are_those_of_brute_force(spark):
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, hash int")
    found = decontamination.find_contamination(docs.repartition(4), bench).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(brute(rows, items), key=key)
    kept = decontamination.keep_clean(docs, bench)
    clean = [r[0] for r in brute(rows, items) if not r[5]]
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d in clean)


def test_empty_sides(spark):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0
    found = decontamination.find_contamination(docs, bench.limit(0)).collect()
    assert len(found) == len(rows) and not any(r.contaminated for r in found)


def test_no_python_runs_in_the_plans(spark):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for frame in (
        pii.find_personal_data(docs),
        pii.mask_personal_data(docs),
        decontamination.find_contamination(docs, bench),
    ):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_columns_that_clash_with_working_names_stay(spark):
    columns = ["_id", "_digest", "_dropped", "_spans", "_personal_data_spans", "spans", "words"]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in columns)
    text = "one two three four five six seven eight nine ten write to a@b.cc"
    rows = [(i, text if i < 2 else f"{i}", *columns) for i in range(4)]
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    for kept, ids in (
        (decontamination.keep_clean(docs, bench), {2, 3}),
        (near_duplicates.keep_one(docs), {0, 2, 3}),
        (pii.mask_personal_data(docs), {0, 1, 2, 3}),
    ):
        found = kept.collect()
        assert kept.columns == docs.columns and {r.doc_id for r in found} == ids
        assert all(r[c] == c for r in found for c in columns)


def test_hits_without_a_broadcast_are_the_same(spark, monkeypatch):
    long = "a b c d e f g h i j k l m"
    rows = [(1, f"x {long} y", ), (1, "e f"), (2, "a a a a a a a a a a a a"), (None, "e f z"), (3, None)]
    docs = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string")
    items = [(1, long), (2, "a " * 11), (3, "E-f"), (4, ""), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = decontamination.find_contamination(docs, bench).collect()
    monkeypatch.setattr(decontamination, "fits_broadcast", lambda *_: False)
    found = decontamination.find_contamination(docs, bench).collect()
    assert sorted(map(str, found)) == sorted(map(str, expected)) and len(found) == 10
    assert sorted((r.n_hit, r.n_items) for r in found) == sorted(
        [(13, 2), (2, 1), (12, 1), (2, 1), (0, 0)] * 2
    )


def test_winnowing_keeps_few_grams_and_one_of_every_window(spark):
    draw = random.Random(3)
    text = " ".join(f"w{draw.randrange(900)}" for _ in range(4000))
    docs = spark.createDataFrame([(text,)], "text string")
    d = decontamination
    row = d.kept_grams(d.with_grams(d.with_words(docs))).first()
    kept = [h is not None for h in row.kept]
    assert all(any(kept[i : i + d.GRAMS]) for i in range(len(row.least)))
    assert sum(kept) / len(kept) < 2.3 / (d.GRAMS + 1)


def test_secrets_behind_key_words(spark):
    value = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"
    texts = [f'token = "{value}" x', f"API_KEY={value}", f"key {value}", 'token = "aaaaaaaaaaaaaaaaaaaa1"',
             f"Secret: '{value}'", "token = short1", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert [found[i].n_secret for i in range(len(texts))] == [1, 1, 0, 0, 1, 0, 0]
    assert found[0].spans == "secret:9:49" and found[0].n_confident == 1
