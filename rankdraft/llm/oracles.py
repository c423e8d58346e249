"""The queries that SQL can express, once more as SQL for DuckDB."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SUBSTRING_DEDUP = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
    FROM docs, unnest(range(1, len(w) - 48)) t(p)),
owners AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h),
gone AS (
    SELECT DISTINCT doc_id, p + k AS i
    FROM windows JOIN owners USING (h), range(50) r(k) WHERE owner < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM
          (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
grams AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[p:p + n - 1], ' ') AS g
    FROM items, unnest(range(1, len(w) - n + 2)) t(p)),
lengths AS (SELECT DISTINCT n FROM grams),
hits AS (
    SELECT DISTINCT d.doc_id, d.p, d.n, g.item FROM (
        SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
        FROM docs, lengths, unnest(range(1, len(w) - n + 2)) t(p)) d
    JOIN grams g ON g.g = d.g AND g.n = d.n),
covered AS (
    SELECT doc_id, count(DISTINCT p + k) AS n_hit
    FROM hits, range(10) r(k) WHERE k < n GROUP BY doc_id),
found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit,
       coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256,
       c.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

# crc32 by the table of its polynomial; bytes are a list of integers.
_CRC_TABLE = """
crc_table AS (
    SELECT list(c ORDER BY i) AS entries FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
            CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i)))"""


def _crc(bytes_list: str) -> str:
    step = "xor(c >> 8, entries[(xor(c, b) & 255) + 1])"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_list}), "
        f"lambda c, b: {step}), 4294967295)"
    )


# Levels of runs of 16: enough for 16^5 rows of a source and as many sources.
_LEVELS = 5


def _tree(first: str, name: str) -> str:
    """CTEs of the levels over ``first`` (grp, idx, h, n) and of each node's siblings."""
    out = []
    for k in range(_LEVELS + 1):
        if k:
            out.append(f"""
{name}{k} AS (
    SELECT grp, idx // 16 AS idx, (n + 15) // 16 AS n,
           CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h
    FROM {name}{k - 1} GROUP BY grp, idx // 16, n)""")
        else:
            out.append(f"\n{name}0 AS (SELECT grp, idx, n, h FROM {first})")
        run = "PARTITION BY grp, idx // 16 ORDER BY idx ROWS BETWEEN"
        out.append(f"""
{name}_s{k} AS (
    SELECT grp, idx, n,
           coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}{k})""")
    return ",".join(out)


def _climb(first: str, name: str, tree: str) -> str:
    """CTEs that carry (row, grp, idx, proof, folded) of ``first`` up through a tree."""
    out = []
    for k in range(_LEVELS):
        source = f"{name}{k - 1}" if k else first
        out.append(f"""
{name}{k} AS (
    SELECT f.id, f.grp, f.idx // 16 AS idx,
           f.proof || CASE WHEN s.n > 1 THEN s.l || s.r ELSE '' END AS proof,
           CASE WHEN s.n > 1 THEN sha256(s.l || f.folded || s.r) ELSE f.folded END AS folded
    FROM {source} f JOIN {tree}_s{k} s ON f.grp IS NOT DISTINCT FROM s.grp AND f.idx = s.idx)""")
    return ",".join(out)


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    fields = (_field(v) for v in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(fields)})"


_ID_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))"
MERKLE_MANIFEST = f"""
WITH {_CRC_TABLE},
hashed AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf,
           CASE WHEN doc_id IS NOT NULL AND {_crc(_ID_BYTES)} % 5 = 0 THEN
               {_leaf(f"translate(text, '{_LETTERS}', '{_LETTERS.lower()}')")} END AS tampered
    FROM documents, crc_table),
leaves AS (
    SELECT *, row_number() OVER () AS id,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY source) AS n
    FROM hashed),
first_nodes AS (SELECT source AS grp, idx, n, leaf AS h FROM leaves),
{_tree("first_nodes", "a")},
subroots AS (
    SELECT grp AS source, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx,
           count(*) OVER () AS n FROM a{_LEVELS}),
upper_nodes AS (SELECT 0 AS grp, idx, n, h FROM subroots),
{_tree("upper_nodes", "b")},
low AS (
    SELECT id, source AS grp, idx, '' AS proof, coalesce(tampered, leaf) AS folded FROM leaves),
{_climb("low", "c", "a")},
high AS (
    SELECT c.id, 0 AS grp, s.idx, c.proof, c.folded
    FROM c{_LEVELS - 1} c JOIN subroots s ON c.grp IS NOT DISTINCT FROM s.source),
{_climb("high", "d", "b")}
SELECT l.doc_id, l.leaf, s.h AS subroot, b.h AS root, sha256(d.proof) AS proof_sha256,
       d.folded AS folded_root, d.folded = b.h AS verified
FROM leaves l JOIN d{_LEVELS - 1} d ON d.id = l.id
JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, b{_LEVELS} b
"""

_RUN_BYTES = (
    "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),"
    " lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))"
)
SPELLING_VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[a-zÀ-ÿ]+')) AS run
        FROM documents)
    WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc(_RUN_BYTES)} AS h FROM runs, crc_table),
typed AS (
    SELECT n, CASE WHEN h % 31 = 0
        THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
    FROM hashed),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
    SELECT word, n, i, word[1:i] || word[i + 2:] AS rest
    FROM words, unnest(range(length(word))) t(i)),
near AS (
    SELECT a.word, b.word AS other, b.n AS other_n
    FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other,
           max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
           CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form,
           CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
    SELECT word, word AS at FROM forms
    UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at
    WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.at AND e.form IS NULL
"""
