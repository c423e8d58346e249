"""Token counts, byte-level BPE and token files against the public libraries."""

import base64
import itertools
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
import tokenizers

from rankdraft.llm import byte_bpe, common, token_counts, token_files

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
MODEL = P.path("piece_bpe_32k.model")

PARTS = [
    "a", "b", " ", "  ", "\n", "\t", " ", "é", "🙂", "1", "23", ".", "'s", "the", "▁", "<s>",
    "<0x0A>", "\x1c", "　", "门", "\r\n", "\x00", "aaaa", "İ", "    ", "<|endoftext|>",
]


def some_texts(n=1500, seed=3):
    draw = random.Random(seed)
    made = ["".join(draw.choices(PARTS, k=draw.randint(0, 25))) for _ in range(n)]
    return [*made, "", " ", "word", "ab " * 5000, "a" * 3000, "é" * 2000, " " * 2000]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(RANKS, P.PATTERN)


def test_byte_bpe_gives_the_librarys_ids_and_the_text_back(bpe):
    library = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={}
    )
    for text in some_texts():
        ids = bpe.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert bpe.decode(ids).decode() == text


def test_a_long_pre_token_takes_time_in_proportion(bpe):
    def seconds(n):
        piece = bytes(random.Random(1).choices(b"abcdefgh", k=n))
        start = time.process_time()
        bpe.merge(piece)
        return time.process_time() - start

    seconds(1000)
    assert seconds(200_000) < 12 * seconds(40_000)


def test_counts_are_those_of_the_library():
    counter = token_counts.PieceCounter(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in some_texts():
        assert counter.count(text) == len(library.encode(text)), repr(text)


def test_memory_of_words_is_bounded():
    seen = byte_bpe.Remembered(lambda w: w.upper(), size=10, longest=3)
    words = [f"{i:03d}" for i in range(100)] + ["long word"]
    for word in words * 2:
        assert seen[word] == word.upper()
    assert len(seen) <= 10 and len(seen.old) <= 10 and "long word" not in seen


ROWS = [(2, "b b", "x"), (1, None, "x"), (None, "null id", "x"), (2, "b b", "x"), (0, "", None)]


def test_rows_keep_nulls_and_repeats(spark):
    counts = token_counts.count_tokens(frame(spark, ROWS), MODEL, limit=1).collect()
    by_id = {(r.doc_id, r.n_bytes): (r.n_tokens > 0, r.over_limit) for r in counts}
    assert by_id[(1, 0)] == (False, False) and by_id[(0, 0)] == (False, False)
    assert by_id[(2, 3)] == (True, True) and len(counts) == 5
    encoded = byte_bpe.encode_documents(frame(spark, ROWS), RANKS, P.PATTERN).collect()
    assert sorted(r.decoded for r in encoded) == ["", "", "b b", "b b", "null id"]
    assert all(len(r.ids) == r.n_tokens for r in encoded)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert token_counts.count_tokens(none, MODEL).count() == 0
    assert byte_bpe.encode_digests(none, RANKS, P.PATTERN).count() == 0
    assert token_files.token_files(none, JSON).count() == 0


def test_blocks_come_back_whatever_they_hold():
    draw = np.random.default_rng(4)
    cases = [
        np.zeros(1, np.uint32),
        np.full(5000, 7, np.uint32),
        np.array([0, 2**32 - 1] * 600, np.uint32),
        draw.integers(0, 50_000, 10_000).astype(np.uint32),
        np.where(draw.random(3000) < 0.02, 2**31, draw.integers(5, 9, 3000)).astype(np.uint32),
    ]
    for ids in cases:
        counts = [len(ids)]
        file = token_files.TokenFile(token_files.file_bytes([None], counts, ids))
        assert file.doc_ids == [None]
        assert np.array_equal(file.ids(0, len(ids)), ids)
        assert np.array_equal(file.ids(len(ids) // 3, len(ids)), ids[len(ids) // 3 :])


def test_outliers_do_not_widen_a_block():
    ids = np.full(1024, 3, np.uint32)
    ids[10] = 2**31
    assert len(token_files.pack(ids)[1]) < 40


def test_files_hold_the_librarys_ids_in_order_of_id(spark):
    texts = some_texts(200)
    rows = [(len(texts) - i, t, None) for i, t in enumerate(texts)]
    rows += [(None, "without an id", None), (7, None, None), (7, "again", None)]
    found = token_files.token_files(frame(spark, rows).repartition(5), JSON).collect()
    library = tokenizers.Tokenizer.from_file(JSON)

    def ids(text):
        return library.encode(text or "", add_special_tokens=False).ids + [2]

    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for doc_id, text, _ in ordered:
        own = ids(text)
        expected.append((doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    got = sorted(map(tuple, found), key=lambda r: r[1])
    assert got == expected


def test_a_file_ends_with_the_document_that_fills_it(spark, tmp_path):
    rows = [(i, "some words " * 50, None) for i in range(60)]
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(frame(spark, rows).repartition(3), JSON, folder)
    assert manifest.selectExpr("sum(n_docs) AS n").first().n == 60
    found = token_files.read_token_files(spark, folder).orderBy("doc_id").collect()
    assert [r.start for r in found] == [i * found[0].n_tokens for i in range(60)]


def plain_merge(ranks, piece):
    """Lowest rank first, then leftmost, by a search of all pairs at each step."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs, default=(1 << 60, 0))
        if rank == 1 << 60:
            return [ranks[p] for p in parts]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_pre_tokens_side_by_side_give_the_ids_of_each(tmp_path):
    draw = random.Random(5)
    tokens = [bytes(t) for n in (2, 3, 4) for t in itertools.product(b"abc", repeat=n)]
    for trial in range(40):
        # A token may rank below the ones that it is made of.
        some = draw.sample(tokens, draw.randint(3, 60))
        single = [bytes([i]) for i in range(256)]
        order = single + some if trial % 2 else some + single
        lines = [b"%s %d" % (base64.b64encode(t), i) for i, t in enumerate(order)]
        (tmp_path / "ranks").write_bytes(b"\n".join(lines))
        own = byte_bpe.ByteBpe(str(tmp_path / "ranks"), P.PATTERN)
        pieces = [bytes(draw.choices(b"abc", k=draw.randint(1, 12))) for _ in range(60)]
        found = [list(ids) for ids in own.merge_all(pieces)]
        assert found == [plain_merge(own.ranks, piece) for piece in pieces]


def test_texts_together_give_the_ids_of_each(bpe):
    texts = some_texts()
    assert bpe.encode_all(texts) == [bpe.encode(t) for t in texts]
    assert bpe.encode_all([]) == []


def test_other_passes_let_go_of_what_a_worker_keeps(spark):
    rows = spark.range(1).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1)

    def held(part):
        return {"n": pa.array([len(common._KEPT)])}

    for _ in range(2):
        byte_bpe.encode_digests(rows, RANKS, P.PATTERN).collect()
        assert common.map_slices(rows, "n long", held, keeps=False).first()["n"] == 0


def test_the_library_is_not_asked_for_places_of_tokens():
    library = tokenizers.Tokenizer.from_file(JSON)

    class Fast:
        def encode_batch_fast(self, *args, **kwargs):
            return library.encode_batch_fast(*args, **kwargs)

    encoder = token_files.Encoder(JSON)
    encoder.tokenizer = Fast()
    texts = some_texts(300)
    ids, sizes = encoder.encode(pa.array(texts), 2)
    own = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == list(itertools.chain(*own)) and sizes.tolist() == list(map(len, own))


def test_words_of_several_slices_are_cut_together(spark):
    rows = spark.range(1500).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1)

    def sizes(part):
        return {"n": pa.array([part.num_rows])}

    found = common.map_slices(rows, "n long", sizes, gather=byte_bpe.DIGESTS_BYTES)
    assert [r.n for r in found.collect()] == [1500]


def test_rare_words_go_to_the_library_without_line_ends_between():
    encoder = token_files.Encoder(JSON)
    library, seen = encoder.tokenizer, []

    class Spy:
        def encode_batch_fast(self, texts, **kwargs):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **kwargs)

    encoder.tokenizer = Spy()
    words = [f" {a}{b}zq" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = ["".join(words), " 日本x. 🙂 12 <|endoftext|>b 'll", "first\nlines\nx, y"]
    ids, sizes = encoder.encode(pa.array(texts), 2)
    own = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == list(itertools.chain(*own)) and sizes.tolist() == list(map(len, own))
    assert not any("\n" in text for text in seen if any(word in text for word in words))


def test_parts_are_encoded_alone_where_tokens_do_not_tell_them_apart():
    encoder = token_files.Encoder(JSON)
    encoder.bytes[:] = 3
    texts = some_texts(300)
    ids, sizes = encoder.encode(pa.array(texts), 2)
    own = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == list(itertools.chain(*own)) and sizes.tolist() == list(map(len, own))


def test_the_pattern_of_all_letters_sees_no_latin_words(monkeypatch):
    encoder, seen = token_files.Encoder(JSON), []
    extract = token_files.pc.extract_regex

    def spy(column, pattern):
        if pattern == encoder.LETTERS:
            seen.extend(column.to_pylist())
        return extract(column, pattern)

    monkeypatch.setattr(token_files.pc, "extract_regex", spy)
    text = "words, größer. that's x1 слово, ñandú; plain"
    ids, _ = encoder.encode(pa.array([text]), 2)
    assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert seen == [" слово,"]


def test_blocks_of_every_width_come_back():
    draw = np.random.default_rng(6)
    for width in range(33):
        for n in (1, 7, 1023, 1024, 2500):
            ids = draw.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
            ids[draw.random(n) < 0.02] = 2**32 - 1
            starts, payload = token_files.pack(ids)
            blocks = [token_files.unpack(payload[a:b]) for a, b in zip(starts, starts[1:])]
            found = np.concatenate(blocks)
            assert found.dtype == np.uint32 and np.array_equal(found, ids)
