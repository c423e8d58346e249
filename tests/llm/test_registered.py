"""The registered queries: SQL twins, the pipeline, the guard of the entry point."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from rankdraft.llm.common import read
from rankdraft.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = entry_points.queries().keys()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and QUERIES.keys() <= names


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame, twin = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    order = sorted(frame.columns)
    assert order == sorted(twin.columns)
    got = sorted(str([r[c] for c in order]) for r in frame.collect())
    places = [twin.columns.index(c) for c in order]
    assert got == sorted(str([r[i] for i in places]) for r in twin.fetchall())


def test_stages_keep_clean_documents_and_their_columns(spark):
    docs = read(spark, SF, "documents")
    whole, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == whole, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    assert counts[-1] > 0.7 * counts[0] and counts[-1] == counts[-2]
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = corpus_pipeline.run(spark, SF).collect()
    digests = {r.doc_id: r.decoded_sha256 for r in found}
    assert digests == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}
    assert all(len(r.ids) == r.n_tokens for r in found)


def test_stages_of_no_documents(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
