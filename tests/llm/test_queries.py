"""The operators' queries against their SQL on the smallest tables, and their contracts' columns."""

import duckdb
import pytest

from tests.test_queries import FOLDER, TABLES
from tidemark.llm import queries
from tools_compare import plain

COLUMNS = {
    "op1_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op2_katz_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op7_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op8_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op10_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(queries.SQL[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == cols
    assert got == sorted((tuple(plain(r[theirs.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    assert set(COLUMNS[name]) <= set(queries.QUERIES[name](spark, FOLDER).columns)


def test_held_out_texts_score_above_the_base(spark):
    rows = queries.op2_katz_scoring(spark, FOLDER).filter("n_tokens > 20").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]
