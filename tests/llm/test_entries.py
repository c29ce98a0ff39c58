"""The registered queries over the smallest tables: columns, types, a row for each document, and their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
#: What the contracts fix: columns with their types, and whether there is a row for each document.
CONTRACTS = {
    "op1_ivf_pq": ("query_id bigint, rank int, vec_id bigint, score double", False),
    "op2_sentencepiece": ("doc_id bigint", True),
    "op3_license_scan": ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double", True),
    "op4_language_id": ("doc_id bigint, held_out boolean, lang_pred string, score double", True),
    "op5_source_mix": ("doc_id bigint, size bigint, source_size bigint, target double, taken bigint", True),
    "op6_ngram_jaccard_join": ("doc_id bigint, n_shingles bigint, component_id bigint", True),
    "op7_shared_passages": ("doc_id bigint, start_word bigint, n_words bigint", False),
    "op8_line_dedup": ("doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string", True),
    "op9_toxicity": ("doc_id bigint, held_out boolean, score double, predicted int", True),
    "op10_va_file": ("query_id bigint, rank int, vec_id bigint, score bigint", False),
    "op11_filter_audit": ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint", False),
    "op12_fill_in_middle": ("doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string", True),
    "op13_url_rules": ("page_id bigint, host string, path string, rule string, verdict string", False),
}


def test_all_queries_have_a_contract():
    assert set(CONTRACTS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", CONTRACTS)
def test_entry(spark, name):
    columns, by_document = CONTRACTS[name]
    df = entry.queries()[name](spark, FOLDER)
    types = dict(df.dtypes)
    assert all(types[c] == t for c, t in (x.split() for x in columns.split(", ")))
    rows = df.collect()
    assert rows
    if by_document:
        ids = sorted(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
        assert sorted(r.doc_id for r in rows) == ids
    if name in queries.ORACLE_SQL:
        duck = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "labels"):
            duck.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
        want = duck.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
