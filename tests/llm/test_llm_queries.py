"""The numbered queries on the given tables, and the pipeline's stages."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline

from ..conftest import SMALL
from ..oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()
COLUMNS = {
    "op1": {"doc_id", "held_out", "lang_pred", "score"},
    "op2": {"query_id", "rank", "vec_id", "score"},
    "op3": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op4": {"doc_id", "fingerprint", "component_id"},
    "op5": {"doc_id", "held_out", "score", "predicted"},
    "op6": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op7": {"page_id", "host", "path", "rule", "verdict"},
    "op8": {"doc_id", "ids", "n_tokens"},
    "op9": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op11": {"doc_id", "n_shingles", "component_id", "kept"},
    "op12": {"word", "n", "n_near", "form", "form_n", "root"},
    "op13": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op10": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}
NAMES = {n.split("_")[0]: n for n in QUERIES if n.startswith("op")}


def test_all_are_registered():
    assert set(NAMES) == set(COLUMNS) and "pipeline" in QUERIES


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_columns_and_rows(spark, op):
    df = QUERIES[NAMES[op]](spark, SMALL)
    assert COLUMNS[op] <= set(df.columns)
    table = {"op2": None, "op12": None, "op7": "pages"}.get(op, "documents")
    if table:
        assert df.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_decontamination_equals_sql(spark):
    agrees, remark = compare(spark, connect(SMALL), NAMES["op9"], SMALL)
    assert agrees, remark


def test_held_out_languages(spark):
    got = QUERIES[NAMES["op1"]](spark, "/root/testdata/sf0.01").where("held_out").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert sum(lang[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.99


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert left == sorted(left, reverse=True) and left[-1] > 100
    run = corpus_pipeline.run(spark, SMALL).collect()
    whole = collections.Counter((r.doc_id, tuple(r.ids)) for r in run)
    assert whole == collections.Counter((r.doc_id, tuple(r.ids)) for r in docs.collect())


def test_stages_on_odd_rows(spark, make, tmp_path):
    docs = make([(1, None), (1, "a word"), (2, ""), (None, "a word"), (3, "a word " * 3000), (4, "a word " * 3000)], extra=True)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id for r in docs.collect()} == set() or {r.doc_id for r in docs.collect()} <= {1, 3, None}
    empty = make([])
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
