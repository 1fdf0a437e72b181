"""Queries against their registered statements on tables larger than those the statements were first written for."""

import duckdb
import pytest

from loomwork import plans
from loomwork.plans import catalog

plans.load_all()
SF = "/root/testdata/sf0.1"


def same(spark, root, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(root))
    theirs = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL[name]})").fetchall()
    ours = [tuple(r) for r in got.collect()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
    return ours


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pairs")
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400").write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.mark.parametrize("every", ["", "_every_item"])
@pytest.mark.parametrize("name", ["token_f1", "content_word_overlap", "quality_gate_reasons"])
def test_pairs_as_stated(spark, pairs, name, every):
    assert len(same(spark, pairs, name + every)) == 400


def test_every_equal_pair(spark, tmp_path):
    texts = ["One text", "one  text", "another", "ONE TEXT", "alone"]
    docs = [(i, t, "src0" if i < 2 else "src1") for i, t in enumerate([*texts, *texts])]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, "another"), (4, "none like it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(same(spark, tmp_path, "exact_overlap")) == 2 * 4 + 2
