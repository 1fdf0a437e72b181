"""Every registered query of the library against its statement in DuckDB."""

import duckdb
import pytest

from loomwork import plans
from loomwork.plans import catalog

plans.load_all()

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canon(rows):
    return sorted(str(tuple(None if v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in rows)


def test_which_queries_have_no_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"tokenizer_gate"}  # test_intake compares its parts with the library


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = df.select(*columns).toPandas().astype(object)
    theirs = duck.execute(catalog.SQL[name]).df().astype(object)
    assert columns == sorted(theirs.columns)
    assert canon(ours.itertuples(index=False, name=None)) == canon(theirs[columns].itertuples(index=False, name=None))
