import duckdb
import pytest

from strandline.plans import catalog

TABLES = "customer documents embeddings lineitem orders part supplier".split()
QUICK = [n for n in catalog.ORACLES if n not in {"preprocess", "outlier_cells", "sts_sort", "landmark_distances"}]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)
