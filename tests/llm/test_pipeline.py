"""The pipeline's stages on small tables, each against its own input."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import catalog

EDGE = [
    (1, "a b c d e f g h i j k l. " * 3, "en", "s", 75), (2, "a b c d e f g h i j k l. " * 3, "en", "s", 75), (3, None, None, None, None),
    (4, "", "en", "s", 0), (5, "one\ntwo\nthree\nfour", "en", "s", 18), (6, "zero\none\ntwo\nthree", "en", "s", 18), (6, "zero\none\ntwo\nthree", "en", "s", 18),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(EDGE, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "three four"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_on_edge_cases(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        out.collect()
    lines = {r["doc_id"]: r["text"] for r in corpus_pipeline.fresh_lines(spark, docs, small).collect()}
    assert lines[5] == "one\ntwo\nthree\nfour" and lines[6] == "zero" and lines[3] is None
    kept = [r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, small).collect()]
    assert 1 in kept and 2 not in kept and kept.count(6) == 1
    clean = [r["doc_id"] for r in corpus_pipeline.no_benchmark(spark, docs, small).collect()]
    assert 5 not in clean and 1 in clean
    assert corpus_pipeline.piece_ids(spark, docs, small).where("round_trip").count() == len(EDGE)


def test_repeated_long_lines_go(spark, small):
    line = " ".join(f"word{k}" for k in range(137))
    docs = spark.createDataFrame([(1, line, "en", "s", 1), (2, line, "en", "s", 1), (3, f"a\n{line}\nb", "en", "s", 1), (4, "a", "en", "s", 1)], SCHEMA)
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.fresh_lines(spark, docs, small).collect()}
    assert left == {1: (line, 1), 2: ("", 0), 3: ("a\nb", 3), 4: ("a", 1)}


def test_stages_on_an_empty_table(spark, small):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0


def test_run_keeps_clean_documents(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    good = docs.join(labels, "doc_id").count()
    assert got.where(~F.col("round_trip")).count() == 0
    assert got.join(labels, "doc_id").count() > 0.75 * good
    assert got.count() < docs.count()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf_dir)
    want = con.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.select(quoted).fetchall()))
