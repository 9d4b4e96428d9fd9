import math

import numpy as np
import pytest

from strandline.functions.stats import benjamini_hochberg, elbow, exact_quantile
from strandline.operators import matrix, quality_control as qc
from strandline.sources import tables


def long(spark, matrix, keep_zero=False):
    rows = [(f"g{i}", f"c{j}", float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v or keep_zero]
    return spark.createDataFrame(rows, "gene_id string, cell_id string, value double")


def test_elbow_by_hand(spark):
    scores = [10, 9, 8, 6, 3, 2, 1, 0.1]
    df = spark.createDataFrame([(str(i + 1), float(s)) for i, s in enumerate(scores)], "gene_id string, score double")
    assert sorted(r["gene_id"] for r in elbow(df).collect()) == ["1", "2", "3", "4", "5"]


def test_elbow_of_groups_and_single_rows(spark):
    df = spark.createDataFrame([("a", "1", 5.0), ("b", "1", 9.0), ("b", "2", 8.5), ("b", "3", 1.0)], "g string, gene_id string, score double")
    kept = {(r["g"], r["gene_id"]) for r in elbow(df, group=["g"]).collect()}
    assert ("a", "1") in kept and ("b", "3") not in kept


@pytest.mark.parametrize("p", [0.0, 0.15, 0.5, 0.75, 1.0])
def test_exact_quantile(spark, p):
    x = np.random.default_rng(1).normal(size=501)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert exact_quantile(df, "x", p) == pytest.approx(np.quantile(x, p))


def test_exact_quantile_with_weights(spark):
    df = spark.createDataFrame([(0.0, 1000), (1.0, 3), (2.0, 2)], "x double, w long")
    assert exact_quantile(df, "x", 0.5, "w") == 0.0
    assert exact_quantile(df, "x", 1.0, "w") == 2.0
    assert exact_quantile(df.limit(0), "x", 0.5) is None


def test_benjamini_hochberg_is_monotone(spark):
    p = [0.01, 0.02, 0.03, 0.5, 0.9]
    df = spark.createDataFrame([(f"g{i}", v) for i, v in enumerate(p)], "gene_id string, pval double")
    got = [r["qval"] for r in benjamini_hochberg(df).orderBy("pval").collect()]
    assert got == sorted(got) and got[0] == pytest.approx(0.05) and max(got) <= 1


def outliers_by_hand(x, lod=1.0, step=4, q=0.95, low=0.15, least=20):
    logs = np.log2(np.maximum(x, lod))
    means = logs.mean(axis=1)

    def shares(t):
        left = means > np.log2(t)
        detected = (x[left] >= lod).sum(axis=0) / max(1, left.sum())
        return left, detected >= q

    for i in range(101):
        left, good = shares(lod + step * i)
        if good.mean() >= 0.5 or left.sum() < least:
            break
    if good.mean() < 0.5:
        return set()
    last = lod + step * (i - 1) if i else lod
    for k in range(1, 5):
        left, good = shares(last + k)
        if good.mean() >= 0.5:
            cut = np.quantile(logs[left][:, good], low)
            return {f"c{j}" for j in np.flatnonzero(np.median(logs[left], axis=0) <= cut)}
    return set()


def test_outliers_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.gamma(2.0, 40.0, size=(60, 24)).round()
    x[rng.random(x.shape) < 0.02] = 0
    x[:, 5] = rng.gamma(1.0, 2.0, 60).round()
    x[40:, :] *= rng.random((20, 24)) < 0.3
    want = outliers_by_hand(x)
    got = {r["cell_id"] for r in qc.identify_outliers(long(spark, x)).collect()}
    assert got == want and "c5" in got


def test_retained_genes_rules(spark):
    x = np.array([[9, 9, 9, 9], [0, 0, 0, 4], [-1, -1, -1, -1], [3, 0, 0, 0]], float)
    expr = long(spark, x, keep_zero=True)
    kept = {r["gene_id"] for r in qc.retain_genes(expr, 1.0, 0.3).select("gene_id").distinct().collect()}
    assert kept == {"g0"}


def test_twins_up_to_case_go_together(spark):
    expr = spark.createDataFrame([("AbC", "c", 100.0), ("abc", "c", 1.0), ("x", "c", 100.0)], "gene_id string, cell_id string, value double")
    assert {r["gene_id"] for r in qc.filter_genes_by_mean(expr, 2.0).collect()} == {"x"}


def test_libsize_gives_equal_sums(spark):
    x = np.random.default_rng(0).integers(0, 9, (7, 5)).astype(float)
    sums = qc.libsize_normalise(long(spark, x)).groupBy("cell_id").sum("value").collect()
    want = np.quantile(x.sum(axis=0), 0.5)
    assert all(r[1] == pytest.approx(want) for r in sums)


def test_reading_text_tables(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("gene\tA.1\tB 2\ng1\t1.5\tNA\ng2\tx\t0\n")
    got = {(r["gene_id"], r["cell_id"]): r["value"] for r in tables.read_expression(spark, str(path)).collect()}
    assert got == {("g1", "A.1"): 1.5, ("g1", "B 2"): -1.0, ("g2", "A.1"): -1.0, ("g2", "B 2"): 0.0}
    path.write_text("A\tB\ng1\t1\tNaN\n")
    got = {r["cell_id"]: r["value"] for r in tables.read_expression(spark, str(path)).collect()}
    assert got == {"A": 1.0, "B": -1.0}


def test_annotation_and_results(spark, tmp_path):
    (tmp_path / "cells.txt").write_text("SampleID\tGroupID\nc1\tMDP\n")
    (tmp_path / "genes.txt").write_text("gene\ng1\ng1\n\n")
    assert tables.read_cell_types(spark, str(tmp_path / "cells.txt")).collect()[0].asDict() == {"cell_id": "c1", "group_id": "MDP"}
    (tmp_path / "cells.txt").write_text("SampleID\tGroupID\nc1\tZ\nc1\tA\n")
    order = spark.createDataFrame([("c1", 1), ("c2", 2)], "cell_id string, rank long")
    found = matrix.annotate(order, tables.read_cell_types(spark, str(tmp_path / "cells.txt"), lines=True))
    assert sorted(map(tuple, found.select("cell_id", "group_id").collect())) == [("c1", "Z"), ("c2", None)]
    assert tables.read_gene_set(spark, str(tmp_path / "genes.txt")).count() == 1
    folder = tables.write_results({"exp_raw": spark.range(3)}, str(tmp_path / "out"), "run")
    assert spark.read.parquet(f"{folder}/exp_raw").count() == 3


def test_detection_counts(spark):
    expr = long(spark, np.array([[5, 0], [1, 7]], float))
    got = {r["cell_id"]: (r["number_of_genes"], r["pct_of_genes"]) for r in qc.gene_detection(expr, 2.0).collect()}
    assert got == {"c0": (1, 0.5), "c1": (1, 0.5)}
    assert math.isclose(qc.gene_means(expr).where("gene_id = 'g1'").first()["mean_raw"], 4.0)
