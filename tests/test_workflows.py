"""Whole workflows on planted data: trajectories and their options, the two-pass pipeline, gene clusters."""

import numpy as np
import pytest
from test_orders import planted, spearman, vec_of

from strandline.functions.runtime import stored
from strandline.operators import clusters, neighbours, trajectory
from strandline.plans import pipeline


def shuffled_flowers():
    """150 rows of four measures in three kinds, rounded to a tenth so that rows repeat, in random order."""
    rng = np.random.default_rng(31)
    kinds = np.array([[5.0, 3.4, 1.5, 0.2], [5.9, 2.8, 4.3, 1.3], [6.6, 3.0, 5.5, 2.0]])
    x = np.round(np.repeat(kinds, 50, axis=0) + rng.normal(size=(150, 4)) * [0.4, 0.3, 0.4, 0.2], 1)
    x[7] = x[3]
    x[120:124] = x[110]
    return x[rng.permutation(150)]


def test_trajectory_of_a_shuffled_table_with_repeated_rows(spark):
    x = shuffled_flowers()
    order, marks = trajectory.wanderlust(vec_of(spark, x), num_waypoints=100, seed=2)
    rows = order.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 151)) and len({r["cell_id"] for r in rows}) == 150
    assert min(r["score"] for r in rows) == 0 and max(r["score"] for r in rows) == 1
    slots = [r["slot"] for r in marks.orderBy("slot").collect()]
    assert slots == list(range(101)) and marks.where("slot = 0").first()["cell_id"] == "0000"


def test_options_of_the_trajectory(spark):
    t, x = planted(60, noise=0.005)
    start, middle = (f"{int(np.argmin(np.abs(t - at))):04d}" for at in (t.min(), 0.5))
    options = {"l": 6, "k": 4, "num_graphs": 2, "num_waypoints": 9, "banded": True, "partial_order": [middle], "flock_rounds": 1, "scheme": "linear"}
    order, marks = trajectory.wanderlust(vec_of(spark, x), start, **options)
    assert spearman(order, t) > 0.9
    found = {r["slot"]: r["cell_id"] for r in marks.collect()}
    assert found[0] == start and found[1] == middle


def test_diffusion_components_are_eigenvectors(spark):
    t, x = planted(40, noise=0.02)
    vec = vec_of(spark, x)
    found, values, _ = trajectory.diffusion_map(vec, "massCyt", n_neighbours=8, k=4)
    v = np.array([r["features"] for r in found.orderBy("pos").collect()])
    w = np.zeros((40, 40))
    for r in neighbours.affinity(neighbours.knn(vec, 8, True), 1.0, vec).collect():
        w[int(r["src"]), int(r["dst"])] += r["w"]
    degree = w.sum(axis=1)
    walk = w / np.where(degree > 0, degree, 1)[:, None]
    assert np.allclose(np.linalg.norm(v, axis=0), 1)
    assert np.allclose(walk @ v, v * np.asarray(values)[: v.shape[1]], atol=2e-3)


def test_trajectory_from_both_ends(spark):
    t, x = planted(160, noise=0.01)  # neighbourhoods of 15 cells must be short next to the line
    order = stored(trajectory.swanderlust(vec_of(spark, x - x.min() + 1), 3, restarts=1, num_waypoints=10), "order")
    assert sorted(r["rank"] for r in order.collect()) == list(range(1, 161)) and spearman(order, t) > 0.9


def expression_of(spark, n=40, seed=33):
    """A gene table along a hidden time: 12 rising and falling genes, 12 without a trend, 6 weak ones."""
    rng = np.random.default_rng(seed)
    t = rng.permutation(np.linspace(0, 1, n))
    rows = []
    for g in range(30):
        level = 6 + 5 * (t if g % 2 else 1 - t) if g < 12 else np.full(n, 4.0) if g < 24 else np.full(n, -1.0)
        y = 2 ** (level + rng.normal(0, 0.25, n))
        rows += [(f"g{g:02d}", f"{i:04d}", float(y[i])) for i in range(n)]
    return t, spark.createDataFrame(rows, "gene_id string, cell_id string, value double")


def test_two_pass_pipeline_recovers_order_and_genes(spark, tmp_path):
    t, expr = expression_of(spark)
    tables = pipeline.run_pipeline(expr, "SPIN", "monocle", preliminary_options={"restarts": 3}, refined_options={"neighbours": 6}, driver_options={"qval": 0.01})
    assert sorted(tables) == sorted([
        "exp_raw", "trimmed_log2exp", "preliminary_sorting_genes", "preliminary_sorting_order", "refined_sorting_genes", "refined_sorting_order",
        "driverGene_refinedOrder_log2exp",
    ])
    for name in ("preliminary_sorting_order", "refined_sorting_order"):
        assert abs(spearman(tables[name], t)) > 0.9
        assert sorted(r["rank"] for r in tables[name].collect()) == list(range(1, 41))
    trend = {f"g{g:02d}" for g in range(12)}
    drivers = {r["gene_id"] for r in tables["refined_sorting_genes"].collect()}
    assert drivers and drivers <= trend
    assert {r["gene_id"] for r in tables["trimmed_log2exp"].select("gene_id").distinct().collect()} == {f"g{g:02d}" for g in range(24)}
    last = tables["driverGene_refinedOrder_log2exp"]
    assert last.count() == len(drivers) * 40 and {r["gene_id"] for r in last.select("gene_id").distinct().collect()} == drivers
    got = {(r["gene_id"], r["cell_id"]): r["log2v"] for r in last.collect()}
    raw = {(r["gene_id"], r["cell_id"]): r["value"] for r in expr.collect()}
    assert all(got[x] == pytest.approx(np.log2(max(raw[x], 1.0))) for x in got)


@pytest.mark.parametrize("distance", [clusters.half_correlation, lambda a, b: abs(a[:, None] - b[None]).sum(axis=2)])
def test_gene_clusters_against_plain_sums(spark, distance):
    rng = np.random.default_rng(34)
    shapes = [np.sin(np.linspace(0, 6, 20)), np.linspace(-1, 1, 20), np.cos(np.linspace(0, 3, 20)) ** 2 * 2 - 1]
    x = np.array([shapes[g % 3] + rng.normal(0, 0.15, 20) for g in range(24)])
    rows = [(f"g{g:02d}", f"c{i:02d}", float(x[g, i])) for g in range(24) for i in range(20)]
    rows += [("gap", "c00", 1.0)] + [("flat", f"c{i:02d}", 2.0) for i in range(20)]
    profiles = spark.createDataFrame(rows, "gene_id string, cell_id string, z double")
    got = {r["gene_id"]: r for r in clusters.cluster_genes(profiles, 20, (2, 5), distance=distance, block=7).collect()}
    assert set(got) == {f"g{g:02d}" for g in range(24)} and {r["k"] for r in got.values()} == {3}
    d = distance(x, x)
    np.fill_diagonal(d, 0)
    for c in {r["cluster"] for r in got.values()}:
        members = sorted(int(g[1:]) for g, r in got.items() if r["cluster"] == c)
        assert len({m % 3 for m in members}) == 1
        medoid = int(got[f"g{members[0]:02d}"]["medoid"][1:])
        assert medoid == members[int(np.argmin(d[np.ix_(members, members)].sum(axis=1)))]
    empty = clusters.cluster_genes(profiles.limit(0), 20)
    assert empty.count() == 0
