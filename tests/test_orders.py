import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.functions.runtime import stored
from strandline.operators import distance, drivers, graph, linalg, matrix, neighbours, sorting, trajectory
from strandline.plans import pipeline


def vec_of(spark, x):
    rows = [(f"{i:04d}", i + 1, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "cell_id string, pos long, features array<double>")


def planted(n=60, m=6, noise=0.02, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.permutation(np.linspace(0, 1, n))
    x = np.stack([np.sin((k + 1) * t) + t * k for k in range(m)], axis=1) + rng.normal(0, noise, (n, m))
    return t, x


def spearman(ordering, t):
    ranks = {r["cell_id"]: r["rank"] for r in ordering.collect()}
    assert sorted(ranks.values()) == list(range(1, len(t) + 1))
    got = np.array([ranks[f"{i:04d}"] for i in range(len(t))])
    return abs(np.corrcoef(got, np.argsort(np.argsort(t)))[0, 1])


def euclid(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def slow_weights(n, sigma=1.0):
    i = np.arange(n)
    w = np.exp(-((i[:, None] - i[None]) ** 2) / (sigma * n))
    for _ in range(10):
        w = w / w.sum(axis=0, keepdims=True)
        w = w / w.sum(axis=1, keepdims=True)
    return (w + w.T) / 2


@pytest.mark.parametrize("method", distance.METRICS)
def test_distances_in_blocks(spark, method):
    x = np.abs(np.random.default_rng(2).normal(size=(23, 5)))
    got = {(r["i"], r["j"]): r["d"] for r in distance.pairwise_distance(vec_of(spark, x), method, block=7).collect()}
    assert len(got) == 23 * 22 // 2
    want = distance.block_distance(x, x, method)
    for (i, j), d in got.items():
        assert d == pytest.approx(want[int(i), int(j)], abs=1e-9)


def test_sts_cost_prefers_the_true_order(spark):
    t, x = planted()
    vec = vec_of(spark, x)
    n = len(t)
    c = np.arange(1, n + 1) - (n + 1) / 2
    assert distance.sts_cost(vec, block=16).first()[0] == pytest.approx(c @ euclid(x) @ c)
    order = np.argsort(t)
    assert distance.sts_cost(vec_of(spark, x[order])).first()[0] < distance.sts_cost(vec).first()[0]


def test_neighbourhood_costs(spark):
    _, x = planted(40)
    w = slow_weights(40)
    assert np.allclose(distance.Weights(40).part(np.arange(40), np.arange(40)), w)
    assert np.allclose(w, w.T) and np.allclose(w.sum(axis=1), 1, atol=0.05)
    d = euclid(x)
    vec = vec_of(spark, x)
    assert distance.neighbourhood_cost(vec, block=11).first()[0] == pytest.approx(np.trace(d @ w @ w.T))
    assert distance.neighbourhood_cost(vec, form="internal", block=11).first()[0] == pytest.approx(np.trace(d @ w))


@pytest.mark.parametrize("method", ["STS", "neighborhood"])
def test_planted_order_returns(spark, method):
    t, x = planted()
    assert spearman(sorting.sort_best_of(vec_of(spark, x), method, 4), t) > 0.95


def test_distributed_sort_is_the_local_one(spark):
    _, x = planted(50, seed=3)
    order, _ = sorting.local_sts(euclid(x), 6)
    got = sorting.sts_sort_distributed(vec_of(spark, x), 6, block=13).orderBy("rank").collect()
    assert [int(r["cell_id"]) for r in got] == order.tolist()


def test_sort_and_cost_of_supplied_distances(spark):
    _, x = planted(50, seed=3)
    d = euclid(x)
    rng = np.random.default_rng(5)
    # Each pair once, either way round, with a cell's distance to itself, which plays no part.
    rows = [(*(f"{k:04d}" for k in rng.permutation([i, j])), float(d[i, j])) for i in range(50) for j in range(i)]
    pairs = spark.createDataFrame([*rows, ("0000", "0000", 3.0)], "i string, j string, d double")
    order, cost = sorting.local_sts(d, 6)
    cells = vec_of(spark, x).drop("features")
    got = sorting.sts_sort_distributed(cells, 6, pairs=pairs)
    assert [int(r["cell_id"]) for r in got.orderBy("rank").collect()] == order.tolist()
    assert distance.sts_cost_of_pairs(pairs, got).first()["cost"] == pytest.approx(cost)
    # Without any pair all sums are 0 and the order stays.
    kept = sorting.sts_sort_distributed(cells, 2, pairs=pairs.limit(0)).orderBy("rank").collect()
    assert [int(r["cell_id"]) for r in kept] == list(range(50))
    assert distance.sts_cost_of_pairs(pairs.limit(0), got).first()["cost"] == 0


def test_distributed_neighbourhood_sort_is_the_local_one(spark):
    _, x = planted(50, seed=3)
    d = distance.block_distance(x, x)
    np.fill_diagonal(d, 0.0)
    order, cost = sorting.local_sort(d, "neighborhood", max_iter=4)
    found = sorting.neighbourhood_sort_distributed(vec_of(spark, x), max_iter=4, block=13)
    assert [int(r["cell_id"]) for r in found.orderBy("rank").collect()] == order.tolist()
    got = distance.neighbourhood_cost(distance.by_rank(vec_of(spark, x), found), form="internal", block=13).first()[0]
    assert got == pytest.approx(cost)


@pytest.mark.parametrize("method", ["STS", "neighborhood"])
def test_restarts_above_the_local_limit_give_the_same(spark, monkeypatch, method):
    _, x = planted(40, seed=5)
    options = {"restarts": 3, "max_iter": 3}
    want = sorting.sort_best_of(vec_of(spark, x), method, **options).orderBy("rank").collect()
    monkeypatch.setattr(sorting, "LOCAL_LIMIT", 10)
    got = sorting.sort_best_of(vec_of(spark, x), method, block=16, **options).orderBy("rank").collect()
    assert [r["cell_id"] for r in got] == [r["cell_id"] for r in want]
    assert got[0]["score"] == pytest.approx(want[0]["score"])


@pytest.mark.parametrize("method", ["STS", "neighborhood"])
def test_jobs_do_not_grow_with_restarts(spark, monkeypatch, method):
    monkeypatch.setattr(sorting, "LOCAL_LIMIT", 10)
    _, x = planted(24, seed=7, noise=0.5)
    jobs = []
    for restarts in (2, 5):
        spark.sparkContext.setJobGroup(f"restarts-{method}-{restarts}", "")
        sorting.sort_best_of(vec_of(spark, x), method, restarts, max_iter=1).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"restarts-{method}-{restarts}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_keyed_sorts_are_those_of_each_key(spark):
    """Groups of unlike sizes, one of a single cell, sorted together and one by one."""
    sizes = {1: 19, 2: 8, 3: 1}
    parts, want = [], {}
    for key, n in sizes.items():
        _, x = planted(n, seed=20 + key, noise=0.3)
        vec = vec_of(spark, x)
        parts.append(vec.withColumn("w", F.lit(key)).withColumn("size", F.lit(n).cast("long")))
        for method in ("STS", "neighborhood"):
            order, cost = sorting.local_sort(distance.same_is_zero(distance.block_distance(x, x), np.arange(n), np.arange(n)), method, max_iter=3)
            names = [r["cell_id"] for r in vec.orderBy("pos").collect()]
            want[method, key] = ([names[i] for i in order], cost)
    cells = parts[0].union(parts[1]).union(parts[2])
    for method in ("STS", "neighborhood"):
        got = sorting._best_distributed(cells, ["w"], method, 1, 1.0, "Euclidean", 123, 3, 5).collect()
        for key in sizes:
            rows = sorted((r for r in got if r["w"] == key), key=lambda r: r["rank"])
            assert [r["cell_id"] for r in rows] == want[method, key][0]
            assert rows[0]["score"] == pytest.approx(want[method, key][1], abs=1e-9)


def test_refinement_above_the_local_limit_gives_the_same(spark, monkeypatch):
    _, x = planted(30, seed=6, noise=0.2)
    options = {"restarts": 2, "increment": 0.4}
    want = sorting.auto_spin(vec_of(spark, x), **options).orderBy("rank").collect()
    monkeypatch.setattr(sorting, "LOCAL_LIMIT", 14)
    got = sorting.auto_spin(vec_of(spark, x), **options).orderBy("rank").collect()
    assert [r["cell_id"] for r in got] == [r["cell_id"] for r in want]


def slow_local_variance(d, alpha, cyclic, exclusion):
    """One centre's window after another, as lists of positions from 1."""
    n, total = len(d), 0.0
    h = int(np.ceil(n * alpha) / 2)
    for i in range(1, n + 1):
        if not cyclic and not max(1, h) <= i <= n - h:
            continue
        if not cyclic:
            window = list(range(max(1, i - h), min(n, i + h) + 1))
            own = window.index(i)
        else:
            begin = (n - i if i - h < 1 else n + i) if exclusion == "positional" else n + i - h
            window = list(range(begin, n + i + h + 1))
            own = window.index(n + i)
        out = i - 1 if exclusion == "positional" else own
        kept = [d[i - 1, (q - 1) % n] for k, q in enumerate(window) if k != out]
        total += np.var(kept, ddof=1)
    return total


@pytest.mark.parametrize("data_type", ["linear", "cyclical"])
@pytest.mark.parametrize("exclusion", ["positional", "self"])
def test_local_variance_in_blocks(spark, data_type, exclusion):
    _, x = planted(37, seed=8)
    for alpha in (0.2, 0.5, 1.0 if data_type == "cyclical" else 0.7):
        want = slow_local_variance(euclid(x), alpha, data_type == "cyclical", exclusion)
        for block in (5, 64):
            assert distance.local_variance(vec_of(spark, x), alpha, data_type, exclusion=exclusion, block=block).first()[0] == pytest.approx(want)


def test_flips_in_blocks(spark):
    _, x = planted(33, seed=9)
    n, d = 33, euclid(x)
    vec = vec_of(spark, x).withColumn("w", F.explode(F.array(*[F.lit(w) for w in (4, 7, 15)])))
    got = {(r["w"], r["window"]): (r["before"], r["after"], r["flip"]) for r in sorting.flip_decisions(vec, n, block=5).collect()}
    assert len(got) == sum(n // w for w in (4, 7, 15))
    for (w, k), (before, after, flip) in got.items():
        start, end = k * w + 1, n if (k + 2) * w > n else (k + 1) * w
        border = end if k == 0 else start
        near = [p for p in range(1, n + 1) if any(int(np.floor(border - w / 2 + j)) == p and border - w / 2 + j <= border for j in range(w))]
        far = [p for p in range(border + (k == 0), n + 1) if p <= border + w / 2]
        turn = lambda p: start + end - p if start <= p <= end else p
        assert before == pytest.approx(sum(d[a - 1, b - 1] for a in near for b in far))
        assert after == pytest.approx(sum(d[turn(a) - 1, turn(b) - 1] for a in near for b in far)) and flip == (before > after)


def test_auto_spin_refines(spark):
    t, x = planted()
    assert spearman(sorting.auto_spin(vec_of(spark, x), restarts=3, increment=0.3), t) > 0.95


def test_tiny_tables_keep_an_order(spark):
    vec = vec_of(spark, np.array([[0.0], [1.0], [2.0]]))
    assert sorting.auto_spin(vec, restarts=2).count() == 3


def test_neighbours_with_duplicates(spark):
    x = np.array([[0.0], [0.0], [1.0], [5.0]])
    got = neighbours.knn(vec_of(spark, x), 2, block=2)
    first = {r["src"]: r["dst"] for r in got.where("nth = 1").collect()}
    assert first["0000"] == "0001" and first["0001"] == "0000"
    assert got.where("src = dst").count() == 0
    w = neighbours.affinity(neighbours.knn(vec_of(spark, x), 2, True), 1.0)
    assert w.where("src = '0000' AND dst = '0001'").count() == 0


def test_list_search_recall(spark):
    x = np.random.default_rng(12).normal(size=(300, 4))
    vec = vec_of(spark, x)
    exact = neighbours.knn(vec, 5)
    assert neighbours.recall(neighbours.knn_by_lists(vec, 5, 8, 8, chunk=40), exact).first()[0] == 1.0
    assert neighbours.recall(neighbours.knn_by_lists(vec, 5, 8, 4), exact).first()[0] > 0.9


def test_descent_finds_nearly_all_neighbours_with_few_pairs(spark):
    rng = np.random.default_rng(22)
    n, k, lists, probes = 2500, 8, 50, 4
    vec = vec_of(spark, rng.normal(size=(n, 3)) @ rng.normal(size=(3, 12)) + 0.2 * rng.normal(size=(n, 12)))
    found = neighbours.knn_by_descent(vec, k, lists, probes)
    assert neighbours.recall(found, neighbours.knn(vec, k)).first()[0] >= 0.9
    # Cells of probed lists, and at most twice wide * wide pairs a cell, of n / 2 pairs a cell.
    first = stored(distance.with_nearest_centroids(vec, distance.centroids_of(vec, lists), probes), "lists")
    sizes = {r["l"]: r["n"] for r in first.groupBy(F.col("lists")[0].alias("l")).agg(F.count("*").alias("n")).collect()}
    probed = sum(sizes.get(x, 0) for r in first.select("lists").collect() for x in r["lists"])
    assert (probed + n * 12 * 13 / 2) / (n * (n - 1) / 2) < 0.26
    got = found.groupBy("src").agg(F.count("*").alias("c"), F.min("nth").alias("a"), F.max("nth").alias("b")).select("c", "a", "b").distinct().collect()
    assert [tuple(r) for r in got] == [(k, 1, k)]


@pytest.mark.parametrize("tiles", [1, 2, 5])
def test_sums_do_not_depend_on_tiles(spark, monkeypatch, tiles):
    rng = np.random.default_rng(23)
    vec = vec_of(spark, rng.normal(size=(90, 4))).withColumn("x", F.col("pos") * 1.0)
    d = distance.block_distance(*[np.array([r["features"] for r in vec.orderBy("pos").collect()])] * 2)
    d[np.diag_indices(90)] = 0
    monkeypatch.setattr(distance, "tiles_of", lambda n, *_: min(n, tiles))
    monkeypatch.setattr(distance, "FOLD_ROWS", 50)
    got = {r["cell_id"]: r["s"] for r in distance.weighted_sums(vec, "x", block=9).collect()}
    assert np.allclose([got[f"{i:04d}"] for i in range(90)], d @ np.arange(1, 91))
    x = np.arange(90) - 44.5
    assert distance.sts_cost(vec, block=9).first()[0] == pytest.approx(x @ d @ x)
    near = neighbours.knn(vec, 4, block=9).orderBy("src", "nth").collect()
    want = np.argsort(d + np.diag(np.full(90, np.inf)), axis=1, kind="stable")[:, :4]
    assert [int(r["dst"]) for r in near] == want.ravel().tolist()
    assert distance.tiles_of(10**6, 1024, 64, 8) < 10**4


def test_centroid_sort_is_close_to_the_exact_one(spark):
    t, x = planted(120, seed=2)
    vec = vec_of(spark, x)
    found = sorting.sts_sort_distributed(vec, 8, centres=distance.centroids_of(vec, 30))
    assert spearman(found, t) > 0.9


def test_affinity_adds_both_directions(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0), ("a", "c", 3.0)], "src string, dst string, dist double")
    got = {(r["src"], r["dst"]): r["w"] for r in neighbours.symmetrise_sum(edges).collect()}
    assert got[("a", "b")] == 4.0 and got[("c", "a")] == 3.0


def dijkstra(edges, source, nodes):
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        for v, w in edges.get(u, []):
            if d + w < best.get(v, np.inf):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return best


def test_landmark_distances_and_unreachable_parts(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(20, 2)), rng.normal(size=(8, 2)) + 100])
    vec = vec_of(spark, x)
    edges = neighbours.knn_graph(vec, 4, 4)
    rows = {}
    for r in edges.collect():
        rows.setdefault(r["src"], []).append((r["dst"], r["w"]))
    slots = spark.createDataFrame([(0, "0000"), (1, "0003"), (2, "0025")], "slot int, cell_id string")
    got = {r["cell_id"]: r["dist"] for r in graph.landmark_distances(edges, slots, vec.select("cell_id")).collect()}
    so_far = 0.0
    for slot, source in enumerate(["0000", "0003", "0025"]):
        want = dijkstra(rows, source, got)
        so_far = max([so_far, *want.values()])
        for cell, dist in got.items():
            assert dist[slot] == pytest.approx(want.get(cell, so_far))


def test_spanning_tree_weight(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(25, 2))
    edges = neighbours.knn_graph(vec_of(spark, x), 6, 6)
    tree = graph.spanning_tree(edges)
    parent = list(range(25))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    total, count = 0.0, 0
    for r in sorted(edges.collect(), key=lambda r: r["w"]):
        a, b = find(int(r["src"])), find(int(r["dst"]))
        if a != b:
            parent[a], total, count = b, total + r["w"], count + 1
    got = tree.agg(F.sum("w"), F.count("*")).first()
    assert got[1] == count and got[0] == pytest.approx(total)


def test_tree_order_of_a_line(spark):
    t, x = planted(40, noise=0.001)
    assert spearman(pipeline.mst_order(vec_of(spark, x), 5), t) > 0.95


def test_eigenvectors_against_numpy(spark):
    rng = np.random.default_rng(8)
    a = rng.random((18, 18))
    a = (a + a.T) / 2
    rows = [(f"{i}", f"{j}", float(a[i, j])) for i in range(18) for j in range(18)]
    edges = spark.createDataFrame(rows, "src string, dst string, w double")
    nodes = spark.createDataFrame([(str(i),) for i in range(18)], "cell_id string")
    found, values, residual = graph.eigenvectors(edges, nodes, 3, steps=3)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:3]
    assert np.allclose(values, want, atol=1e-6) and residual < 1e-4
    v = {r["cell_id"]: r["v"] for r in found.collect()}
    m = np.array([v[str(i)] for i in range(18)])
    assert np.allclose(a @ m, m * values, atol=1e-3)


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(9).normal(size=(30, 4)) * [4, 2, 1, 0.5]
    c, n = linalg.covariance(vec_of(spark, x))
    assert n == 30 and np.allclose(c, np.cov(x.T))
    embedded, values = linalg.pca_embed(vec_of(spark, x), 0.9)
    assert len(values) < 4 and len(embedded.first()["features"]) == len(values)


def test_wide_tables_have_the_same_components(spark, monkeypatch):
    x = np.random.default_rng(10).normal(size=(12, 40)) * np.linspace(3, 0.1, 40)
    vec = vec_of(spark, x)
    centre = x.mean(axis=0)
    want = np.linalg.svd(x - centre, compute_uv=False) ** 2
    monkeypatch.setattr(linalg, "DRIVER_LIMIT", 20)
    values, loadings = linalg.components(vec, 12, 40, linalg.means(vec))
    assert np.allclose(values, want, atol=1e-8)
    v = loadings(0, 5)
    assert np.allclose(v.T @ v, np.eye(5)) and np.allclose((x - centre).T @ ((x - centre) @ v), v * want[:5])
    assert np.allclose(loadings(5, 8).T @ v, 0, atol=1e-8)
    monkeypatch.setattr(linalg, "DRIVER_LIMIT", 5)
    values, loadings = linalg.components(vec, 12, 40, linalg.means(vec))
    assert np.allclose(values[:11], want[:11], rtol=1e-4)
    assert np.allclose(np.abs(np.sum(loadings(0, 3) * v[:, :3], axis=0)), 1, atol=1e-3)


@pytest.mark.parametrize("limit", [5000, 15])
def test_gene_choice_does_not_depend_on_the_side_decomposed(spark, monkeypatch, limit):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(14, 30)) * rng.choice([0.1, 3], 30, p=[0.8, 0.2])
    rows = [(f"g{j:02d}", f"c{i:02d}", float(x[i, j])) for i in range(14) for j in range(30)]
    monkeypatch.setattr(linalg, "DRIVER_LIMIT", limit)
    got = {r["gene_id"]: r["score"] for r in linalg.pca_gene_selection(spark.createDataFrame(rows, "gene_id string, cell_id string, log2v double")).collect()}
    _, sizes, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)

    def cut(scores):
        y = np.sort(scores)[::-1]
        k = np.arange(len(y))
        far = np.round(np.abs((len(y) - 1) * (y - y[0]) - (y[-1] - y[0]) * k), 9)
        return y[np.argmax(far)]

    kept = sizes**2 / 13 >= cut(sizes**2 / 13) * (1 - 1e-9)
    scores = np.abs(v[kept]).sum(axis=0)
    assert set(got) == {f"g{j:02d}" for j in np.flatnonzero(scores >= cut(scores) * (1 - 1e-9))}
    assert all(got[f"g{j:02d}"] == pytest.approx(s) for j, s in enumerate(scores) if f"g{j:02d}" in got)


def test_wanderlust_follows_the_line(spark):
    t, x = planted(50, noise=0.005)
    start = f"{int(np.argmin(t)):04d}"
    order, marks = trajectory.wanderlust(vec_of(spark, x), start, l=6, k=6, num_waypoints=8, flock_rounds=1)
    assert spearman(order, t) > 0.9
    assert marks.count() == 9
    scores = [r["score"] for r in order.collect()]
    assert min(scores) == 0.0 and max(scores) == 1.0


def test_weights_add_up_to_one(spark):
    cells = spark.createDataFrame([("a", [0.0, 3.0]), ("b", [1.0, 1.0])], "cell_id string, dist array<double>")
    for scheme in ("uniform", "exponential", "linear"):
        for r in trajectory.landmark_weights(cells, scheme).collect():
            assert sum(r["weight"]) == pytest.approx(1.0)


def test_spline_test_finds_trends(spark):
    n, rng = 40, np.random.default_rng(4)
    rows = []
    for g, curve in {"up": lambda t: 10 ** (2 * t + 0.5), "flat": lambda t: 10.0}.items():
        rows += [(g, f"{i:04d}", float(curve(i / (n - 1)) * np.exp(rng.normal(0, 0.1))), i + 1) for i in range(n)]
    rows += [("constant", f"{i:04d}", 5.0, i + 1) for i in range(n)]
    expr = spark.createDataFrame(rows, "gene_id string, cell_id string, value double, pseudotime long")
    got = {r["gene_id"]: r for r in drivers.spline_test(expr, n).collect()}
    assert got["up"]["pval"] < 1e-6 < 0.01 < got["flat"]["pval"]
    assert got["constant"]["status"] == "FAIL" and got["constant"]["pval"] == 1.0
    y = np.log10([r[2] for r in rows if r[0] == "up"])
    basis = np.vstack([np.ones(n), drivers.spline(spark, n).columns(np.arange(1, n + 1))])
    fit = basis.T @ np.linalg.lstsq(basis.T, y, rcond=None)[0]
    lrt = n * np.log(((y - y.mean()) ** 2).sum() / ((y - fit) ** 2).sum())
    assert got["up"]["lrt"] == pytest.approx(lrt, rel=1e-6)
    assert got["up"]["linear_driving_force"] == pytest.approx(abs(fit[0] - fit[-1]), rel=1e-6)
    assert got["up"]["cyclic_driving_force"] == pytest.approx(np.ptp(fit), rel=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 501])
def test_range_of_the_fit_is_that_over_all_ranks(spark, n):
    basis = drivers.spline(spark, n)
    q = np.array(basis.columns(np.arange(1.0, n + 1)))
    assert np.allclose(q.sum(axis=1), 0, atol=1e-9) and np.allclose(q @ q.T, np.diag(basis.norms), atol=1e-9)
    rng = np.random.default_rng(n)
    b = np.concatenate([rng.normal(size=(60, 3)), np.eye(3), -np.eye(3), np.zeros((1, 3)), rng.normal(size=(20, 3)) * [1, 1e-9, 0]])
    rows = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(b)], "id int, b1 double, b2 double, b3 double")
    got = [r["r"] for r in rows.select("id", drivers.fit_range(basis).alias("r")).orderBy("id").collect()]
    assert np.allclose(got, np.ptp(b @ q, axis=1), atol=1e-12)


def test_adjusted_p_values_and_elbow_do_not_depend_on_the_size_limit(spark):
    rng = np.random.default_rng(14)
    p = [None if k % 11 == 0 else float(np.round(rng.random() ** 3, 3)) for k in range(400)]
    table = spark.createDataFrame([(f"g{k:03d}", x) for k, x in enumerate(p)], "gene_id string, pval double").repartition(5)
    by_window, by_parts = ({r["gene_id"]: r["qval"] for r in stats.benjamini_hochberg(table, few=f).collect()} for f in (10**5, 10))
    some = sorted(x for x in p if x is not None)
    least = np.minimum.accumulate((np.array(some) * len(some) / np.arange(1, len(some) + 1))[::-1])[::-1]
    want = dict(zip(some[::-1], least[::-1]))
    assert by_window == by_parts and all(by_window[f"g{k:03d}"] == (None if x is None else pytest.approx(min(1, want[x]))) for k, x in enumerate(p))
    scores = spark.createDataFrame([(f"g{k:03d}", float(np.round(x, 1))) for k, x in enumerate(rng.exponential(3, 300))], "gene_id string, score double").repartition(5)
    kept = [sorted(r["gene_id"] for r in stats.elbow(scores, few=f).collect()) for f in (10**5, 10)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < 300


def test_global_rank_has_no_gaps(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    ranks = [r["rank"] for r in matrix.global_rank(df, ["x", "id"]).orderBy("x", "id").collect()]
    assert ranks == list(range(1, 1001))


def test_unknown_method_is_refused(spark):
    with pytest.raises(ValueError):
        pipeline.order_cells(vec_of(spark, np.zeros((2, 2))), "nothing")
