"""Queries of distances, neighbours, orderings and trajectories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.runtime import scratch_path, stored
from strandline.operators import clusters, distance, graph, linalg, matrix, neighbours, sorting, trajectory
from strandline.operators import quality_control as qc
from strandline.operators.drivers import regression_sums, spline
from strandline.plans import pipeline
from strandline.plans.fixtures import cell_types, dense_expr, supplier_order, vector_expr, vector_order, vectors
from strandline.plans.qc_queries import ORDER, X1, rounded
from strandline.sources.tables import RESULT_TABLES, write_results

ABS = "(SELECT CAST(vec_id AS VARCHAR) AS cell_id, row_number() OVER (ORDER BY vec_id) AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)"
VEC = f"vec AS MATERIALIZED {ABS}, n AS (SELECT count(*) AS n FROM vec)"
PAIRS = f"""{VEC}, pairs AS MATERIALIZED (SELECT a.cell_id AS i, b.cell_id AS j, a.pos AS pi, b.pos AS pj,
  CASE WHEN a.pos = b.pos THEN 0 ELSE sqrt(abs(list_dot_product(a.f, a.f) - 2 * list_dot_product(a.f, b.f) + list_dot_product(b.f, b.f))) END AS d
  FROM vec a CROSS JOIN vec b)"""
RANKED = f"""base AS MATERIALIZED {ABS}, vec AS MATERIALIZED (SELECT cell_id, row_number() OVER (ORDER BY f[1], pos) AS pos, f FROM base), n AS (SELECT count(*) AS n FROM vec)"""


def distance_euclidean(spark, sf_dir):
    return rounded(distance.pairwise_distance(vectors(spark, sf_dir)), 5)


def distance_correlation(spark, sf_dir):
    return rounded(distance.pairwise_distance(vectors(spark, sf_dir), "Correlation"), 5)


def distance_ejaccard(spark, sf_dir):
    return rounded(distance.pairwise_distance(vectors(spark, sf_dir), "eJaccard"), 5)


def distance_none(spark, sf_dir):
    given = distance.pairwise_distance(vectors(spark, sf_dir)).where("d < 1.2")
    return rounded(distance.pairwise_distance(given, "none"), 5)


def _ordered(spark, sf_dir):
    return distance.by_rank(vectors(spark, sf_dir), vector_order(spark, sf_dir))


def sts_cost(spark, sf_dir):
    return rounded(distance.sts_cost(_ordered(spark, sf_dir)), 2)


def neighborhood_cost(spark, sf_dir):
    vec = _ordered(spark, sf_dir)
    a = distance.neighbourhood_cost(vec).select(F.lit("reported").alias("form"), "cost")
    return rounded(a.union(distance.neighbourhood_cost(vec, form="internal").select(F.lit("internal"), "cost")), 3)


def distance_grid(spark, sf_dir):
    return rounded(distance.distance_grid(_ordered(spark, sf_dir), 8), 5)


def local_variance_linear(spark, sf_dir):
    return rounded(distance.local_variance(_ordered(spark, sf_dir), 0.1), 5)


def local_variance_cyclic(spark, sf_dir):
    return rounded(distance.local_variance(_ordered(spark, sf_dir), 0.1, "cyclical"), 5)


def knn(spark, sf_dir):
    return rounded(neighbours.knn(vectors(spark, sf_dir), 10), 5).withColumn("nth", F.col("nth").cast("long"))


def knn_graph(spark, sf_dir):
    return rounded(neighbours.knn_graph(vectors(spark, sf_dir), 15, 8), 5)


def affinity(spark, sf_dir):
    vec = vectors(spark, sf_dir)
    return rounded(neighbours.affinity(neighbours.knn(vec, 10, True), 1.0, vec), 5)


def weighted_degree(spark, sf_dir):
    vec = vectors(spark, sf_dir)
    return rounded(neighbours.weighted_degree(neighbours.affinity(neighbours.knn(vec, 10, True), 1.0, vec)), 5)


def knn_block_recall(spark, sf_dir):
    """Small blocks against one block: the search is exact, so the recall is 1."""
    vec = vectors(spark, sf_dir)
    return neighbours.recall(neighbours.knn(vec, 10, block=128), neighbours.knn(vec, 10))


def knn_list_recall(spark, sf_dir):
    """Recall of the search in half of the centroid lists against the exact one, on the first ten principal components."""
    vec = stored(linalg.pca_embed(vectors(spark, sf_dir), 10)[0], "embedded")
    return neighbours.recall(neighbours.nearest(vec, 10, lists=16, probes=8), neighbours.knn(vec, 10))


def knn_descent_recall(spark, sf_dir):
    """Recall of neighbour descent from four of as many lists as the square root of the cells, on the first ten principal components."""
    vec = stored(linalg.pca_embed(vectors(spark, sf_dir), 10)[0], "embedded")
    lists = max(4, round(vec.count() ** 0.5))
    return neighbours.recall(neighbours.nearest(vec, 10, lists=lists), neighbours.knn(vec, 10))


def sts_sort_centroids(spark, sf_dir):
    """The distributed sort with sums over 64 centroids."""
    vec = _ordered(spark, sf_dir)
    return sorting.sts_sort_distributed(vec, centres=distance.centroids_of(vec, 64))


def sts_round(spark, sf_dir):
    found = sorting.sts_round(_ordered(spark, sf_dir), block=256)
    return rounded(found.select("cell_id", "pos", F.col("next").alias("next_rank"), "s"), 4)


def _given(vec):
    """All distances as a table that is supplied to what follows, which reads it once as it is made, and the order without features."""
    vec = stored(vec, "ordered")
    return distance.pairwise_distance(vec), vec.select("cell_id", "pos")


def sts_round_given(spark, sf_dir):
    """The round by a supplied distance table."""
    pairs, cells = _given(_ordered(spark, sf_dir))
    found = sorting.sts_round(cells, pairs=pairs)
    return rounded(found.select("cell_id", "pos", F.col("next").alias("next_rank"), "s"), 4)


def sts_cost_given(spark, sf_dir):
    """The cost by a supplied distance table."""
    pairs, cells = _given(_ordered(spark, sf_dir))
    return rounded(distance.sts_cost_of_pairs(pairs, cells.withColumnRenamed("pos", "rank")), 2)


def sts_sort(spark, sf_dir):
    return sorting.sts_sort_distributed(_ordered(spark, sf_dir), block=256)


def neighborhood_sort(spark, sf_dir):
    return sorting.sort_best_of(vectors(spark, sf_dir), "neighborhood")


def spin(spark, sf_dir):
    return sorting.spin(vectors(spark, sf_dir))


def best_of_restarts(spark, sf_dir):
    return rounded(sorting.sort_best_of(vectors(spark, sf_dir)), 2)


def window_assign(spark, sf_dir):
    order = vector_order(spark, sf_dir)
    n = order.count()
    return sorting.assign_windows(order, n, sorting.window_sizes(n)).select("cell_id", "rank", F.col("w").cast("long").alias("w"), F.col("window").cast("long").alias("window"))


def flip_decision(spark, sf_dir):
    vec = _ordered(spark, sf_dir)
    n = vec.count()
    sizes = sorting.window_sizes(n)
    sized = vec.withColumn("w", F.explode(F.array(*[F.lit(s) for s in sizes])))
    found = sorting.flip_decisions(sized, n)
    return rounded(found.select(F.col("w").cast("long").alias("w"), F.col("window").cast("long").alias("window"), "before", "after"), 3)


def auto_spin(spark, sf_dir):
    return sorting.auto_spin(vectors(spark, sf_dir))


def gene_covariance(spark, sf_dir):
    vec, genes = matrix.to_vectors(qc.log2_floor(dense_expr(spark, sf_dir)))
    return rounded(linalg.gene_covariance(vec, genes), 6)


def regression_sums_query(spark, sf_dir):
    aligned = matrix.with_pseudotime(dense_expr(spark, sf_dir), supplier_order(spark, sf_dir))
    return rounded(regression_sums(aligned, spline(spark, supplier_order(spark, sf_dir).count())).select("gene_id", "mean", "rss0"), 6)


def pca_genes(spark, sf_dir):
    return linalg.pca_gene_selection(qc.log2_floor(vector_expr(spark, sf_dir)))


def pca_embed(spark, sf_dir):
    return linalg.pca_embed(vectors(spark, sf_dir), 0.5)[0]


def long_to_vector(spark, sf_dir):
    vec, genes = matrix.to_vectors(dense_expr(spark, sf_dir), "value")
    return matrix.to_long(vec).join(genes, "gene_idx").select("cell_id", "pos", "gene_id", "value")


def waypoints(spark, sf_dir):
    return trajectory.sample_waypoints(vectors(spark, sf_dir), 40, 2).select(F.col("nth").cast("long").alias("nth"), "cell_id")


def flock(spark, sf_dir):
    vec = vectors(spark, sf_dir)
    return trajectory.flock(vec, trajectory.sample_waypoints(vec, 20, 2), 1).select(F.col("nth").cast("long").alias("nth"), "cell_id")


def _graph_and_slots(spark, sf_dir, count=5):
    vec = vectors(spark, sf_dir)
    slots, _ = trajectory.landmark_slots("0", None, trajectory.sample_waypoints(vec, count, 2))
    return vec, neighbours.knn_graph(vec, 10, 10), slots


def landmark_distances(spark, sf_dir):
    vec, edges, slots = _graph_and_slots(spark, sf_dir)
    found = graph.landmark_distances(edges, slots, vec.select("cell_id"))
    flat = found.select("cell_id", F.posexplode("dist").alias("slot", "d"))
    return rounded(flat.withColumn("slot", F.col("slot").cast("long")), 5)


def _measured(spark, sf_dir):
    """cell_lm straight from distances to five cells, for weights and realignment."""
    vec = vectors(spark, sf_dir)
    marks = trajectory.sample_waypoints(vec, 5, 2)
    cells = neighbours.distances_to(vec, marks.join(vec, "cell_id").select(F.col("nth").alias("query"), "features"))
    return cells, marks.select(F.col("nth").alias("slot"), "cell_id")


def landmark_weights(spark, sf_dir):
    cells, _ = _measured(spark, sf_dir)
    flat = trajectory.landmark_weights(cells).select("cell_id", F.posexplode("weight").alias("slot", "weight"))
    return rounded(flat.withColumn("slot", F.col("slot").cast("long")), 5)


def realign_once(spark, sf_dir):
    cells, slots = _measured(spark, sf_dir)
    found = trajectory.realign(cells.withColumn("t", F.col("dist")[0]), slots, "t", 1)
    flat = found.select("cell_id", F.posexplode("traj").alias("slot", "position"))
    return rounded(flat.withColumn("slot", F.col("slot").cast("long")), 5)


def band_sample(spark, sf_dir):
    cells, _ = _measured(spark, sf_dir)
    return trajectory.band_sample(cells.select("cell_id", F.col("dist")[0].alias("d")), 30).withColumn("nth", F.col("nth").cast("long"))


def diffusion_map(spark, sf_dir):
    return trajectory.diffusion_map(vectors(spark, sf_dir), "massCyt")[0]


def wanderlust(spark, sf_dir):
    return trajectory.wanderlust(vectors(spark, sf_dir), "0", seed=2)[0]


def wanderlust_waypoints(spark, sf_dir):
    return trajectory.wanderlust(vectors(spark, sf_dir), "0", num_waypoints=40, seed=2, num_graphs=2, banded=True, partial_order=["7", "3"], k=10, lists=16)[1]


def wanderlust_expr(spark, sf_dir):
    shifted = vectors(spark, sf_dir).withColumn("features", F.transform("features", lambda x: x + 1.0))
    return trajectory.wanderlust_expr(shifted, "0", num_waypoints=20)[0]


def swanderlust(spark, sf_dir):
    shifted = vectors(spark, sf_dir).withColumn("features", F.transform("features", lambda x: x + 1.0))
    return trajectory.swanderlust(shifted, restarts=2, num_waypoints=20)


def mst_order(spark, sf_dir):
    return pipeline.mst_order(vectors(spark, sf_dir))


def order_cells_none(spark, sf_dir):
    return pipeline.order_cells(vectors(spark, sf_dir), "none")


def cluster_genes(spark, sf_dir):
    profiles = matrix.row_zscore(qc.log2_floor(dense_expr(spark, sf_dir)))
    return clusters.cluster_genes(profiles, qc.count_of(profiles, "cell_id"))


def two_pass_pipeline(spark, sf_dir):
    """The pipeline's seven tables, written and read back: rows and columns of each."""
    quick = {"restarts": 2, "increment": 0.4}
    tables = pipeline.run_pipeline(vector_expr(spark, sf_dir), preliminary_options=quick, refined_options=quick, driver_options={"qval": 0.5})
    folder = write_results(tables, scratch_path(spark, "results"), "run")
    out = None
    for name in RESULT_TABLES:
        table = spark.read.parquet(f"{folder}/{name}")
        row = table.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(",".join(table.columns)).alias("columns"))
        out = row if out is None else out.union(row)
    return out


def cell_type_counts(spark, sf_dir):
    """Cells of each type in each tenth of the order."""
    order = matrix.annotate(vector_order(spark, sf_dir), cell_types(spark, sf_dir))
    n = order.count()
    tenth = F.floor((F.col("rank") - 1) * 10 / n).cast("long").alias("tenth")
    return order.groupBy(tenth, "group_id").agg(F.count("*").alias("n_cells"))


_WEIGHTS = f"""{RANKED}, idx AS (SELECT pos - 1 AS p FROM vec),
g0 AS (SELECT i.p AS i, j.p AS j, exp(-pow(i.p - j.p, 2) / n) AS g FROM idx i CROSS JOIN idx j, n)"""


def _weights_sql() -> str:
    """Weights normalised by columns and rows ten times, as chained CTEs."""
    parts = [_WEIGHTS]
    for k in range(10):
        parts.append(f"c{k} AS MATERIALIZED (SELECT i, j, g / sum(g) OVER (PARTITION BY j) AS g FROM g{k})")
        parts.append(f"g{k + 1} AS MATERIALIZED (SELECT i, j, g / sum(g) OVER (PARTITION BY i) AS g FROM c{k})")
    parts.append("w AS MATERIALIZED (SELECT a.i, a.j, (a.g + b.g) / 2 AS w FROM g10 a JOIN g10 b ON a.i = b.j AND a.j = b.i)")
    parts.append("""d AS MATERIALIZED (SELECT a.pos - 1 AS i, b.pos - 1 AS j, CASE WHEN a.pos = b.pos THEN 0
  ELSE sqrt(abs(list_dot_product(a.f, a.f) - 2 * list_dot_product(a.f, b.f) + list_dot_product(b.f, b.f))) END AS d FROM vec a CROSS JOIN vec b)""")
    return ", ".join(parts)


_RANKED_PAIRS = f"""{RANKED}, d AS MATERIALIZED (SELECT a.cell_id, a.pos AS pi, b.pos AS pj, CASE WHEN a.pos = b.pos THEN 0
  ELSE sqrt(abs(list_dot_product(a.f, a.f) - 2 * list_dot_product(a.f, b.f) + list_dot_product(b.f, b.f))) END AS d FROM vec a CROSS JOIN vec b)"""
_HALF = "h AS (SELECT n, CAST(floor(ceil(n * 0.1) / 2) AS BIGINT) AS h FROM n)"
_KNN = """nn AS MATERIALIZED (SELECT i AS src, j AS dst, d AS dist, row_number() OVER (PARTITION BY i ORDER BY d, pj) AS nth FROM pairs WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, pj) <= {k})"""
_AFFINITY = f"""{PAIRS}, {_KNN.format(where="true", k=10)}, one AS (SELECT src, dst, dist AS w FROM nn WHERE src <> dst),
  s AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM one UNION ALL SELECT dst, src, w FROM one) GROUP BY 1, 2 HAVING sum(w) > 0),
  aff AS (SELECT src, dst, exp(-w) AS w FROM s UNION ALL SELECT cell_id, cell_id, 1.0 FROM vec)"""
_MARKS = "marks AS (SELECT cell_id, row_number() OVER (ORDER BY md5('2:' || cell_id), cell_id) - 1 AS nth FROM vec QUALIFY nth < {k})"
_DIST5 = f"""{PAIRS}, {_MARKS.format(k=5)}, lm AS MATERIALIZED (SELECT i AS cell_id, nth AS slot, d AS dist FROM pairs JOIN marks ON j = marks.cell_id)"""



def _sts_sql(base: str, rounds: int = 10, restarts: int = 1) -> str:
    """CTEs of side-to-side sorts, rounds unrolled: last(t, cell_id, r) of each restart t, and best(t, cost).

    Each round ranks by falling s, ties by the rank before; a restart stops after the round in which s in the new order equals s taken
    by the previous round's permutation.
    """
    start = "CASE WHEN t = 0 THEN lpad(CAST(pos AS VARCHAR), 20, '0') ELSE md5('123:' || t || ':' || cell_id) END"
    parts = [base, f"""d AS MATERIALIZED (SELECT a.pos AS pi, b.pos AS pj, CASE WHEN a.pos = b.pos THEN 0
  ELSE sqrt(abs(list_dot_product(a.f, a.f) - 2 * list_dot_product(a.f, b.f) + list_dot_product(b.f, b.f))) END AS d FROM vec a CROSS JOIN vec b)"""]
    parts.append(f"""r0 AS MATERIALIZED (SELECT t, pos AS id, cell_id, row_number() OVER (PARTITION BY t ORDER BY {start}) AS r, 0 AS prev, false AS done
  FROM vec, range(0, {restarts}) s(t))""")
    for k in range(rounds):
        parts.append(f"s{k} AS MATERIALIZED (SELECT o.t, d.pi AS id, sum(d.d * (o.r - (n + 1) / 2)) AS s FROM d JOIN r{k} o ON o.id = d.pj, n GROUP BY 1, 2)")
        before = "r" if k == 0 else "prev"
        parts.append(f"n{k} AS MATERIALIZED (SELECT t, id, cell_id, r, {before} AS prev, done, s, row_number() OVER (PARTITION BY t ORDER BY s DESC, r) AS nxt FROM r{k} JOIN s{k} USING (t, id))")
        parts.append(f"""g{k} AS MATERIALIZED (SELECT a.t, sum(abs(a.s - c.s)) <= 1.5e-8 * sum(abs(a.s)) AS same
  FROM n{k} a JOIN n{k} b ON b.t = a.t AND b.r = a.nxt JOIN n{k} c ON c.t = b.t AND c.r = b.prev GROUP BY 1)""")
        parts.append(f"""r{k + 1} AS MATERIALIZED (SELECT t, id, cell_id, CASE WHEN done THEN r ELSE nxt END AS r, CASE WHEN done THEN prev ELSE r END AS prev,
  done OR same AS done FROM n{k} JOIN g{k} USING (t))""")
    parts.append(f"last AS (SELECT t, id, cell_id, r FROM r{rounds})")
    if restarts > 1:
        parts.append("""costs AS MATERIALIZED (SELECT a.t, sum(d.d * (a.r - (n + 1) / 2) * (b.r - (n + 1) / 2)) AS cost FROM d JOIN last a ON a.id = d.pi
  JOIN last b ON b.t = a.t AND b.id = d.pj, n GROUP BY 1)""")
        parts.append("best AS (SELECT t, cost FROM costs WHERE cost <= (SELECT min(cost) + 1e-9 * abs(min(cost)) FROM costs) ORDER BY t LIMIT 1)")
    return "WITH " + ", ".join(parts)


def _relaxed_sql(rounds: int) -> str:
    """Shortest distances from landmarks by unrolled relaxation over the neighbour graph."""
    parts = [PAIRS, _KNN.format(where="i <> j", k=10), _MARKS.format(k=5)]
    parts.append("""e AS MATERIALIZED (SELECT src, dst, max(dist) AS w FROM (SELECT src, dst, dist FROM nn UNION ALL SELECT dst, src, dist FROM nn) GROUP BY 1, 2)""")
    parts.append("t0 AS MATERIALIZED (SELECT '0' AS cell_id, 0 AS slot, 0.0::DOUBLE AS d UNION ALL SELECT cell_id, nth + 1, 0.0 FROM marks)")
    for k in range(rounds):
        parts.append(f"""t{k + 1} AS MATERIALIZED (SELECT cell_id, slot, min(d) AS d FROM (SELECT * FROM t{k}
          UNION ALL SELECT e.dst, t.slot, t.d + e.w FROM t{k} t JOIN e ON e.src = t.cell_id) GROUP BY 1, 2)""")
    return f"""WITH {', '.join(parts)}, top AS (SELECT slot, max(max(d)) OVER (ORDER BY slot) AS m FROM t{rounds} GROUP BY 1)
      SELECT v.cell_id, CAST(top.slot AS BIGINT) AS slot, round(coalesce(t.d, top.m), 5) AS d FROM vec v CROSS JOIN top LEFT JOIN t{rounds} t ON t.cell_id = v.cell_id AND t.slot = top.slot"""


def _band_sample_sql() -> str:
    bands, upper = [], 0.998
    while upper > 0.08:
        bands.append(f"({len(bands)}, {upper - 0.1!r}::DOUBLE, {upper!r}::DOUBLE)")
        upper -= 0.1
    return f"""WITH {_DIST5}, near AS (SELECT cell_id, dist AS d FROM lm WHERE slot = 0), bands(band, low, high) AS (VALUES {", ".join(bands)}),
  inside AS (SELECT band, cell_id FROM near JOIN bands ON d BETWEEN low * (SELECT max(d) FROM near) AND high * (SELECT max(d) FROM near)),
  pool AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY band ORDER BY md5('123:' || band || ':' || cell_id)) <= 30)
  SELECT row_number() OVER (ORDER BY md5('124:' || band || ':' || cell_id), band, cell_id) - 1 AS nth, cell_id FROM pool QUALIFY nth < 30"""


BY_NAME = {
    "distance_euclidean": (distance_euclidean, f"WITH {PAIRS} SELECT i, j, round(d, 5) AS d FROM pairs WHERE pi < pj"),
    "distance_correlation": (distance_correlation, f"""WITH {VEC}, c AS (SELECT cell_id, pos, list_transform(f, lambda x: x - list_avg(f)) AS f FROM vec)
  SELECT a.cell_id AS i, b.cell_id AS j, round(1 - list_dot_product(a.f, b.f) / sqrt(list_dot_product(a.f, a.f) * list_dot_product(b.f, b.f)), 5) AS d FROM c a JOIN c b ON a.pos < b.pos"""),
    "distance_ejaccard": (distance_ejaccard, f"""WITH {VEC} SELECT a.cell_id AS i, b.cell_id AS j, round(1 - list_dot_product(a.f, b.f) /
  (list_dot_product(a.f, a.f) + list_dot_product(b.f, b.f) - list_dot_product(a.f, b.f)), 5) AS d FROM vec a JOIN vec b ON a.pos < b.pos"""),
    "distance_none": (distance_none, f"WITH {PAIRS} SELECT i, j, round(d, 5) AS d FROM pairs WHERE pi < pj AND d < 1.2"),
    "sts_cost": (sts_cost, f"WITH {_RANKED_PAIRS} SELECT round(sum(d * (pi - (n + 1) / 2) * (pj - (n + 1) / 2)), 2) AS cost FROM d, n"),
    "sts_cost_given": (sts_cost_given, f"WITH {_RANKED_PAIRS} SELECT round(sum(d * (pi - (n + 1) / 2) * (pj - (n + 1) / 2)), 2) AS cost FROM d, n"),
    "neighborhood_cost": (neighborhood_cost, f"""WITH {_weights_sql()}, band AS MATERIALIZED (SELECT * FROM w WHERE w > 1e-9),
  ww AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.w * b.w) AS w FROM band a JOIN band b ON a.j = b.j GROUP BY 1, 2)
  SELECT 'reported' AS form, round(sum(d * w), 3) AS cost FROM d JOIN ww USING (i, j)
  UNION ALL SELECT 'internal', round(sum(d * w), 3) FROM d JOIN w USING (i, j)"""),
    "distance_grid": (distance_grid, f"WITH {_RANKED_PAIRS} SELECT CAST((pi - 1) * 8 // n AS INTEGER) AS row, CAST((pj - 1) * 8 // n AS INTEGER) AS column, round(avg(d), 5) AS mean_distance FROM d, n GROUP BY 1, 2".replace("AS column", 'AS "column"').replace("AS row,", 'AS "row",')),
    "local_variance_linear": (local_variance_linear, f"""WITH {_RANKED_PAIRS}, {_HALF}, centres AS (SELECT pi, pj, d, greatest(1, pi - h) AS s, row_number() OVER (PARTITION BY pi ORDER BY pj) AS k
  FROM d, h WHERE pi BETWEEN h AND n - h AND pi >= 1 AND pj BETWEEN greatest(1, pi - h) AND least(n, pi + h))
  SELECT round(sum(v), 5) AS local_variance FROM (SELECT pi, var_samp(d) AS v FROM centres WHERE k <> pi GROUP BY 1)"""),
    "local_variance_cyclic": (local_variance_cyclic, f"""WITH {_RANKED_PAIRS}, {_HALF}, ext AS (SELECT pi, pj + k * n AS q, d FROM d, n, range(0, 3) r(k)),
  win AS (SELECT pi, d, row_number() OVER (PARTITION BY pi ORDER BY q) AS k FROM ext, h
    WHERE q BETWEEN CASE WHEN pi - h < 1 THEN n - pi ELSE n + pi END AND n + pi + h)
  SELECT round(sum(v), 5) AS local_variance FROM (SELECT pi, var_samp(d) AS v FROM win WHERE k <> pi GROUP BY 1)"""),
    "knn": (knn, f"WITH {PAIRS}, {_KNN.format(where='i <> j', k=10)} SELECT src, dst, round(dist, 5) AS dist, nth FROM nn"),
    "knn_graph": (knn_graph, f"""WITH {PAIRS}, {_KNN.format(where='i <> j', k=15)},
  pick AS (SELECT src, dst, dist FROM nn QUALIFY row_number() OVER (PARTITION BY src ORDER BY md5('123:' || src || ':' || dst)) <= 8)
  SELECT src, dst, round(max(dist), 5) AS w FROM (SELECT * FROM pick UNION ALL SELECT dst, src, dist FROM pick) GROUP BY 1, 2"""),
    "affinity": (affinity, f"WITH {_AFFINITY} SELECT src, dst, round(w, 5) AS w FROM aff"),
    "weighted_degree": (weighted_degree, f"WITH {_AFFINITY} SELECT src AS cell_id, round(sum(w), 5) AS degree, round(1 / sum(w), 5) AS inverse FROM aff GROUP BY 1"),
    "knn_block_recall": (knn_block_recall, None),
    "knn_list_recall": (knn_list_recall, None),
    "knn_descent_recall": (knn_descent_recall, None),
    "sts_sort_centroids": (sts_sort_centroids, None),
    "sts_round": (sts_round, f"""WITH {_RANKED_PAIRS}, s AS (SELECT cell_id, pi AS pos, sum(d * (pj - (n + 1) / 2)) AS s FROM d, n GROUP BY 1, 2)
  SELECT cell_id, pos, row_number() OVER (ORDER BY s DESC, pos) AS next_rank, round(s, 4) AS s FROM s"""),
    "sts_round_given": (sts_round_given, f"""WITH {_RANKED_PAIRS}, s AS (SELECT cell_id, pi AS pos, sum(d * (pj - (n + 1) / 2)) AS s FROM d, n GROUP BY 1, 2)
  SELECT cell_id, pos, row_number() OVER (ORDER BY s DESC, pos) AS next_rank, round(s, 4) AS s FROM s"""),
    "sts_sort": (sts_sort, f"{_sts_sql(RANKED)} SELECT cell_id, r AS rank FROM last"),
    "neighborhood_sort": (neighborhood_sort, None),
    "spin": (spin, f"{_sts_sql(VEC)} SELECT cell_id, r AS rank, 'untitled' AS group_id FROM last"),
    "best_of_restarts": (best_of_restarts, f"{_sts_sql(VEC, restarts=10)} SELECT cell_id, r AS rank, round(cost, 2) AS score FROM last JOIN best USING (t)"),
    "window_assign": (window_assign, """WITH o AS (SELECT CAST(vec_id AS VARCHAR) AS cell_id, row_number() OVER (ORDER BY CAST(embedding[1] AS DOUBLE), vec_id) AS rank, count(*) OVER () AS n FROM embeddings),
  s AS (SELECT o.*, CAST(ceil(0.1 * n) + k * ceil(n * 0.05) AS BIGINT) AS w FROM o, range(0, 40) r(k) WHERE ceil(0.1 * n) + k * ceil(n * 0.05) < ceil(n * 0.9))
  SELECT cell_id, rank, w, CAST(least((rank - 1) // w, n // w - 1) AS BIGINT) AS window FROM s""".replace("AS window FROM", 'AS "window" FROM')),
    "flip_decision": (flip_decision, f"""WITH {_RANKED_PAIRS}, sizes AS (SELECT CAST(ceil(0.1 * n) + k * ceil(n * 0.05) AS BIGINT) AS w, n FROM n, range(0, 40) r(k) WHERE ceil(0.1 * n) + k * ceil(n * 0.05) < ceil(n * 0.9)),
  wins AS (SELECT w, n, i, (i - 1) * w + 1 AS a, CASE WHEN i * w > n OR (i + 1) * w > n THEN n ELSE i * w END AS b, w * 0.5 AS o
    FROM sizes, range(1, 50) r(i) WHERE i <= n // w AND n // w > 1),
  rowset AS (SELECT w, i, a, b, CAST(floor(CASE WHEN i = 1 THEN b - o ELSE a - o END + k) AS BIGINT) AS p FROM wins, range(0, 3000) r(k) WHERE k <= o),
  colset AS (SELECT w, i, a, b, CAST(CASE WHEN i = 1 THEN b + 1 ELSE a END + k AS BIGINT) AS q FROM wins, range(0, 3000) r(k) WHERE k <= CASE WHEN i = 1 THEN o - 1 ELSE o END),
  cells AS (SELECT r.w, r.i, p, q, CASE WHEN p BETWEEN r.a AND r.b THEN r.a + r.b - p ELSE p END AS tp, CASE WHEN q BETWEEN r.a AND r.b THEN r.a + r.b - q ELSE q END AS tq
    FROM rowset r JOIN colset c ON r.w = c.w AND r.i = c.i)
  SELECT w, CAST(i - 1 AS BIGINT) AS window, round(sum(x.d), 3) AS before, round(sum(y.d), 3) AS after FROM cells
  JOIN d x ON x.pi = p AND x.pj = q JOIN d y ON y.pi = tp AND y.pj = tq GROUP BY 1, 2""".replace("AS window,", 'AS "window",')),
    "auto_spin": (auto_spin, None),
    "gene_covariance": (gene_covariance, f"""WITH {X1}, l AS (SELECT gene_id, cell_id, log2(greatest(value, 1.0)) AS v FROM dense)
  SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, round(covar_samp(a.v, b.v), 6) + 0.0 AS covariance FROM l a JOIN l b ON a.cell_id = b.cell_id AND a.gene_id <= b.gene_id GROUP BY 1, 2"""),
    "regression_sums": (regression_sums_query, f"""WITH {X1}, {ORDER}, n AS (SELECT count(*) AS n FROM ordered), y AS (SELECT gene_id, log10(greatest(value, 1.0)) AS y FROM dense)
  SELECT gene_id, round(sum(y) / any_value(n), 6) AS mean, round(sum(y * y) - sum(y) * sum(y) / any_value(n), 6) AS rss0 FROM y, n GROUP BY 1"""),
    "pca_genes": (pca_genes, None),
    "pca_embed": (pca_embed, None),
    "long_to_vector": (long_to_vector, f"""WITH {X1} SELECT cell_id, dense_rank() OVER (ORDER BY cell_id) AS pos, gene_id, value FROM dense"""),
    "waypoints": (waypoints, f"WITH {VEC}, {_MARKS.format(k=40)} SELECT nth, cell_id FROM marks"),
    "flock": (flock, f"""WITH {PAIRS}, {_MARKS.format(k=20)}, near AS (SELECT nth, j FROM pairs JOIN marks ON i = marks.cell_id QUALIFY row_number() OVER (PARTITION BY nth ORDER BY d, pj) <= 20),
  flat AS (SELECT nth, k, f[k] AS x FROM near JOIN vec ON j = cell_id, range(1, 65) r(k)),
  med AS (SELECT nth, list(m ORDER BY k) AS f FROM (SELECT nth, k, median(x) AS m FROM flat GROUP BY 1, 2) GROUP BY 1)
  SELECT nth, cell_id FROM med JOIN vec ON true QUALIFY row_number() OVER (PARTITION BY nth ORDER BY
    sqrt(abs(list_dot_product(med.f, med.f) - 2 * list_dot_product(med.f, vec.f) + list_dot_product(vec.f, vec.f))), pos) = 1"""),
    "landmark_distances": (landmark_distances, _relaxed_sql(24)),
    "landmark_weights": (landmark_weights, f"""WITH {_DIST5}, sd AS (SELECT 3 * avg(s) AS sdv FROM (SELECT cell_id, stddev_pop(dist) AS s FROM lm GROUP BY 1)),
  raw AS (SELECT cell_id, slot, exp(-0.5 * pow(dist / sdv, 2)) AS w FROM lm, sd) SELECT cell_id, slot, round(w / sum(w) OVER (PARTITION BY cell_id), 5) AS weight FROM raw"""),
    "realign_once": (realign_once, f"""WITH {_DIST5}, t AS (SELECT cell_id, dist AS t FROM lm WHERE slot = 0), ref AS (SELECT nth AS slot, t AS p, t > (SELECT min(t) FROM t) AS moves FROM marks JOIN t USING (cell_id)),
  m AS (SELECT cell_id, slot, CASE WHEN slot >= 1 AND moves THEN CASE WHEN t < p THEN -dist ELSE dist END + p ELSE dist END AS x FROM lm JOIN t USING (cell_id) JOIN ref USING (slot))
  SELECT cell_id, slot, round(x - (SELECT min(x) FROM m), 5) AS position FROM m"""),
    "band_sample": (band_sample, _band_sample_sql()),
    "diffusion_map": (diffusion_map, None),
    "wanderlust": (wanderlust, None),
    "wanderlust_waypoints": (wanderlust_waypoints, None),
    "wanderlust_expr": (wanderlust_expr, None),
    "swanderlust": (swanderlust, None),
    "mst_order": (mst_order, None),
    "order_cells_none": (order_cells_none, "SELECT CAST(vec_id AS VARCHAR) AS cell_id, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings"),
    "cluster_genes": (cluster_genes, None),
    "two_pass_pipeline": (two_pass_pipeline, None),
    "cell_type_counts": (cell_type_counts, """WITH o AS (SELECT row_number() OVER (ORDER BY CAST(embedding[1] AS DOUBLE), vec_id) AS rank, CAST(label AS VARCHAR) AS group_id, count(*) OVER () AS n FROM embeddings)
  SELECT CAST(floor((rank - 1) * 10 / n) AS BIGINT) AS tenth, group_id, count(*) AS n_cells FROM o GROUP BY 1, 2"""),
}
