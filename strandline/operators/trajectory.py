"""Diffusion maps and landmark trajectories.

The per-cell state is one array of distances to the landmarks; realigning and voting are row-local array algebra
with a few scalars gathered each round.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.runtime import stored
from strandline.functions.stats import exact_quantile, seeded
from strandline.operators.distance import by_rank, sts_cost
from strandline.operators.graph import eigenvectors, landmark_distances
from strandline.operators.linalg import pca_embed
from strandline.functions.ranks import global_rank
from strandline.operators.neighbours import affinity, knn_graph, knn_of_queries, nearest, weighted_degree
from strandline.operators.sorting import auto_spin


def diffusion_map(vec: DataFrame, data_type: str = "scSeq", n_neighbours: int = 10, epsilon: float = 1.0, k: int = 10, pca: float = 15, markers: list[int] | None = None, lists: int | None = None):
    """(vec of diffusion components, eigenvalues, residual): eigenvectors of the symmetric Markov matrix of a neighbour graph, scaled to unit length.

    With `lists` the neighbours are searched in centroid lists instead of among all pairs.
    """
    if data_type == "scSeq":
        base, _ = pca_embed(vec, pca)
    elif markers is not None:
        base = vec.withColumn("features", F.transform(F.array(*[F.lit(m) for m in markers]), lambda i: F.element_at("features", i + 1)))
    else:
        base = vec
    base = stored(base, "embedded")
    edges = nearest(base, n_neighbours, include_self=True, lists=lists)
    weights = stored(affinity(edges, epsilon, base), "affinity")
    degree = stored(weighted_degree(weights).select("cell_id", F.sqrt("inverse").alias("root")), "degree")
    scaled = weights.join(degree.withColumnsRenamed({"cell_id": "src", "root": "a"}), "src").join(degree.withColumnsRenamed({"cell_id": "dst", "root": "b"}), "dst")
    found, values, residual = eigenvectors(scaled.select("src", "dst", (F.col("a") * F.col("w") * F.col("b")).alias("w")), base.select("cell_id"), k)
    raw = stored(found.join(degree, "cell_id").select("cell_id", F.transform("v", lambda x: x * F.col("root")).alias("v")), "components")
    size = len(values)
    norms = raw.agg(*[F.sqrt(F.sum(F.col("v")[i] * F.col("v")[i])).alias(f"n{i}") for i in range(size)]).first()
    scale = F.array(*[F.lit(1.0 / x if x else 0.0) for x in norms])
    unit = raw.select("cell_id", F.zip_with("v", scale, lambda a, s: a * s).alias("features"))
    return unit.join(vec.select("cell_id", "pos"), "cell_id").select("cell_id", "pos", "features"), values, residual


def sample_waypoints(vec: DataFrame, k: int, seed: int = 123) -> DataFrame:
    """(nth, cell_id): k cells without replacement, in order of a seeded hash."""
    chosen = vec.select("cell_id").orderBy(seeded(seed, "cell_id"), "cell_id").limit(k)
    return chosen.select((F.row_number().over(Window.orderBy(seeded(seed, "cell_id"), "cell_id")) - 1).alias("nth"), "cell_id")


def band_sample(distances: DataFrame, k: int, seed: int = 123) -> DataFrame:
    """(nth, cell_id): k of up to k cells from each distance band (cell_id, d), ten bands downwards from 0.998 of the greatest distance; a cell on a border may be drawn twice."""
    most = distances.agg(F.max("d")).first()[0] or 0.0
    bands, upper = [], 0.998
    while upper > 0.08:
        bands.append((len(bands), (upper - 0.1) * most, upper * most))
        upper -= 0.1
    spark = distances.sparkSession
    table = F.broadcast(spark.createDataFrame(bands, "band int, low double, high double"))
    inside = distances.join(table, F.col("d").between(F.col("low"), F.col("high")))
    nth = F.row_number().over(Window.partitionBy("band").orderBy(seeded(seed, "band", "cell_id")))
    pool = inside.withColumn("r", nth).where(F.col("r") <= k)
    order = [seeded(seed + 1, "band", "cell_id"), F.col("band"), F.col("cell_id")]
    chosen = pool.orderBy(*order).limit(k)
    return chosen.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("nth"), "cell_id")


def flock(vec: DataFrame, waypoints: DataFrame, rounds: int = 2, n_neighbours: int = 20) -> DataFrame:
    """Waypoints (nth, cell_id) moved, `rounds` times, to the cell nearest to the median of their neighbours."""
    for k in range(rounds):
        queries = waypoints.join(vec, "cell_id").select(F.col("nth").alias("query"), "features")
        near = knn_of_queries(vec, queries, n_neighbours).join(vec.select("cell_id", "features"), "cell_id")
        flat = near.select("query", F.posexplode("features").alias("i", "x"))
        medians = flat.groupBy("query", "i").agg(F.expr("percentile(x, 0.5D)").alias("m"))
        points = medians.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("features"))
        waypoints = stored(knn_of_queries(vec, points, 1).select(F.col("query").alias("nth"), "cell_id"), f"waypoints-{k}")
    return waypoints


def landmark_slots(start: str, partial_order: list[str] | None, waypoints: DataFrame) -> tuple[DataFrame, int]:
    """((slot, cell_id), number of fixed slots): the start, the given order and the waypoints, duplicates kept."""
    fixed = list(partial_order or [])
    if start not in fixed:
        fixed = [start, *fixed]
    head = waypoints.sparkSession.createDataFrame(list(enumerate(fixed)), "slot int, cell_id string")
    return head.union(waypoints.select((F.col("nth") + len(fixed)).cast("int"), "cell_id")), len(fixed)


def landmark_weights(cells: DataFrame, scheme: str = "exponential") -> DataFrame:
    """cell_lm with `weight`, an array that adds up to one for each cell."""
    n = F.size("dist")
    if scheme == "uniform":
        raw = F.transform("dist", lambda d: F.lit(1.0))
    elif scheme == "exponential":
        mean = F.aggregate("dist", F.lit(0.0), lambda s, d: s + d) / n
        spread = F.sqrt(F.aggregate(F.transform("dist", lambda d: (d - mean) * (d - mean)), F.lit(0.0), lambda s, d: s + d) / n)
        sdv = 3 * (cells.agg(F.avg(spread)).first()[0] or 0.0) or 1.0
        raw = F.transform("dist", lambda d: F.exp(-0.5 * F.pow(d / F.lit(sdv), F.lit(2.0))))
    elif scheme == "linear":
        most = cells.agg(F.max(F.array_max("dist"))).first()[0] or 0.0
        raw = F.transform("dist", lambda d: F.lit(most) - d)
    else:
        raise ValueError(f"unknown voting scheme {scheme}")
    weighted = cells.withColumn("__raw", raw)
    total = F.aggregate("__raw", F.lit(0.0), lambda s, w: s + w)
    return weighted.withColumn("weight", F.transform("__raw", lambda w: F.when(total != 0, w / total).otherwise(F.lit(0.0)))).drop("__raw")


def realign(cells: DataFrame, landmarks: DataFrame, position: str, first_slot: int = 0) -> DataFrame:
    """cell_lm with `traj`: distances made signed positions by each landmark's place in the current trajectory `position`.

    For a landmark at p, cells before p get the negative distance, and p is added, if any cell is before it. Slots below
    `first_slot` keep their distances. The least value of the whole table becomes 0.
    """
    places = landmarks.join(cells.select("cell_id", F.col(position).alias("p")), "cell_id").select("slot", "p")
    least = cells.agg(F.min(position)).first()[0]
    at = {r["slot"]: r["p"] for r in places.collect()}
    n = len(at)
    refs = F.array(*[F.struct(F.lit(float(at[i])).alias("p"), F.lit(bool(i >= first_slot and least < at[i])).alias("moves")) for i in range(n)])
    moved = F.zip_with("dist", refs, lambda d, r: F.when(r["moves"], F.when(F.col(position) < r["p"], -d).otherwise(d) + r["p"]).otherwise(d))
    out = cells.withColumn("traj", moved)
    low = out.agg(F.min(F.array_min("traj"))).first()[0] or 0.0
    return out.withColumn("traj", F.transform("traj", lambda x: x - F.lit(low)))


def _vote(traj: str = "traj", weight: str = "weight") -> Column:
    return F.aggregate(F.zip_with(traj, weight, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def scale_unit(df: DataFrame, column: str) -> DataFrame:
    """The column scaled to 0..1 over the table."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    span = (high or 0.0) - (low or 0.0)
    return df.withColumn(column, (F.col(column) - F.lit(low)) / F.lit(span) if span else F.lit(0.0))


def wanderlust(
    vec: DataFrame,
    start: str | int | None = None,
    l: int = 15,
    k: int = 15,
    num_graphs: int = 1,
    num_waypoints: int = 250,
    seed: int = 123,
    flock_rounds: int = 2,
    scheme: str = "exponential",
    banded: bool = False,
    partial_order: list[str] | None = None,
    graph: DataFrame | None = None,
    waypoints: DataFrame | None = None,
    lists: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trajectory(cell_id, score, rank), waypoints(slot, cell_id)): positions along a path from the start cell, voted by landmarks.

    `start` is a cell id, a position from 1, or None for the first cell. With `lists` the graph's neighbours are searched in
    centroid lists.
    """
    vec = stored(vec, "vec")
    if start is None or isinstance(start, int):
        start = vec.where(F.col("pos") == (start or 1)).first()["cell_id"]
    total = None
    for g in range(num_graphs):
        edges = graph if graph is not None and k == l else stored(knn_graph(vec, l, k, seed + g, lists=lists), "graph")
        chosen = waypoints
        if chosen is None:
            wanted = num_waypoints - len(partial_order or [])
            if banded:
                one = vec.sparkSession.createDataFrame([(0, start)], "slot int, cell_id string")
                near = landmark_distances(edges, one, vec.select("cell_id")).select("cell_id", F.col("dist")[0].alias("d"))
                chosen = band_sample(stored(near, "start-distances"), wanted, seed)
            else:
                chosen = sample_waypoints(vec, wanted, seed)
            chosen = flock(vec, stored(chosen, "waypoints"), flock_rounds)
        slots, fixed = landmark_slots(start, partial_order, chosen)
        slots = stored(slots, "landmarks")
        cells = landmark_distances(edges, slots, vec.select("cell_id"))
        cells = stored(landmark_weights(stored(cells, "landmark-distances"), scheme), "landmark-weights")
        first = realign(cells.withColumn("t", F.col("dist")[0]), slots, "t", fixed)
        current = stored(first.withColumn("t", _vote()).select("cell_id", "dist", "weight", "t"), "trajectory")
        for _ in range(20):
            again = realign(current, slots, "t").withColumn("new", _vote()).select("cell_id", "dist", "weight", "t", "new")
            again = stored(again, "trajectory")
            alike = again.agg(F.corr("new", "t")).first()[0]
            current = again.select("cell_id", "dist", "weight", F.col("new").alias("t"))
            if alike is None or alike > 0.9999:
                break
        one = scale_unit(current.select("cell_id", "t"), "t")
        total = one if total is None else total.union(one)
    scores = total.groupBy("cell_id").agg(F.avg("t").alias("score")).join(vec.select("cell_id", "pos"), "cell_id")
    return global_rank(scores, ["score", "pos"]).select("cell_id", "score", "rank"), slots


def wanderlust_features(vec: DataFrame, components: int = 4, **options) -> DataFrame:
    """vec of diffusion components 2..components+1 of raw features scaled to a common sum; features whose scaled sum is not positive are dropped.

    Cells whose sum is 0 can't be scaled and keep zeros.
    """
    own = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    sums = stored(vec.select("cell_id", "pos", "features", own.alias("own")).where(F.size("features") > 0), "sums")
    median = exact_quantile(sums, "own", 0.5) or 1.0
    scaled = F.transform("features", lambda x: F.when(F.col("own") != 0, x / F.col("own") * F.lit(median)).otherwise(F.lit(0.0)))
    scaled = stored(sums.select("cell_id", "pos", scaled.alias("features")), "scaled")
    totals = scaled.agg(vector_to_array(Summarizer.sum(array_to_vector("features")))).first()[0]
    kept = [i for i, s in enumerate(totals) if s > 0]
    if 0 < len(kept) < len(totals):
        chosen = F.transform(F.array(*[F.lit(i) for i in kept]), lambda i: F.element_at("features", i + 1))
        scaled = scaled.withColumn("features", chosen)
    found, _, _ = diffusion_map(scaled, k=max(components + 1, 5), **options)
    return found.withColumn("features", F.slice("features", 2, components))


def wanderlust_expr(vec: DataFrame, start: str | int | None = None, components: int = 4, **options) -> tuple[DataFrame, DataFrame]:
    """`wanderlust` on the diffusion components of expression vectors."""
    return wanderlust(wanderlust_features(vec, components, lists=options.get("lists")), start, **options)


def swanderlust(vec: DataFrame, components: int = 4, restarts: int = 20, num_waypoints: int = 150, seed: int = 123, lists: int | None = None, **options) -> DataFrame:
    """ordering(cell_id, rank, score): trajectories from both ends of the refined distance-based order; the one of lower
    side-to-side cost wins, the second on a tie. The graph and the waypoints do not depend on the start and are made once.
    """
    vec = stored(vec, "vec")
    ends = auto_spin(vec, restarts=restarts)
    first, last = ends.agg(F.min_by("cell_id", "rank"), F.max_by("cell_id", "rank")).first()
    space = stored(wanderlust_features(vec, components, lists=lists), "diffusion")
    graph = stored(knn_graph(space, 15, 15, seed, lists=lists), "graph")
    waypoints = flock(space, stored(sample_waypoints(space, num_waypoints, seed), "waypoints"), 2)
    tried = []
    for start in (first, last):
        order, _ = wanderlust(space, start, graph=graph, waypoints=waypoints, seed=seed, **options)
        order = stored(order, "trajectory")
        tried.append((sts_cost(by_rank(vec, order)).first()["cost"], order))
    return tried[0][1] if tried[0][0] < tried[1][0] else tried[1][1]
