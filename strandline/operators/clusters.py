"""Clusters of co-expressed genes, around medoids, by any distance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.ranks import global_rank
from strandline.functions.runtime import stored
from strandline.operators.distance import BLOCK, _is_diagonal, block_distance, block_pairs, summed_by
from strandline.operators.neighbours import distances_to

MAX_ROUNDS = 30


def complete_rows(df: DataFrame, n: int, value: str) -> DataFrame:
    """Rows of genes that have a value in all n cells and are not constant."""
    good = df.groupBy("gene_id").agg(F.count(value).alias("k"), F.stddev_samp(value).alias("s")).where((F.col("k") == n) & (F.col("s") > 0))
    return df.join(good.select("gene_id"), "gene_id", "left_semi")


def half_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(1 - correlation) / 2 of the rows of two blocks."""
    return block_distance(a, b, "Correlation") / 2


def distance_sums(vec: DataFrame, distance, block: int = BLOCK) -> DataFrame:
    """(cell_id, cluster, s): the sum of each row's distances to the rows of each cluster of `vec` (cell_id, pos, features, cluster)."""

    def partial(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        parts = [pd.DataFrame({"cell_id": pd.Series(dtype=object), "cluster": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64")})]
        for x, y, m in [(a, b, d)] if _is_diagonal(a, b) else [(a, b, d), (b, a, d.T)]:
            for c in y["cluster"].unique():
                parts.append(pd.DataFrame({"cell_id": x["cell_id"], "cluster": int(c), "s": m[:, (y["cluster"] == c).to_numpy()].sum(axis=1)}))
        return pd.concat(parts)

    sums = block_pairs(vec, partial, "cell_id string, cluster long, s double", block, ["cluster"], distance, fold=summed_by("cell_id", "cluster"))
    return sums.groupBy("cell_id", "cluster").agg(F.sum("s").alias("s"))


def _assigned(vec: DataFrame, medoids: list[str], distance) -> DataFrame:
    """vec with `cluster`, the number of the nearest of a few medoids (of equals the first), and the distance `d` to it."""
    numbers = vec.sparkSession.createDataFrame(list(enumerate(medoids)), "query long, cell_id string")
    marks = numbers.join(vec.select("cell_id", "features"), "cell_id").select("query", "features")
    near = F.array_min(F.transform("dist", lambda d, i: F.struct(d.alias("d"), i.cast("long").alias("cluster"))))
    found = distances_to(vec, marks, distance).select("cell_id", near.alias("near"))
    return stored(vec.join(found, "cell_id").select("cell_id", "pos", "features", "near.cluster", "near.d"), "assigned")


def first_medoids(vec: DataFrame, k: int, distance, block: int = BLOCK) -> list[str]:
    """The row of least mean distance, then again and again the row farthest from its nearest medoid; ties go to the lesser name."""
    sums = distance_sums(vec.withColumn("cluster", F.lit(0).cast("long")), distance, block)
    found = [sums.agg(F.min_by("cell_id", F.struct("s", "cell_id"))).first()[0]]
    while len(found) < k:
        farthest = _assigned(vec, found, distance).where(~F.col("cell_id").isin(found))
        found.append(farthest.agg(F.min_by("cell_id", F.struct(-F.col("d"), "cell_id"))).first()[0])
    return found


def medoid_clusters(vec: DataFrame, medoids: list[str], distance, block: int = BLOCK, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, list[str], float]:
    """(vec with `cluster`, medoids, mean silhouette): rounds of assigning each row to its nearest medoid and making the member of least mean distance
    in each cluster its medoid, until none moves. Distances are formed block by block; a row's sums over the clusters are all that is kept."""
    for _ in range(max_rounds):
        assigned = _assigned(vec, medoids, distance)
        sums = stored(distance_sums(assigned, distance, block), "distance-sums")
        own = assigned.select("cell_id", F.col("cluster").alias("own"))
        members = sums.join(own, "cell_id").where("cluster = own").groupBy("cluster").agg(F.min_by("cell_id", F.struct("s", "cell_id")).alias("m"))
        moved = [r["m"] for r in members.orderBy("cluster").collect()]
        if moved == medoids:
            break
        medoids = moved
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    met = sums.join(own, "cell_id").join(F.broadcast(sizes), "cluster")  # one row for each cluster
    inside, mine = F.col("cluster") == F.col("own"), F.when(F.col("cluster") == F.col("own"), F.col("n"))
    each = met.groupBy("cell_id").agg(
        F.max(F.when(inside & (F.col("n") > 1), F.col("s") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~inside, F.col("s") / F.col("n"))).alias("b"), F.max(mine).alias("n"),
    )
    width = F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))).otherwise(0.0)
    return assigned, medoids, float(each.agg(F.avg(F.coalesce(width, F.lit(0.0)))).first()[0] or 0.0)


def cluster_genes(
    profiles: DataFrame, n: int, k_range: tuple[int, int] = (2, 6), value: str = "z",
    distance: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = half_correlation, block: int = BLOCK,
) -> DataFrame:
    """(gene_id, cluster, medoid, k) of profiles (gene_id, cell_id, z), by k-medoids.

    `distance` is a name or a function of two blocks (rows of a, rows of b) of profiles; by default (1 - correlation) / 2. The number
    of clusters with the best mean silhouette is taken, of equals the least; a medoid is the gene of least mean distance in its cluster.
    """
    full = complete_rows(profiles, n, value)
    rows = full.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("cell_id", value))).alias("p"))
    vectors = rows.select(F.col("gene_id").alias("cell_id"), F.transform("p", lambda x: x[value].cast("double")).alias("features"))
    vec = stored(global_rank(vectors, ["cell_id"], "pos").select("cell_id", "pos", "features"), "profiles")
    genes = vec.count()
    last = max(1, min(k_range[1], genes - 1))
    seeds = first_medoids(vec, last, distance, block) if genes else []
    best = None
    for k in range(min(k_range[0], last), last + 1) if genes else []:
        found, medoids, score = medoid_clusters(vec, seeds[:k], distance, block)
        if best is None or score > best[0] + 1e-12:
            best = (score, k, medoids, found)
    if best is None:
        return profiles.sparkSession.createDataFrame([], "gene_id string, cluster int, medoid string, k int")
    _, k, medoids, found = best
    names = F.array(*[F.lit(m) for m in medoids])
    return found.select(F.col("cell_id").alias("gene_id"), F.col("cluster").cast("int").alias("cluster"), names[F.col("cluster").cast("int")].alias("medoid"), F.lit(k).alias("k"))
