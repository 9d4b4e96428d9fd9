"""The two-pass pipeline: quality control, genes, order, driver genes, refined order, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.runtime import stored
from strandline.operators import graph, linalg, matrix, sorting, trajectory
from strandline.operators import quality_control as qc
from strandline.operators.drivers import driver_genes
from strandline.operators.neighbours import knn_graph

METHODS = ("autoSPIN", "sWanderlust", "monocle", "Wanderlust", "SPIN", "none")


def mst_order(vec: DataFrame, neighbours: int = 10, lists: int | None = None) -> DataFrame:
    """ordering(cell_id, rank, score) along a spanning tree of the neighbour graph of the first two principal components; with `lists` its
    neighbours are searched by descent from that many centroid lists."""
    flat, _ = linalg.pca_embed(vec, 2)
    flat = stored(flat, "flat")
    return graph.tree_order(flat, stored(knn_graph(flat, neighbours, neighbours, lists=lists), "graph"))


def order_cells(vec: DataFrame, method: str = "autoSPIN", **options) -> DataFrame:
    """ordering(cell_id, rank) by the named method; `none` keeps the given order."""
    if method == "autoSPIN":
        found = sorting.auto_spin(vec, **options)
    elif method == "SPIN":
        found = sorting.sort_best_of(vec, **options)
    elif method == "sWanderlust":
        found = trajectory.swanderlust(vec, **options)
    elif method == "Wanderlust":
        found, _ = trajectory.wanderlust_expr(vec, **options)
    elif method == "monocle":
        found = mst_order(vec, **options)
    elif method == "none":
        found = vec.select("cell_id", F.col("pos").alias("rank"))
    else:
        raise ValueError(f"unknown method {method}; one of {', '.join(METHODS)}")
    return found.select("cell_id", "rank")


def run_pipeline(
    expr: DataFrame,
    preliminary: str = "autoSPIN",
    refined: str = "autoSPIN",
    lod: float = 1.0,
    log_transform: bool = True,
    remove_outliers: bool = True,
    preliminary_options: dict | None = None,
    refined_options: dict | None = None,
    driver_options: dict | None = None,
) -> dict[str, DataFrame]:
    """The seven result tables of a two-pass run on expr; write them with `write_results`."""
    expr = stored(expr.select("gene_id", "cell_id", "value"), "expr")
    log = stored(qc.preprocess(expr, lod, log_transform, remove_outliers), "expr-log")
    kept_cells = log.select("cell_id").distinct()
    genes = stored(linalg.pca_gene_selection(log), "pca-genes").select("gene_id")
    vec, _ = matrix.to_vectors(matrix.subset(log, genes))
    first = stored(order_cells(vec, preliminary, **(preliminary_options or {})), "preliminary-order")
    raw = expr.join(kept_cells, "cell_id", "left_semi")
    drivers = stored(driver_genes(raw, first, genes, lod=lod, **(driver_options or {})), "drivers").select("gene_id")
    vec, _ = matrix.to_vectors(matrix.subset(log, drivers))
    second = stored(order_cells(vec, refined, **(refined_options or {})), "refined-order")
    return {
        "exp_raw": expr,
        "trimmed_log2exp": log,
        "preliminary_sorting_genes": genes,
        "preliminary_sorting_order": first,
        "refined_sorting_genes": drivers,
        "refined_sorting_order": second,
        "driverGene_refinedOrder_log2exp": matrix.subset(log, drivers, second),
    }
