"""Quality control of expr(gene_id, cell_id, value): an absent pair is a raw zero.

`n_cells` and `n_genes` are the sizes of the full table; absent pairs enter sums as constants, so nothing is
made dense.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.runtime import stored
from strandline.functions.stats import exact_quantile


def count_of(expr: DataFrame, column: str) -> int:
    """Distinct values of a column."""
    return expr.select(column).distinct().count()


def log2_floor(expr: DataFrame, lod: float = 1.0) -> DataFrame:
    """expr_log(gene_id, cell_id, log2v): log2 of the value or the limit of detection, whichever is greater."""
    return expr.select("gene_id", "cell_id", F.log2(F.greatest("value", F.lit(float(lod)))).alias("log2v"))


def floor_raw(expr: DataFrame, lod: float = 1.0) -> DataFrame:
    """Values below the limit of detection raised to it."""
    return expr.withColumn("value", F.greatest("value", F.lit(float(lod))))


def log10_or_limit(value: Column, limit: float = 0.1) -> Column:
    """log10 of a value, that of the detection limit where it is not finite."""
    return F.when(value > 0, F.log10(F.when(value > 0, value).otherwise(F.lit(1.0)))).otherwise(F.lit(math.log10(limit)))


def without(df: DataFrame, names: DataFrame, column: str = "gene_id") -> DataFrame:
    """Rows whose name is not among `names`, upper and lower case being the same."""
    gone = names.select(F.lower(F.col(column)).alias("__name")).distinct()
    return df.join(gone, F.lower(df[column]) == F.col("__name"), "left_anti")


def is_element_ignore_case(df: DataFrame, names: DataFrame, column: str = "gene_id") -> DataFrame:
    """Every row with `found`: whether its name is among `names`, upper and lower case being the same."""
    there = names.select(F.lower(F.col(column)).alias("__name")).distinct().withColumn("__there", F.lit(True))
    joined = df.join(there, F.lower(df[column]) == F.col("__name"), "left")
    return joined.withColumn("found", F.col("__there").isNotNull()).drop("__name", "__there")


def gene_means(expr: DataFrame, lod: float = 1.0, n_cells: int | None = None) -> DataFrame:
    """(gene_id, mean_raw, mean_log2): means over all cells; mean_log2 is of the floored log2 values."""
    n = n_cells or count_of(expr, "cell_id")
    log2v = F.log2(F.greatest("value", F.lit(float(lod))))
    absent = (F.lit(n) - F.count("*")) * math.log2(lod)
    return expr.groupBy("gene_id").agg((F.sum("value") / n).alias("mean_raw"), ((F.sum(log2v) + absent) / n).alias("mean_log2"))


def gene_mean_log2(expr: DataFrame, n_cells: int | None = None) -> DataFrame:
    """(gene_id, mean_raw, log2_of_mean) over kept cells; the logarithm is null where the mean is not positive."""
    n = n_cells or count_of(expr, "cell_id")
    return expr.groupBy("gene_id").agg((F.sum("value") / n).alias("mean_raw")).withColumn(
        "log2_of_mean", F.when(F.col("mean_raw") > 0, F.log2(F.when(F.col("mean_raw") > 0, F.col("mean_raw")).otherwise(1.0)))
    )


def filter_genes_by_mean(expr: DataFrame, threshold: float, lod: float = 1.0) -> DataFrame:
    """Rows of genes whose mean log2 expression is above log2(threshold); twins up to case go together."""
    weak = gene_means(expr, lod).where(F.col("mean_log2") <= math.log2(threshold))
    return without(expr, weak)


def gene_detection(expr: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(cell_id, number_of_genes, pct_of_genes): genes at or above the threshold in each cell, fewest first."""
    m = count_of(expr, "gene_id")
    counted = expr.groupBy("cell_id").agg(F.count_if(F.col("value") >= threshold).alias("number_of_genes"))
    return counted.withColumn("pct_of_genes", F.col("number_of_genes") / m).orderBy("number_of_genes", "cell_id")


def cells_expressing(expr: DataFrame, min_expr: float = 0.1) -> DataFrame:
    """(gene_id, n_cells): cells in which each gene is above `min_expr`."""
    return expr.groupBy("gene_id").agg(F.count_if(F.col("value") > min_expr).alias("n_cells"))


def genes_expressed(expr: DataFrame, min_expr: float = 0.1) -> DataFrame:
    """(cell_id, n_genes): genes above `min_expr` in each cell."""
    return expr.groupBy("cell_id").agg(F.count_if(F.col("value") > min_expr).alias("n_genes"))


def weak_genes(expr: DataFrame, lod: float = 1.0, pct_detection: float = 0.1) -> DataFrame:
    """Genes to remove: mean raw value from 0 to 2 lod, or at least 2 lod in fewer than `pct_detection` of the cells.

    Both rules are one aggregate. A negative mean is left to the second rule.
    """
    n = count_of(expr, "cell_id")
    found = expr.groupBy("gene_id").agg(
        (F.sum("value") / n).alias("mean"), (F.count_if(F.col("value") >= 2 * lod) / n).alias("share")
    )
    return found.where(F.col("mean").between(0, 2 * lod) | (F.col("share") < pct_detection)).select("gene_id")


def retain_genes(expr: DataFrame, lod: float = 1.0, pct_detection: float = 0.1) -> DataFrame:
    """Rows of the genes that `weak_genes` does not name."""
    return without(expr, weak_genes(expr, lod, pct_detection))


def drop_cells(expr: DataFrame, outliers: DataFrame) -> DataFrame:
    """Rows of cells that are no outliers."""
    return expr.join(outliers.select("cell_id"), "cell_id", "left_anti")


def _detection_by_threshold(expr: DataFrame, levels: DataFrame, n_levels: int, lod: float) -> DataFrame:
    """(i, cell_id, detected): genes left at threshold i that the cell detects, by a running sum over levels.

    `levels` gives each gene the number of thresholds that it passes, so one pass serves all of them.
    """
    found = expr.where(F.col("value") >= lod).join(levels, "gene_id")
    by_level = found.groupBy("cell_id", "level").agg(F.count("*").alias("n"))
    # A gene of level L is left at thresholds 0..L-1.
    histogram = by_level.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("h"))
    levels_above = F.transform(
        F.sequence(F.lit(0), F.lit(n_levels - 1)),
        lambda i: F.struct(
            i.alias("i"),
            F.aggregate(F.map_entries("h"), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"] > i, e["value"]).otherwise(0)).alias("detected"),
        ),
    )
    return histogram.select("cell_id", F.inline(levels_above))


def _gene_levels(means: DataFrame, thresholds: list[float]) -> DataFrame:
    """(gene_id, level): how many of the rising thresholds the gene's mean log2 passes, least of its twins up to case."""
    logs = F.array(*[F.lit(math.log2(t)) for t in thresholds])
    own = F.size(F.filter(logs, lambda t: t < F.col("mean_log2")))
    twins = Window.partitionBy(F.lower("gene_id"))
    return means.select("gene_id", F.min(own).over(twins).alias("level"))


def _good_shares(expr: DataFrame, levels: DataFrame, thresholds: list[float], lod: float, detected_share: float, n_cells: int):
    """Per threshold: (genes left, share of cells that detect at least `detected_share` of them). At most 101 rows reach the driver."""
    by_level = {r["level"]: r["n"] for r in levels.groupBy("level").agg(F.count("*").alias("n")).collect()}
    genes = [sum(n for level, n in by_level.items() if level > i) for i in range(len(thresholds))]
    detected = _detection_by_threshold(expr, levels, len(thresholds), lod)
    need = F.element_at(F.array(*[F.lit(g) for g in genes]), F.col("i") + 1)
    good = detected.where((need > 0) & (F.col("detected") / need >= detected_share))
    counted = {r["i"]: r["n"] for r in good.groupBy("i").agg(F.count("*").alias("n")).collect()}
    return [(genes[i], counted.get(i, 0) / n_cells) for i in range(len(thresholds))], detected, need


def identify_outliers(
    expr: DataFrame,
    lod: float = 1.0,
    step: float = 4.0,
    fine_step: float = 1.0,
    num_fine_test: int = 4,
    pct_goodsample: float = 0.5,
    quantile: float = 0.95,
    low_quantile: float = 0.15,
    min_gene_number: int = 20,
    max_steps: int = 100,
) -> DataFrame:
    """(cell_id): cells whose median expression is at or below a low quantile of that of the good cells.

    The threshold rises from `lod` in coarse steps until at least half of the cells detect 95 % of the genes left, then
    in fine steps from the last coarse one. All coarse thresholds are tried in one pass over the table.
    """
    spark = expr.sparkSession
    none = spark.createDataFrame([], "cell_id string").select(F.col("cell_id").cast(expr.schema["cell_id"].dataType))
    expr = stored(expr.select("gene_id", "cell_id", "value"), "expr")
    n = count_of(expr, "cell_id")
    means = stored(gene_means(expr, lod, n), "gene-means")
    coarse = [lod + step * i for i in range(max_steps + 1)]
    shares, _, _ = _good_shares(expr, _gene_levels(means, coarse), coarse, lod, quantile, n)
    stop = next((i for i, (genes, share) in enumerate(shares) if share >= pct_goodsample or genes < min_gene_number), max_steps)
    if shares[stop][1] < pct_goodsample:
        return none
    last = coarse[stop] - step if stop else lod
    fine = [last + fine_step * (k + 1) for k in range(num_fine_test)]
    levels = stored(_gene_levels(means, fine), "gene-levels")
    shares, detected, need = _good_shares(expr, levels, fine, lod, quantile, n)
    chosen = next((i for i, (_, share) in enumerate(shares) if share >= pct_goodsample), None)
    if chosen is None:
        return none
    left = levels.where(F.col("level") > chosen).select("gene_id")
    m = shares[chosen][0]
    values = log2_floor(expr, lod).join(left, "gene_id", "left_semi").select("cell_id", "log2v")
    cells = expr.select("cell_id").distinct()
    stored_pairs = values.groupBy("cell_id").agg(F.count("*").alias("k"))
    absent = cells.join(stored_pairs, "cell_id", "left").select(
        "cell_id", F.lit(math.log2(lod)).alias("log2v"), (F.lit(m) - F.coalesce("k", F.lit(0))).alias("w")
    )
    weighted = stored(values.withColumn("w", F.lit(1).cast("long")).union(absent.where("w > 0")), "weighted-values")
    good = detected.where((F.col("i") == chosen) & (detected["detected"] / need >= quantile)).select("cell_id")
    cutoff = exact_quantile(weighted.join(good, "cell_id", "left_semi"), "log2v", low_quantile, "w")
    medians = weighted.groupBy("cell_id").agg(F.expr("percentile(log2v, 0.5D, w)").alias("median"))
    return medians.where(F.col("median") <= cutoff).select("cell_id")


def preprocess(expr: DataFrame, lod: float = 1.0, log_transform: bool = True, remove_outliers: bool = True, **outlier_options) -> DataFrame:
    """expr_log of the kept cells and genes."""
    expr = stored(expr.select("gene_id", "cell_id", "value"), "expr")
    kept = drop_cells(expr, identify_outliers(expr, lod, **outlier_options)) if remove_outliers else expr
    kept = retain_genes(kept, lod)
    return log2_floor(kept, lod) if log_transform else kept.select("gene_id", "cell_id", F.col("value").alias("log2v"))


def libsize_normalise(expr: DataFrame) -> DataFrame:
    """Values divided by their cell's sum over all features and multiplied by the median sum; then features whose scaled sum is not positive are dropped.

    Cells whose sum is 0 can't be scaled and take no part.
    """
    expr = stored(expr.select("gene_id", "cell_id", "value"), "expr")
    sums = stored(expr.groupBy("cell_id").agg(F.sum("value").alias("total")), "sums")
    median = exact_quantile(sums, "total", 0.5)
    scaled = expr.join(sums.where("total <> 0"), "cell_id").select("gene_id", "cell_id", (F.col("value") / F.col("total") * F.lit(median)).alias("value"))
    scaled = stored(scaled, "scaled")
    there = scaled.groupBy("gene_id").agg(F.sum("value").alias("s")).where("s > 0").select("gene_id")
    return scaled.join(there, "gene_id", "left_semi")
