"""Layouts: long tables to vectors, orderings attached to tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.ranks import global_rank
from strandline.functions.runtime import stored


def subset(expr: DataFrame, genes: DataFrame | None = None, ordering: DataFrame | None = None) -> DataFrame:
    """Rows of the listed genes (exact names) and cells, with the cells' ranks."""
    out = expr if genes is None else expr.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    return out if ordering is None else out.join(ordering.select("cell_id", "rank"), "cell_id")


def with_pseudotime(expr: DataFrame, ordering: DataFrame, genes: DataFrame | None = None, lod: float = 1.0) -> DataFrame:
    """(gene_id, cell_id, value, pseudotime): raw values floored at the limit of detection, aligned to an ordering."""
    floored = F.greatest("value", F.lit(float(lod))).alias("value")
    return subset(expr, genes, ordering).select("gene_id", "cell_id", floored, F.col("rank").alias("pseudotime"))


def annotate(ordering: DataFrame, cell_annot: DataFrame) -> DataFrame:
    """The ordering with each cell's group; of several annotations of a cell the one of the least `nth` (its line) counts, without
    such a column the first by name."""
    order = F.struct("nth", "group_id") if "nth" in cell_annot.columns else F.col("group_id")
    first = cell_annot.groupBy("cell_id").agg(F.min_by("group_id", order).alias("group_id"))
    return ordering.join(first, "cell_id", "left")


def signature_slice(expr: DataFrame, gene_set: DataFrame) -> DataFrame:
    """Rows of the signature genes."""
    return expr.join(gene_set.select("gene_id").distinct(), "gene_id", "left_semi")


def row_zscore(df: DataFrame, value: str = "log2v", key: str = "gene_id") -> DataFrame:
    """Values standardised within each gene; null for a constant gene."""
    stats = df.groupBy(key).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    scaled = F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s"))
    return df.join(stats, key).withColumn("z", scaled).drop("__m", "__s")


def gene_dictionary(expr: DataFrame) -> DataFrame:
    """gene_dict(gene_idx, gene_id), genes in order of their names, from 0."""
    return global_rank(expr.select("gene_id").distinct(), ["gene_id"], "r").select((F.col("r") - 1).cast("int").alias("gene_idx"), "gene_id")


def to_vectors(expr: DataFrame, value: str = "log2v", fill: float = 0.0, gene_dict: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vec(cell_id, pos, features), gene_dict): one shuffle by cell; pos counts cells by name from 1.

    Choose the genes first: a vector holds all of them.
    """
    genes = stored(gene_dictionary(expr) if gene_dict is None else gene_dict, "genes")
    m = genes.count()
    pairs = expr.join(F.broadcast(genes) if m <= 100_000 else genes, "gene_id")
    packed = pairs.groupBy("cell_id").agg(F.collect_list("gene_idx").alias("i"), F.collect_list(value).alias("v"))

    @F.pandas_udf("array<double>")
    def dense(places: pd.Series, values: pd.Series) -> pd.Series:
        rows = []
        for i, v in zip(places, values):
            row = np.full(m, fill)
            row[i] = v
            rows.append(row)
        return pd.Series(rows, dtype=object)

    rows = packed.select("cell_id", dense("i", "v").alias("features"))
    return global_rank(rows, ["cell_id"], "pos").select("cell_id", "pos", "features"), genes


def to_long(vec: DataFrame) -> DataFrame:
    """(cell_id, pos, gene_idx, value) of vectors."""
    return vec.select("cell_id", "pos", F.posexplode("features").alias("gene_idx", "value"))
