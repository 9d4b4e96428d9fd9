"""Exact statistics over distributed columns, and small numeric helpers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.ranks import global_rank, running
from strandline.functions.runtime import stored


#: Distinct values that are put in order by one window.
FEW_VALUES = 100_000


def exact_quantile(df: DataFrame, column: str, p: float, weight: str | None = None, few: int = FEW_VALUES) -> float | None:
    """The p-quantile with linear interpolation between neighbours; rows may carry an integer weight.

    Approximate quantiles cut the values into ranges whose exact weights are counted; the ranges of the wanted ranks are
    cut again until they hold few values, which alone are put in order.
    """
    w = F.col(weight) if weight else F.lit(1)
    some = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), w.cast("long").alias("w")).where("w > 0")
    some = stored(some, "quantile")
    n = some.agg(F.sum("w")).first()[0]
    if not n:
        return None
    at = (n - 1) * p
    ranks = [math.floor(at), math.ceil(at)]
    inside, below = some, 0
    while True:
        # Ends of ranges; a value belongs to the first range whose end it does not exceed.
        got = inside.agg(F.count("*").alias("rows"), F.percentile_approx("x", [k / 100 for k in range(101)], 1000).alias("cuts")).first()
        cuts = sorted(set(got["cuts"]))
        if got["rows"] <= few or len(cuts) == 1:
            break
        # The summary's ends may not be those of the column, so the outer ranges are open.
        cuts = cuts[:-1]
        number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("x")))
        sums = {r["k"]: r["n"] for r in inside.groupBy(number.alias("k")).agg(F.sum("w").alias("n")).collect()}
        upto, wanted = below, []
        for k in sorted(sums):
            if any(upto <= r < upto + sums[k] for r in ranks):
                wanted.append((k, upto))
            upto += sums[k]
        first, last = wanted[0], wanted[-1]
        narrower = inside
        if first[0] > 0:
            narrower = narrower.where(F.col("x") > cuts[first[0] - 1])
        if last[0] < len(cuts):
            narrower = narrower.where(F.col("x") <= cuts[last[0]])
        below = first[1]
        if last[0] - first[0] + 1 >= len(sums):
            break
        inside = narrower
    values = inside.groupBy("x").agg(F.sum("w").alias("w"))
    ranked = values.select("x", (F.sum("w").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(below)).alias("upto"))
    found = ranked.agg(*[F.min(F.when(F.col("upto") > r, F.col("x"))).alias(f"x{k}") for k, r in enumerate(ranks)]).first()
    return found["x0"] + (found["x1"] - found["x0"]) * (at - ranks[0])


def benjamini_hochberg(df: DataFrame, p: str = "pval", q: str = "qval", few: int = FEW_VALUES) -> DataFrame:
    """Adjusted p-values: the least of p * M / rank over this and all greater p, at most 1; null p stay null.

    Up to `few` rows are put in order by one window; more are ranked by range partitions, whose least values are carried on.
    """
    tested = stored(df, "tested")
    some = tested.where(F.col(p).isNotNull())
    m = some.count()
    order = [F.col(p), F.col("gene_id")]
    if m <= few:
        ranked = some.withColumn("__r", F.row_number().over(Window.orderBy(*order))).withColumn("__x", F.col(p) * m / F.col("__r"))
        least = ranked.withColumn("__least", F.min("__x").over(Window.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ranked = global_rank(some, order, "__r").withColumn("__x", F.col(p) * m / F.col("__r"))
        least = running(ranked, [F.col("__r").desc()], "__x", "__least", F.min)
    adjusted = least.withColumn(q, F.least("__least", F.lit(1.0))).drop("__r", "__x", "__least")
    return adjusted.unionByName(tested.where(F.col(p).isNull()).withColumn(q, F.lit(None).cast("double")))


def elbow(df: DataFrame, score: str = "score", key: str = "gene_id", group: list[str] | None = None, few: int = FEW_VALUES) -> DataFrame:
    """Rows at or above the elbow of the falling scores; groups of one row are kept whole.

    The elbow is the first point with the greatest distance from the chord between the greatest and the least score. Without groups, more than
    `few` rows are ranked by range partitions instead of one window.
    """
    group = group or []

    def distance(n: Column, top: Column, low: Column) -> Column:
        # Up to a positive factor: the cross product with the chord's direction.
        return F.round(F.abs((n - 1) * (F.col(score) - top) - (low - top) * (F.col("__r") - 1)), 9)

    falling = [F.col(score).desc(), F.col(key)]
    if not group:
        df = stored(df, "scores")
        about = df.agg(F.count("*").alias("n"), F.max(score).alias("top"), F.min(score).alias("low")).first()
        if about["n"] > few:
            ranked = global_rank(df, falling, "__r").withColumn("__r", F.col("__r").cast("double"))
            far = distance(F.lit(float(about["n"])), F.lit(about["top"]), F.lit(about["low"]))
            cut = ranked.agg(F.max(F.struct(far.alias("d"), -F.col("__r"), F.col(score).alias("s"))).alias("best")).first()["best"]["s"]
            return df.where(F.col(score) >= cut)
    whole = Window.partitionBy(*group)
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*falling)).cast("double"))
    ranked = ranked.withColumn("__n", F.count("*").over(whole)).withColumn("__top", F.max(score).over(whole))
    ranked = ranked.withColumn("__low", F.min(score).over(whole))
    ranked = ranked.withColumn("__d", distance(F.col("__n"), F.col("__top"), F.col("__low")))
    best = F.max(F.struct("__d", -F.col("__r"), F.col(score).alias("__s"))).over(whole)
    ranked = ranked.withColumn("__cut", best["__s"])
    return ranked.where(F.col(score) >= F.col("__cut")).drop("__r", "__n", "__top", "__low", "__d", "__cut")


def _chi2_sf_3(x: pd.Series) -> pd.Series:
    v = np.maximum(x.to_numpy(dtype=float), 0.0)
    tail = np.array([math.erfc(math.sqrt(a / 2)) if a == a else math.nan for a in v])
    return pd.Series(tail + np.sqrt(2 * v / math.pi) * np.exp(-v / 2))


def chi2_sf_3(x: Column) -> Column:
    """Survival function of the chi-squared distribution with three degrees of freedom."""
    return F.pandas_udf(_chi2_sf_3, "double")(x)


def seeded(seed: int, *columns: str) -> Column:
    """A reproducible random key: the MD5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))
