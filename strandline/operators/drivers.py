"""Genes that drive an ordering: scattering, spline tests along the order, driving forces.

Input is (gene_id, cell_id, value, pseudotime) with pseudotime 1..n; a gene's absent cells have the floor value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.runtime import stored
from strandline.functions.stats import benjamini_hochberg, chi2_sf_3, elbow, exact_quantile
from strandline.operators.matrix import with_pseudotime
from strandline.operators.quality_control import log10_or_limit


KNOTS = (0.0, 1 / 3, 2 / 3, 1.0)


@dataclass
class Spline:
    """A natural spline with three degrees of freedom over pseudotimes 1..n, as columns of pseudotime.

    t is pseudotime scaled to 0..1. The raw columns are t and two differences of truncated cubes; q_k = sum_j turn[k, j] (raw_j - mean_j) are
    orthogonal to the constant and to each other over 1..n, with squared lengths `norms`. Knots at the ends and the thirds of
    the range; the space, not the basis, decides the test.
    """

    n: int
    mean: np.ndarray
    turn: np.ndarray
    norms: np.ndarray

    @staticmethod
    def raw(t):
        """The raw columns of t, a column or an array."""
        least = F.greatest if isinstance(t, Column) else np.maximum
        zero = F.lit(0.0) if isinstance(t, Column) else 0.0

        def d(j: int):
            x = t - KNOTS[j]
            x = least(x, zero) if j else x
            return x * x * x / (1.0 - KNOTS[j])

        return [t, d(0) - d(2), d(1) - d(2)]

    def time(self, pseudotime):
        return (pseudotime - 1) / float(max(1, self.n - 1))

    def columns(self, pseudotime):
        """q_1, q_2 and q_3 at a pseudotime, a column or an array."""
        raw = [c - float(m) for c, m in zip(self.raw(self.time(pseudotime)), self.mean)]
        return [sum((raw[j] * float(self.turn[k, j]) for j in range(k)), raw[k] * float(self.turn[k, k])) for k in range(3)]


def spline(spark: SparkSession, n: int) -> Spline:
    """The spline over 1..n; its moments are added up on the executors, and nothing of length n leaves them."""
    found = Spline(n, np.zeros(3), np.eye(3), np.zeros(3))
    ranks = spark.range(1, n + 1)
    raw = found.raw(found.time(F.col("id").cast("double")))
    found.mean = np.array(ranks.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(raw)]).first(), float)
    own = [c - float(m) for c, m in zip(raw, found.mean)]
    pairs = [(i, j) for i in range(3) for j in range(i + 1)]
    sums = ranks.agg(*[F.sum(own[i] * own[j]).alias(f"s{i}{j}") for i, j in pairs]).first()
    inner = np.zeros((3, 3))
    for (i, j), x in zip(pairs, sums):
        inner[i, j] = inner[j, i] = x
    for k in range(3):
        for _ in range(2):
            for j in range(k):
                if found.norms[j] > 1e-12:
                    found.turn[k] -= found.turn[j] * (found.turn[k] @ inner @ found.turn[j]) / found.norms[j]
        found.norms[k] = found.turn[k] @ inner @ found.turn[k]
    return found


def scattering(expr: DataFrame, n: int, lod: float = 1.0, window_share: float = 0.1, nonzero_share: float = 0.1, min_expr: float = 0.1) -> DataFrame:
    """(gene_id, scattering): ranges of log10 expression in windows along the order, over the gene's whole range, summed.

    Windows have ceil(share n) cells and the first cell of the next one; a window with few non-zero cells counts
    nothing; genes of constant expression are dropped. A window with fewer stored cells than cells also holds the floor.
    """
    size = math.ceil(n * window_share)
    windows = max(1, math.ceil((n - 1) / size)) if n > 1 else 1
    floor = math.log10(max(lod, 1e-300)) if lod > 0 else math.log10(min_expr)
    at = F.col("pseudotime") - 1
    window = F.least(F.floor(at / size), F.lit(windows - 1)).cast("int")
    shared = (at % size == 0) & (at > 0) & (at / size <= windows - 1)
    both = F.when(shared, F.array(window, window - 1)).otherwise(F.array(window))
    logged = expr.select("gene_id", log10_or_limit(F.col("value"), min_expr).alias("y"), F.explode(both).alias("w"))
    begin = F.col("w") * size
    cells = F.least(begin + size, F.lit(n - 1)) - begin + 1
    over = F.col("y") > math.log10(min_expr)
    per = logged.groupBy("gene_id", "w").agg(
        F.min(F.when(over, F.col("y"))).alias("low"), F.max(F.when(over, F.col("y"))).alias("high"),
        F.count_if(over).alias("k"), F.count("*").alias("stored"),
    )
    per = per.withColumn("absent", cells - F.col("stored"))
    if floor > math.log10(min_expr):
        some = F.col("absent") > 0
        per = per.withColumn("low", F.when(some, F.least("low", F.lit(floor))).otherwise(F.col("low")))
        per = per.withColumn("high", F.when(some, F.greatest("high", F.lit(floor))).otherwise(F.col("high")))
        per = per.withColumn("k", F.col("k") + F.col("absent"))
    span = F.when(F.col("k") > nonzero_share * size, F.col("high") - F.col("low")).otherwise(F.lit(0.0))
    whole = expr.groupBy("gene_id").agg(
        F.min(log10_or_limit(F.col("value"), min_expr)).alias("least"), F.max(log10_or_limit(F.col("value"), min_expr)).alias("most"), F.count("*").alias("stored")
    )
    fewer = F.col("stored") < n
    whole = whole.select(
        "gene_id",
        (F.when(fewer, F.greatest("most", F.lit(floor))).otherwise(F.col("most")) - F.when(fewer, F.least("least", F.lit(floor))).otherwise(F.col("least"))).alias("range"),
    )
    summed = per.groupBy("gene_id").agg(F.sum(span).alias("s"))
    return summed.join(whole.where("range > 0"), "gene_id").select("gene_id", (F.col("s") / F.col("range")).alias("scattering"))


def scattering_filter(scattered: DataFrame, prob: float = 0.75) -> DataFrame:
    """Genes whose scattering is below the quantile."""
    cutoff = exact_quantile(scattered, "scattering", prob)
    return scattered.where(F.col("scattering") < F.lit(cutoff))


def regression_sums(expr: DataFrame, basis: Spline, lod: float = 1.0) -> DataFrame:
    """(gene_id, mean, rss0, b1, b2, b3): sums of log10 expression against the spline's columns, over all n cells.

    y is measured from the floor's logarithm, so absent cells add nothing to the sums.
    """
    n, floor = basis.n, math.log10(lod)
    y = log10_or_limit(F.greatest("value", F.lit(float(lod)))) - floor
    columns = basis.columns(F.col("pseudotime").cast("double"))
    sums = expr.withColumn("y", y).groupBy("gene_id").agg(
        F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), *[F.sum(F.col("y") * q).alias(f"s{k}") for k, q in enumerate(columns, 1)],
    )
    slopes = [(F.col(f"s{k}") / float(x) if x > 1e-12 else F.lit(0.0)).alias(f"b{k}") for k, x in enumerate(basis.norms, 1)]
    rss0 = F.greatest(F.col("syy") - F.col("sy") ** 2 / n, F.lit(0.0))
    return sums.select("gene_id", (F.col("sy") / n + floor).alias("mean"), rss0.alias("rss0"), *slopes)


def fitted(basis: Spline, pseudotime) -> Column:
    """The fitted curve of a gene (b1, b2, b3) at a pseudotime, less its mean."""
    return sum((F.col(f"b{k}") * q for k, q in enumerate(basis.columns(pseudotime), 1)), F.lit(0.0))


def fit_range(basis: Spline) -> Column:
    """The range of the fitted curve over pseudotimes 1..n, in closed form.

    Between knots the curve is a cubic of t. Its derivative is continuous, so between the roots of the derivative in the three parts
    it rises or falls throughout: over the ranks it is extreme at the first, at the last or next to a root.
    """
    a1, a2, a3 = (sum((F.col(f"b{k + 1}") * float(basis.turn[k, j]) for k in range(3)), F.lit(0.0)) for j in range(3))
    thirds = KNOTS[1], KNOTS[2]
    # Derivatives of (t - knot)^3 / (1 - knot): 3, 4.5 and 9 times the square; each is (square, linear, constant) in t.
    parts = [(3 * a2, F.lit(0.0), a1)]
    second = 4.5 * a3
    parts.append((3 * a2 + second, -2 * thirds[0] * second, a1 + thirds[0] ** 2 * second))
    third = -9 * (a2 + a3)
    parts.append((3 * a2 + second + third, -2 * (thirds[0] * second + thirds[1] * third), a1 + thirds[0] ** 2 * second + thirds[1] ** 2 * third))
    roots = []
    for a, b, c in parts:
        root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
        # The stable pair of roots: q / a and c / q.
        q = -0.5 * (b + F.when(b < 0, -root).otherwise(root))
        roots += [F.try_divide(q, a), F.try_divide(c, q)]
    last = float(max(1, basis.n))
    near = [F.when(F.isnan(t) | t.isNull(), F.lit(0.0)).otherwise(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))) * float(basis.n - 1) for t in roots]
    around = F.transform(F.array(*near), lambda x: F.array(*[F.least(F.greatest(F.floor(x).cast("double") + k, F.lit(1.0)), F.lit(last)) for k in range(4)]))
    ranks = F.concat(F.array(F.lit(1.0), F.lit(last)), F.flatten(around))
    curve = F.transform(ranks, lambda x: fitted(basis, x))
    return F.array_max(curve) - F.array_min(curve)


def spline_test(expr: DataFrame, n: int, lod: float = 1.0) -> DataFrame:
    """de(gene_id, status, lrt, pval, qval, cyclic_driving_force, linear_driving_force).

    Likelihood ratio of the spline model against the constant on log10 expression, n ln(RSS0 / RSS1), with three
    degrees of freedom. The linear force is the distance of the fitted ends, the cyclic one the range of the fit.
    """
    basis = spline(expr.sparkSession, n)
    sums = regression_sums(expr, basis, lod)
    explained = sum((F.col(f"b{k}") ** 2 * float(x) for k, x in enumerate(basis.norms, 1)), F.lit(0.0))
    rss1 = F.greatest(F.col("rss0") - explained, F.col("rss0") * 1e-12)
    fine = F.col("rss0") > 1e-12
    lrt = F.when(fine, n * F.ln(F.when(fine, F.col("rss0") / rss1).otherwise(F.lit(1.0))))
    linear = F.abs(fitted(basis, F.lit(float(n))) - fitted(basis, F.lit(1.0)))
    tested = sums.withColumn("lrt", lrt).withColumn("linear_driving_force", F.when(fine, linear))
    tested = tested.withColumn("pval", F.when(fine, chi2_sf_3(F.coalesce("lrt", F.lit(0.0)))).otherwise(F.lit(1.0)))
    tested = tested.withColumn("cyclic_driving_force", F.when(fine, fit_range(basis)))
    tested = tested.withColumn("status", F.when(fine, "OK").otherwise("FAIL"))
    out = benjamini_hochberg(tested)
    return out.select("gene_id", "status", "lrt", "pval", "qval", "cyclic_driving_force", "linear_driving_force")


def force_filter(de: DataFrame, data_type: str = "linear", cutoff: float | None = None) -> DataFrame:
    """Genes whose driving force is above `cutoff`, or at or above the elbow; infinite forces count as 0."""
    name = "linear_driving_force" if data_type == "linear" else "cyclic_driving_force"
    force = F.col(name)
    usable = F.when(force.isNull() | F.isnan(force) | (F.abs(force) == float("inf")), F.lit(0.0)).otherwise(force)
    forces = de.withColumn("force", usable)
    if cutoff is not None:
        kept = forces.where(F.col("force") > cutoff)
    else:
        kept = elbow(forces, "force")
    return kept.orderBy(F.col("force").desc(), "gene_id")


def driver_genes(
    expr: DataFrame,
    ordering: DataFrame,
    genes: DataFrame | None = None,
    scattering_prob: float = 0.75,
    cutoff: float | None = None,
    qval: float = 0.05,
    data_type: str = "linear",
    lod: float = 1.0,
) -> DataFrame:
    """Driver genes of an ordering, strongest first: little scattering, a significant trend and a strong driving force."""
    n = ordering.count()
    aligned = stored(with_pseudotime(expr, ordering, genes, lod), "aligned")
    steady = scattering_filter(stored(scattering(aligned, n, lod), "scattering"), scattering_prob)
    tested = spline_test(aligned.join(steady.select("gene_id"), "gene_id", "left_semi"), n, lod)
    significant = stored(tested.where(F.col("qval") < qval), "significant")
    if significant.count() <= 1:
        raise ValueError("one driver gene or none passes the test along the ordering")
    return force_filter(significant, data_type, cutoff)
