"""Queries of quality control, gene choice along a given order and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators import drivers, matrix
from strandline.operators import quality_control as qc
from strandline.plans.fixtures import cell_types, dense_expr, doubled_cell_types, faint_expr, mixed_order, signed_expr, sparse_expr, supplier_order, twin_expr, vector_expr, vector_order
from strandline.sources.tables import coerced

X1 = """dense AS (SELECT p_brand AS gene_id, CAST(l_suppkey AS VARCHAR) AS cell_id, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
X2 = """sparse AS (SELECT CAST(l_partkey AS VARCHAR) AS gene_id, CAST(l_suppkey AS VARCHAR) AS cell_id, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""
X4 = """expr4 AS (SELECT 'g' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS gene_id, CAST(vec_id AS VARCHAR) AS cell_id,
  pow(2.0, 20 * CAST(embedding[i] AS DOUBLE)) AS value FROM embeddings, range(1, 65) r(i))"""
ORDER = """ordered AS (SELECT CAST(s_suppkey AS VARCHAR) AS cell_id, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison; negative zero becomes zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def number_coercion(spark, sf_dir):
    """Raw texts, some of which are no numbers, as numbers."""
    texts = sparse_expr(spark, sf_dir).withColumn(
        "value", F.when(F.col("value") % 7 == 0, "n/a").when(F.col("value") % 7 == 1, "NaN").otherwise(F.col("value").cast("string"))
    )
    return coerced(texts)


def log2_floor(spark, sf_dir):
    return rounded(qc.log2_floor(dense_expr(spark, sf_dir), 200.0))


def floor_raw(spark, sf_dir):
    return qc.floor_raw(dense_expr(spark, sf_dir), 200.0)


def log10_limit(spark, sf_dir):
    shifted = F.col("value") - 50
    return rounded(sparse_expr(spark, sf_dir).select("gene_id", "cell_id", qc.log10_or_limit(shifted).alias("log10v")))


def gene_mean(spark, sf_dir):
    return rounded(qc.gene_means(sparse_expr(spark, sf_dir)))


def gene_mean_log2(spark, sf_dir):
    return rounded(qc.gene_mean_log2(sparse_expr(spark, sf_dir)))


def gene_detection(spark, sf_dir):
    return rounded(qc.gene_detection(sparse_expr(spark, sf_dir), 30.0))


def cells_per_gene(spark, sf_dir):
    return qc.cells_expressing(sparse_expr(spark, sf_dir), 20.0)


def genes_per_cell(spark, sf_dir):
    return qc.genes_expressed(sparse_expr(spark, sf_dir), 20.0)


def retain_genes(spark, sf_dir):
    return qc.retain_genes(sparse_expr(spark, sf_dir), 3.0, 0.2)


def filter_genes_by_mean(spark, sf_dir):
    return qc.filter_genes_by_mean(twin_expr(spark, sf_dir), 64.0)


def _names(spark, sf_dir):
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower("p_brand").alias("gene_id")).distinct()
    return brands.where(F.col("gene_id").rlike("[135]$"))


def case_insensitive_anti(spark, sf_dir):
    return qc.without(dense_expr(spark, sf_dir), _names(spark, sf_dir))


def is_element_ignore_case(spark, sf_dir):
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("gene_id")).distinct()
    return qc.is_element_ignore_case(brands, _names(spark, sf_dir))


def outlier_cells(spark, sf_dir):
    return qc.identify_outliers(faint_expr(spark, sf_dir))


def preprocess(spark, sf_dir):
    return rounded(qc.preprocess(faint_expr(spark, sf_dir)))


def libsize_normalise(spark, sf_dir):
    return rounded(qc.libsize_normalise(signed_expr(spark, sf_dir)))


def elbow(spark, sf_dir):
    means = qc.gene_means(dense_expr(spark, sf_dir)).select("gene_id", F.round("mean_raw", 6).alias("score"))
    return stats.elbow(means)


def elbow_by_group(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("gene_id"), F.round("c_acctbal", 2).alias("score")
    )
    return stats.elbow(orders, group=["nation"])


def bh_adjust(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("gene_id"), (F.pmod(F.col("p_partkey") * 7919, F.lit(10007)) / 10007.0).alias("pval"))
    return rounded(stats.benjamini_hochberg(parts), 9)


def pseudotime_join(spark, sf_dir):
    return matrix.with_pseudotime(sparse_expr(spark, sf_dir), supplier_order(spark, sf_dir), lod=10.0)


def subset_ordered(spark, sf_dir):
    genes = dense_expr(spark, sf_dir).where("value > 900").select("gene_id")
    return matrix.subset(dense_expr(spark, sf_dir), genes, supplier_order(spark, sf_dir))


def annotate_order(spark, sf_dir):
    return matrix.annotate(vector_order(spark, sf_dir), doubled_cell_types(spark, sf_dir))


def _n(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").count()


def scattering(spark, sf_dir):
    aligned = matrix.with_pseudotime(sparse_expr(spark, sf_dir), supplier_order(spark, sf_dir))
    return rounded(drivers.scattering(aligned, _n(spark, sf_dir)))


def scattering_filter(spark, sf_dir):
    aligned = matrix.with_pseudotime(sparse_expr(spark, sf_dir), supplier_order(spark, sf_dir))
    scattered = rounded(drivers.scattering(aligned, _n(spark, sf_dir)))
    return drivers.scattering_filter(scattered, 0.4321)


def spline_test(spark, sf_dir):
    aligned = matrix.with_pseudotime(dense_expr(spark, sf_dir), supplier_order(spark, sf_dir))
    found = drivers.spline_test(aligned, _n(spark, sf_dir))
    return rounded(found.drop("pval", "qval"), 4)


def spline_pvalues(spark, sf_dir):
    aligned = matrix.with_pseudotime(sparse_expr(spark, sf_dir), supplier_order(spark, sf_dir))
    return rounded(drivers.spline_test(aligned, _n(spark, sf_dir)), 4)


def driver_genes(spark, sf_dir):
    return rounded(drivers.driver_genes(vector_expr(spark, sf_dir), mixed_order(spark, sf_dir)), 4)


def driver_profiles(spark, sf_dir):
    """z-scored profiles, in order, of the driver genes of the given order."""
    expr, order = vector_expr(spark, sf_dir), mixed_order(spark, sf_dir)
    genes = drivers.driver_genes(expr, order).select("gene_id")
    return rounded(matrix.row_zscore(matrix.subset(qc.log2_floor(expr), genes, order)).select("gene_id", "cell_id", "rank", "z"), 5)


def signature_profiles(spark, sf_dir):
    expr = qc.log2_floor(vector_expr(spark, sf_dir))
    genes = expr.select("gene_id").distinct().where(F.col("gene_id") < "g16")
    sliced = matrix.row_zscore(matrix.signature_slice(expr, genes))
    ordered = matrix.annotate(vector_order(spark, sf_dir), cell_types(spark, sf_dir))
    return rounded(sliced.join(ordered, "cell_id").select("gene_id", "cell_id", "rank", "group_id", "z"), 5)


def row_zscore(spark, sf_dir):
    return rounded(matrix.row_zscore(qc.log2_floor(dense_expr(spark, sf_dir))), 5)


NAMES_SQL = "names AS (SELECT DISTINCT lower(p_brand) AS gene_id FROM part WHERE regexp_matches(p_brand, '[135]$'))"

FAINT = """dense AS (SELECT p_brand AS gene_id, CAST(l_suppkey AS VARCHAR) AS cell_id,
  sum(l_quantity) * CASE WHEN l_suppkey % 9 = 4 THEN 0.02::DOUBLE ELSE 1.0::DOUBLE END AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_suppkey)"""
TWINS = """twins AS (SELECT CASE WHEN l_linenumber = 1 THEN lower(p_brand) ELSE p_brand END AS gene_id, CAST(l_suppkey AS VARCHAR) AS cell_id,
  sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
SIGNED = """signed AS (SELECT CAST(l_partkey AS VARCHAR) AS gene_id, CAST(l_suppkey AS VARCHAR) AS cell_id,
  CASE WHEN l_partkey % 50 = 7 THEN -1.0::DOUBLE ELSE sum(l_quantity) END AS value FROM lineitem GROUP BY l_partkey, l_suppkey)"""
MIXED = """ordered AS (SELECT CAST(vec_id AS VARCHAR) AS cell_id, row_number() OVER (ORDER BY list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE))), vec_id) AS rank
  FROM embeddings)"""

OUTLIERS = f"""{FAINT}, n AS (SELECT count(DISTINCT cell_id) AS n FROM dense),
means AS (SELECT gene_id, sum(log2(greatest(value, 1.0))) / (SELECT n FROM n) AS m FROM dense GROUP BY 1),
coarse AS (SELECT i, 1 + 4 * i AS t FROM range(0, 101) r(i)),
lefts AS (SELECT i, t, gene_id FROM coarse JOIN means ON m > log2(t)),
sizes AS (SELECT c.i, count(l.gene_id) AS genes FROM coarse c LEFT JOIN lefts l USING (i) GROUP BY 1),
det AS (SELECT i, cell_id, count(*) AS d FROM lefts JOIN dense USING (gene_id) WHERE value >= 1 GROUP BY 1, 2),
good AS (SELECT s.i, s.genes, count(d.cell_id) FILTER (WHERE d.d / s.genes >= 0.95) / (SELECT n FROM n) AS share
  FROM sizes s LEFT JOIN det d USING (i) GROUP BY 1, 2),
stop AS (SELECT coalesce(min(i) FILTER (WHERE share >= 0.5 OR genes < 20), 100) AS i FROM good),
ok AS (SELECT share >= 0.5 AS ok, i FROM good WHERE i = (SELECT i FROM stop)),
fine AS (SELECT k, CASE WHEN i = 0 THEN 1 ELSE 1 + 4 * (i - 1) END + k AS t FROM ok, range(1, 5) r(k) WHERE ok),
fleft AS (SELECT k, gene_id FROM fine JOIN means ON m > log2(t)),
fsize AS (SELECT k, count(*) AS genes FROM fleft GROUP BY 1),
fdet AS (SELECT k, cell_id, count(*) AS d FROM fleft JOIN dense USING (gene_id) WHERE value >= 1 GROUP BY 1, 2),
fgood AS (SELECT k, cell_id FROM fdet JOIN fsize USING (k) WHERE d / genes >= 0.95),
pick AS (SELECT min(k) AS k FROM (SELECT k, count(*) AS c FROM fgood GROUP BY 1) WHERE c / (SELECT n FROM n) >= 0.5),
vals AS (SELECT cell_id, log2(greatest(value, 1.0)) AS v FROM dense WHERE gene_id IN (SELECT gene_id FROM fleft WHERE k = (SELECT k FROM pick))),
cut AS (SELECT quantile_cont(v, 0.15) AS c FROM vals WHERE cell_id IN (SELECT cell_id FROM fgood WHERE k = (SELECT k FROM pick))),
outliers AS (SELECT cell_id FROM vals GROUP BY 1 HAVING median(v) <= (SELECT c FROM cut))"""


def _scattering_sql(table: str, order: str) -> str:
    """CTEs of the scattering of the genes of a table `sparse`, along an order `ordered`."""
    return f"""{table}, {order}, n AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.1) AS BIGINT) AS size FROM ordered),
cells AS (SELECT cell_id, rank - 1 AS pos FROM ordered),
wins AS (SELECT w, w * size AS a, least(w * size + size, n - 1) AS b FROM n, range(0, 1000) r(w) WHERE w < ceil((n - 1) / size)),
genes AS (SELECT DISTINCT gene_id FROM sparse),
logs AS (SELECT g.gene_id, c.pos, log10(greatest(coalesce(s.value, 0), 1.0)) AS y
  FROM genes g CROSS JOIN cells c LEFT JOIN sparse s ON s.gene_id = g.gene_id AND s.cell_id = c.cell_id),
per AS (SELECT gene_id, w, max(y) - min(y) AS r FROM logs JOIN wins ON pos BETWEEN a AND b GROUP BY 1, 2),
whole AS (SELECT gene_id, max(y) - min(y) AS r FROM logs GROUP BY 1 HAVING max(y) > min(y)),
scattered AS (SELECT gene_id, round(sum(per.r) / any_value(whole.r), 6) AS scattering FROM per JOIN whole USING (gene_id) GROUP BY 1)"""


SCATTERING = _scattering_sql(X2, ORDER)


def _spline_sql(table: str, order: str, genes: str = "true") -> str:
    """CTEs of the spline test of the genes of a table `dense` along an order `ordered`; absent cells have the floor, 1."""
    return f"""{table}, {order}, n AS (SELECT count(*) AS n FROM ordered),
t AS (SELECT cell_id, rank, (rank - 1) / (n - 1) AS t FROM ordered, n),
raw AS (SELECT cell_id, rank, t AS c1,
  (pow(t, 3) - pow(greatest(t - 1, 0), 3)) - (pow(greatest(t - 2/3, 0), 3) - pow(greatest(t - 1, 0), 3)) * 3 AS c2,
  (pow(greatest(t - 1/3, 0), 3) - pow(greatest(t - 1, 0), 3)) * 1.5 - (pow(greatest(t - 2/3, 0), 3) - pow(greatest(t - 1, 0), 3)) * 3 AS c3 FROM t),
o1 AS (SELECT cell_id, rank, c1 - avg(c1) OVER () AS q1, c2 - avg(c2) OVER () AS c2, c3 - avg(c3) OVER () AS c3 FROM raw),
o2 AS (SELECT cell_id, rank, q1, c2 - q1 * (sum(c2 * q1) OVER ()) / (sum(q1 * q1) OVER ()) AS q2,
  c3 - q1 * (sum(c3 * q1) OVER ()) / (sum(q1 * q1) OVER ()) AS c3 FROM o1),
o3 AS (SELECT cell_id, rank, q1, q2, c3 - q2 * (sum(c3 * q2) OVER ()) / (sum(q2 * q2) OVER ()) AS q3 FROM o2),
norm AS (SELECT sum(q1 * q1) AS n1, sum(q2 * q2) AS n2, sum(q3 * q3) AS n3, arg_max(q1, rank) - arg_min(q1, rank) AS e1,
  arg_max(q2, rank) - arg_min(q2, rank) AS e2, arg_max(q3, rank) - arg_min(q3, rank) AS e3 FROM o3),
sums AS (SELECT gene_id, sum(y) AS sy, sum(y * y) AS syy, sum(y * q1) AS s1, sum(y * q2) AS s2, sum(y * q3) AS s3
  FROM (SELECT gene_id, cell_id, log10(greatest(value, 1.0)) AS y FROM dense WHERE {genes}) JOIN o3 USING (cell_id) GROUP BY 1),
fit AS (SELECT gene_id, s1 / n1 AS b1, s2 / n2 AS b2, s3 / n3 AS b3, syy - sy * sy / n AS rss0,
  s1 * s1 / n1 + s2 * s2 / n2 + s3 * s3 / n3 AS ex, e1, e2, e3, n FROM sums, norm, n),
curve AS (SELECT gene_id, max(b1 * q1 + b2 * q2 + b3 * q3) - min(b1 * q1 + b2 * q2 + b3 * q3) AS range FROM fit, o3 GROUP BY 1)"""


SPLINE = _spline_sql(X1, ORDER)
# The survival function of chi-squared with three degrees of freedom, erfc as a series of positive terms; beyond 60 it is 0 to twelve digits.
TESTED = """test AS (SELECT *, rss0 > 1e-12 AS fine, CASE WHEN rss0 > 1e-12 THEN n * ln(rss0 / greatest(rss0 - ex, rss0 * 1e-12)) END AS lrt FROM fit),
probs AS (SELECT *, CASE WHEN NOT fine THEN 1.0 WHEN lrt > 60 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-lrt / 2) * list_sum(list_transform(range(0, 160),
    lambda k: exp(2 * k * ln(2) + (k + 0.5) * ln(greatest(lrt, 1e-12) / 2) - lgamma(2 * k + 2.0) + lgamma(k + 1.0)))) + sqrt(2 * lrt / pi()) * exp(-lrt / 2) END AS pval FROM test),
ranked AS (SELECT *, row_number() OVER (ORDER BY pval, gene_id) AS r, count(*) OVER () AS m FROM probs),
de AS (SELECT gene_id, CASE WHEN fine THEN 'OK' ELSE 'FAIL' END AS status, lrt, pval, least(1.0, min(pval * m / r) OVER (ORDER BY r DESC)) AS qval,
  CASE WHEN fine THEN range END AS cyclic_driving_force, CASE WHEN fine THEN abs(b1 * e1 + b2 * e2 + b3 * e3) END AS linear_driving_force
  FROM ranked JOIN curve USING (gene_id))"""
DRIVERS = f"""{X4}, {_scattering_sql("sparse AS (SELECT * FROM expr4)", MIXED)},
steady AS (SELECT gene_id FROM scattered WHERE scattering < (SELECT quantile_cont(scattering, 0.75) FROM scattered)),
{_spline_sql("dense AS (SELECT * FROM expr4 WHERE gene_id IN (SELECT gene_id FROM steady))", "unused AS (SELECT 1)").replace("n AS (SELECT count(*) AS n FROM ordered)", "n2 AS (SELECT 1)", 1)}, {TESTED},
signif AS (SELECT *, linear_driving_force AS force, row_number() OVER (ORDER BY linear_driving_force DESC, gene_id) AS k, count(*) OVER () AS c,
  max(linear_driving_force) OVER () AS top, min(linear_driving_force) OVER () AS low FROM de WHERE qval < 0.05),
bent AS (SELECT *, round(abs((c - 1) * (force - top) - (low - top) * (k - 1)), 9) AS d FROM signif),
drivers AS (SELECT * FROM bent WHERE force >= (SELECT force FROM bent ORDER BY d DESC, k LIMIT 1))"""
DE_COLUMNS = "gene_id, status, round(lrt, 4) + 0.0 AS lrt, round(pval, 4) + 0.0 AS pval, round(qval, 4) + 0.0 AS qval, round(cyclic_driving_force, 4) + 0.0 AS cyclic_driving_force, round(linear_driving_force, 4) + 0.0 AS linear_driving_force"

BY_NAME = {
    "number_coercion": (number_coercion, f"WITH {X2} SELECT gene_id, cell_id, CASE WHEN value % 7 IN (0, 1) THEN -1.0 ELSE value END AS value FROM sparse"),
    "log2_floor": (log2_floor, f"WITH {X1} SELECT gene_id, cell_id, round(log2(greatest(value, 200.0)), 6) AS log2v FROM dense"),
    "floor_raw": (floor_raw, f"WITH {X1} SELECT gene_id, cell_id, greatest(value, 200.0) AS value FROM dense"),
    "log10_limit": (log10_limit, f"WITH {X2} SELECT gene_id, cell_id, round(CASE WHEN value > 50 THEN log10(value - 50) ELSE -1.0 END, 6) + 0.0 AS log10v FROM sparse"),
    "gene_mean": (gene_mean, f"""WITH {X2}, n AS (SELECT count(DISTINCT cell_id) AS n FROM sparse) SELECT gene_id, round(sum(value) / any_value(n), 6) AS mean_raw,
  round(sum(log2(greatest(value, 1.0))) / any_value(n), 6) AS mean_log2 FROM sparse, n GROUP BY 1"""),
    "gene_mean_log2": (gene_mean_log2, f"""WITH {X2}, n AS (SELECT count(DISTINCT cell_id) AS n FROM sparse) SELECT gene_id, round(sum(value) / any_value(n), 6) AS mean_raw,
  round(log2(sum(value) / any_value(n)), 6) AS log2_of_mean FROM sparse, n GROUP BY 1"""),
    "gene_detection": (gene_detection, f"""WITH {X2} SELECT cell_id, count(*) FILTER (WHERE value >= 30) AS number_of_genes,
  round(count(*) FILTER (WHERE value >= 30) / (SELECT count(DISTINCT gene_id) FROM sparse), 6) AS pct_of_genes FROM sparse GROUP BY 1"""),
    "cells_per_gene": (cells_per_gene, f"WITH {X2} SELECT gene_id, count(*) FILTER (WHERE value > 20) AS n_cells FROM sparse GROUP BY 1"),
    "genes_per_cell": (genes_per_cell, f"WITH {X2} SELECT cell_id, count(*) FILTER (WHERE value > 20) AS n_genes FROM sparse GROUP BY 1"),
    "retain_genes": (retain_genes, f"""WITH {X2}, n AS (SELECT count(DISTINCT cell_id) AS n FROM sparse), weak AS (SELECT gene_id FROM sparse, n GROUP BY 1
  HAVING sum(value) / any_value(n) BETWEEN 0 AND 6 OR count(*) FILTER (WHERE value >= 6) / any_value(n) < 0.2)
  SELECT * FROM sparse WHERE lower(gene_id) NOT IN (SELECT lower(gene_id) FROM weak)"""),
    "filter_genes_by_mean": (filter_genes_by_mean, f"""WITH {TWINS}, n AS (SELECT count(DISTINCT cell_id) AS n FROM twins), weak AS (SELECT gene_id FROM twins, n GROUP BY 1
  HAVING sum(log2(greatest(value, 1.0))) / any_value(n) <= log2(64.0)) SELECT * FROM twins WHERE lower(gene_id) NOT IN (SELECT lower(gene_id) FROM weak)"""),
    "case_insensitive_anti": (case_insensitive_anti, f"WITH {X1}, {NAMES_SQL} SELECT * FROM dense WHERE lower(gene_id) NOT IN (SELECT gene_id FROM names)"),
    "is_element_ignore_case": (is_element_ignore_case, f"WITH {NAMES_SQL} SELECT DISTINCT p_brand AS gene_id, lower(p_brand) IN (SELECT gene_id FROM names) AS found FROM part"),
    "outlier_cells": (outlier_cells, f"WITH {OUTLIERS} SELECT cell_id FROM outliers"),
    "preprocess": (preprocess, f"""WITH {OUTLIERS}, kept AS (SELECT * FROM dense WHERE cell_id NOT IN (SELECT cell_id FROM outliers)),
  k AS (SELECT count(DISTINCT cell_id) AS n FROM kept), weak AS (SELECT gene_id FROM kept, k GROUP BY 1
  HAVING sum(value) / any_value(n) BETWEEN 0 AND 2 OR count(*) FILTER (WHERE value >= 2) / any_value(n) < 0.1)
  SELECT gene_id, cell_id, round(log2(greatest(value, 1.0)), 6) AS log2v FROM kept WHERE gene_id NOT IN (SELECT gene_id FROM weak)"""),
    "libsize_normalise": (libsize_normalise, f"""WITH {SIGNED}, s AS (SELECT cell_id, sum(value) AS t FROM signed GROUP BY 1), m AS (SELECT quantile_cont(t, 0.5) AS m FROM s),
  scaled AS (SELECT gene_id, cell_id, value / t * m AS value FROM signed JOIN s USING (cell_id), m WHERE t <> 0)
  SELECT gene_id, cell_id, round(value, 6) + 0.0 AS value FROM scaled WHERE gene_id IN (SELECT gene_id FROM scaled GROUP BY 1 HAVING sum(value) > 0)"""),
    "elbow": (elbow, f"""WITH {X1}, n AS (SELECT count(DISTINCT cell_id) AS n FROM dense), s AS (SELECT gene_id, round(sum(value) / any_value(n), 6) AS score FROM dense, n GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene_id) AS r, count(*) OVER () AS c, max(score) OVER () AS top, min(score) OVER () AS low FROM s),
  d AS (SELECT *, round(abs((c - 1) * (score - top) - (low - top) * (r - 1)), 9) AS d FROM r)
  SELECT gene_id, score FROM d WHERE score >= (SELECT score FROM d ORDER BY d DESC, r LIMIT 1)"""),
    "elbow_by_group": (elbow_by_group, """WITH r AS (SELECT c_nationkey AS nation, c_custkey AS gene_id, round(c_acctbal, 2) AS score FROM customer),
  o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, gene_id) AS r, count(*) OVER w AS c, max(score) OVER w AS top, min(score) OVER w AS low
    FROM r WINDOW w AS (PARTITION BY nation)),
  d AS (SELECT *, round(abs((c - 1) * (score - top) - (low - top) * (r - 1)), 9) AS d FROM o),
  k AS (SELECT nation, score AS cut FROM d QUALIFY row_number() OVER (PARTITION BY nation ORDER BY d DESC, r) = 1)
  SELECT nation, gene_id, score FROM d JOIN k USING (nation) WHERE score >= cut"""),
    "bh_adjust": (bh_adjust, """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS gene_id, ((p_partkey * 7919) % 10007) / 10007.0 AS pval FROM part),
  r AS (SELECT *, row_number() OVER (ORDER BY pval, gene_id) AS r, count(*) OVER () AS m FROM p)
  SELECT gene_id, round(pval, 9) AS pval, round(least(1.0, min(pval * m / r) OVER (ORDER BY r DESC)), 9) AS qval FROM r"""),
    "pseudotime_join": (pseudotime_join, f"WITH {X2}, {ORDER} SELECT gene_id, cell_id, greatest(value, 10.0) AS value, rank AS pseudotime FROM sparse JOIN ordered USING (cell_id)"),
    "subset_ordered": (subset_ordered, f"WITH {X1}, {ORDER} SELECT gene_id, cell_id, value, rank FROM dense JOIN ordered USING (cell_id) WHERE gene_id IN (SELECT gene_id FROM dense WHERE value > 900)"),
    "annotate_order": (annotate_order, """SELECT CAST(vec_id AS VARCHAR) AS cell_id, row_number() OVER (ORDER BY CAST(embedding[1] AS DOUBLE), vec_id) AS rank,
  CASE WHEN vec_id % 3 = 0 THEN 'z' ELSE '' END || CAST(label AS VARCHAR) AS group_id FROM embeddings"""),
    "scattering": (scattering, f"WITH {SCATTERING} SELECT gene_id, scattering FROM scattered"),
    "scattering_filter": (scattering_filter, f"WITH {SCATTERING} SELECT gene_id, scattering FROM scattered WHERE scattering < (SELECT quantile_cont(scattering, 0.4321) FROM scattered)"),
    "spline_test": (spline_test, f"""WITH {SPLINE} SELECT gene_id, 'OK' AS status, round(n * ln(rss0 / (rss0 - ex)), 4) AS lrt,
  round(range, 4) AS cyclic_driving_force, round(abs(b1 * e1 + b2 * e2 + b3 * e3), 4) AS linear_driving_force FROM fit JOIN curve USING (gene_id)"""),
    "spline_pvalues": (spline_pvalues, f"WITH {_spline_sql(X2.replace('sparse AS', 'dense AS'), ORDER)}, {TESTED} SELECT {DE_COLUMNS} FROM de"),
    "driver_genes": (driver_genes, f"WITH {DRIVERS} SELECT {DE_COLUMNS}, round(force, 4) + 0.0 AS force FROM drivers"),
    "driver_profiles": (driver_profiles, f"""WITH {DRIVERS}, l AS (SELECT gene_id, cell_id, log2(greatest(value, 1.0)) AS v FROM expr4 WHERE gene_id IN (SELECT gene_id FROM drivers)),
  ms AS (SELECT gene_id, avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1)
  SELECT gene_id, cell_id, rank, round((v - m) / s, 5) + 0.0 AS z FROM l JOIN ms USING (gene_id) JOIN ordered USING (cell_id)"""),
    "signature_profiles": (signature_profiles, f"""WITH {X4}, l AS (SELECT gene_id, cell_id, log2(greatest(value, 1.0)) AS v FROM expr4 WHERE gene_id < 'g16'),
  s AS (SELECT gene_id, avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1),
  o AS (SELECT CAST(vec_id AS VARCHAR) AS cell_id, row_number() OVER (ORDER BY CAST(embedding[1] AS DOUBLE), vec_id) AS rank, CAST(label AS VARCHAR) AS group_id FROM embeddings)
  SELECT gene_id, cell_id, rank, group_id, round((v - m) / s, 5) + 0.0 AS z FROM l JOIN s USING (gene_id) JOIN o USING (cell_id)"""),
    "row_zscore": (row_zscore, f"""WITH {X1}, l AS (SELECT gene_id, cell_id, log2(greatest(value, 1.0)) AS v FROM dense), s AS (SELECT gene_id, avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1)
  SELECT gene_id, cell_id, round(v, 5) AS log2v, round((v - m) / s, 5) + 0.0 AS z FROM l JOIN s USING (gene_id)"""),
}
