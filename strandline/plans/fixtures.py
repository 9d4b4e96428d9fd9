"""The model's tables, derived from the given star-schema and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.ranks import global_rank


def _expr(lines: DataFrame, gene: str) -> DataFrame:
    summed = lines.groupBy(F.col(gene).cast("string").alias("gene_id"), F.col("l_suppkey").cast("string").alias("cell_id"))
    return summed.agg(F.sum("l_quantity").alias("value"))


def dense_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as genes, suppliers as cells, quantity as value; nearly every pair is there."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    return _expr(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "p_brand")


def sparse_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as genes, suppliers as cells; most pairs are absent."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity")
    return _expr(lines, "l_partkey")


def faint_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 with every ninth cell at a fiftieth of its expression."""
    faint = F.col("cell_id").cast("long") % 9 == 4
    return dense_expr(spark, sf_dir).withColumn("value", F.when(faint, F.col("value") * 0.02).otherwise(F.col("value")))


def twin_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 with first lines counted for a gene whose name differs in case only."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return _expr(named.withColumn("gene", F.when(F.col("l_linenumber") == 1, F.lower("p_brand")).otherwise(F.col("p_brand"))), "gene")


def signed_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 with the values of every fiftieth gene unreadable, that is, -1."""
    unread = F.col("gene_id").cast("long") % 50 == 7
    return sparse_expr(spark, sf_dir).withColumn("value", F.when(unread, F.lit(-1.0)).otherwise(F.col("value")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec(cell_id, pos, features) of the embeddings; pos counts from 1 in order of vec_id."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ids = global_rank(rows.select("vec_id").distinct(), ["vec_id"], "pos")
    features = F.col("embedding").cast("array<double>").alias("features")
    return rows.join(ids, "vec_id").select(F.col("vec_id").cast("string").alias("cell_id"), "pos", features)


def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_annot(cell_id, group_id) of the embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").cast("string").alias("cell_id"), F.col("label").cast("string").alias("group_id"))


def doubled_cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_annot(cell_id, group_id, nth): every third cell has another annotation on an earlier line."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("v"), F.col("label").cast("string").alias("group_id"))
    more = own.where("v % 3 = 0").select((F.col("v") * 2).alias("nth"), "v", F.concat(F.lit("z"), "group_id").alias("group_id"))
    both = own.select((F.col("v") * 2 + 1).alias("nth"), "v", "group_id").union(more)
    return both.select(F.col("v").cast("string").alias("cell_id"), "group_id", "nth")


def vector_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding dimension as a gene with value 2^(20 e)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    long = rows.select(F.col("vec_id").cast("string").alias("cell_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "e"))
    return long.select(F.format_string("g%02d", "i").alias("gene_id"), "cell_id", F.pow(F.lit(2.0), 20 * F.col("e")).alias("value"))


def supplier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordering(cell_id, rank): suppliers by account balance."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_acctbal")
    ranked = global_rank(rows, ["s_acctbal", "s_suppkey"])
    return ranked.select(F.col("s_suppkey").cast("string").alias("cell_id"), "rank")


def vector_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordering(cell_id, rank): embeddings by their first dimension."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding")[0].alias("e"))
    ranked = global_rank(rows, ["e", "vec_id"])
    return ranked.select(F.col("vec_id").cast("string").alias("cell_id"), "rank")


def mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordering(cell_id, rank): embeddings by the sum of their first sixteen dimensions."""
    total = F.aggregate(F.slice(F.col("embedding").cast("array<double>"), 1, 16), F.lit(0.0), lambda s, x: s + x)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", total.alias("e"))
    ranked = global_rank(rows, ["e", "vec_id"])
    return ranked.select(F.col("vec_id").cast("string").alias("cell_id"), "rank")
