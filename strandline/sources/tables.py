"""Readers and writers: expression tables, annotations, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_TABLES = (
    "exp_raw", "trimmed_log2exp", "preliminary_sorting_genes", "preliminary_sorting_order",
    "refined_sorting_genes", "refined_sorting_order", "driverGene_refinedOrder_log2exp",
)


def as_number(column: Column) -> Column:
    """A number; what can't be read as one, and NaN, is -1."""
    return F.coalesce(F.nanvl(column.try_cast("double"), F.lit(-1.0)), F.lit(-1.0))


def read_expression(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """expr(gene_id, cell_id, value) of a text table: a header of cell names, then a gene and its values on each line.

    Lines are split on the executors, so the number of columns is not limited; cell names are joined by
    position from the header line.
    """
    lines = spark.read.text(path)
    header = lines.first()["value"]
    names = header.split(sep)
    body = lines.where(F.col("value") != header).select(F.split("value", sep).alias("parts"))
    # A header may name the gene column or leave it out; the cells are the last entries either way.
    width = body.select(F.max(F.size("parts"))).first()[0] or len(names)
    cells = spark.createDataFrame(list(enumerate(names[len(names) - width + 1 :])), "at int, cell_id string")
    values = body.select(F.col("parts")[0].alias("gene_id"), F.posexplode(F.slice("parts", 2, width)).alias("at", "text"))
    return values.join(F.broadcast(cells), "at").select("gene_id", "cell_id", as_number(F.col("text")).alias("value"))


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """expr of a Parquet table that is long already."""
    return coerced(spark.read.parquet(path).select("gene_id", "cell_id", "value"))


def coerced(expr: DataFrame) -> DataFrame:
    """expr with numeric values, whatever type they had."""
    return expr.withColumn("value", as_number(F.col("value").cast("string")))


def read_cell_types(spark: SparkSession, path: str, sep: str = "\t", lines: bool = False) -> DataFrame:
    """cell_annot(cell_id, group_id) of a two-column text table with a header.

    With `lines` a column `nth` rises with the line, by which `annotate` takes a cell's first annotation; that is the order of
    one file, of several files each has its own.
    """
    table = spark.read.csv(path, sep=sep, header=True)
    named = table.select(F.col(table.columns[0]).alias("cell_id"), F.col(table.columns[1]).alias("group_id"))
    return named.withColumn("nth", F.monotonically_increasing_id()) if lines else named


def read_gene_set(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """gene_set(gene_id) of a one-column text table."""
    table = spark.read.csv(path, sep="\t", header=header)
    return table.select(F.trim(F.col(table.columns[0])).alias("gene_id")).where("gene_id <> ''").distinct()


def write_results(tables: dict[str, DataFrame], directory: str, project: str) -> str:
    """Write each table as Parquet at directory/project/name; returns that folder."""
    folder = f"{directory.rstrip('/')}/{project}"
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder
