"""Input tables and the entities derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(brand, ord, r, g, b): a colour for each part."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), k.alias("ord"), (k * 37 % 256).cast("double").alias("r"), (k * 91 % 256).cast("double").alias("g"), (F.col("p_size") * 5 % 256).cast("double").alias("b"))


def brand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(brand, term), distinct."""
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.explode(F.split("p_name", " ")).alias("term")).distinct()


def brand_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(brand, family), distinct."""
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("family")).distinct()
