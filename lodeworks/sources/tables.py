"""The parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; the scan keeps pushdown and column pruning."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def house_list(spark: SparkSession, folder: str) -> DataFrame:
    """The last release of ``reference``, which is *the list*.

    One release number is looked up first (a single-row aggregate over one column), so the scan gets it
    as a pushed filter. An empty table gives an empty list.
    """
    ref = table(spark, folder, "reference")
    last = ref.agg(F.max("release_no").alias("n")).first()["n"]
    return ref.filter(F.col("release_no") == F.lit(last if last is not None else -1))
