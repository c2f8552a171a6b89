"""Writing: bundles, partitioned details, optional-field JSON, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, compressed: bool = False) -> None:
    """One document a row, null fields left out; committed as a whole."""
    w = df.write.mode("overwrite").option("ignoreNullFields", True)
    (w.option("compression", "gzip") if compressed else w).json(path)


def documents(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON document without its null fields."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias(name))


def details(df: DataFrame, path: str, by: str = "continentId") -> None:
    """Details in one folder per community; stale folders go with the overwrite."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def pair_table(df: DataFrame, path: str) -> None:
    """A sparse symmetric matrix as its upper triangle (i, j, ...)."""
    df.where(F.col("i") < F.col("j")).write.mode("overwrite").parquet(path)


def within_budget(files: DataFrame, most: int = 19_000) -> int:
    """Number of distinct files; an error beyond the budget."""
    n = files.distinct().count()
    if n > most:
        raise ValueError(f"{n} files exceed the budget of {most}")
    return n
