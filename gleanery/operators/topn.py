"""Ranking within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_by_score(df: DataFrame, group: str, item: str, score: str, n: int, name: str = "rank") -> DataFrame:
    """The n best items of each group, score descending, ties by item ascending; adds the place from 1."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item).asc())
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
