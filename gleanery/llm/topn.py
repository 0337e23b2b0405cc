"""Top N items within every group by a hot-cold split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.scale import heavy_keys, heavy_limit, split_by


def top_n_per_group(df: DataFrame, groups: list[str], item: str, score: str, n: int = 5, heavy_rows: int | None = None) -> DataFrame:
    """The n items of highest score of each group: (groups..., item, score, place).

    An item counts once a group, at its highest score; ties go to the lower item. Null and NaN scores and null items do
    not count; rows with a null group key form a group like any other. Fewer than n items: all of them. Other columns
    are left alone, an empty table gives an empty result.

    Exact counts find the groups of more than `heavy_rows` rows (by default a part of a task's fair share of all rows). Those are range-sorted by (group, salt), each piece gives its
    n best, and the pieces' winners meet once more; all other groups go through an ordinary window. Repeated rows fall
    together before anything is sorted.
    """
    names = {g: f"g{i}" for i, g in enumerate(groups)}
    keys = list(names.values())
    src = df.select(*[F.col(g).alias(a) for g, a in names.items()], F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    src = src.filter(F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    heavy_rows = heavy_rows or heavy_limit(src.count(), df.sparkSession)
    heavy = heavy_keys(src, keys, heavy_rows)
    items = src.groupBy(*keys, "item").agg(F.max("score").alias("score"))
    best = [F.desc("score"), F.asc("item")]

    def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("place") <= n)

    if heavy is None:
        out = ranked(items, keys)
    else:
        hot, cold = split_by(items, heavy, keys)
        salt = F.pmod(F.xxhash64("item"), F.greatest(F.lit(2), F.ceil(F.col("rows_in_group") / heavy_rows) * 2)).cast("int")
        hot = hot.withColumn("salt", salt).drop("rows_in_group")
        hot = hot.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], F.col("salt"))
        hot = ranked(ranked(hot, [*keys, "salt"]).drop("place", "salt"), keys)
        out = ranked(cold, keys).unionByName(hot)
    return out.select(*[F.col(a).alias(g) for g, a in names.items()], F.col("item").alias(item), F.col("score").alias(score), "place")
