"""Building blocks that keep plans even when a key holds a large share of all rows."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows from which a key is hot in a join; the MOST_HEAVY hottest are met by broadcast, any further one holds less than a MOST_HEAVY-th of all rows.
HEAVY_ROWS = 250_000
MOST_HEAVY = 10_000
#: A group is heavy from a SHARE-th of a task's fair share of all rows on, but not below LEAST_HEAVY rows.
SHARE, LEAST_HEAVY = 4, 10_000
#: Tables written by materialise() and settle() and not yet released: (session, path).
_WRITTEN: list[tuple[SparkSession, str]] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set on the context; a temporary one only where neither is and all runs in one process (tests).

    On a cluster a folder has to be named: a machine's own is no place for what other machines read.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if not current.isDefined():
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "gleanery-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def heavy_limit(rows: int, spark: SparkSession) -> int:
    """Rows from which a group is heavy: a part of a task's fair share. So no more than SHARE * (number of tasks) groups can be."""
    return max(LEAST_HEAVY, rows // (SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def heavy_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """The groups of more than `limit` rows with their exact counts (`rows_in_group`); None if there are none.

    At most |df| / limit groups come back; with heavy_limit() that is a multiple of the number of tasks, so the result may be broadcast.
    """
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_in_group")).filter(F.col("rows_in_group") > limit)
    rows = found.collect()
    return df.sparkSession.createDataFrame(rows, found.schema) if rows else None


def split_by(df: DataFrame, heavy: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of heavy groups with rows_in_group, all other rows); heavy comes from heavy_keys and is bounded."""
    small = F.broadcast(heavy.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "rows_in_group"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    hot = df.join(small, on, "inner").drop(*[f"_h_{k}" for k in keys])
    return hot, df.join(small, on, "left_anti")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Row numbers within groups of any size: one range sort of everything, then an offset for each (group, partition).

    `order` has to be total within a group. The sorted rows are checkpointed, for their place must not change between
    the two reads. The table of offsets has at most groups + partitions rows.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    laid = checkpoint(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq"))
    )
    per = laid.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    small = F.broadcast(per.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_part").alias("_o_part"), "_first", "_before"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys] + [F.col("_part") == F.col("_o_part")])
    out = laid.join(small, on, "inner").withColumn(name, F.col("_seq") - F.col("_first") + F.col("_before") + 1)
    return out.drop(*[f"_o_{k}" for k in keys], "_o_part", "_part", "_seq", "_first", "_before")


def hot_cold_join(left: DataFrame, right: DataFrame, key: str, weight: str, limit: int = HEAVY_ROWS, most: int = MOST_HEAVY) -> DataFrame:
    """Inner join on one key that `right` has once and that some values hold many rows of `left` for.

    right[weight] says how many rows of left have the key. The heaviest keys (at most `most`, each over `limit`) are
    broadcast, so that their rows stay where they are; all other rows meet by an ordinary shuffle.
    """
    hot_keys = right.filter(F.col(weight) > limit).orderBy(F.desc(weight), key).limit(most)
    hot = F.broadcast(hot_keys)
    cold_right = right.join(F.broadcast(hot_keys.select(key)), key, "left_anti")
    cold_left = left.join(F.broadcast(hot_keys.select(key)), key, "left_anti")
    return left.join(hot, key, "inner").unionByName(cold_left.join(cold_right, key, "inner"))


def latest(df: DataFrame, key: str, when: str, others: list[str]) -> DataFrame:
    """One row for each non-null key: that of the latest `when` (ties by a hash of the row).

    A rank of one needs no whole group: Spark cuts each map task's rows to one a key before they are shuffled.
    """
    w = Window.partitionBy(key).orderBy(F.col(when).desc_nulls_last(), F.xxhash64(*others), *[F.col(c) for c in others[:1]])
    return (
        df.select(key, when, *others).filter(F.col(key).isNotNull())
        .withColumn("_place", F.row_number().over(w)).filter(F.col("_place") == 1).drop("_place", when)
    )


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder, which release() deletes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df once as Parquet beside the checkpoints and read it back: for a large table that several branches need."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> tuple[DataFrame, str]:
    """materialise(), and the path for discard(). The shuffles that made the table are deleted at once, not when the driver happens to collect its garbage."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, was = new_path(spark, "table"), spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, was)
    return spark.read.schema(df.schema).parquet(path), path


def taken(spark: SparkSession, path: str) -> int:
    """Bytes of a table of settle()."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def discard(path: str) -> None:
    """Delete a table of settle() that nothing reads any more."""
    for entry in [x for x in _WRITTEN if x[1] == path]:
        _WRITTEN.remove(entry)
        at = entry[0]._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(entry[0]._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Delete the tables of materialise(), for when results are written; DataFrames that still read them fail from then on."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 the session has ended; its folder goes with the shared folder's cleaning
            return


atexit.register(release)
