"""Local sessions for tests and benchmarks; on a cluster the session is given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "12g", name: str = "gleanery") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false", "spark.driver.extraJavaOptions": "-XX:+UseParallelGC",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
