"""A local session with the settings that queries expect; clusters bring their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = SparkSession.builder.master(f"local[{cores}]").config(map={
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true",
    }).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
