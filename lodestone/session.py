"""Session helpers: one place for the Spark settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = 8, app: str = "lodestone", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return reachable(spark)


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package wherever the driver was started; clusters use --py-files."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def read(spark: SparkSession, sf_dir: str, name: str):
    """One input table by name; Catalyst prunes its columns and pushes filters to the scan."""
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
