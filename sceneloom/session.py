"""Session helpers: a local session for tests and benches, table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "sceneloom", **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the caller brings its own session."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores. Only an input of fewer files than cores is shuffled for it;
    a large input has more partitions and comes back as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
