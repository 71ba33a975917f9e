"""Cutting lineage with written tables in the folder all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset (tests, a laptop) an
own folder is made. A table written here survives the loss of any executor; a query that goes
on from it reads plain Parquet, so column pruning and size statistics work again.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Folders made for local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; on a local master one is made where none is set, elsewhere that is an error."""
    root = spark.conf.get(_KEY, None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"{_KEY} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sceneloom-")
    return _OWN[app]


def scratch_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder."""
    return f"{shared_dir(spark)}/sceneloom/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this application. Call it when no result that reads one is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
