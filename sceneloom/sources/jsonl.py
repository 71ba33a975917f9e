"""JSON lines and JSON documents, text reports, append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import in_order
from ..operators.ranges import numbered


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file with an explicit schema; blank lines are skipped, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of lines that aren't JSON objects. Lines are numbered from 1 within their file, blank ones too;
    a file is read whole for its numbers, so this is for the files a person edits."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("i", "value"))
    kind = F.schema_of_variant(F.try_parse_json("value"))
    return lines.where(F.trim("value") != "").where(~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).select("file", (F.col("i") + 1).alias("line"), "value")


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row a file that holds one JSON object."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def read_map(spark: SparkSession, path: str, field: str, key: str, value: str) -> DataFrame:
    """key, value of a map-shaped field of a JSON document, such as a frozen split plan."""
    rows = spark.read.schema(T.StructType([T.StructField(field, T.MapType(T.StringType(), T.StringType()))])).option("multiLine", "true").json(path)
    return rows.select(F.explode(field).alias(key, value))


def write_jsonl(df: DataFrame, path: str, order: str | None = None, *, one_file: bool = False) -> None:
    """JSON lines in UTF-8, in the given order. One file only where a reader needs it: it is written by one task."""
    out = df.orderBy(order) if order else df
    (out.coalesce(1) if one_file else out).write.option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds rows to a log folder of JSON lines, which a stream may read as it grows."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def report(df: DataFrame, by: list[str], line: Column, order: str, separator: str = "\n") -> DataFrame:
    """by, text: the lines of each group joined in order. A group is one page of a report."""
    return df.select(*by, F.col(order).alias("_o"), line.alias("_l")).groupBy(*by).agg(F.array_join(in_order(F.col("_l"), F.col("_o")), separator).alias("text"))


def pages(df: DataFrame, by: str, line: Column, order: str, lines: int = 1000, separator: str = "\n") -> DataFrame:
    """by, page, text: the lines of groups of any size, in pages of a bounded number of lines numbered from 0."""
    rows = numbered(df.select(by, F.col(order).alias("_o"), line.alias("_l")), by, "_o", number="_k", name="pages")
    return report(rows.select(by, F.floor(F.col("_k") / lines).cast("int").alias("page"), "_o", "_l"), [by, "page"], F.col("_l"), "_o", separator)


def raw_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))
