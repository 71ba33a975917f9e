"""Every query of the subpackage on empty tables of the given columns, and on tables of nulls."""

import os

import pytest

from sceneloom.llm import queries

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_every_query(spark, tmp_path, kind):
    from pyspark.sql import functions as F

    for name in ("documents", "eval_scenes", "master_segments", "sft_pairs"):
        t = spark.read.parquet(f"{ROOT}/{name}.parquet")
        t = t.limit(0) if kind == "empty" else t.limit(3).select([F.lit(None).cast(t.schema[c].dataType).alias(c) for c in t.columns])
        t.write.parquet(f"file://{tmp_path}/{name}.parquet")
    one_row = {"p2_check", "p4_check", "p5_check", "p5_fill"}
    for name, q in queries.queries().items():
        got = q(spark, f"file://{tmp_path}").count()
        assert got == (1 if name in one_row else got if kind == "nulls" and name.startswith(("p5", "p7_rates")) else 0), name
