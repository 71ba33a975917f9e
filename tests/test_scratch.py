import pytest

from sceneloom import scratch


class Session:
    """As much of a session as the folder's choice looks at."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_the_named_folder_comes_first():
    assert scratch.shared_dir(Session("file:///shared/", "spark://host:7077")) == "file:///shared"
    own = scratch.shared_dir(Session(None, "local[4]"))
    assert own.startswith("file://") and own == scratch.shared_dir(Session(None, "local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch.shared_dir(Session(None, master))


def test_tables_are_written_and_dropped(spark):
    df = spark.range(5).selectExpr("id", "array(named_struct('a', id, 'b', cast(null as string))) as x")
    back = scratch.materialise(df, "t")
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(r.id for r in back.collect()) == list(range(5))
    assert scratch.materialise(df.limit(0), "empty").count() == 0
    scratch.drop_scratch(spark)
    with pytest.raises(Exception):
        back.collect()
