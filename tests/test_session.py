import pytest

from constellate import session as S


def test_materialised_rows_have_no_lineage_and_keep_their_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", None]), (None, None)], "k int, v array<string>")
    out = S.materialize(df, "t")
    assert out.schema == df.schema and sorted(out.collect(), key=repr) == sorted(df.collect(), key=repr)
    assert "LocalTableScan" not in out._jdf.queryExecution().executedPlan().toString()
    assert S.materialize(df.limit(0), "empty").count() == 0


class Stub:
    """A session as far as the choice of the folder needs one."""

    def __init__(self, setting, context_dir, master="local[2]"):
        self.master = master
        self.conf = self
        self.sparkContext = self
        self.setting, self.context_dir, self.applicationId = setting, context_dir, f"{setting}-{context_dir}"

    def get(self, _name, _default):
        return self.setting

    def getCheckpointDir(self):  # noqa: N802
        return self.context_dir


def test_the_shared_folder_is_the_configured_one():
    assert S.shared_dir(Stub("hdfs://x/shared/", "file:/other")) == "hdfs://x/shared"
    assert S.shared_dir(Stub(None, "hdfs://x/points/1")) == "hdfs://x/points/1"
    own = S.shared_dir(Stub(None, None))
    assert own.startswith("file://") and own == S.shared_dir(Stub(None, None))


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            S.shared_dir(Stub(None, None, master))
        assert S.shared_dir(Stub("hdfs://x/shared", None, master)) == "hdfs://x/shared"
