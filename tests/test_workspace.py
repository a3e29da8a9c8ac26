from types import SimpleNamespace

import pytest

from emberfall import workspace


def _session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        workspace.shared_folder(_session(master))
    assert workspace.shared_folder(_session(master, "hdfs:///scratch/")) == "hdfs:///scratch"


def test_local_master_falls_back():
    session = _session("local[8]")
    assert workspace.shared_folder(session) == workspace.shared_folder(session)


def test_clean_removes_only_this_application(spark):
    kept = workspace.materialise(spark.range(3))
    assert kept.count() == 3
    path = workspace._application_folder(spark)
    workspace.clean(spark)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
