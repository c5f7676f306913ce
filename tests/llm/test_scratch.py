from types import SimpleNamespace

import pytest

from diurna.llm import scratch


def fake(master, conf=None):
    context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: conf or {})
    return SimpleNamespace(conf=conf or {}, sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_clusters_need_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(fake(master))
    assert scratch.shared_dir(fake(master, {"spark.checkpoint.dir": "hdfs://shared/"})) == "hdfs://shared"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_machine_may_use_a_temporary_folder(master):
    assert scratch.shared_dir(fake(master)).startswith("/")


def test_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    df = scratch.materialize(spark.range(5))
    assert df.count() == 5 and len(list(tmp_path.iterdir())) == 1
    scratch.clean(spark)
    assert not list(tmp_path.iterdir())
