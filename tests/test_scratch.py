from types import SimpleNamespace

import pytest

from slicewise.scratch import LOCAL_SHARED_DIR, NoSharedFolder, freeze_parts, shared_dir


def session(master, named=None, checkpoints=None):
    conf = SimpleNamespace(get=lambda key: named)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: checkpoints))


def test_the_session_names_the_folder():
    assert shared_dir(session("spark://host:7077", "hdfs://here/x/")) == "hdfs://here/x"
    assert shared_dir(session("yarn", None, "hdfs://set/later")) == "hdfs://set/later"
    assert shared_dir(session("local[4]", "/shared")) == "/shared"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_one(master):
    with pytest.raises(NoSharedFolder, match="spark.checkpoint.dir"):
        shared_dir(session(master))


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_one_machine_does_without(master):
    assert shared_dir(session(master)) == LOCAL_SHARED_DIR


def test_parts_are_written_one_after_the_other(spark):
    seen = []

    def parts():
        for i in range(3):
            seen.append(i)
            yield spark.range(i, i + 2)

    out = freeze_parts(parts(), "parts")
    assert seen == [0, 1, 2] and sorted(r.id for r in out.collect()) == [0, 1, 1, 2, 2, 3]
    assert freeze_parts(iter([]), "parts") is None
