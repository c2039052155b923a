"""Where intermediate tables go."""

import types

import pytest

from amperia.sources.interim import shared_dir


def session(master, named=None):
    set_to = []
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=set_to.append)
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default: named), sparkContext=context), set_to


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session(master)[0])
    assert shared_dir(session(master, "hdfs:///shared")[0]) == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_process_gets_a_folder_of_its_own(master):
    s, set_to = session(master)
    assert shared_dir(s) == set_to[0]
