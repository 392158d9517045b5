from types import SimpleNamespace

import pytest

from tabscope.plans.scratch import scratch_folder


def session(master, settings):
    conf = SimpleNamespace(get=settings.get, set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_cluster_without_shared_folder_is_an_error():
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(ValueError, match="shared folder"):
            scratch_folder(session(master, {}), "x")


def test_shared_folder_is_used_and_names_do_not_repeat():
    s = session("yarn", {"spark.checkpoint.dir": "hdfs://nn/shared/"})
    one, two = scratch_folder(s, "x"), scratch_folder(s, "x")
    assert one.startswith("hdfs://nn/shared/x-") and one != two


def test_one_process_may_use_a_temporary_folder():
    settings = {}
    assert scratch_folder(session("local[4]", settings), "x").startswith(settings["spark.checkpoint.dir"])
