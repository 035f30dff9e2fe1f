"""Scratch space follows the cluster's setting."""

from callsight.session import scratch_path


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    def __init__(self, conf, master, folder=None):
        self.conf = Conf(conf)
        self.sparkContext = type("C", (), {"master": master, "getCheckpointDir": staticmethod(lambda: folder)})


def test_shared_folder_comes_first():
    path = scratch_path(Session({"spark.checkpoint.dir": "hdfs://shared/"}, "yarn", "hdfs://other"), "logs")
    assert path.startswith("hdfs://shared/logs-")
    assert scratch_path(Session({}, "yarn", "hdfs://other"), "logs").startswith("hdfs://other/logs-")


def test_a_cluster_never_gets_a_local_folder():
    try:
        scratch_path(Session({}, "spark://host:7077"), "logs")
    except ValueError:
        return
    raise AssertionError("no error")
