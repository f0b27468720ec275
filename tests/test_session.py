"""Scratch-folder rules, with stub sessions (no second JVM needed)."""

import pytest

from tablescope.session import scratch_dir


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Context:
    def __init__(self, master, ckpt=None):
        self.master, self.ckpt = master, ckpt

    def getCheckpointDir(self):
        return self.ckpt

    def setCheckpointDir(self, path):
        self.ckpt = path


class _Session:
    def __init__(self, master, conf=None, ckpt=None):
        self.conf = _Conf(conf or {})
        self.sparkContext = _Context(master, ckpt)


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(ValueError, match="shared storage"):
        scratch_dir(_Session("yarn"))


def test_setting_from_the_session_is_used():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert scratch_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs:///shared/ckpt"


def test_local_master_gets_a_temporary_folder():
    s = _Session("local[4]")
    path = scratch_dir(s)
    assert path and s.conf.get("spark.checkpoint.dir") == path
