"""The checkpoint folder: the session's own, one of ours on a single machine, none on a cluster without a shared one."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from aerolith.session import checkpoint_root


def session(master, folder=None):
    context = SimpleNamespace(master=master, _dir=None, getCheckpointDir=lambda: context._dir, setCheckpointDir=lambda d: setattr(context, "_dir", d))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=context)


def test_the_named_folder_is_used():
    assert checkpoint_root(session("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x"


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            checkpoint_root(session(master))


def test_one_machine_keeps_one_folder():
    spark = session("local[8]")
    assert checkpoint_root(spark) == checkpoint_root(spark)
