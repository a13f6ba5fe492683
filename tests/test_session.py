from __future__ import annotations

from types import SimpleNamespace

import pytest

from cellprofiles import session


def fake(master, warehouse, checkpoint=None):
    settings = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": checkpoint}
    context = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: None)
    conf = SimpleNamespace(get=lambda name, default=None: settings.get(name) or default)
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.fixture(autouse=True)
def nothing_registered(monkeypatch):
    monkeypatch.setattr(session, "_roots", set())
    monkeypatch.setattr(session.atexit, "register", lambda *a: None)


@pytest.mark.parametrize("warehouse", ["file:/home/me/warehouse", "/home/me/warehouse"])
def test_a_local_folder_is_refused_on_a_cluster(warehouse):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(fake("spark://host:7077", warehouse))
    assert session.scratch_root(fake("local[4]", warehouse)).startswith(warehouse)


def test_shared_folders_are_taken():
    assert session.scratch_root(fake("yarn", "hdfs://a/w")) == "hdfs://a/w/_scratch/cellprofiles-app"
    assert session.scratch_root(fake("yarn", "/w", "file:///nfs/x/")) == "file:///nfs/x/cellprofiles-app"
