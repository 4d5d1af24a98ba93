"""Tables between steps."""

import os
from types import SimpleNamespace

import pytest

from zetasky.llm import util


def test_stashes_go_when_they_are_done_with(spark):
    a, at = util.stash(spark.range(5))
    b, bt = util.stash(spark.range(6))
    assert a.count() == 5 and b.count() == 6
    util.unstash(spark, at)
    assert not os.path.exists(at) and os.path.exists(bt)
    util.unstash_all()
    assert not os.path.exists(bt) and not util._left


@pytest.mark.parametrize(("master", "folder"), [("yarn", None), ("local[2]", None), ("yarn", "hdfs://shared")])
def test_a_cluster_needs_a_shared_folder(master, folder):
    conf = SimpleNamespace(get=lambda *_: folder)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    if master == "yarn" and not folder:
        with pytest.raises(RuntimeError, match="checkpoint"):
            util.shared_folder(session)
    else:
        assert util.shared_folder(session).endswith(folder or "zetasky-shared")


def test_free_names(spark):
    df = spark.range(1).selectExpr("id as Hits", "id as hits_")
    assert util.free_name(df, "hits") == "hits__" and util.free_name(df, "other") == "other"
