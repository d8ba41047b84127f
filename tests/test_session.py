from __future__ import annotations

from types import SimpleNamespace

import pytest

from riskweave.session import shared_folder, side_by_side, store


def fake(master, conf):
    seen = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: seen[-1] if seen else None, setCheckpointDir=seen.append
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1000]"])
def test_a_cluster_must_name_the_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake(master, {}))
    assert shared_folder(fake(master, {"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"


def test_local_mode_takes_a_temporary_folder():
    assert "riskweave-" in shared_folder(fake("local[8]", {}))


def test_store_reads_the_same_rows(spark):
    assert store(spark.range(5), "five").count() == 5
    assert store(spark.range(0), "none").count() == 0


def test_side_by_side_nests(spark):
    def outer(n):
        return sum(side_by_side(lambda k: spark.range(k + 1).count(), [n, n + 1]))

    assert side_by_side(outer, [0, 1, 2]) == [3, 5, 7]
    assert side_by_side(outer, []) == []
    with pytest.raises(ZeroDivisionError):
        side_by_side(lambda n: 1 // n, [1, 0])
