"""Where intermediate tables go, and that they are removed."""

import os

import pytest

from trailmill import session


class Named:
    """A session of which only the settings are asked."""

    def __init__(self, **conf):
        self.conf = self
        self.values = {k.replace("_", "."): v for k, v in conf.items()}

    def get(self, name, default=None):
        return self.values.get(name, default)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Named(spark_master=master))
    assert session.shared_dir(Named(spark_master=master, **{"spark_checkpoint_dir": "hdfs:///shared/"})) == "hdfs:///shared"


def test_intermediate_tables_are_removed(spark):
    kept, path = session.stored(spark.range(3))
    folder = path.removeprefix("file://")
    with session.intermediate_tables(spark):
        inner, other = session.stored(spark.range(5))
        assert inner.count() == 5 and os.path.isdir(other.removeprefix("file://"))
    assert not os.path.exists(other.removeprefix("file://")) and kept.count() == 3 and os.path.isdir(folder)
    session.drop_stored(spark)
    assert not os.path.exists(folder) and not session._stored


def test_small_tables_come_from_the_driver(spark):
    df, small = session.small_or_stored(spark.range(5), 5)
    assert small and df.count() == 5
    df, small = session.small_or_stored(spark.range(6), 5)
    assert not small and sorted(r.id for r in df.collect()) == [*range(6)]
