import os

import pytest

from rowdelta.llm.common import forget, free_name, input_bytes, scratch, shared_dir, spread, stored


def local(path):
    return path.removeprefix("file:").replace("//", "/")


def test_stored_tables_live_until_forgotten(spark):
    a = stored(spark.range(5), "a")
    with scratch(spark):
        b, c = stored(a, "b"), stored(a, "c")
        forget(c)
        assert not os.path.exists(local(c._stored_at)) and b.count() == 5
    assert not os.path.exists(local(b._stored_at)) and a.count() == 5
    forget(a)
    forget(a)
    assert not os.path.exists(local(a._stored_at))


def test_chunks_follow_the_input(spark):
    a = stored(spark.range(100_000), "a")
    assert input_bytes(a) > 0
    assert spread(a, 1000, 7) > 100 and spread(a, 1 << 40, 7) == 7


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Cluster)


def test_threads_delete_their_own_tables(spark):
    from threading import Thread

    with scratch(spark):
        mine = stored(spark.range(3), "mine")

        def other():
            with scratch(spark):
                stored(spark.range(3), "other")

        t = Thread(target=other)
        t.start()
        t.join()
        assert mine.count() == 3
    assert not os.path.exists(local(mine._stored_at))


def test_free_names(spark):
    assert free_name(spark.range(1).selectExpr("id AS Keep", "id AS _keep"), "keep") == "__keep"
