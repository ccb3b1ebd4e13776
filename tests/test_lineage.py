"""Tables that blocks store and delete."""

import threading

import pytest

from trackloom.plans.lineage import scratch, stored


def test_a_block_deletes_only_its_own_tables(spark):
    before = stored(spark.range(3), "t")
    held, done, found = threading.Event(), threading.Event(), []

    def elsewhere():
        with scratch(spark):
            mine = stored(spark.range(5), "t")
            held.set()
            done.wait(60)
            found.append(mine.count())

    other = threading.Thread(target=elsewhere)
    with scratch(spark):
        outer = stored(spark.range(7), "t")
        other.start()
        assert held.wait(60)
        with scratch(spark):
            inner = stored(spark.range(9), "t")
            assert inner.count() == 9
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            inner.collect()
        assert outer.count() == 7
    done.set()
    other.join()
    assert (before.count(), found) == (3, [5])
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        outer.collect()
