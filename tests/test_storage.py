"""Stored tables: written to the shared folder, and gone when nobody needs them."""

import os
import urllib.parse

import pytest

from slotweave import storage
from slotweave.operators import slots


def tables(spark):
    path = urllib.parse.urlparse(storage.shared_dir(spark)).path
    return {x for x in os.listdir(path) if x.startswith("slotweave-")} if os.path.isdir(path) else set()


def test_scope_leaves_what_is_kept(spark):
    before = tables(spark)
    with storage.scope(spark) as kept:
        a = storage.stored(spark.range(5), "a")
        with storage.scope(spark) as inner:
            inner.append(storage.stored(spark.range(6), "b"))
            storage.stored(spark.range(7), "c")
        assert len(tables(spark) - before) == 2
        kept.append(a)
    left = tables(spark) - before
    assert len(left) == 1 and a.count() == 5
    storage.drop(a)
    storage.drop(spark.range(1))
    assert tables(spark) == before


def test_scope_cleans_up_after_errors(spark):
    before = tables(spark)
    with pytest.raises(ZeroDivisionError), storage.scope(spark):
        storage.stored(spark.range(5))
        1 / 0  # noqa: B018
    assert tables(spark) == before


def test_rounds_replace_each_other(spark):
    before = tables(spark)
    with storage.scope(spark):
        links = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "slot bigint, parent bigint")
        got = slots.ancestry(links, links["slot"] == 1)
        assert got.where("linked").count() == 39
        assert len(tables(spark) - before) == 1  # the last round's
    assert tables(spark) == before
