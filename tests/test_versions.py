"""Published versions: undo and redo, the limit, and writers that die half way."""

import os

import pytest
from pyspark.sql import functions as F

from hexloom.operators.versions import Versions


def values(v, table="cells"):
    return sorted(r.n for r in v.load(table).collect())


def test_undo_and_redo(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "map"))
    assert v.undo() is None and v.redo() is None
    with pytest.raises(ValueError, match="no version"):
        v.load("cells")
    table = lambda n: {"cells": spark.range(n).withColumnRenamed("id", "n")}
    first = v.publish(table(2))
    v.publish({"cells": v.load("cells").withColumn("n", F.col("n") + 10)})  # reads the version that it follows
    assert values(v) == [10, 11]
    assert v.undo() == first and values(v) == [0, 1] and v.undo() is None
    assert v.redo() and values(v) == [10, 11] and v.redo() is None
    v.undo()
    v.publish(table(4))
    assert values(v) == [0, 1, 2, 3] and v.redo() is None and v.undo() == first
    with pytest.raises(ValueError, match="no table"):
        v.load("rivers")
    with pytest.raises(ValueError, match="more than"):
        v.load("cells", most_bytes=10)


def test_old_versions_go(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "map"), undone=2)
    for n in range(1, 6):
        v.publish({"cells": spark.range(n).withColumnRenamed("id", "n")})
    assert len(v.state()["undo"]) == 2 and len([f for f in os.listdir(tmp_path / "map") if f.startswith("v")]) == 3
    assert v.undo() and v.undo() and v.undo() is None and len(values(v)) == 3


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    v = Versions(spark, str(tmp_path / "map"))
    v.publish({"cells": spark.range(3).withColumnRenamed("id", "n")})
    before = v.state()

    def dies(*_):
        raise OSError("gone")

    for step in ("_point", "_rename"):  # all tables written and named but not pointed to; and before they are named
        with monkeypatch.context() as m:
            m.setattr(Versions, step, dies)
            with pytest.raises(OSError):
                Versions(spark, str(tmp_path / "map")).publish({"cells": spark.range(9).withColumnRenamed("id", "n")})
        assert v.state() == before and values(v) == [0, 1, 2]
    with pytest.raises(Exception, match="broken"):
        v.publish({"rivers": spark.range(2), "cells": spark.range(2).select(F.raise_error(F.lit("broken")).cast("long").alias("n"))})
    assert v.state() == before and values(v) == [0, 1, 2]
    assert v.recover() == 3 and v.recover() == 0 and values(v) == [0, 1, 2]
    assert sorted(f for f in os.listdir(tmp_path / "map") if not f.startswith(".")) == sorted(["state.json", before["current"]])
