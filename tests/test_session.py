import os

from hexloom import session
from hexloom.operators.water import lake_levels


def test_tables_are_deleted(spark):
    session.clean_up(spark)
    kept, gone = (session.cut_lineage(spark.range(n)) for n in (3, 4))
    paths = [session._written[t] for t in (kept, gone)]
    assert [t.count() for t in (kept, gone)] == [3, 4] and all(os.path.isdir(p) for p in paths)
    session.release(gone)
    assert [os.path.isdir(p) for p in paths] == [True, False]
    del gone
    assert session.clean_up(spark) == 1 and session.clean_up(spark) == 0 and not os.path.isdir(paths[0])


def test_upper_medians(spark):
    heights = {1: [5.0], 2: [1.0, 9.0], 3: [4.0, 4.0, 4.0, 80.0], 4: [7.0, 1.0, 3.0, 1.0, 30.0]}
    rows = [(i, b, h) for b, values in heights.items() for i, h in enumerate(values)]
    found = {r.body: (r.n, r.level, r.kept) for r in lake_levels(spark.createDataFrame(rows, "node long, body long, elevation double").repartition(3)).collect()}
    wanted = {b: (len(v), sorted(v)[len(v) // 2], sum(abs(h - sorted(v)[len(v) // 2]) <= 15 for h in v)) for b, v in heights.items()}
    assert found == wanted
