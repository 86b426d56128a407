import json

from hexloom.operators import geometry

LINE = [[0, 0], [1, 2], [3.5, 4]]
RING = [[0, 0], [4, 0], [4, 4], [0, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 1]]


def plain(g):
    """The polylines of a parsed geometry."""
    kind = g.get("type") if isinstance(g, dict) else None
    if kind == "Feature":
        return plain(g.get("geometry"))
    if kind in ("FeatureCollection", "GeometryCollection"):
        return [line for x in g["features" if kind[0] == "F" else "geometries"] for line in plain(x)]
    c = g.get("coordinates") if kind else None
    lines = {"LineString": lambda: [c], "MultiPoint": lambda: [c], "Polygon": lambda: c, "MultiLineString": lambda: c, "MultiPolygon": lambda: [r for p in c for r in p]}.get(kind, lambda: [])()
    return [[p[:2] for p in line] for line in lines if len(line) > 1]


def test_nested_geometries(spark):
    line, polygon = {"type": "LineString", "coordinates": LINE}, {"type": "Polygon", "coordinates": [RING, HOLE]}
    deep = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [7, 7]}, {"type": "GeometryCollection", "geometries": [polygon, {"type": "GeometryCollection", "geometries": [line, line]}]}, line]}
    shapes = [
        line, polygon, {"type": "MultiPolygon", "coordinates": [[RING, HOLE], [RING]]}, {"type": "MultiLineString", "coordinates": [LINE, [[5, 5]], LINE]}, {"type": "Point", "coordinates": [1, 1]},
        {"type": "Feature", "properties": {"type": "x"}, "geometry": polygon}, {"type": "Feature", "geometry": None}, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": deep}, {"type": "Feature", "geometry": line}]}, deep,
        {"type": "LineString", "coordinates": [[1, 2, 3], [4, 5, 6]]}, {"type": "Circle", "coordinates": [[1, 2], [3, 4]]}, [1, 2], {"type": "GeometryCollection", "geometries": []}, {"coordinates": LINE},
    ]
    rows = [(i, json.dumps(s)) for i, s in enumerate(shapes)] + [(90, None), (91, ""), (92, "{broken"), (93, '{"type": "LineString", "coordinates": [["a", "b"], [1, 2]]}'), (0, json.dumps(deep))]
    found = {}
    for r in geometry.polylines(spark.createDataFrame(rows, "id int, geometry string").repartition(4)).collect():
        found.setdefault(r.id, {}).setdefault((r.part, r.seq), []).append([r.x, r.y])
    wanted = {}
    for i, text in rows:
        if text and text[0] in "{[" and i < 90:
            for part, points in enumerate(plain(json.loads(text))):
                for seq, p in enumerate(points):
                    wanted.setdefault(i, {}).setdefault((part, seq), []).append([float(x) for x in p])
    same = lambda d: {i: {k: sorted(v) for k, v in parts.items()} for i, parts in d.items()}
    assert same(found) == same(wanted) and len(wanted) == 8


def test_texts_are_parsed_once_and_parts_need_no_join(spark):
    rows = [(i, json.dumps({"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": LINE}, {"type": "Polygon", "coordinates": [RING, HOLE]}]})) for i in range(5)]
    found = geometry.polylines(spark.createDataFrame(rows, "id int, geometry string"))
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "parse" not in plan.lower().replace("== parsed logical plan ==", "")
    assert {(r.id, r.part) for r in found.collect()} == {(i, k) for i in range(5) for k in range(3)}
