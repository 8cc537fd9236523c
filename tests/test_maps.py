"""The forms of map files give the same faces."""

import json

import pytest

from ninefold.operators import mesh as M
from ninefold.sources.maps import read_maps

POLES = {"up": (0.0, 0.0, 1.0), "down": (0.0, 0.0, -1.0), "zero": (1.0, 0.0, 0.0), "east": (0.0, 1.0, 0.0), "far": (-1.0, 0.0, 0.0), "west": (0.0, -1.0, 0.0)}
DEGREES = {"up": (90, 0), "down": (-90, 0.0), "zero": (0, 0), "east": (0, 90), "far": (0.0, 180), "west": (0, -90.0)}
SIDES = [{"name": f"{p}-{a}", "vx": [list(POLES).index(x) for x in (p, a, b)], "grid": [k, n], "up": p == "up"} for n, p in enumerate(("up", "down")) for k, (a, b) in enumerate((("zero", "east"), ("east", "far"), ("far", "west"), ("west", "zero")))]


def lettered(lat, lon):
    return [[abs(lat), "S" if lat < 0 else "N"], [abs(lon), "w" if lon < 0 else "E"]]


FORMS = {
    "xyz": lambda n: {"name": n, "xyz": POLES[n]},
    "ll": lambda n: {"idx": 7, "name": n, "ll": DEGREES[n]},
    "pairs": lambda n: {"name": n, "ll": lettered(*DEGREES[n]), "sp": [1, 2]},
    "both": lambda n: {"name": n, "xyz": POLES[n], "ll": lettered(11, 12)},
}


@pytest.fixture()
def folder(tmp_path):
    for form, vertex in FORMS.items():
        body = {"id": form, "vertices": [vertex(n) for n in POLES], "sides": SIDES}
        if form == "ll":
            body |= {"grid": [0, 0, 7, 3], "topo": "WGS84"}
        if form == "pairs":
            body |= {"mapping": {"phi": [5, 4, 3, 2, 1, 0], "own": [0]}, "grid": []}
        (tmp_path / f"{form}.json").write_text(json.dumps(body, indent="\t"))
    return tmp_path


def test_all_forms_give_the_same_faces(spark, folder):
    maps = read_maps(spark, str(folder))
    by_map: dict = {}
    for r in maps.faces.collect():
        by_map.setdefault(r["map"], {})[r["name"]] = (r["up"], r["gx"], r["gy"], [[round(x, 12) + 0.0 for x in r[f"p{k}"]] for k in range(3)])
    assert set(by_map) == set(FORMS) and all(len(f) == 8 for f in by_map.values())
    assert by_map["xyz"] == by_map["ll"] == by_map["pairs"] == by_map["both"]
    assert all(r["equilateral"] for r in M.check_equilateral(maps.faces).collect())
    assert {r["map"]: r["grid"] for r in maps.grids.collect()} == {"xyz": [0, 0, 11, 4], "ll": [0, 0, 7, 3], "pairs": [0, 0, 11, 4], "both": [0, 0, 11, 4]}
    assert sorted((r["map"], r["other"], r["idx"], r["other_idx"]) for r in maps.mappings.collect()) == sorted([("pairs", "phi", k, 5 - k) for k in range(6)] + [("pairs", "own", 0, 0)])


def test_odd_maps(spark, tmp_path):
    lines = ['{"vertices": [{"xyz": [1, 0, 0]}, {"name": "none"}, {"ll": [10, [5, "W"]]}, {"ll": "x"}], "sides": [{"vx": [0, 1, 9]}, {"vx": [0, 1, 2], "name": "odd"}], "mapping": null}', "", '{"id": "empty"}', '{"id": 4, "vertices": [], "sides": [], "mapping": {}, "grid": "no"}']
    (tmp_path / "maps.txt").write_text("\n".join(lines))
    maps = read_maps(spark, str(tmp_path), lines=True)
    v = {r["idx"]: r for r in maps.vertices.collect()}
    assert (v[0]["x"], v[1]["x"], v[3]["z"]) == (1.0, None, None) and round(v[2]["z"], 6) == 0.173648 and v[2]["y"] < 0
    assert [(r["name"], r["map"]) for r in maps.faces.collect()] == [("odd", None)]
    assert sorted((r["map"] or "", r["grid"]) for r in maps.grids.collect()) == [("", [0, 0, 11, 4]), ("4", [0, 0, 11, 4]), ("empty", [0, 0, 11, 4])] and maps.mappings.count() == 0
    (tmp_path / "bad.txt").write_text("{not json}")
    with pytest.raises(Exception, match="MALFORMED"):
        read_maps(spark, str(tmp_path / "bad.txt"), lines=True).grids.collect()
