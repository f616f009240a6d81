import numpy as np
import pytest

from fotolake.operators import places as p


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, lat double, lon double, cell string, native int")


def run(spark, rows, regions=None, radius=50.0, **kw):
    reg = None if regions is None else spark.createDataFrame(regions, "region_id long, ring_lat array<double>, ring_lon array<double>, id string")
    return sorted(tuple(r) for r in p.near_and_inside(frame(spark, rows), reg, radius_m=radius, **kw).collect())


SQUARE = [(900, [0.0, 0.0, 10.0, 10.0], [170.0, -170.0, -170.0, 170.0], ""), (901, None, None, ""), (902, [1.0, 2.0], [1.0, 2.0], ""), (903, [0.0, None, 1.0], [0.0, 1.0, 2.0], "")]


def test_what_counts_as_a_place(spark):
    rows = [(1, 5.0, 179.0, "", 0), (1, 5.0, 179.0, "", 0), (2, 5.0, None, "", 0), (3, 95.0, 5.0, "", 0), (4, 0.0, 0.0, "", 0), (5, 5.0, float("nan"), "", 0), (6, 5.0, 179.0, "", 0), (7, 5.0, -179.9999, "", 0), (None, 5.0, 179.0, "", 0), (8, 0.0, 5.0, "", 0)]
    assert run(spark, rows, SQUARE) == [("inside", 1, 900), ("inside", 6, 900), ("inside", 7, 900), ("near", 1, 6)]
    assert run(spark, rows, SQUARE, expand=False) == [("inside", 1, 900), ("inside", 7, 900), ("same", 1, 6)]


def test_empty(spark):
    assert run(spark, [], SQUARE) == [] and run(spark, [(1, 5.0, 5.0, "", 0)]) == [] and run(spark, [(1, 5.0, 175.0, "", 0)], []) == []


def test_date_line_and_pole(spark):
    rows = [(1, 20.0, 179.9999, "", 0), (2, 20.0, -179.9999, "", 0), (3, 89.9999, 0.0, "", 0), (4, 89.9999, 180.0, "", 0), (5, 20.0, 179.99, "", 0)]
    assert run(spark, rows) == [("near", 1, 2), ("near", 3, 4)]


def test_cells_of_two_levels_equal_all_distances():
    rng = np.random.default_rng(5)
    pivots = p.unit(np.concatenate([rng.uniform(-80, 80, 300), 48 + rng.normal(0, 0.5, 300)]), np.concatenate([rng.uniform(-180, 180, 300), 11 + rng.normal(0, 0.5, 300)]))
    xyz, reach = p.unit(rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500)), rng.choice([50.0, 5e4, 3e7], 500)
    d = p.arc_m(xyz @ pivots.T)
    home = d.argmin(axis=1)
    want = {(i, int(j), int(home[i])) for i in range(500) for j in np.nonzero(d[i] <= d[i, home[i]] + 2 * (reach[i] + p.SLACK_M))[0]}
    assert set(zip(*(x.tolist() for x in p.Cells(pivots).near(xyz, reach)))) == want
    assert [x.tolist() for x in p.Cells(pivots[:1]).near(xyz[:2], reach[:2])] == [[0, 1], [0, 0], [0, 0]]


def test_a_crowded_spot_is_one_spot(spark):
    rows = [(k, 48.0, 11.0, "", 0) for k in range(300)] + [(1000, 48.0001, 11.0, "", 0), (1000, -10.0, 5.0, "", 0), (1001, -10.0, 5.0, "", 0)]
    got = run(spark, rows, expand=False)
    assert got == [("near", 0, 1000)] + [("same", 0, k) for k in range(1, 300)] + [("same", 1000, 1001)]
    assert len(run(spark, rows)) == 300 * 299 // 2 + 300 + 1


@pytest.mark.parametrize("cell,corners", [(5, 0), (1500, 10)])
def test_equals_brute_force(spark, cell, corners, monkeypatch):
    monkeypatch.setattr(p, "CELL_PLACES", cell)
    monkeypatch.setattr(p, "MAX_CORNERS", corners)
    rng = np.random.default_rng(3)
    lat = np.concatenate([rng.uniform(-80, 80, 150), 48 + rng.normal(0, 0.002, 250), np.full(20, 10.0)])
    lon = np.concatenate([rng.uniform(-180, 180, 150), 11 + rng.normal(0, 0.002, 250), np.full(20, 10.0)])
    rows = [(i, float(a), float(b), "", 0) for i, (a, b) in enumerate(zip(lat, lon))]
    ring = [(9000, [47.999, 48.001, 48.0, 48.003], [10.998, 10.999, 11.0, 11.004], ""), (9001, [-80.0, -80.0, 80.0, 80.0], [-100.0, 50.0, 50.0, -100.0], "")]
    near = {(i, j) for i in range(len(lat)) for j in range(i + 1, len(lat)) if p.great_circle_m(lat[i], lon[i], lat[j], lon[j]) <= 120}

    def inside(i, la, lo):  # ray along the parallel, rings here don't cross the date line
        hit = False
        for k in range(len(la)):
            m = (k + 1) % len(la)
            if (la[k] > lat[i]) != (la[m] > lat[i]) and lon[i] < (lo[m] - lo[k]) * (lat[i] - la[k]) / (la[m] - la[k]) + lo[k]:
                hit = not hit
        return hit

    # a side of 150 degrees is no longer than half the globe, so the second ring means what it shows
    want = [("near", a, b) for a, b in near] + [("inside", i, r) for r, la, lo, _ in ring for i in range(len(lat)) if inside(i, la, lo)]
    assert run(spark, rows, ring, 120.0) == sorted(want)
