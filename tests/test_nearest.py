"""Nearest stations: dense regions, the poles, 180 degrees and ties against brute force, and the stations a point meets."""

import numpy as np

from heliospan.operators import spatial


def brute(points, stations, radius, k):
    """The nearest stations of each point in the order of the ranking."""
    out, km = {}, spatial.KM_PER_DEGREE
    for key, lat, lon in points:
        if lat is None or lon is None:
            continue
        cos = max(0.05, np.cos(lat * np.pi / 180))
        first = np.floor((lon - min(180.0, radius / (km * cos)) + 180) / 2)
        found = []
        for name, slat, slon, _ in stations:
            if slat is None or slon is None:
                continue
            apart = slon - lon
            apart += -360 if apart > 180 else 360 if apart < -180 else 0
            d2 = (apart * cos * km) ** 2 + ((slat - lat) * km) ** 2
            if d2 <= radius**2:
                row, column = min(90, np.floor((slat + 90) / 2)), min(179, np.floor((slon + 180) / 2))
                found.append((round(d2, 6), row, (column - first) % 180, name))
        out.update({(key, i): (f[3], f[0]) for i, f in enumerate(sorted(found)[:k], 1)})
    return out


def frames(spark, points, stations):
    return spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(stations, "station long, lat double, lon double, v double")


def test_nearest_stations(spark):
    rng = np.random.default_rng(4)
    spread = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(250)]
    dense = [(48 + rng.normal(0, 0.2), 11 + rng.normal(0, 0.3)) for _ in range(500)]
    poles = [(s * (90 - rng.uniform(0, 2)), rng.uniform(-180, 180)) for s in (1, -1) for _ in range(60)]
    edge = [(rng.uniform(-1, 1), s * (180 - rng.uniform(0, 0.6))) for s in (1, -1) for _ in range(60)]
    ties = [(10.0, 20.0)] * 12 + [(10.5, 20.5), (10.5, 19.5), (9.5, 20.5), (9.5, 19.5)]
    places = [*spread, *dense, *poles, *edge, *ties, (90.0, 0.0), (-90.0, 180.0), (None, 3.0), (4.0, None)]
    stations = [(i, a if a is None else float(a), b if b is None else float(b), float(i)) for i, (a, b) in enumerate(places)]
    at = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)] + [(48 + rng.normal(0, 0.6), 11 + rng.normal(0, 0.9)) for _ in range(40)]
    at += [(90.0, 5.0), (-90.0, -180.0), (89.5, 179.9), (0.0, 180.0), (0.1, -180.0), (10.0, 20.0), (10.2, 20.0), (0.3, 179.99), (None, 1.0), (1.0, None), (90.5, 0.0)]
    points = [(i, a if a is None else float(a), b if b is None else float(b)) for i, (a, b) in enumerate(at)]
    for radius in (300.0, 2500.0):
        p, s = frames(spark, points, stations)
        rows = spatial.nearest_stations(p, s, "id", "station", "v", radius_km=radius).collect()
        got = {(r["id"], r["place"]): (r["station"], round(r["d2"], 6)) for r in rows}
        want = brute(points, stations, radius, spatial.NEIGHBOURS)
        assert got.keys() == want.keys()
        # equal distances may differ in their last bits
        assert all(np.isclose(got[k][1], want[k][1], atol=1e-5) for k in want)
        assert sum(got[k][0] != want[k][0] for k in want) == 0


def test_dense_regions_meet_few(spark):
    """Ten times the stations in a region leave the number that its points meet as it was."""
    rng = np.random.default_rng(5)
    points = [(i, float(rng.uniform(40, 44)), float(rng.uniform(0, 4))) for i in range(50)]
    met = []
    for n in (4000, 40000):
        stations = [(i, float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(rng.uniform(39, 45, n), rng.uniform(-1, 5, n), strict=True))]
        p, s = frames(spark, points, stations)
        met.append(spatial.candidates(p, s, "id", "station", "v").count() / len(points))
    assert max(met) < 700 and met[1] < 2 * met[0]


def test_nearest_of_nothing(spark):
    p, s = frames(spark, [(1, 0.0, 0.0)], [])
    assert spatial.nearest_stations(p, s, "id", "station", "v").count() == 0
    assert spatial.nearest_stations(p.limit(0), s, "id", "station", "v").count() == 0
