"""Raster tiles: rings at the poles and across 180 degrees, from cells and from a file."""

import numpy as np
import pytest

from heliospan.operators import spatial
from heliospan.sources import files


def ring_of(grid, row, col):
    """The first ring with land and the mean of its cells. grid: months, rows, columns."""
    _, rows, columns = grid.shape
    for ring in range(4):
        near = [(r, c % columns) for r in range(row - ring, row + ring + 1) for c in range(col - ring, col + ring + 1) if 0 <= r < rows and max(abs(r - row), abs(c - col)) == ring]
        land = [x for x in near if grid[0][x]]
        if land:
            return ring, len(land), [(sum(int(grid[m][x]) for x in land) / len(land) - 1) / 254.0 for m in range(12)]
    return None, None, None


@pytest.mark.parametrize("rows,columns", [(18, 36), (50, 130), (4, 7)])
def test_rings_from_tiles(spark, tmp_path, rows, columns):
    rng = np.random.default_rng(rows)
    grid = rng.integers(1, 255, (12, rows, columns)).astype(np.uint8)
    grid[:, rng.random((rows, columns)) < 0.93] = 0
    (tmp_path / "grid").write_bytes(grid.tobytes())
    degrees = 180.0 / rows
    places = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300), strict=True))]
    places += [(300, 90.0, 180.0), (301, -90.0, -180.0), (302, 90.0, 179.99), (303, 0.0, 180.0)]
    points = spark.createDataFrame(places, "id long, lat double, lon double")
    cells = files.raster(spark, str(tmp_path / "grid"), rows, columns)
    store = files.raster_tiles(spark, str(tmp_path / "grid"), rows, columns)
    held = {(r["trow"], r["tcol"]): bytes(r["data"]) for r in spatial.tiles(cells, rows, columns).collect()}
    assert {(r["trow"], r["tcol"]): bytes(r["data"]) for r in store.collect()} == held
    got = {r["id"]: (r["ring"], r["cells"], r["ndvi"]) for r in spatial.nearest_ring(points, store, "id", degrees, rows, columns).collect()}
    assert len(got) == len(places) and {r[0] for r in got.values()} >= {0, 1}
    for i, lat, lon in places:
        ring, n, ndvi = ring_of(grid, min(rows - 1, int((90 - lat) / degrees)), int((lon + 180) / degrees) % columns)
        assert got[i][:2] == (ring, n) and (ndvi is None and got[i][2] is None or np.allclose(got[i][2], ndvi, atol=1e-12))


def test_a_point_meets_one_tile(spark, tmp_path):
    points = spark.range(50).selectExpr("id", "id * 3.0D - 75 AS lat", "id * 7.0D - 170 AS lon")
    cells = spark.createDataFrame([(r, c, [9] * 12) for r in range(0, 180, 5) for c in range(0, 360, 5)], "row int, col int, m array<int>")
    found = spatial.nearest_ring(points, spatial.tiles(cells, 180, 360), "id", 1.0, 180, 360)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Join") == 1 and "explode" not in text.split("FlatMapGroups")[0] and found.count() == 50
    assert spatial.tile_size(3600) == 60 and spatial.tile_cells(60) == 66
    with pytest.raises(ValueError, match="3 rings"):
        spatial.nearest_ring(points, spatial.tiles(cells, 180, 360), "id", 1.0, 180, 360, rings=4)
    (tmp_path / "bad").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="a raster has"):
        files.raster_tiles(spark, str(tmp_path / "bad"), 180, 360).collect()
