"""The whole run and its tools by their arguments."""

import json

import numpy as np
import pytest
from test_derived import STATIONS, manifest
from test_reports import write_archive
from test_tiff import write

from heliospan import __main__ as command
from heliospan.sources import outputs


def texts(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_run(spark, tmp_path, capsys, monkeypatch):
    root, out = tmp_path / "isd", tmp_path / "out"
    write_archive(root, STATIONS[0])
    write_archive(root, STATIONS[1], (2021,))  # too few years
    write_archive(root, "999999-11111", (2021,))  # no manifest row, too few years
    (root / "2021" / "444444-99999-2021.gz").write_bytes(__import__("gzip").compress(b"short\n"))  # too few reports
    (tmp_path / "countries.txt").write_text("code        name\n\nUS          UNITED STATES\n")
    places = manifest(tmp_path)
    values = np.full((36, 72), 6000, np.int16)
    values[:, 70:] = -32767
    (tmp_path / "green").mkdir()
    for month in (1, 7):
        write(tmp_path / "green" / f"veg_ndvi_avhrr.mod09ga_p90_5km_s0..0cm_2016{month:02}01..20160131_v1.0.tif", values, 8, 5)
    assert command.grid(spark, str(tmp_path / "green"), str(tmp_path / "tiles"), command.span("2015-2019"), command.span("1-12")) == 2
    with pytest.raises(ValueError, match="no file"):
        command.grid(spark, str(tmp_path / "green"), str(tmp_path / "tiles"), command.span("2019"), command.span("1-12"))
    assert command.span("7") == range(7, 8) and command.span("2015-2017") == range(2015, 2018)

    (tmp_path / "scratch").mkdir()
    with monkeypatch.context() as m:
        m.setattr(outputs.tempfile, "mkdtemp", lambda **_: str(tmp_path / "scratch"))
        told = command.run(spark, str(root), places, str(out), str(tmp_path / "countries.txt"))
    assert list((tmp_path / "scratch").iterdir()) == []  # what lay between the steps is gone
    said = capsys.readouterr().out
    assert told == {"published": 1, "without derived data": 2, "without manifest match": 0}
    order = [said.index(f"=== {s} ===") for s in ("index", "filter", "parse", "derive", "publish")]
    assert order == sorted(order) and "3 of 4 stations report often enough" in said and "3 derived anew" in said and "total" in said
    (row,) = json.loads(texts(out / "stations"))
    assert (row["id"], row["country_name"], row["vegetation_source"]) == (STATIONS[0], "United States", "rain")
    assert [p.name for p in (out / "details").glob("*.json")] == [f"{STATIONS[0]}.json"]
    text = command.explain(spark, str(out / "derived"), places)
    assert STATIONS[1] in text and "few years" in text and STATIONS[0] not in text
    assert command.explain(spark, str(out / "derived"), places, ["temp_c"]).count("\n") == 0
    with pytest.raises(ValueError, match="no results"):
        command.explain(spark, str(tmp_path / "nothing"), places)
