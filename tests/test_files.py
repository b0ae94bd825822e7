"""Readers on the file shapes they accept, and writers read back."""

import os
import subprocess
import sys
import pytest

from isogon.sources import readers, writers


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return f"file://{tmp_path}/{name}"

    return write


def test_lenient_points(spark, put):
    p = put("a.txt", 'x y v\n\n"1.5",2,3\n4\t5\t-6e1 7\nbad line\n8 9 10\n')
    got = readers.xyz(spark, p).orderBy("id").collect()
    assert [(r.id, r.x, r.y, r.v) for r in got] == [(2, 1.5, 2.0, 3.0), (3, 4.0, 5.0, -60.0), (5, 8.0, 9.0, 10.0)]


def test_sniffed_classes(spark, put):
    p = put("b.txt", "# c\n1;2;3;1\n4;5;6\n7;8\n9;9;9;0\n")
    assert readers.sniff(spark, p) == ";"
    assert [(r.x, r["index"]) for r in readers.classed(spark, p).orderBy("id").collect()] == [(1.0, 1), (4.0, None), (9.0, 0)]


def test_base_map_status(spark, put):
    p = put("c.txt", "1 2 3\n\n1 2\n1,b,3\n4;5;6")
    assert [r.status for r in readers.base_map(spark, p).orderBy("line_no").collect()] == ["ok", "blank", "arity", "number", "ok"]
    assert readers.strict_triples(spark, p).count() == 2


def test_fusion_source_fails_on_a_bad_row(spark, put):
    assert readers.fusion_source(spark, put("d.txt", "1 2 3\n4 5 6\n"), 2.0, 0).count() == 2
    with pytest.raises(Exception):
        readers.fusion_source(spark, put("e.txt", "1 2 3\nx 5 6\n"), 2.0, 0).collect()


def test_tracks_places_and_queries(spark, put):
    assert readers.track(spark, put("f.txt", "1,2,3\n4,5\n6,7,8,9\n")).count() == 2
    assert readers.places(spark, put("g.txt", "# a\n// b\n1, 2\n3;4\n")).count() == 2
    q = readers.model_queries(spark, put("h.txt", "2021.5 E K1.5 30 110\n2021.5 M M2 30 110\n2021 E F3280.0839895 91 110\n2021 E 30 110\n")).orderBy("line_no").collect()
    assert [r.ok for r in q] == [True, True, False, False] and [r.height_km for r in q[:3]] == [1.5, 2000.0, 1.0]


def test_survey_lines(spark, put):
    q = put("h.csv", "L0,2020-01-01,00:00:00.0,1,2,3,110,10,4,5,50000,1,2,3,4\n")
    p = put("i.csv", "L1,2021-03-04,05:06:07.5,1,2,3,111.5,18.5,4,5,50000,1,2,3,4\nbad\n")
    both = {r.name: r for r in readers.survey_lines(spark, [q, p]).collect()}
    r = both["L1"]
    assert (both["L0"].doc_id, r.doc_id, r.height, r.gps_week) == (0, 1, -3.0, 2147) and abs(r.gps_seconds - (4 * 86400 + 5 * 3600 + 6 * 60 + 7)) < 1e-3
    assert abs(r.x - 2046800) < 1000 and abs(r.y - 552800) < 1000  # north, east
    assert (r.year, r.month, r.day, r.hour, r.minute, r.second, r.lat, r.lon) == (2021, 3, 4, 5, 6, 7.5, 18.5, 111.5)


def test_complexity_file(spark, put):
    p = put("j.csv", "﻿Longitude,lat,base,spacing,lon_grid,lat_grid\n111,18,45000,9,1,2\n")
    r = readers.complexity_file(spark, p, {"longitude": "lon"}).first()
    assert (r.lon, r.lat, r.base, r.spacing) == (111.0, 18.0, 45000.0, 9.0)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1.23456789, 2.0, 1234567.891), (3.0, float("nan"), 1.0)], "x double, y double, v double")
    path = f"file://{tmp_path}/out"
    writers.fixed(df, path, "x", "y", "v", digits={"x": 6, "y": 6, "v": 3})
    assert [r.value for r in spark.read.text(path).collect()] == ["1.234568,2.000000,1234567.891"]
    writers.append_catalogue(df.limit(1), f"file://{tmp_path}/cat")
    writers.append_catalogue(df.limit(1), f"file://{tmp_path}/cat")
    assert spark.read.text(f"file://{tmp_path}/cat").count() == 2
    c = spark.createDataFrame([(111.0, 18.0, 1.0, 8.0), (111.0, 18.0, 1.0, 7.0)], "lon double, lat double, base double, spacing double")
    writers.export_complexity(c, f"file://{tmp_path}/ex")
    assert sorted(r["index"] for r in spark.read.csv(f"file://{tmp_path}/ex", header=True).collect()) == ["0", "1"]
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbflon,lat,baseMag,index\n") for f in (tmp_path / "ex").glob("*.csv"))


def test_lines_of_many_splits(spark, tmp_path):
    """Numbers go on over the splits of a file, and begin again in the next file."""
    text = {f"{n}.txt": [f"{n} line {i}" for i in range(k)] for n, k in (("a", 5000), ("b", 1), ("c", 1200))}
    for name, rows in text.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = readers.lines(spark, f"file://{tmp_path}")
        assert df.rdd.getNumPartitions() > 0
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((n, i, v) for n, rows in text.items() for i, v in enumerate(rows))


def test_database_with_commit_and_rollback(spark):
    url = "jdbc:derby:memory:isogon;create=true"
    spark.createDataFrame([("m1", "a", 1.0), ("m2", "b", 2.0)], "name string, platform string, max_x double").write.jdbc(url, "catalogue", properties={"createTableColumnTypes": "name VARCHAR(40), platform VARCHAR(40)"})
    read = lambda: {r[0]: (r[1], r[2]) for r in readers.database(spark, url, "catalogue").collect()}
    c = writers.Catalogue(spark, url, "catalogue")
    c.add(name="m3", platform="it's", max_x=3.0)
    c.update("m1", max_x=9.0)
    c.delete("m2")
    assert len(read()) == 2
    c.submit()
    assert read() == {"m1": ("a", 9.0), "m3": ("it's", 3.0)}
    c.delete("m1")
    c.add(name="x" * 100, platform="too long", max_x=0.0)
    with pytest.raises(Exception):
        c.submit()
    assert set(read()) == {"m1", "m3"}
    c.cancel()
    c.submit()
    spark.range(1000).selectExpr("CAST(id AS INT) AS k", "id * 2 AS v").write.jdbc(url, "numbers")
    df = readers.database(spark, url, "numbers", key="k", partitions=4)
    assert df.rdd.getNumPartitions() == 4 and df.agg({"v": "sum"}).first()[0] == 999_000


def test_models_as_files():
    from isogon.functions import mainfield

    m = mainfield.Model(2020.0, [(1, 0, -29404.5, 0.0, 6.7, 0.0), (1, 1, -1450.7, 4652.9, 7.7, -25.1), (2, 0, -2500.0, 0.0, -11.5, 0.0), (2, 1, 2982.0, -2991.6, -7.1, -30.2), (2, 2, 1676.8, -734.8, -2.2, -23.9)])
    same = lambda a: all((getattr(a, n) == getattr(m, n)).all() for n in ("g", "h", "gdot", "hdot")) and a.epoch == m.epoch
    assert same(mainfield.read_cof(writers.cof_lines(m, "WMM", "1/1/2020")))
    assert same(mainfield.read_pair(*writers.pair_lines(m, "EMM", "1/1/2020")))
    two = mainfield.read_shdf(writers.shdf_lines([m, m.at(2025.0)], "X"))
    assert same(two[0]) and two[1].epoch == 2025.0 and abs(two[1].g[1, 0] - m.at(2025.0).g[1, 0]) < 1e-6
    with pytest.raises(ValueError):
        mainfield.read_epochs(["   A 2000.0 1 0"])


def test_borders_colours_images_and_projects(spark, put, tmp_path):
    import struct
    import zlib

    p = put("b.json", '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[1,2],[3,4],[5,6.5],[1,2]]]}},{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,1],[0,0]]],[[[7,8],[9,9],[7,8]]]]}}]}')
    assert [(r.feature, r.ring, r.seq, r.lon, r.lat) for r in readers.borders(spark, p).orderBy("feature", "ring", "seq").collect()][2:8] == [(0, 0, 2, 5.0, 6.5), (0, 0, 3, 1.0, 2.0), (1, 0, 0, 0.0, 0.0), (1, 0, 1, 1.0, 1.0), (1, 0, 2, 0.0, 0.0), (1, 1, 0, 7.0, 8.0)]
    c = readers.colour_map(spark, put("c.rgb", "n 2\n# r g b\n255 0 51\nbad\n0 255 0\n")).orderBy("i").collect()
    assert [(r.i, r.red, r.green, r.blue) for r in c] == [(0, 1.0, 0.0, 0.2), (1, 0.0, 1.0, 0.0)]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes([0, 0, 51, 255, 0, 102, 1, 2]))) + chunk(b"IEND", b"")
    writers.put(spark, f"file://{tmp_path}/img/a.png", png)
    assert [(r.row, r.col, r.v) for r in readers.raster_image(spark, f"file://{tmp_path}/img").orderBy("row", "col").collect()] == [(0, 0, 0.0), (0, 1, 0.2), (0, 2, 1.0), (1, 0, 0.4), (1, 1, 1 / 255), (1, 2, 2 / 255)]
    writers.copy(spark, f"file://{tmp_path}/c.rgb", f"file://{tmp_path}/project/c.txt")
    writers.put(spark, f"file://{tmp_path}/project/d.dat", b"1")
    assert writers.listing(spark, f"file://{tmp_path}/project", ".txt", ".dat") == ["c.txt", "d.dat"]


def test_database_on_several_processes(tmp_path):
    """Executors that are not the driver read the queries' databases."""
    run = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from isogon.plans import catalog
for name in ("S17_database", "K10_catalogue_changes"):
    print(name, catalog.QUERIES[name](s, "/root/testdata/sf0.001").count())
s.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=180)
    assert [x for x in got.stdout.splitlines() if x.startswith(("S17", "K10"))] == ["S17_database 25", "K10_catalogue_changes 25"], got.stderr[-2000:]


def test_model_query_lines_out_of_range(spark, put):
    """Lines of the right form are read whatever their numbers; those out of range, heights included, are not ok."""
    text = "2021 E K1 30 180\n2021 E K1 30 180.03\n2021 E K1 90.5 110\n2021 E M9 30 110\n2021 E M10 30 110\n2021 E K-10000 30 110\n2021 E X1 30 110\n2021 E K1 30 east\n"
    got = readers.model_queries(spark, put("r.txt", text)).orderBy("line_no").collect()
    assert [(r.read, r.ok) for r in got] == [(True, True), (True, False), (True, False), (True, True), (True, False), (True, False), (False, False), (False, False)]
    assert [(r.height_km, r.lat, r.lon) for r in got[1:3]] == [(1.0, 30.0, 180.03), (1.0, 90.5, 110.0)]
