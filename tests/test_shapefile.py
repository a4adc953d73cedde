"""The shapefile reader against files written here and by hand."""

import datetime
import struct

import pytest
from pyspark.errors import PySparkException

from roadloom.operators import geometry
from roadloom.sources import shapefile

SQUARE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]
FAR = [(10.0, 50.5), (12.0, 50.5), (11.0, 52.5), (10.0, 50.5)]
FIELDS = [("ISO2", "C", 4, 0), ("AREA", "N", 9, 2), ("POP", "N", 6, 0), ("EU", "L", 1, 0), ("SINCE", "D", 8, 0)]
DAY = datetime.date(1990, 10, 3)
ROWS = [("ÉA", 12.25, 7, True, DAY, [SQUARE, HOLE]), ("BB", None, None, None, None, None), (None, -0.5, -3, False, DAY, [FAR]), ("ÉA", 1.0, 1, True, None, [FAR])]


def load(spark, path, per=2):
    spark.dataSource.register(shapefile.Shapefile)
    return spark.read.format("shapefile").option("recordsPerPartition", per).load(path)


@pytest.mark.parametrize("per", [1, 3, 1000])
def test_round_trip(spark, tmp_path, per):
    shapefile.write_polygons(str(tmp_path / "a.shp"), ROWS, FIELDS)
    df = load(spark, str(tmp_path / "a.shp"), per)
    assert [t for _, t in df.dtypes] == ["string", "double", "bigint", "boolean", "date", "array<array<struct<x:double,y:double>>>"]
    got = [(*r[:5], r.rings and [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in df.collect()]
    assert sorted(got, key=str) == sorted(ROWS, key=str)
    assert df.rdd.getNumPartitions() == -(-len(ROWS) // per)
    assert load(spark, f"file://{tmp_path}/a.shp").count() == 4


def test_z_values_deleted_records_and_an_encoding(spark, tmp_path):
    shapefile.write_polygons(str(tmp_path / "b.shp"), ROWS, FIELDS)
    raw = bytearray((tmp_path / "b.shp").read_bytes())
    struct.pack_into("<i", raw, 108, 15)  # the first record is a polygon with heights
    (tmp_path / "b.shp").write_bytes(raw)
    table = bytearray((tmp_path / "b.dbf").read_bytes())
    begin, width = struct.unpack_from("<HH", table, 8)
    table[begin + width : begin + width + 1] = b"*"
    table[begin + 1 : begin + 5] = "ÉA".encode("latin-1").ljust(4)
    table[begin + 3 * width + 1 : begin + 3 * width + 5] = "ÉA".encode("latin-1").ljust(4)
    (tmp_path / "b.dbf").write_bytes(table)
    (tmp_path / "b.cpg").write_text("ISO-8859-1")
    got = load(spark, str(tmp_path / "b.shp")).collect()
    assert sorted(map(str, (r.ISO2 for r in got))) == ["None", "ÉA", "ÉA"] and len(got[0].rings) == 2


def test_holes_and_repeated_points(spark, tmp_path):
    shapefile.write_polygons(str(tmp_path / "c.shp"), ROWS, FIELDS)
    lands = load(spark, str(tmp_path / "c.shp")).withColumnRenamed("ISO2", "iso2")
    places = [(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 2.0, 2.0), (3, 51.0, 11.0), (4, 51.0, 30.0), (5, None, 1.0)]
    df = spark.createDataFrame(places, "i long, lat double, lon double")
    got = sorted(((r.i, r.iso2) for r in geometry.country_of(df, lands, "lat", "lon", ["i"]).collect()), key=str)
    assert got == [(1, "ÉA"), (3, "ÉA"), (3, None)]


def test_broken_files(spark, tmp_path):
    shapefile.write_polygons(str(tmp_path / "d.shp"), [], FIELDS)
    assert load(spark, str(tmp_path / "d.shp")).count() == 0
    shapefile.write_polygons(str(tmp_path / "e.shp"), ROWS, FIELDS)
    (tmp_path / "e.shx").write_bytes((tmp_path / "e.shx").read_bytes()[:-8])
    with pytest.raises(PySparkException, match="differ in number"):
        load(spark, str(tmp_path / "e.shp")).count()
    with pytest.raises(ValueError, match="no polygon"):
        shapefile.rings_of(struct.pack("<i", 1) + bytes(16))
