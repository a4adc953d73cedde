"""Upserts, versions and conflicts of the keyed store."""

import os

import pytest

from roadloom.sources.store import Conflict, KeyedStore

COLUMNS = "Id long, Prediction string, at int"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("Id", "Prediction", "at").collect()), key=str)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(os.path.join(folder, "data")) for f in names if f.endswith(".parquet")}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path), ["Id"], 16)
    with pytest.raises(FileNotFoundError):
        s.read()
    first = [(i, "a", 0) for i in range(100)] + [(None, "null", 0)]
    assert s.upsert(frame(spark, first)) == 1 and rows_of(s.read()) == sorted(first, key=str)
    before = files(tmp_path)
    assert s.upsert(frame(spark, [(7, "b", 1), (500, "new", 1), (None, "again", 1)])) == 2
    want = {i: ("a", 0) for i in range(100)} | {7: ("b", 1), 500: ("new", 1), None: ("again", 1)}
    assert {r.Id: (r.Prediction, r.at) for r in s.read().collect()} == want and s.read().count() == len(want)
    assert rows_of(s.read(1)) == sorted(first, key=str)  # readers of a version keep it
    added = files(tmp_path) - before
    assert before <= files(tmp_path) and 1 <= len(added) <= 3
    s.vacuum()
    assert s.versions() == [2] and {r.Id: (r.Prediction, r.at) for r in s.read().collect()} == want
    assert len(files(tmp_path)) <= 16


def test_updates_only_latest_and_partial_columns(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path), ["Id"], 4)
    s.upsert(frame(spark, [(1, "a", 0), (2, "b", 0)]))
    s.upsert(frame(spark, [(1, "x", 1), (1, "y", 3), (9, "z", 1)]), latest=["at"], insert=False)
    assert rows_of(s.read()) == [(1, "y", 3), (2, "b", 0)]
    s.upsert(spark.createDataFrame([(2, "c"), (3, None)], "Id long, Prediction string"))
    assert rows_of(s.read()) == [(1, "y", 3), (2, "c", 0), (3, None, None)]
    s.upsert(frame(spark, []))
    assert rows_of(s.read()) == [(1, "y", 3), (2, "c", 0), (3, None, None)] and s.versions() == [1, 2, 3, 4]


def test_the_second_writer_of_a_version_fails(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path), ["Id"], 4)
    s.upsert(frame(spark, [(1, "a", 0)]))
    with pytest.raises(Conflict):
        s._publish(1, {0: 1})
    assert rows_of(s.read()) == [(1, "a", 0)] and s.versions() == [1]
    assert not [x for x in os.listdir(tmp_path / "versions") if x.startswith("draft")]
