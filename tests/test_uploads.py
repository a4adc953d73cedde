"""Three files of an upload in different batches, out of order, late, repeated and unknown."""

import os
from datetime import datetime

from roadloom.plans.predict import predict
from roadloom.streaming import uploads

KINDS = {"tracks": "Id int, Distance double", "rich": "Id int, Speed double", "incoming": "Id int, Number bigint"}


def put(folder, name, at, text):
    path = folder / name
    path.write_text(text)
    os.utime(path, (at, at))


def plan(tracks, rich, incoming):
    counts = [d.groupBy("Id").count().withColumnRenamed("count", n) for d, n in ((rich, "n_rich"), (incoming, "n_incoming"))]
    return tracks.join(counts[0], "Id", "left").join(counts[1], "Id", "left")


def run(spark, base, per_batch=1):
    files = uploads.parts(spark, str(base / "in"), files_per_batch=per_batch)
    q = uploads.score_uploads(uploads.assembled(files, tuple(KINDS), "60 seconds"), plan, str(base / "out"), str(base / "bad"), str(base / "state"), KINDS)
    q.awaitTermination(300)
    assert q.exception() is None


def found(spark, base):
    out = spark.read.parquet(str(base / "out")).collect() if (base / "out").exists() else []
    bad = spark.read.parquet(str(base / "bad")).collect() if (base / "bad").exists() else []
    return sorted((r.Id, r.Distance, r.n_rich, r.n_incoming) for r in out), sorted((r.upload, r.status, r.error) for r in bad)


def test_parts_meet_over_batches_and_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t0 = datetime(2024, 1, 8).timestamp()
    head = {"tracks": "Id,Distance\n", "rich": "Id,Speed\n", "incoming": "Id,Number\n"}
    rows = {"tracks": "{0},{0}.5\n", "rich": "{0},1.0\n{0},2.0\n", "incoming": "{0},7\n"}

    def part(i, kind, at):
        put(tmp_path / "in", f"{i}_{kind}.csv", t0 + at, head[kind] + rows[kind].format(i))

    for k, (i, kind) in enumerate([(1, "rich"), (2, "tracks"), (1, "tracks"), (3, "rich"), (2, "rich"), (1, "incoming"), (2, "incoming")]):
        part(i, kind, k)
    put(tmp_path / "in", "1_notes.csv", t0 + 8, "x\n")
    put(tmp_path / "in", "readme.txt", t0 + 9, "x\n")
    run(spark, tmp_path)
    good, bad = found(spark, tmp_path)
    assert good == [(1, 1.5, 2, 1), (2, 2.5, 2, 1)]
    assert [b[1:] for b in bad] == [("unknown", "unknown file notes"), ("unknown", "unknown file readme.txt")]
    # a second run goes on from the state: 3 waits in vain, 1 comes again, 4 is whole
    part(4, "tracks", 30)
    put(tmp_path / "in", "1_rich.csv.gz", t0 + 31, "again")
    part(4, "rich", 200)
    part(4, "incoming", 201)
    run(spark, tmp_path, per_batch=2)
    good, bad = found(spark, tmp_path)
    assert good[:2] == [(1, 1.5, 2, 1), (2, 2.5, 2, 1)] and good[2:] == [(4, 4.5, 2, 1)]
    assert ("1", "repeated", "the upload has been scored: rich") in bad and ("3", "incomplete", "missing: tracks, incoming") in bad


def test_uploads_go_through_the_whole_plan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    token = "AB"
    put(tmp_path / "in", "9_tracks.csv", 1.7e9, f"DeviceToken,Id,IncomingTrackId,CompanyId,DistanceGPS,Distance\n{token},5,6,6,3.0,3.0\n")
    points = "".join(f"{token},{{0}},2024-01-08 00:{i // 60:02d}:{i % 60:02d},{55 + i * 1e-4},37.0,{20 + i % 9},{i * 11.0},{i}\n" for i in range(120))
    for kind, key, ident in (("rich", "RichTrackId", 5), ("incoming", "IncomingTrackId", 6)):
        put(tmp_path / "in", f"9_{kind}.csv", 1.7e9 + 1, f"DeviceToken,{key},PointDate,Latitude,Longitude,Speed,TotalMeters,Number\n" + points.format(*[ident] * 120).replace("{0}", str(ident)))
    files = uploads.parts(spark, str(tmp_path / "in"))
    label = lambda tracks, rich, incoming: predict(incoming, rich, tracks)
    q = uploads.score_uploads(uploads.assembled(files), label, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "state"))
    q.awaitTermination(300)
    row = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.IncomingTrackId, r.RichTrackId, r.error) for r in row] == [(6, 5, "")] and row[0].prediction == row[0].debug_pred is not None
