"""Queries of the trip operators over the test tables, each with equivalent SQL where SQL can say it.

Trips are made of the event table (see ``sources.trips.track_points``); airports, stops, ways and
countries are made of the small star-schema tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo as gx
from roadloom.functions.stats import edge_names, kurtosis, skewness
from roadloom.operators import features as ft
from roadloom.operators import geometry, history, learning, places, rules, segments, sensors
from roadloom.operators.prep import date_gate, deduplicate, drop_last, in_order, keep_large_groups
from roadloom.plans.features import prepared
from roadloom.schema import BUS_TYPES, RAIL_TYPES
from roadloom.session import scratch_folder
from roadloom.sources import sinks, trips
from roadloom.sources.store import KeyedStore
from roadloom.streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark, d):
    return trips.track_points(_t(spark, d, "events"))


def _header(spark, d):
    return trips.track_header(_points(spark, d))


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = "WITH " + BASE + sql if sql.lstrip().startswith(",") else sql
        return fn

    return add


def round_half(col: Column, digits: int) -> Column:
    """Rounds the scaled double, as DuckDB does. Spark's own function rounds the shortest decimal, which differs where halves aren't exact."""
    return F.when(F.abs(col) < 1e290, F.round(col * F.lit(10.0**digits)) / F.lit(10.0**digits)).otherwise(col)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and counts as long, so that engines can be compared."""
    out = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        if t == "double":
            col = round_half(col, digits) + F.lit(0.0)
        elif t in ("int", "smallint", "tinyint"):
            col = col.cast("long")
        out.append(col.alias(c))
    return df.select(*out)


BASE = """
ev AS (SELECT *, CAST(floor((day(ts) - 1) / 10.0) AS BIGINT) AS dec FROM events),
tp AS (
  SELECT event_id AS RowId, user_id AS DeviceToken, user_id * 10 + dec AS TrackId, ts AS PointDate, value AS Speed,
         round(sum(value) OVER (PARTITION BY user_id, dec ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS TotalMeters,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS SpeedLimit,
         round(CAST(55.0 AS DOUBLE) + ((event_id * 7919) % 41) * CAST(0.0001 AS DOUBLE) + (user_id % 10) * CAST(0.005 AS DOUBLE) + CASE WHEN user_id % 7 = 0 AND dec = 2 THEN 5 ELSE 0 END, 6) AS Latitude,
         round(CAST(37.0 AS DOUBLE) + ((event_id * 104729) % 43) * CAST(0.0001 AS DOUBLE), 6) AS Longitude
  FROM ev),
hd AS (SELECT TrackId, min(DeviceToken) AS DeviceToken, min(PointDate) AS StartDate, max(PointDate) AS EndDate, max(TotalMeters) AS Distance, count(*) AS n_points FROM tp GROUP BY TrackId),
d1 AS (SELECT * FROM tp QUALIFY row_number() OVER (PARTITION BY TrackId, Latitude, Longitude ORDER BY PointDate DESC, RowId DESC) = 1),
dd AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY TrackId, PointDate ORDER BY RowId DESC) = 1),
s0 AS (
  SELECT *, row_number() OVER o AS n, count(*) OVER (PARTITION BY TrackId) AS total, CAST(Speed <= 9 AS INT) AS b, lag(CAST(Speed <= 9 AS INT)) OVER o AS pb,
         CAST(Speed <= 3 AS INT) AS c, lag(CAST(Speed <= 3 AS INT)) OVER o AS pc, lag(PointDate) OVER o AS pd, lag(Speed) OVER o AS pv
  FROM dd WINDOW o AS (PARTITION BY TrackId ORDER BY PointDate, RowId)),
s1 AS (SELECT *, CASE WHEN pb IS NULL THEN CASE WHEN b = 1 THEN 1 ELSE -1 END ELSE b - pb END AS e, CASE WHEN pc IS NULL THEN CASE WHEN c = 1 THEN 1 ELSE -1 END ELSE c - pc END AS f FROM s0),
s2 AS (SELECT *, max(CASE WHEN e = 1 THEN n END) OVER (PARTITION BY TrackId) AS p1, max(CASE WHEN e = -1 THEN n END) OVER (PARTITION BY TrackId) AS c1 FROM s1),
seg AS (
  SELECT *, n <= cut AS is_car, n >= cut AS is_walk,
         CASE WHEN pd IS NULL OR epoch_us(PointDate) <= epoch_us(pd) THEN CAST(0 AS DOUBLE) ELSE (Speed - pv) / ((epoch_us(PointDate) - epoch_us(pd)) / CAST(1000000 AS DOUBLE)) END AS acc
  FROM (SELECT *, CASE WHEN p1 > c1 THEN p1 ELSE total END AS cut FROM s2)),
edges AS (SELECT TrackId, RowId, f, (epoch_us(PointDate) - epoch_us(lag(PointDate) OVER o)) / CAST(1000000 AS DOUBLE) AS secs, TotalMeters - lag(TotalMeters) OVER o AS ds FROM seg WHERE is_car AND f <> 0 WINDOW o AS (PARTITION BY TrackId ORDER BY PointDate, RowId)),
sm AS (SELECT seg.*, CASE WHEN edges.secs > 5 AND edges.f = -1 THEN secs END AS stop_s, CASE WHEN edges.secs > 5 AND edges.f = 1 THEN ds END AS move_m FROM seg LEFT JOIN edges USING (TrackId, RowId))
"""


def _hist(value: str, edges: list[float], label: str) -> str:
    inside = f"count(CASE WHEN {value} >= {edges[0]} AND {value} <= {edges[-1]} THEN 1 END)"
    out = []
    for k, name in enumerate(edge_names(label, edges)):
        op = "<=" if k == len(edges) - 2 else "<"
        n = f"count(CASE WHEN {value} >= {edges[k]} AND {value} {op} {edges[k + 1]} THEN 1 END)"
        out.append(f'round(coalesce({n} / nullif(CAST({inside} AS DOUBLE) * {edges[k + 1] - edges[k]}, 0), 0), 6) AS "{name}"')
    return ", ".join(out)


_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, power(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin((radians({3}) - radians({1})) / 2), 2))))"


# ---- sources and sinks ---------------------------------------------------------------------------


@query("src_track_points", ", x AS (SELECT 1) SELECT * FROM tp")
def src_track_points(spark, d):
    return _points(spark, d)


@query("src_track_header", ", x AS (SELECT 1) SELECT * FROM hd")
def src_track_header(spark, d):
    return _header(spark, d)


@query("src_sql_params", ", x AS (SELECT 1) SELECT TrackId, PointDate, Speed FROM tp WHERE DeviceToken = 7 AND Speed >= 10 ")
def src_sql_params(spark, d):
    text = "SELECT TrackId, PointDate, Speed FROM {points} WHERE DeviceToken = :device AND Speed >= :least"
    return trips.query(spark, text, {"points": _points(spark, d)}, device=7, least=10)


@query("src_keyed_fetch", ", x AS (SELECT 1) SELECT RowId, TrackId FROM tp WHERE DeviceToken = 12 AND TrackId IN (120, 122, 999)")
def src_keyed_fetch(spark, d):
    return trips.fetch(_points(spark, d), 12, [120, 122, 999]).select("RowId", "TrackId")


@query("src_list_slice", ", r AS (SELECT TrackId, RowId, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) - 1 AS i, count(*) OVER (PARTITION BY TrackId) AS k FROM tp) SELECT TrackId, RowId FROM r WHERE i BETWEEN k - 3 AND k - 1")
def src_list_slice(spark, d):
    return trips.list_slice(_points(spark, d), ["TrackId"], ["PointDate", "RowId"], -3, -1).select("TrackId", "RowId")


@query("snk_list_remove", ", r AS (SELECT TrackId, RowId, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) - 1 AS i FROM tp) SELECT TrackId, RowId FROM r WHERE i NOT IN (0, 2)")
def snk_list_remove(spark, d):
    return trips.without_indexes(_points(spark, d), ["TrackId"], ["PointDate", "RowId"], [0, 2]).select("TrackId", "RowId")


@query("src_key_scan", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS token FROM events WHERE event_type IN ('view', 'error')")
def src_key_scan(spark, d):
    keys = _t(spark, d, "events").select(F.concat_ws(":", "user_id", "event_id", "event_type").alias("key"))
    return trips.keys_like(keys, "%:view").union(trips.keys_like(keys, "%:error")).distinct()


@query("src_log_scan", "SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS token FROM events WHERE event_type <> 'error'")
def src_log_scan(spark, d):
    line = F.concat(F.lit("id="), F.col("event_id"), F.lit(" token="), F.col("user_id"), F.when(F.col("event_type") == "error", " token=again").otherwise(" ok"))
    lines = _t(spark, d, "events").select(line.alias("value"))
    return trips.scan_log(lines, {"id": r"id=\d+", "token": r"token=\w+"}).select(F.split("id", "=")[1].alias("id"), F.split("token", "=")[1].alias("token"))


@query("snk_unpivot", ", x AS (SELECT 1) SELECT TrackId, 'Distance' AS Key, round(CAST(Distance AS DOUBLE), 6) AS Value FROM hd UNION ALL SELECT TrackId, 'n_points', CAST(n_points AS DOUBLE) FROM hd")
def snk_unpivot(spark, d):
    return rounded(sinks.to_long(_header(spark, d).select("TrackId", "Distance", "n_points"), ["TrackId"]))


@query("snk_update_prediction", ", x AS (SELECT 1) SELECT TrackId AS Id, CASE WHEN n_points > 20 THEN 'Bus' ELSE 'OriginalDriver' END AS Prediction FROM hd")
def snk_update_prediction(spark, d):
    h = _header(spark, d)
    tracks = h.select(F.col("TrackId").alias("Id"), F.lit("OriginalDriver").alias("Prediction"))
    return sinks.update_prediction(tracks, h.where("n_points > 20").select(F.col("TrackId").alias("Id"), F.lit("Bus").alias("Prediction")))


# ---- filters, windows ----------------------------------------------------------------------------


@query("snk_store", ", x AS (SELECT 1) SELECT TrackId AS Id, n_points, CASE WHEN n_points > 20 THEN 'Bus' END AS Prediction FROM hd UNION ALL SELECT -1, count(*), 'first version' FROM hd")
def snk_store(spark, d):
    """Headers in a keyed store; predictions of known trips are merged into their buckets, the first version stays."""
    h = _header(spark, d).select(F.col("TrackId").alias("Id"), "n_points", F.lit(None).cast("string").alias("Prediction"))
    held = KeyedStore(spark, scratch_folder(spark, "store"), ["Id"], 16)
    first = held.upsert(h)
    labels = h.where("n_points > 20").select("Id", F.lit("Bus").alias("Prediction"))
    held.upsert(labels.union(labels.select(F.col("Id") + 10**9, "Prediction")), insert=False)
    old = held.read(first).where("Prediction is null").agg(F.lit(-1).cast("long").alias("Id"), F.count("*").alias("n_points"), F.lit("first version").alias("Prediction"))
    return held.read().unionByName(old)


@query("flt_date_gate", ", x AS (SELECT 1) SELECT RowId FROM tp WHERE PointDate > TIMESTAMP '2024-01-10'")
def flt_date_gate(spark, d):
    return date_gate(_points(spark, d), "2024-01-10").select("RowId")


@query("flt_group_size", ", g AS (SELECT TrackId, RowId, count(*) OVER (PARTITION BY TrackId, SpeedLimit > 50) AS k FROM tp) SELECT TrackId, RowId FROM g WHERE k > 4")
def flt_group_size(spark, d):
    p = _points(spark, d).withColumn("fast", F.col("SpeedLimit") > 50)
    return keep_large_groups(p, "fast").select("TrackId", "RowId")


@query("flt_balanced", "WITH c AS (SELECT min(k) AS least FROM (SELECT count(*) AS k FROM events GROUP BY event_type)) SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) CROSS JOIN c WHERE n <= least")
def flt_balanced(spark, d):
    return history.balanced(_t(spark, d, "events"), "event_type", ["event_id"]).select("event_id", "event_type")


@query("win_dedupe", ", x AS (SELECT 1) SELECT * FROM dd")
def win_dedupe(spark, d):
    return deduplicate(_points(spark, d))


@query("win_first_last", ", x AS (SELECT 1) SELECT TrackId, min(DeviceToken) AS DeviceToken, min(PointDate) AS first_PointDate, arg_min(Latitude, (PointDate, RowId)) AS first_Latitude, arg_min(Longitude, (PointDate, RowId)) AS first_Longitude, max(PointDate) AS last_PointDate, arg_max(Latitude, (PointDate, RowId)) AS last_Latitude, arg_max(Longitude, (PointDate, RowId)) AS last_Longitude FROM tp GROUP BY TrackId")
def win_first_last(spark, d):
    return history.first_last_points(_points(spark, d))


@query("win_acceleration", ", x AS (SELECT 1) SELECT TrackId, RowId, round(acc, 9) AS acc FROM seg")
def win_acceleration(spark, d):
    return rounded(ft.acceleration(deduplicate(_points(spark, d))).select("TrackId", "RowId", "acc"), 9)


@query("win_runs", ", r AS (SELECT TrackId, sum(CASE WHEN e <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) AS run FROM s1) SELECT TrackId, CAST(run AS BIGINT) AS run, count(*) AS n FROM r GROUP BY TrackId, run")
def win_runs(spark, d):
    p = deduplicate(_points(spark, d)).withColumn("e", segments.state_edge(F.col("Speed") <= segments.WALK_SPEED))
    return p.withColumn("run", segments.run_id(F.col("e")).cast("long")).groupBy("TrackId", "run").agg(F.count("*").alias("n"))


@query("win_walk_split", ", x AS (SELECT 1) SELECT TrackId, RowId, is_car, is_walk FROM seg")
def win_walk_split(spark, d):
    return segments.split_walk(deduplicate(_points(spark, d))).select("TrackId", "RowId", "is_car", "is_walk")


@query("win_stops_moves", ", x AS (SELECT 1) SELECT TrackId, RowId, round(stop_s, 6) AS stop_s, round(move_m, 6) AS move_m FROM sm WHERE stop_s IS NOT NULL OR move_m IS NOT NULL")
def win_stops_moves(spark, d):
    p = segments.intervals(segments.split_walk(deduplicate(_points(spark, d))))
    return rounded(p.where("stop_s is not null or move_m is not null").select("TrackId", "RowId", "stop_s", "move_m"))


@query("win_interpolate", """
, h AS (SELECT TrackId, RowId, CASE WHEN SpeedLimit >= 30 THEN SpeedLimit END AS v, row_number() OVER (PARTITION BY TrackId ORDER BY RowId) AS i FROM tp),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(v IGNORE NULLS) OVER a AS v0,
             first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(v IGNORE NULLS) OVER b AS v1
      FROM h WINDOW a AS (PARTITION BY TrackId ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY TrackId ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT TrackId, RowId, round(coalesce(v, v0 + CASE WHEN i1 > i0 THEN (i - i0) * (v1 - v0) / (i1 - i0) END, v0), 6) AS Height FROM k""")
def win_interpolate(spark, d):
    p = _points(spark, d).withColumn("Height", F.when(F.col("SpeedLimit") >= 30, F.col("SpeedLimit")))
    return rounded(ft.interpolate(p, "Height").select("TrackId", "RowId", "Height"))


@query("win_rolling_amplitude", """
, a AS (SELECT TrackId, RowId, CASE WHEN count(Speed) OVER w = 10 THEN max(Speed) OVER w - min(Speed) OVER w END AS r
        FROM tp WINDOW w AS (PARTITION BY TrackId ORDER BY RowId ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))
SELECT TrackId, RowId, round(coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY TrackId ORDER BY RowId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                                      first_value(r IGNORE NULLS) OVER (PARTITION BY TrackId ORDER BY RowId ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS amplitude FROM a""")
def win_rolling_amplitude(spark, d):
    return rounded(sensors.rolling_amplitude(_points(spark, d), "Speed", 10, "RowId").select("TrackId", "RowId", "amplitude"))


@query("win_start_end_mean", """
, r AS (SELECT *, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) AS u, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate DESC, RowId DESC) AS v FROM tp)
SELECT TrackId, min(PointDate) AS start_date, max(PointDate) AS end_date, round(avg(CASE WHEN u <= 3 THEN Latitude END), 6) AS start_lat, round(avg(CASE WHEN u <= 3 THEN Longitude END), 6) AS start_lon,
       round(avg(CASE WHEN v <= 3 THEN Latitude END), 6) AS end_lat, round(avg(CASE WHEN v <= 3 THEN Longitude END), 6) AS end_lon FROM r GROUP BY TrackId""")
def win_start_end_mean(spark, d):
    return rounded(rules.start_end(_points(spark, d)).select("TrackId", "start_date", "end_date", "start_lat", "start_lon", "end_lat", "end_lon"))


@query("win_longest_run", """
, g AS (SELECT TrackId, PointDate, RowId, Speed > 10 AS good, sum(CASE WHEN Speed > 10 THEN 0 ELSE 1 END) OVER (PARTITION BY TrackId ORDER BY PointDate DESC, RowId DESC) AS left_ FROM tp),
r AS (SELECT TrackId, left_, sum(CASE WHEN good THEN 1 ELSE 0 END) AS k FROM g GROUP BY TrackId, left_)
SELECT TrackId, CAST(coalesce(max(CASE WHEN left_ > 0 THEN k END), 0) AS BIGINT) AS longest_run FROM r GROUP BY TrackId""")
def win_longest_run(spark, d):
    return rounded(segments.longest_run(_points(spark, d), F.col("Speed") > 10, ["PointDate", "RowId"]))


@query("win_distance_from_last", f"""
, e AS (SELECT TrackId, min(DeviceToken) AS DeviceToken, min(PointDate) AS t, arg_min(Latitude, (PointDate, RowId)) AS la, arg_min(Longitude, (PointDate, RowId)) AS lo, arg_max(Latitude, (PointDate, RowId)) AS la2, arg_max(Longitude, (PointDate, RowId)) AS lo2 FROM tp GROUP BY TrackId),
l AS (SELECT *, lag(la2) OVER w AS pla, lag(lo2) OVER w AS plo FROM e WINDOW w AS (PARTITION BY DeviceToken ORDER BY t, TrackId)),
g AS (SELECT DeviceToken, TrackId, CASE WHEN pla IS NOT NULL THEN {_HAV.format('pla', 'plo', 'la', 'lo')} END AS gap FROM l)
SELECT DeviceToken, TrackId, round(coalesce(gap, median(gap) OVER (PARTITION BY DeviceToken), 0), 3) AS dist_from_last_track FROM g""")
def win_distance_from_last(spark, d):
    return rounded(history.distance_from_last(_points(spark, d)), 3)


@query("win_turn_angle", """
, s AS (SELECT TrackId, RowId, Longitude - lag(Longitude) OVER w AS ux, Latitude - lag(Latitude) OVER w AS uy, lead(Longitude) OVER w - Longitude AS vx, lead(Latitude) OVER w - Latitude AS vy FROM dd WINDOW w AS (PARTITION BY TrackId ORDER BY PointDate, RowId))
SELECT TrackId, RowId, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))), 3) AS angle FROM s
WHERE ux IS NOT NULL AND vx IS NOT NULL AND (ux * ux + uy * uy) > 0 AND (vx * vx + vy * vy) > 0""")
def win_turn_angle(spark, d):
    return rounded(sensors.turn_angles(deduplicate(_points(spark, d))), 3)


@query("win_drop_last", ", r AS (SELECT TrackId, RowId, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate DESC, RowId DESC) AS n FROM tp) SELECT TrackId, RowId FROM r WHERE n > 10")
def win_drop_last(spark, d):
    return drop_last(_points(spark, d), 10).select("TrackId", "RowId")


# ---- features ------------------------------------------------------------------------------------


def _prepared(spark, d):
    return prepared(deduplicate(_points(spark, d)))


@query("ftr_speed", f", x AS (SELECT 1) SELECT TrackId, {_hist('CASE WHEN is_car THEN Speed END', ft.SPEED_EDGES, 'v')}, round(median(Speed), 6) AS speed_median, round(avg(Speed), 6) AS speed_mean, round(coalesce(stddev_samp(Speed), 0), 6) AS speed_std, round(max(Speed), 6) AS speed_max FROM seg GROUP BY TrackId")
def ftr_speed(spark, d):
    return rounded(segments.split_walk(deduplicate(_points(spark, d))).groupBy("TrackId").agg(*ft.speed_aggregates()).fillna(0))


_PN = ", ".join(f"round(coalesce({f}(CASE WHEN {c} THEN {s}acc END), 0), 9) AS acc_{n}_{k}" for n, c, s in (("pos", "acc > 0", ""), ("neg", "acc < 0", "-")) for k, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp")))


@query("ftr_acceleration", f", x AS (SELECT 1) SELECT TrackId, {_hist('acc', ft.ACC_EDGES, 'a').replace(', 6)', ', 9)')}, round(avg(acc), 9) AS acc_mean, round(coalesce(stddev_samp(acc), 0), 9) AS acc_std, {_PN} FROM seg GROUP BY TrackId")
def ftr_acceleration(spark, d):
    return rounded(ft.acceleration(deduplicate(_points(spark, d))).groupBy("TrackId").agg(*ft.acceleration_aggregates()).fillna(0), 9)


@query("ftr_totals", ", x AS (SELECT 1) SELECT TrackId, (epoch_us(max(PointDate)) - epoch_us(min(PointDate))) / CAST(1000000 AS DOUBLE) AS total_secs, max(TotalMeters) AS total_dist, round(max(CASE WHEN is_walk THEN TotalMeters END) - min(CASE WHEN is_walk THEN TotalMeters END), 6) AS pedestrian_dist FROM seg GROUP BY TrackId")
def ftr_totals(spark, d):
    return rounded(segments.split_walk(deduplicate(_points(spark, d))).groupBy("TrackId").agg(*ft.total_aggregates()))


@query("ftr_stops", f"""
, t AS (SELECT *, CASE WHEN stop_s > 5 AND stop_s < 600 THEN stop_s END AS s FROM sm),
u AS (SELECT TrackId, (epoch_us(max(CASE WHEN is_car THEN PointDate END)) - epoch_us(min(CASE WHEN is_car THEN PointDate END))) / CAST(1000000 AS DOUBLE) AS ts FROM sm GROUP BY TrackId)
SELECT TrackId, round(coalesce(sum(stop_s) / nullif(max(ts), 0), 0), 6) AS rel_stand_time, count(s) AS nstops, round(coalesce(median(s) / nullif(max(ts), 0), 0), 6) AS rel_stand_time_median,
       round(coalesce(stddev_pop(s) / nullif(max(ts), 0), 0), 6) AS rel_stand_time_std, {_hist('s', ft.STOP_EDGES, 'st_t')} FROM t JOIN u USING (TrackId) GROUP BY TrackId""")
def ftr_stops(spark, d):
    return rounded(_prepared(spark, d).groupBy("TrackId").agg(*ft.stop_aggregates()))


@query("ftr_moves", f"""
, u AS (SELECT *, max(CASE WHEN is_car THEN TotalMeters END) OVER (PARTITION BY TrackId) AS car_m, coalesce(sum(move_m) OVER (PARTITION BY TrackId), 0) = 0 AS none FROM sm),
v AS (SELECT *, CASE WHEN none THEN CASE WHEN n = 1 THEN car_m END ELSE move_m END AS raw FROM u),
t AS (SELECT *, CASE WHEN raw > 10 AND raw < 180000 THEN raw END AS m FROM v)
SELECT TrackId, round(coalesce(median(m) / nullif(max(car_m), 0), 0), 6) AS rel_move_len_median, round(coalesce(stddev_pop(m) / nullif(max(car_m), 0), 0), 6) AS rel_move_len_std, {_hist('m', ft.MOVE_EDGES, 'mv_d')} FROM t GROUP BY TrackId""")
def ftr_moves(spark, d):
    return rounded(_prepared(spark, d).groupBy("TrackId").agg(*ft.move_aggregates()))


def _rich(spark, d):
    return _points(spark, d).withColumn("Height", F.when(F.col("SpeedLimit") >= 10, F.col("SpeedLimit"))).withColumn("FromSource", F.col("Speed") > 20).withColumn("Urban", F.col("SpeedLimit") < 60)


@query("ftr_rich", """
, h AS (SELECT *, CASE WHEN SpeedLimit >= 10 THEN SpeedLimit END AS v, row_number() OVER (PARTITION BY TrackId ORDER BY RowId) AS i FROM tp),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(v IGNORE NULLS) OVER a AS v0,
             first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(v IGNORE NULLS) OVER b AS v1
      FROM h WINDOW a AS (PARTITION BY TrackId ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY TrackId ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, coalesce(v, v0 + CASE WHEN i1 > i0 THEN (i - i0) * (v1 - v0) / (i1 - i0) END, v0, 0) AS ht, CASE WHEN SpeedLimit = 0 THEN 1 ELSE Speed / SpeedLimit END AS o FROM k),
g AS (SELECT *, CASE WHEN o > 1 THEN o END AS ov FROM f)
SELECT TrackId, round(avg(CAST(Speed > 20 AS INT)), 6) AS rel_from_device, round(avg(CAST(SpeedLimit < 60 AS INT)), 6) AS rel_urban,
       round(min(ht), 6) AS height_min, round(max(ht), 6) AS height_max, round(avg(ht), 6) AS height_mean, round(median(ht), 6) AS height_median, round(stddev_pop(ht), 6) AS height_std,
       round(coalesce(max(ov), 1), 6) AS rel_overspeed_max, round(coalesce(avg(ov), 1), 6) AS rel_overspeed_mean, round(coalesce(median(ov), 1), 6) AS rel_overspeed_median, round(coalesce(stddev_pop(ov), 0), 6) AS rel_overspeed_std,
       day(min(PointDate)) AS day, isodow(min(PointDate)) - 1 AS weekday, hour(min(PointDate)) AS hour, minute(min(PointDate)) AS minute FROM g GROUP BY TrackId""")
def ftr_rich(spark, d):
    return rounded(ft.rich_features(_rich(spark, d)))


def _tracks(spark, d):
    h = _header(spark, d)
    return h.select(F.col("TrackId").alias("Id"), F.col("TrackId").alias("IncomingTrackId"), "DeviceToken", "StartDate", "EndDate", "Distance", F.col("n_points").alias("Duration"), (F.col("Distance") / 1000).alias("DistanceGPS"))


@query("ftr_header", ", x AS (SELECT CAST(StartDate AS DATE) AS day, count(*) AS k FROM hd GROUP BY 1) SELECT TrackId, TrackId AS IncomingTrackId, Distance, n_points AS Duration, round(Distance / 1000, 6) AS DistanceGPS, k AS trips_per_day, k % 2 AS trips_odd FROM hd JOIN x ON CAST(StartDate AS DATE) = day")
def ftr_header(spark, d):
    return rounded(ft.header_features(_tracks(spark, d)))


# ---- joins, aggregates, sets ---------------------------------------------------------------------


@query("jn_points_header", ", x AS (SELECT 1) SELECT tp.RowId, tp.TrackId, hd.StartDate FROM tp JOIN hd USING (TrackId)")
def jn_points_header(spark, d):
    return _points(spark, d).join(_header(spark, d).select("TrackId", "StartDate"), "TrackId").select("RowId", "TrackId", "StartDate")


@query("jn_asof_previous", ", m AS (SELECT a.DeviceToken, a.TrackId, max(b.EndDate) AS prev_end FROM hd a JOIN hd b ON a.DeviceToken = b.DeviceToken AND b.EndDate <= a.StartDate GROUP BY 1, 2) SELECT m.DeviceToken, m.TrackId, m.prev_end, hd.TrackId AS prev_id FROM m JOIN hd ON hd.DeviceToken = m.DeviceToken AND hd.EndDate = m.prev_end")
def jn_asof_previous(spark, d):
    h = _header(spark, d)
    return history.latest_before(h, h).select("DeviceToken", "TrackId", "prev_end", "prev_id")


@query("jn_neighbours", ", x AS (SELECT 1) SELECT TrackId, lag(TrackId) OVER w AS prev_id, lead(TrackId) OVER w AS next_id FROM hd WINDOW w AS (PARTITION BY DeviceToken ORDER BY StartDate, TrackId)")
def jn_neighbours(spark, d):
    return history.neighbours(_header(spark, d)).select("TrackId", "prev_id", "next_id")


@query("jn_semi_devices", "SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE left(event_type, 2) = 'pu' OR event_type = 'error')")
def jn_semi_devices(spark, d):
    e = _t(spark, d, "events")
    params = e.where((F.left("event_type", F.lit(2)) == "pu") | (F.col("event_type") == "error")).select("user_id").distinct()
    return e.select("user_id").distinct().join(params, "user_id", "left_semi")


@query("jn_orders_lines", "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus IS NOT NULL AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_orderpriority")
def jn_orders_lines(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus is not null and o_orderdate < timestamp_ntz '1998-01-01 00:00:00'")
    j = o.join(_t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def _airports(spark, d):
    r = _t(spark, d, "region")
    return r.select((F.lit(55.0) + F.col("r_regionkey") * 0.011).alias("latitude"), (F.lit(37.0) + F.col("r_regionkey") * 0.02).alias("longitude"))


_AIR = ", air AS (SELECT CAST(55.0 AS DOUBLE) + r_regionkey * CAST(0.011 AS DOUBLE) AS la, CAST(37.0 AS DOUBLE) + r_regionkey * CAST(0.02 AS DOUBLE) AS lo FROM region)"


@query("jn_nearest_airport", f"""{_AIR}
, x AS (SELECT RowId, min({_HAV.format('Latitude', 'Longitude', 'la', 'lo')}) AS m FROM tp CROSS JOIN air GROUP BY RowId)
SELECT RowId, round(CASE WHEN m <= 3500 THEN m END, 3) AS airport_m, CASE WHEN m <= 1500 THEN 2 WHEN m <= 3500 THEN 1 ELSE 0 END AS class FROM x""")
def jn_nearest_airport(spark, d):
    p = _points(spark, d).select("RowId", "Latitude", "Longitude")
    out = rules.nearest_airport(p, _airports(spark, d), "Latitude", "Longitude", ["RowId"])
    return rounded(out.select("RowId", "airport_m", rules.airport_class(F.col("airport_m")).alias("class")), 3)


def _counts_sql() -> str:
    m = "8.9883063456985468e-06"
    d_ = "sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))"
    cols = ", ".join(f"(sum(CASE WHEN {d_} < {r} * {m}::DOUBLE THEN 1 ELSE 0 END) - 1) / CAST(count(*) AS DOUBLE) AS r{r}" for r in history.END_RADII)
    out = ", ".join(f"round(r{r}, 6) AS rel_end_count_{r}" for r in history.END_RADII)
    ratios = ", ".join(f'round(r100 / CASE WHEN r{r} <= 0 THEN 1 ELSE r{r} END, 6) AS "end_count_100/{r}"' for r in (500, 1000))
    return f", e AS (SELECT TrackId, arg_max(Longitude, (PointDate, RowId)) AS x, arg_max(Latitude, (PointDate, RowId)) AS y FROM tp GROUP BY TrackId), c AS (SELECT a.TrackId, {cols} FROM e a CROSS JOIN e b GROUP BY a.TrackId) SELECT TrackId, {out}, {ratios} FROM c"


@query("agg_end_counts", _counts_sql())
def agg_end_counts(spark, d):
    return rounded(history.end_counts(_points(spark, d)))


@query("agg_moments", ", c AS (SELECT TrackId, Speed, avg(Speed) OVER (PARTITION BY TrackId) AS m FROM tp) SELECT TrackId, count(*) AS n, round(CASE WHEN stddev_pop(Speed) > 0 THEN avg(power(Speed - m, 3)) / power(avg(power(Speed - m, 2)), 1.5) ELSE 0 END, 6) + 0 AS skew, round(CASE WHEN stddev_pop(Speed) > 0 THEN avg(power(Speed - m, 4)) / power(avg(power(Speed - m, 2)), 2) - 3 ELSE -3 END, 6) AS kurt FROM c GROUP BY TrackId")
def agg_moments(spark, d):
    return rounded(_points(spark, d).groupBy("TrackId").agg(F.count("*").alias("n"), skewness(F.col("Speed")).alias("skew"), kurtosis(F.col("Speed")).alias("kurt")))


@query("agg_before_after", "SELECT ts > TIMESTAMP '2024-01-15' AS later, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, max(value) AS max FROM events GROUP BY 1")
def agg_before_after(spark, d):
    v = F.col("value")
    return rounded(_t(spark, d, "events").groupBy((F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz")).alias("later")).agg(F.mean(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.max(v).alias("max")))


@query("agg_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > 1")
def agg_value_counts(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).where("n > 1")


@query("agg_fractions", ", x AS (SELECT 1) SELECT TrackId, round(avg(CAST(SpeedLimit <> 0 AS INT)), 6) AS nonzero, round(avg(CASE WHEN Speed > 30 THEN 1 ELSE 0 END), 6) AS fast FROM tp GROUP BY TrackId")
def agg_fractions(spark, d):
    return rounded(_points(spark, d).groupBy("TrackId").agg(F.avg((F.col("SpeedLimit") != 0).cast("double")).alias("nonzero"), F.avg(F.when(F.col("Speed") > 30, 1.0).otherwise(0.0)).alias("fast")))


@query("srt_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 191")
def srt_top_n(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(191)


@query("srt_latest_trip", ", x AS (SELECT 1) SELECT DeviceToken, arg_max(TrackId, (EndDate, TrackId)) AS TrackId FROM hd GROUP BY DeviceToken")
def srt_latest_trip(spark, d):
    return _header(spark, d).groupBy("DeviceToken").agg(F.max_by("TrackId", F.struct("EndDate", "TrackId")).alias("TrackId"))


@query("set_union", "SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT user_id FROM events WHERE value > 100")
def set_union(spark, d):
    e = _t(spark, d, "events")
    return e.where("event_type = 'view'").select("user_id").union(e.where("value > 100").select("user_id")).distinct()


@query("set_difference", "SELECT user_id, event_type FROM events WHERE value <= 100 EXCEPT SELECT user_id, event_type FROM events WHERE value > 100")
def set_difference(spark, d):
    e = _t(spark, d, "events")
    return e.where("value <= 100").select("user_id", "event_type").subtract(e.where("value > 100").select("user_id", "event_type"))


@query("set_intersection", "SELECT user_id, event_type FROM events WHERE value <= 100 INTERSECT SELECT user_id, event_type FROM events WHERE value > 100")
def set_intersection(spark, d):
    e = _t(spark, d, "events")
    return e.where("value <= 100").select("user_id", "event_type").intersect(e.where("value > 100").select("user_id", "event_type"))


@query("set_union_by_name", "SELECT user_id, event_type, NULL AS props FROM events WHERE value > 50 UNION ALL SELECT user_id, NULL, props FROM events WHERE value <= 50")
def set_union_by_name(spark, d):
    e = _t(spark, d, "events")
    return e.where("value > 50").select("user_id", "event_type").unionByName(e.where("value <= 50").select("props", "user_id"), allowMissingColumns=True)


# ---- geometry ------------------------------------------------------------------------------------


@query("geo_distance", f", l AS (SELECT TrackId, RowId, Latitude, Longitude, lag(Latitude) OVER w AS pa, lag(Longitude) OVER w AS po FROM tp WINDOW w AS (PARTITION BY TrackId ORDER BY PointDate, RowId)) SELECT TrackId, RowId, CASE WHEN pa IS NOT NULL THEN round({_HAV.format('pa', 'po', 'Latitude', 'Longitude')}, 3) END AS m, round(radians(Longitude) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(Latitude) / 2)) * 6378137, 3) AS y FROM l")
def geo_distance(spark, d):
    p = _points(spark, d)
    m = gx.haversine_m(F.lag("Latitude").over(in_order()), F.lag("Longitude").over(in_order()), F.col("Latitude"), F.col("Longitude"))
    return rounded(p.select("TrackId", "RowId", m.alias("m"), gx.mercator_x("Longitude").alias("x"), gx.mercator_y("Latitude").alias("y")), 3)


@query("geo_clusters", """
, q AS (SELECT *, radians(Longitude) * 6378137 AS x, ln(tan(pi() / 4 + radians(Latitude) / 2)) * 6378137 AS y, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) AS i FROM dd),
near AS (SELECT a.TrackId, a.i, b.i AS j FROM q a JOIN q b ON a.TrackId = b.TrackId AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 10000),
core AS (SELECT TrackId, i FROM near GROUP BY TrackId, i HAVING count(*) >= 3),
cc AS (SELECT near.TrackId, near.i, j FROM near JOIN core a ON a.TrackId = near.TrackId AND a.i = near.i JOIN core b ON b.TrackId = near.TrackId AND b.i = near.j),
reach AS (SELECT TrackId, i, i AS r FROM core UNION SELECT reach.TrackId, reach.i, cc.j FROM reach JOIN cc ON cc.TrackId = reach.TrackId AND cc.i = reach.r),
comp AS (SELECT TrackId, i, min(r) AS root FROM reach GROUP BY TrackId, i),
lab AS (SELECT TrackId, i, dense_rank() OVER (PARTITION BY TrackId ORDER BY root) - 1 AS label FROM comp),
edge AS (SELECT near.TrackId, near.i, min(label) AS label FROM near JOIN lab ON lab.TrackId = near.TrackId AND lab.i = near.j GROUP BY near.TrackId, near.i)
SELECT q.TrackId, q.RowId, CAST(coalesce(lab.label, edge.label, -1) AS BIGINT) AS labels FROM q LEFT JOIN lab USING (TrackId, i) LEFT JOIN edge USING (TrackId, i)""")
def geo_clusters(spark, d):
    return rounded(geometry.cluster(deduplicate(_points(spark, d))).select("TrackId", "RowId", "labels"))


ORACLE_SQL["geo_clusters"] = ORACLE_SQL["geo_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)


def _stops(spark, d):
    s = _t(spark, d, "supplier")
    return s.select("s_name", "s_suppkey").select(F.col("s_name").alias("name"), F.round(F.lit(37.0) + (F.col("s_suppkey") * 31 % 43) * F.lit(0.0001), 6).alias("lon"), F.round(F.lit(55.0) + (F.col("s_suppkey") * 17 % 500) * F.lit(0.0001), 6).alias("lat"))


_STOPS = ", st AS (SELECT s_name AS name, round(CAST(37.0 AS DOUBLE) + (s_suppkey * 31 % 43) * CAST(0.0001 AS DOUBLE), 6) AS lon, round(CAST(55.0 AS DOUBLE) + (s_suppkey * 17 % 500) * CAST(0.0001 AS DOUBLE), 6) AS lat FROM supplier)"
_WIDTH = "(50 * CAST(8.9883063456985468e-06 AS DOUBLE))"
_SEGMENTS = """, vv AS (SELECT TrackId, Longitude AS ax, Latitude AS ay, lead(Longitude) OVER w AS bx, lead(Latitude) OVER w AS by_ FROM dd WINDOW w AS (PARTITION BY TrackId ORDER BY PointDate, RowId)),
sg AS (SELECT * FROM vv WHERE bx IS NOT NULL AND (ax <> bx OR ay <> by_))"""
_FOUND = f""", fs AS (SELECT DISTINCT TrackId, name, lon, lat FROM sg JOIN st ON ((lon - ax) * (bx - ax) + (lat - ay) * (by_ - ay)) / (power(bx - ax, 2) + power(by_ - ay, 2)) BETWEEN 0 AND 1
  AND ((bx - ax) * (lat - ay) - (by_ - ay) * (lon - ax)) / sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) BETWEEN -{_WIDTH} AND 0)"""


@query("geo_corridor_stops", f"{_STOPS}{_SEGMENTS}{_FOUND} SELECT TrackId, name FROM fs")
def geo_corridor_stops(spark, d):
    return geometry.right_stops(deduplicate(_points(spark, d)), _stops(spark, d)).select("TrackId", "name")


_PROJECTED = """, pj AS (SELECT fs.TrackId, name, lon, lat, i FROM fs JOIN (SELECT TrackId, Longitude, Latitude, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) - 1 AS i FROM dd) p ON p.TrackId = fs.TrackId
  QUALIFY row_number() OVER (PARTITION BY fs.TrackId, name, lon, lat ORDER BY sqrt(power(lon - Longitude, 2) + power(lat - Latitude, 2)), i) = 1)"""


@query("geo_project_stops", f"{_STOPS}{_SEGMENTS}{_FOUND}{_PROJECTED} SELECT TrackId, name, CAST(i AS BIGINT) AS idx FROM pj")
def geo_project_stops(spark, d):
    return rounded(geometry.right_stops(deduplicate(_points(spark, d)), _stops(spark, d), nearest=True).select("TrackId", "name", "idx"))


@query("geo_stop_speeds", f"""{_STOPS}{_SEGMENTS}{_FOUND}{_PROJECTED}
, sp AS (SELECT TrackId, Speed, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) - 1 AS k FROM dd),
mv AS (SELECT pj.TrackId, name, lon, lat, min(Speed) AS v FROM pj JOIN sp ON sp.TrackId = pj.TrackId AND k BETWEEN i - 7 AND i + 3 GROUP BY ALL),
cm AS (SELECT *, avg(v) OVER (PARTITION BY TrackId) AS m FROM mv),
ag AS (SELECT TrackId, avg(v) AS a, median(v) AS b, stddev_pop(v) AS c, count(*) AS k, CASE WHEN stddev_pop(v) > 0 THEN avg(power(v - m, 4)) / power(avg(power(v - m, 2)), 2) - 3 ELSE -3 END AS ku, CASE WHEN stddev_pop(v) > 0 THEN avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5) ELSE 0 END AS sk FROM cm GROUP BY TrackId)
SELECT TrackId, round(coalesce(a, -999), 5) AS bus_stop_speed_mean, round(coalesce(b, -999), 5) AS bus_stop_speed_median, round(coalesce(c, -999), 5) AS bus_stop_speed_std, round(coalesce(ku, -999), 5) AS bus_stop_speed_kurtosis, round(coalesce(sk, -999), 5) + 0 AS bus_stop_speed_skew, coalesce(k, 0) AS bus_stop_num
FROM (SELECT DISTINCT TrackId FROM dd) LEFT JOIN ag USING (TrackId)""")
def geo_stop_speeds(spark, d):
    return rounded(geometry.right_stop_speeds(deduplicate(_points(spark, d)), _stops(spark, d)), 5)


def _countries(spark, d):
    r = _t(spark, d, "region")
    lo = F.lit(54.0) + F.col("r_regionkey") * 1.5
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    ring = F.array(corner(36.5, lo), corner(37.5, lo), corner(37.0, lo + 1.5))
    return r.select(F.substring("r_name", 1, 2).alias("iso2"), F.array(ring).alias("rings"))


@query("geo_country", """
, tri AS (SELECT substr(r_name, 1, 2) AS iso2, CAST(54.0 AS DOUBLE) + r_regionkey * CAST(1.5 AS DOUBLE) AS lo FROM region)
SELECT DISTINCT RowId, iso2 FROM tp JOIN tri ON Latitude > lo AND Latitude < lo + 1.5 AND Longitude > 36.5 + (Latitude - lo) / 3 AND Longitude < 37.5 - (Latitude - lo) / 3""")
def geo_country(spark, d):
    return geometry.country_of(_points(spark, d), _countries(spark, d), "Latitude", "Longitude", ["RowId"])


def _ways(spark, d):
    kinds = F.array(*map(F.lit, RAIL_TYPES + BUS_TYPES))
    n = F.col("n_nationkey")
    end = lambda x: F.struct(F.lit(x).alias("x"), (F.lit(55.0) + n * 0.0021).alias("y"))
    return _t(spark, d, "nation").select(n.cast("long").alias("way_id"), F.get(kinds, n % 9).alias("way_type"), F.array(end(36.999), end(37.002), end(37.006)).alias("line"))


@query("geo_speed_curve")
def geo_speed_curve(spark, d):
    p = _points(spark, d)
    return rounded(geometry.speed_curves(geometry.without_outliers(p), p), 3)


# ---- rules, places, sensors, models, streams -----------------------------------------------------


@query("rul_home", ", a AS (SELECT TrackId, min(DeviceToken) AS DeviceToken, avg(Latitude) AS la, avg(Longitude) AS lo FROM tp GROUP BY TrackId) SELECT DeviceToken, round(median(round_even(la, 1)), 6) AS home_lat, round(median(round_even(lo, 1)), 6) AS home_lon FROM a GROUP BY DeviceToken")
def rul_home(spark, d):
    return rounded(rules.homes(rules.start_end(_points(spark, d))))


@query("rul_bicycle", """
, z AS (SELECT *, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate DESC, RowId DESC) > 100 AS body, sqrt(3 * power(SpeedLimit / 50, 2)) AS turn FROM
  (SELECT * FROM (SELECT DeviceToken AS TrackId, RowId, PointDate, Speed, SpeedLimit, Latitude, Longitude FROM tp QUALIFY row_number() OVER (PARTITION BY DeviceToken, Latitude, Longitude ORDER BY PointDate DESC, RowId DESC) = 1) QUALIFY row_number() OVER (PARTITION BY TrackId, PointDate ORDER BY RowId DESC) = 1))
SELECT TrackId, coalesce(sum(CAST(body AS INT)) > 0 AND sum(CASE WHEN body AND turn > 1 THEN 1 ELSE 0 END) / nullif(CAST(sum(CAST(body AS INT)) AS DOUBLE), 0) > 0.15 AND max(Speed) > 10 AND max(Speed) < 30 AND (epoch_us(max(PointDate)) - epoch_us(min(PointDate))) / 60000000.0 > 5 AND count(*) > 100, false) AS bicycle FROM z GROUP BY TrackId""")
def rul_bicycle(spark, d):
    p = _points(spark, d).withColumn("TrackId", F.col("DeviceToken"))
    return rules.bicycle(p.withColumns({c: F.col("SpeedLimit") / 50 for c in sensors.GYRO}))


@query("rul_transport", ", x AS (SELECT TrackId, max(Speed) AS v, avg(SpeedLimit) / 100 AS p, max(TotalMeters) / 1000 AS km, avg(CASE WHEN SpeedLimit > 10 THEN 1.0 ELSE 0.0 END) AS rail FROM tp GROUP BY TrackId) SELECT TrackId, CASE WHEN v < 25 THEN 'Other' WHEN rail >= 0.8 AND km > 0.2 THEN CASE WHEN km > 2 THEN 'Train' ELSE 'OriginalDriver' END WHEN p >= 0.4 AND km > 2 THEN 'Bus' ELSE 'OriginalDriver' END AS label FROM x")
def rul_transport(spark, d):
    t = _points(spark, d).groupBy("TrackId").agg(F.max("Speed").alias("v"), (F.avg("SpeedLimit") / 100).alias("p"), (F.max("TotalMeters") / 1000).alias("km"), F.avg((F.col("SpeedLimit") > 10).cast("double")).alias("rail"))
    return t.select("TrackId", rules.transport(F.col("v"), F.col("p"), F.col("km"), F.col("rail")).alias("label"))


@query("rul_decide", ", x AS (SELECT TrackId, DeviceToken, n_points % 4 - 1 AS taxi, n_points % 5 = 0 AS bike, n_points > 8 AS has FROM hd), y AS (SELECT *, CASE WHEN bike THEN 'Bicycle' WHEN taxi = 1 THEN 'Taxi' WHEN taxi = -1 THEN 'Other' END AS r FROM x), z AS (SELECT *, CASE WHEN r IS NULL THEN CASE WHEN has THEN 'Bus' ELSE 'OriginalDriver' END WHEN has THEN r END AS label FROM y) SELECT TrackId, label, CASE WHEN r IS NOT NULL AND NOT has THEN 'track is empty' ELSE '' END AS error, CASE WHEN DeviceToken % 3 = 0 OR (DeviceToken IN (6, 1064) AND label IS DISTINCT FROM 'Bicycle') THEN label ELSE 'OriginalDriver' END AS prediction FROM z")
def rul_decide(spark, d):
    h = _header(spark, d)
    n = F.col("n_points")
    label, error = rules.decide(n % 4 - 1, n % 5 == 0, n > 8, F.lit("Bus"))
    out = h.select("TrackId", "DeviceToken", label.alias("label"), error.alias("error"))
    return out.select("TrackId", "label", "error", rules.gate(F.col("label"), F.col("DeviceToken") % 3 == 0, F.col("DeviceToken")).alias("prediction"))


def _ends(spark, d):
    return _points(spark, d).select("DeviceToken", "PointDate", "Latitude", "Longitude")


@query("plc_places", f"""
, q AS (SELECT DeviceToken, PointDate, Latitude, Longitude, row_number() OVER (PARTITION BY DeviceToken ORDER BY PointDate, Latitude, Longitude) AS i FROM tp),
n0 AS (SELECT a.DeviceToken, a.i, b.i AS j, {_HAV.format('a.Latitude', 'a.Longitude', 'b.Latitude', 'b.Longitude')} AS m FROM q a JOIN q b ON a.DeviceToken = b.DeviceToken),
ok AS (SELECT DeviceToken, i FROM n0 WHERE m < 1000 GROUP BY 1, 2 HAVING count(*) >= 4),
near AS (SELECT n0.DeviceToken, n0.i, j FROM n0 JOIN ok a ON a.DeviceToken = n0.DeviceToken AND a.i = n0.i JOIN ok b ON b.DeviceToken = n0.DeviceToken AND b.i = j WHERE m <= 1000),
core AS (SELECT DeviceToken, i FROM near GROUP BY 1, 2 HAVING count(*) >= 4),
cc AS (SELECT near.DeviceToken, near.i, j FROM near JOIN core a ON a.DeviceToken = near.DeviceToken AND a.i = near.i JOIN core b ON b.DeviceToken = near.DeviceToken AND b.i = j),
lo AS (SELECT DeviceToken, i, min(j) AS m FROM cc GROUP BY 1, 2),
reach AS (SELECT DeviceToken, i, m AS r FROM lo UNION SELECT reach.DeviceToken, reach.i, lo.m FROM reach JOIN lo ON lo.DeviceToken = reach.DeviceToken AND lo.i = reach.r),
comp AS (SELECT DeviceToken, i, min(r) AS root FROM reach GROUP BY 1, 2),
lab AS (SELECT DeviceToken, i, dense_rank() OVER (PARTITION BY DeviceToken ORDER BY root) - 1 AS label FROM comp),
edge AS (SELECT near.DeviceToken, near.i, min(label) AS label FROM near JOIN lab ON lab.DeviceToken = near.DeviceToken AND lab.i = near.j GROUP BY 1, 2),
c AS (SELECT q.DeviceToken, label, sum(CASE WHEN isodow(PointDate) >= 6 THEN 1 ELSE 0 END) AS h, sum(CASE WHEN isodow(PointDate) >= 6 THEN 0 ELSE 1 END) AS w, median(hour(PointDate)) AS mh, median(Longitude) AS lo_, median(Latitude) AS la_ FROM q JOIN edge USING (DeviceToken, i) GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY DeviceToken ORDER BY h + w DESC, label) = 1 AS home FROM c),
y AS (SELECT *, NOT home AND row_number() OVER (PARTITION BY DeviceToken ORDER BY home, w DESC, label) = 1 AS work FROM x)
SELECT DeviceToken, CAST(label AS BIGINT) AS label, CAST(h AS BIGINT) AS holy_num, CAST(w AS BIGINT) AS work_num, round(mh, 6) AS median_hour, round(lo_, 6) AS Longitude, round(la_, 6) AS Latitude, CASE WHEN home THEN 'home' WHEN work THEN 'work' WHEN h > w THEN 'holy' ELSE '' END AS place FROM y""")
def plc_places(spark, d):
    return rounded(places.places(_ends(spark, d)))


ORACLE_SQL["plc_places"] = ORACLE_SQL["plc_places"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("sen_orientation", ", x AS (SELECT 1) SELECT RowId, round(sqrt(power(Speed, 2) + power(SpeedLimit, 2) + 1), 6) AS R, round(degrees(acos(1 / sqrt(power(Speed, 2) + power(SpeedLimit, 2) + 1))), 6) AS theta FROM tp")
def sen_orientation(spark, d):
    p = _points(spark, d).withColumn("ax", F.col("Speed")).withColumn("ay", F.col("SpeedLimit")).withColumn("az", F.lit(1.0))
    return rounded(sensors.orientation(p, ["ax", "ay", "az"], ["none"]).select("RowId", "R", "theta"))


def _scored(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_returnflag") == "R", "l_discount", "l_quantity").toDF("y", "s", "q").withColumn("y", F.col("y").cast("int"))


@query("ml_auc", "WITH g AS (SELECT value AS s, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS q FROM events GROUP BY value), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT round(sum(p * (b + q / 2.0)) / (sum(p) * sum(q)), 6) AS auc FROM b")
def ml_auc(spark, d):
    return rounded(learning.auc(_t(spark, d, "events").select((F.col("event_type") == "error").cast("int").alias("y"), "value"), "y", "value"))


@query("ml_threshold_sweep", "WITH t AS (SELECT unnest([0.02, 0.05, 0.08])::DOUBLE AS threshold), x AS (SELECT threshold, l_returnflag = 'R' AS y, l_discount >= threshold AS p FROM lineitem CROSS JOIN t), c AS (SELECT threshold, count(*)::DOUBLE AS n, count(CASE WHEN y AND p THEN 1 END)::DOUBLE AS tp, count(CASE WHEN p AND NOT y THEN 1 END)::DOUBLE AS fp, count(CASE WHEN y AND NOT p THEN 1 END)::DOUBLE AS fn, count(CASE WHEN NOT y AND NOT p THEN 1 END)::DOUBLE AS tn FROM x GROUP BY threshold) SELECT threshold, round((tp + tn) / n, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fn), 6) AS recall_1, round(tn / (tn + fp), 6) AS recall_0 FROM c")
def ml_threshold_sweep(spark, d):
    return rounded(learning.threshold_sweep(_scored(spark, d), "y", "s", [0.02, 0.05, 0.08]))


@query("ml_confusion", "SELECT CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS label, CAST(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS BIGINT) AS predicted, count(*) AS n FROM lineitem GROUP BY 1, 2")
def ml_confusion(spark, d):
    return rounded(learning.confusion(_scored(spark, d), "y", F.col("s") >= 0.05))


@query("ml_mutual_information", """
WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) AS c, max(l_discount) AS e FROM lineitem),
x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, 'q' AS name, least(9, CAST(floor((l_quantity - a) * 10 / (b - a)) AS INT)) AS k FROM lineitem CROSS JOIN r UNION ALL
      SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, 's', least(9, CAST(floor((l_discount - c) * 10 / (e - c)) AS INT)) FROM lineitem CROSS JOIN r),
j AS (SELECT name, k, y, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY name) AS t, sum(n) OVER (PARTITION BY name, k) AS nk, sum(n) OVER (PARTITION BY name, y) AS ny FROM j)
SELECT name, round(sum(n / t * log2(n * t / (nk * ny))), 6) AS rank FROM m GROUP BY name""")
def ml_mutual_information(spark, d):
    return rounded(learning.mutual_information(_scored(spark, d), "y", ["q", "s"]))


@query("ml_split", "WITH c AS (SELECT event_type, count(*) AS k, CAST(ceil(count(*) * 0.7) AS BIGINT) AS n FROM events GROUP BY event_type) SELECT event_type, 'train' AS part, n FROM c UNION ALL SELECT event_type, 'test', k - n FROM c")
def ml_split(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type")
    train, test = learning.stratified_split(e, "event_type", "event_id", 0.7)
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test"))).groupBy("event_type", "part").agg(F.count("*").alias("n"))


@query("str_windows", ", x AS (SELECT 1) SELECT DeviceToken, CAST(time_bucket(INTERVAL 6 HOUR, PointDate) AS TIMESTAMP) AS start, count(*) AS n, round(avg(Speed), 6) AS speed_mean, max(Speed) AS speed_max FROM tp GROUP BY 1, 2")
def str_windows(spark, d):
    return rounded(online.windowed_speed(_points(spark, d), "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("str_sessions", ", l AS (SELECT *, lag(PointDate) OVER (PARTITION BY DeviceToken ORDER BY PointDate, RowId) AS p FROM tp), g AS (SELECT *, sum(CASE WHEN p IS NULL OR PointDate >= p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY DeviceToken ORDER BY PointDate, RowId) AS s FROM l) SELECT DeviceToken, min(PointDate) AS start, max(PointDate) + INTERVAL 12 HOUR AS stop, count(*) AS n, max(Speed) AS speed_max FROM g GROUP BY DeviceToken, s")
def str_sessions(spark, d):
    out = online.sessions(_points(spark, d), "12 hours")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("stop", F.col("stop").cast("timestamp_ntz")))


from roadloom import queries_more  # noqa: E402, F401  registers its queries here
