"""More queries of the trip operators: lines, map coverage, rules and sensors over clustered trips."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom import queries as q
from roadloom.operators import boosting, geometry, learning, rules, segments, sensors
from roadloom.operators.prep import deduplicate, in_order
from roadloom.plans.features import driver_features
from roadloom.plans.features import geo_features as geo_plan
from roadloom.plans.predict import Maps, validate
from roadloom.plans.predict import predict as predict_plan
from roadloom.schema import BUS_TYPES, RAIL_TYPES
from roadloom.session import materialised, scratch_folder
from roadloom.sources import shapefile, sinks, trips
from roadloom.streaming import online, uploads

#: Clusters of each trip (lb) and the points of those of more than four (wo).
_CLUSTERED = """
, q AS (SELECT *, radians(Longitude) * 6378137 AS x, ln(tan(pi() / 4 + radians(Latitude) / 2)) * 6378137 AS y, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) AS i FROM dd),
near AS (SELECT a.TrackId, a.i, b.i AS j FROM q a JOIN q b ON a.TrackId = b.TrackId AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 10000),
core AS (SELECT TrackId, i FROM near GROUP BY TrackId, i HAVING count(*) >= 3),
cc AS (SELECT near.TrackId, near.i, j FROM near JOIN core a ON a.TrackId = near.TrackId AND a.i = near.i JOIN core b ON b.TrackId = near.TrackId AND b.i = near.j),
reach AS (SELECT TrackId, i, i AS r FROM core UNION SELECT reach.TrackId, reach.i, cc.j FROM reach JOIN cc ON cc.TrackId = reach.TrackId AND cc.i = reach.r),
comp AS (SELECT TrackId, i, min(r) AS root FROM reach GROUP BY TrackId, i),
lab AS (SELECT TrackId, i, dense_rank() OVER (PARTITION BY TrackId ORDER BY root) - 1 AS label FROM comp),
edge AS (SELECT near.TrackId, near.i, min(label) AS label FROM near JOIN lab ON lab.TrackId = near.TrackId AND lab.i = near.j GROUP BY near.TrackId, near.i),
lb AS (SELECT q.TrackId, q.RowId, CAST(coalesce(lab.label, edge.label, -1) AS BIGINT) AS labels FROM q LEFT JOIN lab USING (TrackId, i) LEFT JOIN edge USING (TrackId, i)),
wo AS (SELECT * FROM (SELECT dd.*, labels, count(*) OVER (PARTITION BY dd.TrackId, labels) AS lk FROM dd JOIN lb USING (TrackId, RowId) WHERE labels <> -1) WHERE lk > 4)"""


def recursive(name: str, sql: str):
    """query() whose SQL has recursive parts."""
    add = q.query(name, sql)

    def with_mark(fn):
        add(fn)
        q.ORACLE_SQL[name] = q.ORACLE_SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)
        return fn

    return with_mark


def _simplified(n: str, source: str, keys: list[str], metres: float) -> str:
    """CTEs up to <n>_v (keys, seq, x, y): the vertices of the simplified lines of a source."""
    k = ", ".join(keys)
    same = " AND ".join(f"p.{c} = s.{c} AND u.{c} = s.{c} AND v.{c} = s.{c}" for c in keys)
    own = ", ".join(f"s.{c} AS {c}" for c in keys)
    eps = f"({metres} * CAST(8.9883063456985468e-06 AS DOUBLE))"
    return f"""
, {n}_p AS (SELECT {k}, Longitude AS x, Latitude AS y, row_number() OVER (PARTITION BY {k} ORDER BY PointDate, RowId) AS i FROM {source}),
{n}_s AS (
  SELECT {k}, CAST(1 AS BIGINT) AS a, max(i) AS b FROM {n}_p GROUP BY {k}
  UNION ALL
  SELECT {k}, unnest([a, cut]) AS a, unnest([cut, b]) AS b FROM (
    SELECT {k}, a, b, -best.m AS cut FROM (
      SELECT {k}, a, b, span, max(struct_pack(d := CASE WHEN span > 0 THEN abs(wx * ry - wy * rx) ELSE rx * rx + ry * ry END, m := -i)) AS best FROM (
        SELECT {own}, a, b, p.i AS i, v.x - u.x AS wx, v.y - u.y AS wy, p.x - u.x AS rx, p.y - u.y AS ry, sqrt((v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y)) AS span
        FROM {n}_s s JOIN {n}_p p ON p.i > a AND p.i < b JOIN {n}_p u ON u.i = a JOIN {n}_p v ON v.i = b AND {same}
      ) GROUP BY {k}, a, b, span
    ) WHERE CASE WHEN span > 0 THEN best.d / span ELSE sqrt(best.d) END > {eps}
  )),
{n}_i AS (SELECT {k}, a AS i FROM {n}_s UNION SELECT {k}, b FROM {n}_s),
{n}_v AS (SELECT {k}, row_number() OVER (PARTITION BY {k} ORDER BY i) - 1 AS seq, x, y FROM (SELECT * FROM {n}_i UNION ALL SELECT {k}, 1 FROM {n}_s WHERE a = 1 AND b = 1) JOIN {n}_p USING ({k}, i))"""


def _segments_sql(n: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f""", {n}_g AS (SELECT {k}, seq, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM {n}_v WINDOW w AS (PARTITION BY {k} ORDER BY seq)),
{n}_e AS (SELECT * FROM {n}_g WHERE bx IS NOT NULL AND (ax <> bx OR ay <> by_))"""


# ---- lines ---------------------------------------------------------------------------------------


@recursive("geo_simplify", f"{_simplified('l', 'dd', ['TrackId'], 50.0)} SELECT TrackId, seq, x AS Longitude, y AS Latitude FROM l_v")
def geo_simplify(spark, d):
    return q.rounded(geometry.simplify(deduplicate(q._points(spark, d)), 50.0))


_W30 = "(30.0 * CAST(8.9883063456985468e-06 AS DOUBLE))"
_N = f"(ay - by_) / sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) * {_W30}", f"(bx - ax) / sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) * {_W30}"


@recursive("geo_corridors", f"""{_simplified('l', 'dd', ['TrackId'], 50.0)}{_segments_sql('l', ['TrackId'])}
, n AS (SELECT TrackId, row_number() OVER (PARTITION BY TrackId ORDER BY seq) - 1 AS part, ax, ay, bx, by_, {_N[0]} AS nx, {_N[1]} AS ny FROM l_e)
SELECT TrackId, part, round(ax + nx, 9) AS x0, round(ay + ny, 9) AS y0, round(bx + nx, 9) AS x1, round(by_ + ny, 9) AS y1, round(bx - nx, 9) AS x2, round(by_ - ny, 9) AS y2, round(ax - nx, 9) AS x3, round(ay - ny, 9) AS y3 FROM n""")
def geo_corridors(spark, d):
    rings = geometry.corridors(deduplicate(q._points(spark, d))).select("TrackId", F.posexplode("rings").alias("part", "ring"))
    return q.rounded(rings.select("TrackId", "part", *(F.get("ring", F.lit(i))[c].alias(f"{c}{i}") for i in range(4) for c in "xy")), 9)


_SIDES = """
, tri AS (SELECT substr(r_name, 1, 2) AS iso2, CAST(54.0 AS DOUBLE) + r_regionkey * CAST(1.5 AS DOUBLE) AS lo FROM region),
mid AS (SELECT TrackId, median(Latitude) AS la, median(Longitude) AS lo_ FROM {source} GROUP BY TrackId),
sides AS (SELECT TrackId, EXISTS (SELECT 1 FROM tri WHERE iso2 = 'AS' AND la > lo AND la < lo + 1.5 AND lo_ > 36.5 + (la - lo) / 3 AND lo_ < 37.5 - (la - lo) / 3) AS "left" FROM mid)"""


def _sides(spark, d, track: DataFrame) -> DataFrame:
    return geometry.left_hand(track, q._countries(spark, d), spark.createDataFrame([("AS",)], "ISO2 string"))


@q.query("geo_left_hand", _SIDES.format(source="tp") + ' SELECT TrackId, "left" FROM sides')
def geo_left_hand(spark, d):
    return _sides(spark, d, q._points(spark, d))


#: Stops in the one-sided corridors (fs) of the simplified lines b_v of trips with their sides.
_STOPS_FOUND = f"""{q._STOPS}{_segments_sql('b', ['TrackId'])}
, bo AS (SELECT b_e.TrackId, name, lon, lat, "left", ((lon - ax) * (bx - ax) + (lat - ay) * (by_ - ay)) / (power(bx - ax, 2) + power(by_ - ay, 2)) AS u, ((bx - ax) * (lat - ay) - (by_ - ay) * (lon - ax)) / sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS off FROM b_e JOIN sides USING (TrackId) CROSS JOIN st),
fs AS (SELECT DISTINCT TrackId, name, lon, lat FROM bo WHERE u BETWEEN 0 AND 1 AND CASE WHEN "left" THEN off BETWEEN 0 AND {q._WIDTH} ELSE off BETWEEN -{q._WIDTH} AND 0 END)"""


@recursive("geo_bus_stops", f"{_CLUSTERED}{_SIDES.format(source='wo')}{_simplified('b', 'wo', ['TrackId'], 10.0)}{_STOPS_FOUND} SELECT TrackId, name FROM fs")
def geo_bus_stops(spark, d):
    """Stops of a whole trip: its side of the road, its simplified line, its one-sided corridor."""
    track = geometry.without_outliers(q._points(spark, d))
    return geometry.bus_stops(track, q._stops(spark, d), _sides(spark, d, track)).select("TrackId", "name")


# ---- coverage ------------------------------------------------------------------------------------

_KINDS = "[" + ", ".join(f"'{k}'" for k in RAIL_TYPES + BUS_TYPES) + "]"
_HAV_KM = q._HAV.format("ay", "ax", "by_", "bx") + " / 1000"


def _stretch_sql(c0: str, c1: str, lo: str, hi: str, name: str) -> str:
    inside = f"CASE WHEN {c0} >= {lo} AND {c0} <= {hi} THEN"
    a, b = f"({lo} - {c0}) / {c1}", f"({hi} - {c0}) / {c1}"
    return f"CASE WHEN {c1} = 0 THEN {inside} 0 END ELSE greatest(least({a}, {b}), 0) END AS {name}_lo, CASE WHEN {c1} = 0 THEN {inside} 1 END ELSE least(greatest({a}, {b}), 1) END AS {name}_hi"


def _circle_sql(x: str, y: str, name: str) -> str:
    b, c = f"((px - {x}) * dx + (py - {y}) * dy)", f"(power(px - {x}, 2) + power(py - {y}, 2) - 2500)"
    a = "(dx * dx + dy * dy)"
    there, root = f"CASE WHEN {b} * {b} - {a} * {c} >= 0 THEN", f"sqrt(greatest({b} * {b} - {a} * {c}, 0))"
    return f"{there} greatest((-{b} - {root}) / {a}, 0) END AS {name}_lo, {there} least((-{b} + {root}) / {a}, 1) END AS {name}_hi"


#: From the simplified lines w_v: km of a trip by kind of way (ln), and the features of them (wf).
_COVERED = f"""{_segments_sql('w', ['TrackId', 'labels'])}
, wl AS (SELECT *, avg(y) OVER (PARTITION BY TrackId, labels) AS lat0 FROM w_v),
wm AS (SELECT *, radians(x) * CAST(6371000 AS DOUBLE) * cos(radians(lat0)) AS ax, radians(y) * CAST(6371000 AS DOUBLE) AS ay FROM wl),
wn AS (SELECT *, lead(ax) OVER o AS bx, lead(ay) OVER o AS by_ FROM wm WINDOW o AS (PARTITION BY TrackId, labels ORDER BY seq)),
ws AS (SELECT *, coalesce(sqrt(power(bx - ax, 2) + power(by_ - ay, 2)), 0) AS size FROM wn),
wb AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY TrackId, labels ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ws),
wa AS (SELECT {_KINDS}[n_nationkey % 9 + 1] AS kind, CAST(55.0 AS DOUBLE) + n_nationkey * CAST(0.0021 AS DOUBLE) AS y, [36.999, 37.002, 37.006]::DOUBLE[] AS xs, unnest([1, 2]) AS k FROM nation),
wc AS (SELECT TrackId, labels, before, size, kind, ax, ay, bx, by_, radians(xs[k]) * CAST(6371000 AS DOUBLE) * cos(radians(lat0)) AS px, radians(wa.y) * CAST(6371000 AS DOUBLE) AS py, radians(xs[k + 1]) * CAST(6371000 AS DOUBLE) * cos(radians(lat0)) AS qx, radians(wa.y) * CAST(6371000 AS DOUBLE) AS qy FROM wb CROSS JOIN wa WHERE bx IS NOT NULL AND size > 0),
wd AS (SELECT *, qx - px AS dx, qy - py AS dy, bx - ax AS wx, by_ - ay AS wy FROM wc),
we AS (SELECT *, ((px - ax) * wx + (py - ay) * wy) / (wx * wx + wy * wy) AS u0, (dx * wx + dy * wy) / (wx * wx + wy * wy) AS u1, wx * (py - ay) - wy * (px - ax) AS v0, wx * dy - wy * dx AS v1, 50 * sqrt(wx * wx + wy * wy) AS rr FROM wd),
wg AS (SELECT *, {_stretch_sql('u0', 'u1', '0', '1', 'f')}, {_stretch_sql('v0', 'v1', '(-rr)', 'rr', 's')}, {_circle_sql('ax', 'ay', 'a')}, {_circle_sql('bx', 'by_', 'b')} FROM we),
wh AS (SELECT *, [CASE WHEN greatest(f_lo, s_lo) <= least(f_hi, s_hi) AND f_lo IS NOT NULL AND s_lo IS NOT NULL THEN greatest(f_lo, s_lo) END, CASE WHEN a_lo <= a_hi THEN a_lo END, CASE WHEN b_lo <= b_hi THEN b_lo END] AS los,
       [CASE WHEN greatest(f_lo, s_lo) <= least(f_hi, s_hi) AND f_lo IS NOT NULL AND s_lo IS NOT NULL THEN least(f_hi, s_hi) END, CASE WHEN a_lo <= a_hi THEN a_hi END, CASE WHEN b_lo <= b_hi THEN b_hi END] AS his FROM wg),
wi AS (SELECT *, least(greatest(u0 + list_min(los) * u1, 0), 1) AS e0, least(greatest(u0 + list_max(his) * u1, 0), 1) AS e1 FROM wh WHERE list_min(los) IS NOT NULL),
wj AS (SELECT TrackId, labels, kind, before + size * least(e0, e1) AS m0, before + size * greatest(e0, e1) AS m1 FROM wi),
wk AS (SELECT *, max(m1) OVER (PARTITION BY TrackId, labels, kind ORDER BY m0, m1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM wj),
ln AS (SELECT TrackId, kind, sum(greatest(0, m1 - greatest(m0, coalesce(r, m0)))) / 1000 AS km FROM wk GROUP BY 1, 2 UNION ALL SELECT TrackId, 'track', sum({_HAV_KM}) FROM w_e GROUP BY 1),
lw AS (SELECT TrackId, max(CASE WHEN kind = 'track' THEN km END) AS km, coalesce(max(CASE WHEN kind IN {tuple(RAIL_TYPES)} THEN km END), 0) AS rail, coalesce(max(CASE WHEN kind IN {tuple(BUS_TYPES)} THEN km END), 0) AS bus FROM ln GROUP BY 1),
wf AS (SELECT TrackId, coalesce(rail / nullif(km, 0), 0) AS rail_frequency, coalesce(bus / nullif(km, 0), 0) AS bus_frac, (1 - coalesce(bus / nullif(km, 0), 0)) * km AS bus_uncovered_len, (1 - coalesce(rail / nullif(km, 0), 0)) * km AS rail_uncovered_len FROM lw)"""
_WF = ", ".join(f"round({c}, 6) AS {c}" for c in ("rail_frequency", "bus_frac", "bus_uncovered_len", "rail_uncovered_len"))


@recursive("geo_coverage", f"{_CLUSTERED}{_simplified('w', 'wo', ['TrackId', 'labels'], 25.0)}{_COVERED} SELECT TrackId, {_WF} FROM wf")
def geo_coverage(spark, d):
    track = geometry.without_outliers(q._points(spark, d))
    return q.rounded(geometry.way_features(geometry.coverage(geometry.simplify(track, 25.0, ["TrackId", "labels"]), q._ways(spark, d))))


@recursive("geo_way_lengths", f"{_CLUSTERED}{_simplified('w', 'wo', ['TrackId', 'labels'], 25.0)}{_COVERED} SELECT TrackId, kind AS name, round(km, 6) AS length FROM ln")
def geo_way_lengths(spark, d):
    track = geometry.without_outliers(q._points(spark, d))
    return q.rounded(geometry.coverage(geometry.simplify(track, 25.0, ["TrackId", "labels"]), q._ways(spark, d)))


@recursive("geo_speed_profile", f"""{_CLUSTERED}
, po AS (SELECT *, radians(Longitude) * 6378137 AS ax, ln(tan(pi() / 4 + radians(Latitude) / 2)) * 6378137 AS ay FROM wo),
pn AS (SELECT *, lead(ax) OVER o AS bx, lead(ay) OVER o AS by_, row_number() OVER o AS seq, min(Latitude) OVER t AS la0, max(Latitude) OVER t AS la1, min(Longitude) OVER t AS lo0, max(Longitude) OVER t AS lo1 FROM po WINDOW o AS (PARTITION BY TrackId, labels ORDER BY PointDate, RowId), t AS (PARTITION BY TrackId)),
ps AS (SELECT *, coalesce(sqrt(power(bx - ax, 2) + power(by_ - ay, 2)), 0) AS size FROM pn),
pb AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY TrackId ORDER BY labels, PointDate, RowId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ps),
oth AS (SELECT RowId, Latitude, Longitude, Speed, radians(Longitude) * 6378137 AS x, ln(tan(pi() / 4 + radians(Latitude) / 2)) * 6378137 AS y FROM tp),
pm AS (SELECT pb.TrackId, labels, seq, before, size, ax, ay, bx, by_, oth.RowId, oth.Speed, x, y, least(greatest(coalesce(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / nullif(power(bx - ax, 2) + power(by_ - ay, 2), 0), 0), 0), 1) AS u
       FROM pb JOIN oth ON oth.Latitude BETWEEN la0 AND la1 AND oth.Longitude BETWEEN lo0 AND lo1 WHERE bx IS NOT NULL),
pg AS (SELECT *, sqrt(power(ax + u * (bx - ax) - x, 2) + power(ay + u * (by_ - ay) - y, 2)) AS gap FROM pm),
pf AS (SELECT TrackId, labels, RowId, arg_min(before + u * size, (gap, seq)) AS dist, any_value(Speed) AS Speed FROM pg WHERE gap <= 35 GROUP BY 1, 2, 3)
SELECT TrackId, 'own' AS src, RowId, round(before, 3) AS dist, round(Speed, 3) AS Speed FROM pb UNION ALL SELECT TrackId, 'other', RowId, round(dist, 3), round(Speed, 3) FROM pf""")
def geo_speed_profile(spark, d):
    p = q._points(spark, d)
    return q.rounded(geometry.speed_profile(geometry.without_outliers(p), p), 3)


# ---- rules ---------------------------------------------------------------------------------------

_NEAR_M = "(SELECT min(CASE WHEN m <= 3500 THEN m END) FROM (SELECT {hav} AS m FROM air))"


@q.query("rul_airport_taxi", f"""{q._AIR}
, r AS (SELECT *, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) AS u, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate DESC, RowId DESC) AS v FROM dd),
a AS (SELECT TrackId, min(DeviceToken) AS DeviceToken, min(PointDate) AS sd, max(PointDate) AS ed, avg(CASE WHEN u <= 3 THEN Latitude END) AS sla, avg(CASE WHEN u <= 3 THEN Longitude END) AS slo, avg(CASE WHEN v <= 3 THEN Latitude END) AS ela, avg(CASE WHEN v <= 3 THEN Longitude END) AS elo,
  max(CASE WHEN u = 1 THEN Latitude END) AS fla, max(CASE WHEN u = 1 THEN Longitude END) AS flo, avg(Latitude) AS mla, avg(Longitude) AS mlo FROM r GROUP BY TrackId),
h AS (SELECT DeviceToken, median(round_even(mla, 1)) AS hla, median(round_even(mlo, 1)) AS hlo FROM a GROUP BY DeviceToken),
ms AS (SELECT TrackId, min({q._HAV.format('sla', 'slo', 'la', 'lo')}) AS s0, min({q._HAV.format('ela', 'elo', 'la', 'lo')}) AS e0 FROM a CROSS JOIN air GROUP BY TrackId),
m AS (SELECT a.*, hla, hlo, CASE WHEN s0 <= 3500 THEN s0 END AS sm, CASE WHEN e0 <= 3500 THEN e0 END AS em FROM a JOIN h USING (DeviceToken) JOIN ms USING (TrackId)),
c AS (SELECT *, CASE WHEN sm IS NOT NULL AND em IS NOT NULL AND sm >= em THEN 0 WHEN sm <= 1500 THEN 2 WHEN sm <= 3500 THEN 1 ELSE 0 END AS S, CASE WHEN sm IS NOT NULL AND em IS NOT NULL AND sm < em THEN 0 WHEN em <= 1500 THEN 2 WHEN em <= 3500 THEN 1 ELSE 0 END AS E,
  {q._HAV.format('fla', 'flo', 'hla', 'hlo')} < 400000 AS H, {q._HAV.format('ela', 'elo', 'hla', 'hlo')} >= 400000 AS away FROM m),
n AS (SELECT *, lag(struct_pack(sd := sd, ed := ed, sla := sla, slo := slo, ela := ela, elo := elo, away := away)) OVER w AS p, lead(struct_pack(sd := sd, ed := ed, sla := sla, slo := slo, ela := ela, elo := elo, away := away)) OVER w AS q FROM c WINDOW w AS (PARTITION BY DeviceToken ORDER BY sd, TrackId)),
o AS (SELECT *, CASE WHEN S <> 0 THEN p ELSE q END AS oth, CASE WHEN S <> 0 THEN S ELSE E END AS reach, {q._HAV.format('fla', 'flo', 'p.ela', 'p.elo')} < 100000 AS near_before FROM n),
z AS (SELECT *, {q._HAV.format('oth.elo', 'oth.ela', 'slo', 'sla')} >= 400000 AS far_, (epoch_us(oth.ed) - epoch_us(sd)) / CAST(1000000 AS DOUBLE) AS secs FROM o),
y AS (SELECT *, CASE WHEN secs > 432000 THEN 1 WHEN secs > 172800 THEN 2 ELSE 0 END AS gap FROM z)
SELECT TrackId, CAST(CASE WHEN S = 0 AND E = 0 AND H THEN 0 WHEN S = 0 AND E = 0 THEN CASE WHEN p IS NOT NULL AND p.away AND near_before THEN 0 ELSE -1 END WHEN oth IS NULL THEN CASE WHEN reach = 2 THEN -1 ELSE 0 END
  WHEN far_ THEN 1 WHEN gap = 0 THEN CASE WHEN H THEN 0 ELSE -1 END WHEN (reach = 2 AND gap = 2) OR (reach = 1 AND gap = 1) THEN 1 ELSE -1 END AS BIGINT) AS taxi FROM y""")
def rul_airport_taxi(spark, d):
    return q.rounded(rules.airport_taxi(q._points(spark, d), q._airports(spark, d)))


# ---- sensors -------------------------------------------------------------------------------------


@q.query("sen_parking", f"""
, w AS (SELECT *, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) AS i FROM seg WHERE is_walk),
l AS (SELECT *, lead(Latitude) OVER o AS la1, lead(Longitude) OVER o AS lo1, lead(Latitude, 2) OVER o AS la2, lead(Longitude, 2) OVER o AS lo2 FROM w WINDOW o AS (PARTITION BY TrackId ORDER BY i)),
s AS (SELECT *, CASE WHEN la1 IS NOT NULL THEN {q._HAV.format('Latitude', 'Longitude', 'la1', 'lo1')} END AS step, lo1 - Longitude AS ux, la1 - Latitude AS uy, lo2 - lo1 AS vx, la2 - la1 AS vy FROM l),
t AS (SELECT *, CASE WHEN (ux * ux + uy * uy) * (vx * vx + vy * vy) > 0 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))) END AS angle FROM s),
g AS (SELECT TrackId, step > 0.5 AND step < 30 AS good, sum(CASE WHEN step > 0.5 AND step < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY TrackId ORDER BY i DESC) AS left_ FROM t WHERE step < 100),
r AS (SELECT TrackId, left_, sum(CASE WHEN good THEN 1 ELSE 0 END) AS k FROM g GROUP BY TrackId, left_),
lr AS (SELECT TrackId, coalesce(max(CASE WHEN left_ > 0 THEN k END), 0) AS longest_run FROM r GROUP BY TrackId)
SELECT TrackId, round(coalesce(sum(CASE WHEN step < 100 THEN step END), 0), 6) AS steps_m, count(CASE WHEN step < 100 THEN 1 END) AS n_steps, round(avg(angle), 4) AS angle_mean, round(max(angle), 4) AS angle_max, CAST(coalesce(max(longest_run), 0) AS BIGINT) AS longest_run FROM t LEFT JOIN lr USING (TrackId) GROUP BY TrackId""")
def sen_parking(spark, d):
    out = sensors.parking(segments.split_walk(deduplicate(q._points(spark, d))).where("is_walk"))
    return q.rounded(out.withColumns({c: q.round_half(F.col(c), 4) for c in ("angle_mean", "angle_max")}))


def _taxi_sql() -> str:
    parking = q.ORACLE_SQL["sen_parking"].split(q.BASE, 1)[1].lstrip().removeprefix(",")
    cols = ["time_delta", "theta_0", "rstd", "amp", "screen_direction"]
    best = ", ".join(f"round(coalesce(arg_max({c}, (time_delta, t0)), -1), 4) AS {c}" for c in cols)
    zeros = ", ".join(f"CAST(0 AS DOUBLE) AS z_f{k}" for k in range(4))
    return f"{_STILL.format(amp=10.0, secs=300.0, std=8.0)}, bp AS (SELECT TrackId, {best} FROM (SELECT DISTINCT TrackId FROM tp) LEFT JOIN st0 USING (TrackId) GROUP BY TrackId) SELECT bp.*, {zeros}, pk.* EXCLUDE (TrackId) FROM bp LEFT JOIN (WITH {parking}) pk USING (TrackId)"


def sen_taxi_row(spark, d):
    """The feature row of a possible taxi; no trip here has the 300 samples that vertical features need."""
    walk = segments.split_walk(deduplicate(q._points(spark, d))).where("is_walk")
    out = sensors.taxi_row(_oriented(spark, d), walk)
    return q.rounded(out.withColumns({c: q.round_half(F.col(c), 4) for c in ("theta_0", "rstd", "amp", "angle_mean", "angle_max")}))


#: One step of the recursion: smoothed samples, then the angles that turn to gravity, then the vertical.
_STEADY = """
, va AS (SELECT DeviceToken % 5 AS TrackId, PointDate, RowId, CAST(0.9 + Speed / 1000 AS DOUBLE) AS x0, CAST(coalesce(SpeedLimit, 0) / 500 AS DOUBLE) AS x1, CAST((RowId % 7) / 50 AS DOUBLE) AS x2, CAST(Speed / 2000 - 0.02 AS DOUBLE) AS y0, CAST((RowId % 5) / 100 - 0.02 AS DOUBLE) AS y1, CAST(0.01 AS DOUBLE) AS y2 FROM tp),
vb AS (SELECT *, row_number() OVER o - 1 AS i, coalesce(epoch_us(PointDate) - epoch_us(lag(PointDate) OVER o), 0) / CAST(1000000 AS DOUBLE) AS dt FROM va WINDOW o AS (PARTITION BY TrackId ORDER BY PointDate, RowId)),
vr AS (
  SELECT TrackId, i, x0 AS a0, x1 AS a1, x2 AS a2, y0 AS g0, y1 AS g1, y2 AS g2, CAST(0 AS DOUBLE) AS s1, CAST(1 AS DOUBLE) AS c1, CAST(0 AS DOUBLE) AS s2, CAST(1 AS DOUBLE) AS c2, x2 AS up FROM vb WHERE i = 0
  UNION ALL
  SELECT TrackId, i, a0, a1, a2, g0, g1, g2, s1, c1, s2, c2, (a2 * c1 + a1 * s1) * c2 + a0 * s2 FROM (
    SELECT TrackId, i, a0, a1, a2, g0, g1, g2, CASE WHEN go THEN f * a1 / flat + (1 - f) * s1 ELSE s1 END AS s1, CASE WHEN go THEN f * a2 / flat + (1 - f) * c1 ELSE c1 END AS c1,
      CASE WHEN go THEN f * a0 / whole + (1 - f) * s2 ELSE s2 END AS s2, CASE WHEN go THEN f * flat / whole + (1 - f) * c2 ELSE c2 END AS c2 FROM (
      SELECT *, CASE WHEN i < 200 THEN flat < 1.3 AND whole > 0.7 ELSE NOT (up >= 0.85 AND up <= 1.15) END AS go FROM (
        SELECT *, sqrt(a1 * a1 + a2 * a2 + a0 * a0) AS whole, sqrt(a1 * a1 + a2 * a2) AS flat FROM (
          SELECT vb.TrackId, vb.i, CASE WHEN dt > 0 THEN dt / (0.03 + dt) ELSE 0 END AS f, s1, c1, s2, c2, up, a0 + w * (x0 - a0) AS a0, a1 + w * (x1 - a1) AS a1, a2 + w * (x2 - a2) AS a2, g0 + w * (y0 - g0) AS g0, g1 + w * (y1 - g1) AS g1, g2 + w * (y2 - g2) AS g2
          FROM vr JOIN (SELECT *, CASE WHEN dt > 0 THEN dt / (0.5 + dt) ELSE 0 END AS w FROM vb) vb ON vb.TrackId = vr.TrackId AND vb.i = vr.i + 1))))),
vs AS (SELECT TrackId, up, (g2 * c1 + g1 * s1) * c2 + g0 * s2 AS spin FROM vr)"""
_MANY = "CASE WHEN count(CASE WHEN abs({0}) < {1} THEN 1 END) >= 300 THEN round({2}(CASE WHEN abs({0}) < {1} THEN {0} END), 6) ELSE 0 END AS {3}"


@recursive("sen_vertical", _STEADY + " SELECT TrackId, " + ", ".join(_MANY.format(c, least, f, n) for c, least, f, n in (("spin", 0.1, "avg", "z_f0"), ("spin", 0.1, "stddev_pop", "z_f1"), ("up", "CAST(1 AS DOUBLE)", "avg", "z_f2"), ("up", "CAST(1 AS DOUBLE)", "stddev_pop", "z_f3"))) + " FROM vs GROUP BY TrackId")
def sen_vertical(spark, d):
    """Vertical rotation and acceleration of long made-up trips, all points of a fifth of the devices, with axes turned to gravity."""
    x = [0.9 + F.col("Speed") / 1000, F.coalesce("SpeedLimit", F.lit(0.0)) / 500, F.col("RowId") % 7 / 50]
    y = [F.col("Speed") / 2000 - 0.02, F.col("RowId") % 5 / 100 - 0.02, F.lit(0.01)]
    p = q._points(spark, d).withColumn("TrackId", F.col("DeviceToken") % 5).withColumns(dict(zip([*sensors.ACC, *sensors.GYRO], [*x, *y], strict=True)))
    return q.rounded(sensors.vertical_features(p))


@q.query("sen_spectrum", """
, b AS (SELECT TrackId, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) - 1 AS j, sqrt(power(Speed, 2) + power(SpeedLimit, 2)) / CAST(9.81523 AS DOUBLE) AS y0 FROM tp),
c AS (SELECT TrackId, j, y0 - avg(y0) OVER (PARTITION BY TrackId) AS y, count(*) OVER (PARTITION BY TrackId) AS n FROM b),
k AS (SELECT TrackId, n, unnest(range(0, (n - 1) // 2 + 1)) AS k FROM (SELECT DISTINCT TrackId, n FROM c WHERE n > 1))
SELECT c.TrackId, round(k.k / CAST(k.n AS DOUBLE), 6) AS freq, round(sqrt(power(sum(y * cos(2 * pi() * k.k * j / k.n)), 2) + power(sum(y * sin(2 * pi() * k.k * j / k.n)), 2)) / k.n, 6) AS amp FROM c JOIN k ON k.TrackId = c.TrackId GROUP BY c.TrackId, k.k, k.n""")
def sen_spectrum(spark, d):
    s = q._points(spark, d).select("TrackId", F.row_number().over(in_order()).cast("double").alias("t"), F.col("Speed").alias("X"), F.col("SpeedLimit").alias("Y"), F.lit(0.0).alias("Z"))
    return q.rounded(sensors.spectrum(s))


@recursive("win_low_pass", """
, b AS (SELECT TrackId, RowId, Speed, row_number() OVER o AS i, (epoch_us(PointDate) - epoch_us(lag(PointDate) OVER o)) / CAST(1000000 AS DOUBLE) AS dt FROM tp WINDOW o AS (PARTITION BY TrackId ORDER BY PointDate, RowId)),
f AS (SELECT TrackId, RowId, i, Speed AS x FROM b WHERE i = 1 UNION ALL SELECT b.TrackId, b.RowId, b.i, f.x + CASE WHEN b.dt > 0 THEN b.dt / (0.5 + b.dt) ELSE 0 END * (b.Speed - f.x) FROM f JOIN b ON b.TrackId = f.TrackId AND b.i = f.i + 1)
SELECT TrackId, RowId, round(x, 6) AS smooth FROM f""")
def win_low_pass(spark, d):
    return q.rounded(sensors.low_pass(q._points(spark, d), "Speed"))


def _sampled(spark, d) -> DataFrame:
    """Trip points with their moments 15 seconds apart, so that a trip is a few minutes long."""
    n = F.row_number().over(in_order())
    return q._points(spark, d).withColumn("__n", n).withColumn("PointDate", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("__n") * 15)).drop("__n")


_SAMPLED = """
, sa AS (SELECT TrackId, RowId, Speed, (row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId)) * 15 AS t FROM tp),
ge AS (SELECT TrackId, unnest(range(min(t), max(t) + 1)) AS t FROM sa GROUP BY TrackId),
jo AS (SELECT ge.TrackId, ge.t, Speed AS v FROM ge LEFT JOIN sa USING (TrackId, t)),
fi AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0, last_value(v IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t1, first_value(v IGNORE NULLS) OVER b AS v1
  FROM jo WINDOW a AS (PARTITION BY TrackId ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY TrackId ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rs AS (SELECT TrackId, t, coalesce(v, v0 + (t - t0) * (v1 - v0) / (t1 - t0)) AS v FROM fi)"""


@q.query("win_resample", f"{_SAMPLED} SELECT TrackId, t, round(v, 6) AS value FROM rs")
def win_resample(spark, d):
    out = sensors.resample_seconds(_sampled(spark, d), "Speed")
    return q.rounded(out.select("TrackId", (F.unix_seconds(F.col("second").cast("timestamp")) - 1704067200).alias("t"), "value"))


_K = "abs(o - 29.5) / 30.0"
_PARZEN = f"CASE WHEN {_K} <= 0.5 THEN 1 - 6 * power({_K}, 2) + 6 * power({_K}, 3) ELSE 2 * power(1 - {_K}, 3) END"


@q.query("win_parzen", f"""{_SAMPLED}
, we AS (SELECT o, {_PARZEN} AS w FROM (SELECT unnest(range(0, 60)) AS o)),
po AS (SELECT TrackId, t, v, row_number() OVER (PARTITION BY TrackId ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY TrackId) AS n FROM rs),
av AS (SELECT a.TrackId, a.i, sum(b.v * w) / (SELECT sum(w) FROM we) AS y FROM po a CROSS JOIN we JOIN po b ON b.TrackId = a.TrackId AND b.i = a.i - 30 + o WHERE a.i >= 30 AND a.i + 30 <= a.n GROUP BY a.TrackId, a.i),
al AS (SELECT po.TrackId, t, po.i, y FROM po LEFT JOIN av ON av.TrackId = po.TrackId AND av.i = po.i)
SELECT TrackId, t, round(coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY TrackId ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(y IGNORE NULLS) OVER (PARTITION BY TrackId ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS smooth FROM al""")
def win_parzen(spark, d):
    out = sensors.smooth(sensors.resample_seconds(_sampled(spark, d), "Speed"), 60)
    return q.rounded(out.select("TrackId", (F.unix_seconds(F.col("second").cast("timestamp")) - 1704067200).alias("t"), "smooth"))


_THETA = _SAMPLED.replace("RowId, Speed, (row_number()", "RowId, degrees(acos(1 / sqrt(power(Speed, 2) + power(SpeedLimit, 2) + 1))) AS Speed, (row_number()")
#: Still stretches (st0) of the trips of _SAMPLED by the smoothed angle of a made-up phone.
_STILL = f"""{_THETA}
, we AS (SELECT o, {_PARZEN} AS w FROM (SELECT unnest(range(0, 60)) AS o)),
po AS (SELECT TrackId, t, v, row_number() OVER (PARTITION BY TrackId ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY TrackId) AS n FROM rs),
av AS (SELECT a.TrackId, a.i, sum(b.v * w) / (SELECT sum(w) FROM we) AS y FROM po a CROSS JOIN we JOIN po b ON b.TrackId = a.TrackId AND b.i = a.i - 30 + o WHERE a.i >= 30 AND a.i + 30 <= a.n GROUP BY a.TrackId, a.i),
al AS (SELECT po.TrackId, t, po.i, y FROM po LEFT JOIN av ON av.TrackId = po.TrackId AND av.i = po.i),
so AS (SELECT TrackId, t, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY TrackId ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(y IGNORE NULLS) OVER (PARTITION BY TrackId ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM al),
ra AS (SELECT TrackId, t, y, CASE WHEN count(y) OVER w = 30 THEN max(y) OVER w - min(y) OVER w END AS r FROM so WINDOW w AS (PARTITION BY TrackId ORDER BY t ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)),
am AS (SELECT TrackId, t, y, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY TrackId ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(r IGNORE NULLS) OVER (PARTITION BY TrackId ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS amp FROM ra),
pp AS (SELECT TrackId, RowId, Speed, SpeedLimit, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) AS i, count(*) OVER (PARTITION BY TrackId) AS n FROM tp),
pj0 AS (SELECT pp.*, y, amp, amp <= {{amp}} AS s FROM pp JOIN am ON am.TrackId = pp.TrackId AND am.t = pp.i * 15),
pe AS (SELECT *, CASE WHEN i > 1 AND s = lag(s) OVER o THEN 0 ELSE 1 END AS e FROM pj0 WINDOW o AS (PARTITION BY TrackId ORDER BY i)),
pr AS (SELECT *, sum(e) OVER (PARTITION BY TrackId ORDER BY i) AS r FROM pe),
pd AS (SELECT *, coalesce(Speed - lag(Speed) OVER (PARTITION BY TrackId, r ORDER BY i), 0) AS dv FROM pr WHERE i < n AND s),
pg0 AS (SELECT TrackId, r, min(i) * 15 AS t0, max(i) * 15 AS t1, CAST((max(i) - min(i)) * 15 AS DOUBLE) AS time_delta, avg(y) AS theta_0, stddev_samp(y) AS rstd, max(amp) AS amp, corr(dv, SpeedLimit) AS c FROM pd GROUP BY TrackId, r),
st0 AS (SELECT TrackId, t0, t1, time_delta, theta_0, rstd, amp, CASE WHEN c > 0 THEN 0.5 WHEN c < 0 THEN -0.5 ELSE 0 END AS screen_direction FROM pg0 WHERE time_delta >= {{secs}} AND NOT coalesce(rstd > {{std}}, false))"""


def _oriented(spark, d) -> DataFrame:
    p = _sampled(spark, d).withColumns({"ax": F.col("Speed"), "ay": F.col("SpeedLimit"), "az": F.lit(1.0)})
    p = sensors.orientation(p, ["ax", "ay", "az"], ["none"]).withColumns({**dict.fromkeys(sensors.ACC[:2], F.lit(0.0)), sensors.ACC[2]: F.col("SpeedLimit"), **dict.fromkeys(sensors.GYRO, F.lit(0.0))})
    return sensors.smooth_theta(p, 60, 30)


@q.query("sen_positions", f"{_STILL.format(amp=6.0, secs=75.0, std=3.5)} SELECT TrackId, t0, t1, time_delta, round(theta_0, 5) AS theta_0, round(rstd, 5) AS rstd, round(amp, 5) AS amp, CAST(screen_direction AS DOUBLE) AS screen_direction FROM st0")
def sen_positions(spark, d):
    """Stretches in which a made-up phone lay still."""
    out = sensors.positions(_oriented(spark, d), 6.0, 75.0, 3.5)
    second = lambda c: (F.unix_seconds(F.col(c).cast("timestamp")) - 1704067200)
    return q.rounded(out.select("TrackId", second("start").alias("t0"), second("end").alias("t1"), "time_delta", "theta_0", "rstd", "amp", "screen_direction"), 5)


q.query("sen_taxi_row", _taxi_sql())(sen_taxi_row)


# ---- the whole feature plan ----------------------------------------------------------------------

#: The prepared rows (sm) of clustered points instead of those of de-duplicated ones.
_ON_CLUSTERS = "WITH RECURSIVE " + q.BASE.replace("\ns0 AS (", "\n" + _CLUSTERED.strip().lstrip(",") + ",\ns0 AS (").replace("  FROM dd WINDOW o AS (PARTITION BY TrackId ORDER BY PointDate, RowId)),\ns1", "  FROM wo WINDOW o AS (PARTITION BY TrackId ORDER BY PointDate, RowId)),\ns1")


def _part(name: str) -> str:
    """A query's SQL as a table: its own parts after the common ones."""
    own = q.ORACLE_SQL[name].split(q.BASE, 1)[1].lstrip().removeprefix(",")
    return f"(WITH {own})"


_GEO_PARTS = f"""{_SIDES.format(source='wo')}{_simplified('b', 'wo', ['TrackId'], 10.0)}{_STOPS_FOUND}{q._PROJECTED.replace('FROM dd)', 'FROM wo)')}{_simplified('w', 'wo', ['TrackId', 'labels'], 25.0)}{_COVERED}
, sp AS (SELECT TrackId, Speed, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) - 1 AS k FROM wo),
mv AS (SELECT pj.TrackId, name, lon, lat, min(Speed) AS v FROM pj JOIN sp ON sp.TrackId = pj.TrackId AND k BETWEEN i - 7 AND i + 3 GROUP BY ALL),
cm AS (SELECT *, avg(v) OVER (PARTITION BY TrackId) AS m FROM mv),
ag AS (SELECT TrackId, avg(v) AS a, median(v) AS b, stddev_pop(v) AS c, count(*) AS k, CASE WHEN stddev_pop(v) > 0 THEN avg(power(v - m, 4)) / power(avg(power(v - m, 2)), 2) - 3 ELSE -3 END AS ku, CASE WHEN stddev_pop(v) > 0 THEN avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5) ELSE 0 END AS sk FROM cm GROUP BY TrackId),
wk0 AS (SELECT TrackId, arg_min(Latitude, (PointDate, RowId)) AS wla, arg_min(Longitude, (PointDate, RowId)) AS wlo FROM seg WHERE is_walk GROUP BY TrackId),
ls AS (SELECT wk0.TrackId, count(CASE WHEN {q._HAV.format('wla', 'wlo', 'lat', 'lon')} < 50 THEN 1 END) AS ped_last_stop FROM wk0 LEFT JOIN fs ON fs.TrackId = wk0.TrackId GROUP BY wk0.TrackId),
gf AS (SELECT ls.TrackId, ped_last_stop, coalesce(a, -999) AS bus_stop_speed_mean, coalesce(b, -999) AS bus_stop_speed_median, coalesce(c, -999) AS bus_stop_speed_std, coalesce(ku, -999) AS bus_stop_speed_kurtosis, coalesce(sk, -999) AS bus_stop_speed_skew, coalesce(k, 0) AS bus_stop_num, wf.* EXCLUDE (TrackId) FROM ls JOIN wf USING (TrackId) LEFT JOIN ag USING (TrackId))"""
_GF = ", ".join(f"round({c}, 5) + 0 AS {c}" for c in ("bus_stop_speed_mean", "bus_stop_speed_median", "bus_stop_speed_std", "bus_stop_speed_kurtosis", "bus_stop_speed_skew", "rail_frequency", "bus_frac", "bus_uncovered_len", "rail_uncovered_len"))


@q.query("geo_features", f"{_ON_CLUSTERS}{_GEO_PARTS} SELECT TrackId, ped_last_stop, bus_stop_num, {_GF} FROM gf")
def geo_features(spark, d):
    track = materialised(geometry.without_outliers(q._points(spark, d)))
    return q.rounded(geo_plan(track, q._stops(spark, d), q._ways(spark, d), _sides(spark, d, track)), 5)


def _all_sql() -> str:
    parts = {n: _part(n) for n in ("ftr_speed", "ftr_acceleration", "ftr_totals", "ftr_stops", "ftr_moves", "ftr_rich", "ftr_header")}
    totals = parts["ftr_totals"].replace("round(max(CASE WHEN is_walk", "coalesce(round(max(CASE WHEN is_walk").replace(", 6) AS pedestrian_dist", ", 6), 0) AS pedestrian_dist")
    joined = " JOIN ".join(f"{sql} {n} USING (TrackId)" for n, sql in {**parts, "ftr_totals": totals}.items() if n not in ("ftr_header", "ftr_speed"))
    return f"{_ON_CLUSTERS}{_GEO_PARTS}, fa AS (SELECT TrackId, ped_last_stop, bus_stop_num, {_GF} FROM gf) SELECT * EXCLUDE (TrackId) FROM {parts['ftr_header']} ftr_header JOIN {parts['ftr_speed']} ftr_speed USING (TrackId) JOIN {joined} JOIN fa USING (TrackId)"


def features(spark, d) -> DataFrame:
    points = q._points(spark, d).withColumn("IncomingTrackId", F.col("TrackId"))
    rich = q._rich(spark, d).withColumn("RichTrackId", F.col("TrackId"))
    return driver_features(points, rich, q._tracks(spark, d), q._stops(spark, d), q._ways(spark, d), _sides(spark, d, q._points(spark, d)))


@q.query("ftr_all", _all_sql())
def ftr_all(spark, d):
    """The whole plan: cleaning with clusters, and all features of the three tables, stops and ways."""
    out = features(spark, d)
    coarse = [c for c in out.columns if c.startswith(("bus_", "rail_"))]
    fine = [c for c in out.columns if c.startswith(("acc_", "a("))]
    kinds = dict(out.dtypes)
    digits = {c: 5 if c in coarse else 9 if c in fine else 6 for c in out.columns}
    rounded = [(q.round_half(F.col(f"`{c}`"), digits[c]) + F.lit(0.0) if kinds[c] == "double" else F.col(f"`{c}`").cast("long")).alias(c) for c in out.columns]
    return out.select(*rounded)


# ---- files, data sets, models, streams -----------------------------------------------------------

_FILE = "RowId bigint, TrackId bigint, DeviceToken string, PointDate timestamp_ntz, Speed double, SpeedLimit double, Number bigint"


def _filed(spark, d) -> DataFrame:
    p = q._points(spark, d)
    return p.select((F.col("RowId") + _BEYOND).alias("RowId"), "TrackId", F.col("DeviceToken").cast("string").alias("DeviceToken"), "PointDate", "Speed", F.when(F.col("SpeedLimit") >= 30, F.col("SpeedLimit")).alias("SpeedLimit"))


#: Ids beyond the whole numbers that doubles tell apart.
_BEYOND = 1 << 53
_FILED = f", x AS (SELECT 1) SELECT RowId + {_BEYOND} AS RowId, TrackId, CAST(DeviceToken AS VARCHAR) AS DeviceToken, PointDate, Speed, CASE WHEN SpeedLimit >= 30 THEN SpeedLimit END AS SpeedLimit, CAST(NULL AS BIGINT) AS Number FROM tp"


@q.query("src_three_tables", """, x AS (SELECT 1)
SELECT TrackId AS Id, CAST(DeviceToken AS VARCHAR) AS DeviceToken, CASE n_points % 3 WHEN 2 THEN round(Distance, 6) END AS Distance, n_points AS n_rich, k AS n_limits, s AS speed_max
FROM hd JOIN (SELECT TrackId, count(CASE WHEN SpeedLimit >= 30 THEN 1 END) AS k, max(Speed) AS s FROM tp GROUP BY TrackId) USING (TrackId)""")
def src_three_tables(spark, d):
    """A set of trips written as three tables and loaded by their schemas; blanks and NA are nulls, missing columns too."""
    base = scratch_folder(spark, "tables")
    p, h = q._points(spark, d), q._header(spark, d)
    blank = F.when(F.col("n_points") % 3 == 0, "").when(F.col("n_points") % 3 == 1, "NA").otherwise(F.col("Distance").cast("string"))
    sinks.write_csv(h.select(F.col("TrackId").alias("Id"), F.col("TrackId").alias("IncomingTrackId"), "DeviceToken", blank.alias("Distance")), f"{base}/tracks")
    limit = F.when(F.col("SpeedLimit") >= 30, F.col("SpeedLimit").cast("string")).otherwise("NA")
    sinks.write_csv(p.select(F.col("TrackId").alias("RichTrackId"), "PointDate", limit.alias("SpeedLimit")), f"{base}/rich")
    sinks.write_csv(p.select(F.col("TrackId").alias("IncomingTrackId"), "PointDate", "Speed", F.col("RowId").alias("Number")), f"{base}/incoming")
    t = trips.load(spark, f"{base}/tracks", f"{base}/rich", f"{base}/incoming")
    rich = t.rich.groupBy(F.col("RichTrackId").alias("Id")).agg(F.count("PointDate").alias("n_rich"), F.count("SpeedLimit").alias("n_limits"))
    raw = t.incoming.where("Height is null").groupBy("IncomingTrackId").agg(F.max("Speed").alias("speed_max"))
    out = t.tracks.join(rich, "Id").join(raw, "IncomingTrackId")
    return q.rounded(out.select("Id", "DeviceToken", "Distance", "n_rich", "n_limits", "speed_max"))


@q.query("src_shapefile", """
, tri AS (SELECT substr(r_name, 1, 2) AS iso2, r_regionkey AS code, CAST(54.0 AS DOUBLE) + r_regionkey * CAST(1.5 AS DOUBLE) AS lo FROM region)
SELECT DISTINCT RowId, iso2, code FROM tp JOIN tri ON Latitude > lo AND Latitude < lo + 1.5 AND Longitude > 36.5 + (Latitude - lo) / 3 AND Longitude < 37.5 - (Latitude - lo) / 3
  AND NOT (Latitude > lo + 1.00005 AND Latitude < lo + 1.03005 AND Longitude > 37.00105 AND Longitude < 37.00305)""")
def src_shapefile(spark, d):
    """Points in the countries of a shapefile, each with a hole, read in parts of two records."""
    folder = scratch_folder(spark, "borders").removeprefix("file://")
    os.makedirs(folder)
    rows = []
    for r in q._t(spark, d, "region").select("r_name", "r_regionkey").collect():
        lo, corner = 54.0 + r.r_regionkey * 1.5, [37.00105, 1.00005, 37.00305, 1.03005]
        hole = [(corner[i], lo + corner[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3), (0, 1))]
        rows.append((r.r_name[:2], r.r_regionkey, [[(36.5, lo), (37.5, lo), (37.0, lo + 1.5), (36.5, lo)], hole]))
    shapefile.write_polygons(f"{folder}/borders.shp", rows, [("ISO2", "C", 2, 0), ("CODE", "N", 5, 0)])
    spark.dataSource.register(shapefile.Shapefile)
    lands = spark.read.format("shapefile").option("recordsPerPartition", 2).load(f"{folder}/borders.shp").withColumnRenamed("ISO2", "iso2")
    found = geometry.country_of(q._points(spark, d), lands, "Latitude", "Longitude", ["RowId"])
    return found.join(lands.select("iso2", F.col("CODE").alias("code")), "iso2").select("RowId", "iso2", "code")


@q.query("src_csv", _FILED)
def src_csv(spark, d):
    """Written as compressed CSV and read again by the schema; a column that the file lacks is null."""
    folder = scratch_folder(spark, "csv")
    sinks.write_csv(_filed(spark, d), folder)
    return trips.read_csv(spark, folder, _FILE)


@q.query("src_csv_comma", _FILED)
def src_csv_comma(spark, d):
    """Semicolons between columns, decimal commas, NA for a missing number."""
    folder = scratch_folder(spark, "comma")
    comma = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("NA")), F.lit("."), F.lit(",")).alias(c)
    _filed(spark, d).select("RowId", "TrackId", "DeviceToken", F.col("PointDate").cast("string"), comma("Speed"), comma("SpeedLimit")).write.option("header", True).option("sep", ";").csv(folder)
    return trips.read_csv(spark, folder, _FILE, sep=";", decimal=",")


@q.query("snk_by_trip", ", x AS (SELECT 1) SELECT TrackId, count(*) AS n, round(sum(Speed), 6) AS v FROM tp GROUP BY TrackId")
def snk_by_trip(spark, d):
    """A folder per trip, read again."""
    folder = scratch_folder(spark, "trips")
    sinks.write_by_trip(q._points(spark, d), folder, "TrackId")
    return q.rounded(spark.read.parquet(folder).groupBy(F.col("TrackId").cast("long").alias("TrackId")).agg(F.count("*").alias("n"), F.sum("Speed").alias("v")))


def _labelled(spark, d) -> tuple[DataFrame, DataFrame]:
    h = q._header(spark, d)
    tracks = h.select(F.col("TrackId").alias("IncomingTrackId"), F.when(F.col("n_points") % 3 == 0, "Bus").when(F.col("n_points") % 3 == 1, "Car").alias("TrackOrigin"))
    return h.select(F.col("TrackId").alias("IncomingTrackId"), "Distance", F.col("n_points").alias("weekday"), F.col("n_points").alias("height_max")), tracks


@q.query("ml_dataset", ", x AS (SELECT 1) SELECT TrackId AS IncomingTrackId, Distance, CAST(n_points % 3 = 0 AS BIGINT) AS label FROM hd WHERE n_points % 3 < 2")
def ml_dataset(spark, d):
    """Features without the irrelevant ones, with a label by the trip's origin."""
    return q.rounded(learning.dataset(*_labelled(spark, d)), 9)


@q.query("prj_relabel", ", x AS (SELECT 1) SELECT TrackId AS IncomingTrackId, CASE WHEN TrackId % 20 = 0 THEN 'Bus' WHEN n_points % 3 = 0 THEN 'Bus' WHEN n_points % 3 = 1 THEN 'Car' END AS TrackOrigin FROM hd")
def prj_relabel(spark, d):
    _, tracks = _labelled(spark, d)
    return learning.relabel(tracks, "TrackOrigin", tracks.where("IncomingTrackId % 20 = 0").select("IncomingTrackId"), "IncomingTrackId", "Bus")


@q.query("prj_codes", "SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS code FROM events")
def prj_codes(spark, d):
    return learning.codes(q._t(spark, d, "events"), "event_type", "code").select("event_id", "code")


@q.query("flt_validate", ", x AS (SELECT TrackId // 20 AS g, CASE WHEN TrackId // 20 % 2 = 0 THEN 1 ELSE DeviceToken END AS dev, CASE WHEN TrackId // 20 % 3 = 0 THEN 1 ELSE TrackId END AS id FROM hd), y AS (SELECT g, count(DISTINCT dev) AS n, count(DISTINCT id) AS m FROM x GROUP BY g) SELECT g AS IncomingTrackId, CASE WHEN n <> 1 THEN 'got several DeviceTokens ' || n WHEN m <> 1 THEN 'got number of ' || m || ' RichTrackIds, expected 1' ELSE '' END AS error FROM y")
def flt_validate(spark, d):
    g = F.floor(F.col("TrackId") / 20)
    h = q._header(spark, d).select(g.alias("IncomingTrackId"), F.when(g % 2 == 0, F.lit("1")).otherwise(F.col("DeviceToken").cast("string")).alias("DeviceToken"), F.when(g % 3 == 0, F.lit(1)).otherwise(F.col("TrackId")).alias("Id"))
    return validate(h)


@q.query("sen_spectrum_slice", """
, b AS (SELECT TrackId, row_number() OVER (PARTITION BY TrackId ORDER BY PointDate, RowId) AS t, sqrt(power(Speed, 2) + power(SpeedLimit, 2)) / CAST(9.81523 AS DOUBLE) AS y0 FROM tp),
s AS (SELECT TrackId, t, y0 - avg(y0) OVER (PARTITION BY TrackId) AS y FROM b),
c AS (SELECT TrackId, y, t - min(t) OVER (PARTITION BY TrackId) AS j, count(*) OVER (PARTITION BY TrackId) AS n FROM s WHERE t >= 3 AND t < 13),
k AS (SELECT TrackId, n, unnest(range(0, (n - 1) // 2 + 1)) AS k FROM (SELECT DISTINCT TrackId, n FROM c WHERE n > 1))
SELECT c.TrackId, round(k.k / CAST(k.n AS DOUBLE), 6) AS freq, round(sqrt(power(sum(y * cos(2 * pi() * k.k * j / k.n)), 2) + power(sum(y * sin(2 * pi() * k.k * j / k.n)), 2)) / k.n, 6) AS amp FROM c JOIN k ON k.TrackId = c.TrackId GROUP BY c.TrackId, k.k, k.n""")
def sen_spectrum_slice(spark, d):
    """The slice 3 <= t < 13 of each trip, with its first moment as 0."""
    s = q._points(spark, d).select("TrackId", F.row_number().over(in_order()).cast("double").alias("t"), F.col("Speed").alias("X"), F.col("SpeedLimit").alias("Y"), F.lit(0.0).alias("Z"))
    return q.rounded(sensors.spectrum(s, lo=3.0, hi=13.0))


def _separable(spark, d) -> DataFrame:
    """A label that one of the columns tells."""
    e = q._t(spark, d, "events")
    label = (F.col("event_type") == "error").cast("int")
    return e.select("event_id", label.alias("label"), (label * 10.0).alias("x"), "value")


_SEPARABLE = "SELECT event_id, CAST(event_type = 'error' AS BIGINT) AS predicted FROM events"


@q.query("ml_booster", _SEPARABLE)
def ml_booster(spark, d):
    """Boosted trees fitted on a part, stored, loaded and scored on all rows; the classes are separable."""
    df = _separable(spark, d)
    train, _ = learning.stratified_split(df, "label", "event_id", 0.7)
    folder = scratch_folder(spark, "model")
    learning.save_model(learning.booster(train, drop=("event_id",), rounds=2, depth=2), folder)
    return q.rounded(learning.score(df, learning.load_model(folder)).select("event_id", (F.col("proba") >= 0.5).cast("int").alias("predicted")))


@q.query("ml_forest", _SEPARABLE)
def ml_forest(spark, d):
    """A forest on the columns that a first forest finds important."""
    df = _separable(spark, d)
    best = learning.select_important(df, learning.forest(df, drop=("event_id",), trees=3), keep=("label", "event_id"))
    return q.rounded(learning.score(best, learning.forest(best, drop=("event_id",), trees=3)).select("event_id", (F.col("proba") >= 0.5).cast("int").alias("predicted")))


@q.query("str_score", ", x AS (SELECT 1) SELECT TrackId, count(*) AS n, round(max(Speed), 6) AS speed_max, max(Speed) > 60 AS fast FROM tp GROUP BY TrackId UNION ALL SELECT TrackId, NULL, NULL, true FROM tp GROUP BY TrackId HAVING max(Speed) > 60")
def str_score(spark, d):
    """A folder of trips scored as a stream, batch by batch, with a second sink for the fast ones; both read again."""
    base = scratch_folder(spark, "stream")
    p = q._points(spark, d).select("TrackId", "Speed")
    p.repartition(3, "TrackId").write.parquet(f"{base}/in")
    points = online.watch(spark, f"{base}/in", "TrackId bigint, Speed double", 1)

    def plan(batch: DataFrame) -> DataFrame:
        return batch.groupBy("TrackId").agg(F.count("*").alias("n"), F.max("Speed").alias("speed_max")).withColumn("fast", F.col("speed_max") > 60)

    online.score_stream(points, plan, f"{base}/out", f"{base}/state", {f"{base}/fast": lambda r: r.where("fast").select("TrackId", "fast")}).awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("batch")
    return q.rounded(out.unionByName(spark.read.parquet(f"{base}/fast").drop("batch"), allowMissingColumns=True))


_PARTS = {"tracks": "TrackId bigint, Distance double", "rich": "TrackId bigint, SpeedLimit double", "incoming": "TrackId bigint, Speed double"}


@q.query("str_uploads", """, x AS (SELECT 1)
SELECT TrackId, round(Distance, 6) AS Distance, rich, incoming, fast, '' AS error
FROM (SELECT TrackId, max(TotalMeters) AS Distance, count(SpeedLimit) AS rich, count(*) AS incoming, max(Speed) > 60 AS fast FROM tp WHERE DeviceToken % 5 <> 4 GROUP BY TrackId)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'missing: rich'""")
def str_uploads(spark, d):
    """Uploads of three files each, put together over several batches of a stream of files; one lacks a part and expires."""
    base = scratch_folder(spark, "uploads")
    p = q._points(spark, d).withColumn("upload", F.col("DeviceToken") % 5)
    heads = p.groupBy("upload", "TrackId").agg(F.max("TotalMeters").alias("Distance"))
    for kind, df in (("tracks", heads), ("rich", p.where("upload <> 4").select("upload", "TrackId", "SpeedLimit")), ("incoming", p.select("upload", "TrackId", "Speed"))):
        df.withColumn("kind", F.lit(kind)).repartition("upload").write.mode("append").partitionBy("upload", "kind").option("header", True).csv(f"{base}/in")
    _age(spark, f"{base}/in")
    files = uploads.parts(spark, f"{base}/in", r"upload=([^/]+)/kind=([a-z]+)/", 6)

    def plan(tracks, rich, incoming):
        n, m = rich.groupBy("TrackId").agg(F.count("SpeedLimit").alias("rich")), incoming.groupBy("TrackId").agg(F.count("*").alias("incoming"), (F.max("Speed") > 60).alias("fast"))
        return tracks.join(n, "TrackId").join(m, "TrackId").withColumn("error", F.lit(""))

    uploads.score_uploads(uploads.assembled(files, tuple(_PARTS), "10 minutes"), plan, f"{base}/out", f"{base}/bad", f"{base}/state", _PARTS).awaitTermination()
    bad = spark.read.parquet(f"{base}/bad").select("error")
    return q.rounded(spark.read.parquet(f"{base}/out").drop("batch").unionByName(bad, allowMissingColumns=True))


def _age(spark, folder: str) -> None:
    """Gives the few files of uploads times an hour apart from upload to upload, the last upload being the oldest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").collect():
        hours = 10 - int(r["path"].split("upload=")[1].split("/")[0])
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(r["path"]), (1_700_000_000 + hours * 3600) * 1000, -1)


@q.query("str_last_trip", ", x AS (SELECT 1) SELECT DeviceToken, arg_max(TrackId, (EndDate, TrackId)) AS TrackId FROM hd GROUP BY DeviceToken")
def str_last_trip(spark, d):
    """Each device's latest trip, from a stream of headers in several batches with state per device."""
    base = scratch_folder(spark, "last")
    h = q._header(spark, d).select("DeviceToken", "TrackId", "EndDate")
    h.repartition(3, "TrackId").write.parquet(f"{base}/in")
    last = online.last_trip_per_device(online.watch(spark, f"{base}/in", "DeviceToken bigint, TrackId bigint, EndDate timestamp_ntz", 1))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    last.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("DeviceToken").agg(F.max_by("TrackId", "batch").alias("TrackId"))


def _predict_sql() -> str:
    bicycle = q.ORACLE_SQL["rul_bicycle"].replace("DeviceToken AS TrackId, RowId", "TrackId, RowId").replace("PARTITION BY DeviceToken, Latitude", "PARTITION BY TrackId, Latitude")
    return f"""WITH f AS ({q.ORACLE_SQL['ftr_all']}), t AS ({q.ORACLE_SQL['rul_airport_taxi']}), b AS ({bicycle}), h AS ({q.ORACLE_SQL['src_track_header']}),
x AS (SELECT h.TrackId, h.DeviceToken, f.IncomingTrackId IS NOT NULL AS has, CASE WHEN bicycle THEN 'Bicycle' WHEN taxi = 1 THEN 'Taxi' WHEN taxi = -1 THEN 'Other' END AS r,
  CASE WHEN speed_max < 25 THEN 'Other' WHEN rail_frequency >= 0.8 AND DistanceGPS * 4 > 2 THEN 'Train' WHEN trips_odd = 1 AND DistanceGPS * 4 > 2 THEN 'Bus' ELSE 'OriginalDriver' END AS common
  FROM h LEFT JOIN f ON f.IncomingTrackId = h.TrackId LEFT JOIN t USING (TrackId) LEFT JOIN b USING (TrackId)),
z AS (SELECT *, CASE WHEN r IS NULL THEN CASE WHEN has THEN common ELSE 'OriginalDriver' END WHEN has THEN r END AS label FROM x)
SELECT TrackId AS IncomingTrackId, TrackId AS RichTrackId, label AS debug_pred, CASE WHEN DeviceToken % 3 = 0 OR (DeviceToken IN (6, 1064) AND label IS DISTINCT FROM 'Bicycle') THEN label ELSE 'OriginalDriver' END AS prediction, CASE WHEN r IS NOT NULL AND NOT has THEN 'track is empty' ELSE '' END AS error FROM z"""


@q.query("predict", _predict_sql())
def predict(spark, d):
    """Labels of all trips by the whole plan: model, airports, stops, ways, sides, gyroscope and allow-list.

    The model knows one feature, so that SQL can say what it finds: a trip is a bus on days of an odd
    number of trips. Trips count four times as long, so that some are far enough for a bus or a train.
    """
    points = q._points(spark, d)
    odd = (F.col("id") % 2).cast("int")
    model = learning.booster(spark.range(100).select(odd.alias("trips_odd"), odd.alias("label")), rounds=3, depth=2)
    tracks = q._tracks(spark, d).withColumn("CompanyId", F.col("DeviceToken").cast("int")).withColumn("DeviceToken", F.col("DeviceToken").cast("string"))
    tracks = tracks.withColumn("DistanceGPS", F.col("DistanceGPS") * 4)
    allowed = tracks.where("DeviceToken % 3 = 0").select("DeviceToken").distinct()
    maps = Maps(q._airports(spark, d), q._stops(spark, d), q._ways(spark, d), _sides(spark, d, points), allowed)
    moved = points.withColumns({c: F.col("SpeedLimit") / 50 for c in sensors.GYRO}).withColumn("IncomingTrackId", F.col("TrackId"))
    return predict_plan(moved, q._rich(spark, d).withColumn("RichTrackId", F.col("TrackId")), tracks, model, maps)


# ---- learning without SQL: tested against plain versions ----------------------------------------

_ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "days"]


def _items(spark, d) -> DataFrame:
    """Order lines, whether they were returned, and when they were shipped."""
    return q._t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_ITEM[:4], F.datediff("l_shipdate", F.lit("1992-01-01")).alias("days"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


@q.query("ml_information_coefficient")
def ml_information_coefficient(spark, d):
    """The maximal information coefficient of the return of an order line with each of its columns."""
    return q.rounded(learning.information_coefficients(_items(spark, d), "label", _ITEM))


@q.query("ml_boosting")
def ml_boosting(spark, d):
    """Order lines scored by second-order boosted trees with the tuned set of hyper-parameters, a few rounds of them."""
    items = _items(spark, d)
    model = boosting.fit(items, "label", _ITEM, **{**boosting.BUS_TUNED, "rounds": 4})
    return q.rounded(model.score(items).select("l_orderkey", "l_linenumber", "proba"))


@q.query("ml_staged_cv")
def ml_staged_cv(spark, d):
    """(round, fold, auc, best): held-out AUC of each round of five boosters that are trained together."""
    items = _items(spark, d).withColumn("fold", F.pmod(F.hash("l_orderkey"), F.lit(5)))
    aucs, best = boosting.cross_validated(items, "label", _ITEM, "fold", 5, **{**boosting.BUS_TUNED, "rounds": 3})
    return q.rounded(spark.createDataFrame([(r + 1, f, a, r + 1 == best) for r, row in enumerate(aucs) for f, a in enumerate(row)], "round int, fold int, auc double, best boolean"))
