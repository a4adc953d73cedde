"""Clusters, simplification, corridors, stops and map coverage of trips.

Points are dealt by TrackId and each trip goes through a kernel; joins between trips and the map
meet on grid cells, so no trip is paired with the whole map.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import kernels
from roadloom.functions.geo import DEGREES_PER_METRE, EARTH_M, along, cell, haversine_m, in_corridor, in_ring, mercator_x, mercator_y, near_part, planar, segment_cells
from roadloom.functions.stats import kurtosis, ratio, skewness
from roadloom.operators import beside, density
from roadloom.operators.grouped import map_groups, spans
from roadloom.operators.prep import date_gate, deduplicate, keep_large_groups
from roadloom.schema import BUS_TYPES, RAIL_TYPES
from roadloom.session import materialised

CLUSTER_EPS, CLUSTER_MIN = 100.0, 3


def cluster(points: DataFrame, eps: float = CLUSTER_EPS, at_least: int = CLUSTER_MIN) -> DataFrame:
    """Adds labels: density clusters of each trip in the web projection, -1 for noise."""
    return density.labelled(points, "TrackId", ["PointDate", "RowId"], {"x": mercator_x("Longitude"), "y": mercator_y("Latitude")}, eps, at_least)


def without_outliers(points: DataFrame) -> DataFrame:
    """De-duplicated points in clusters of more than four points."""
    return keep_large_groups(cluster(deduplicate(points)).where("labels <> -1"), "labels")


def clean(points: DataFrame) -> DataFrame:
    return without_outliers(date_gate(points))


def simplify(points: DataFrame, metres: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, seq, Longitude, Latitude): the vertices of each trip's simplified line. Many trips go through the kernel at once."""
    keys = keys or ["TrackId"]
    eps = metres * DEGREES_PER_METRE
    kinds = dict(points.dtypes)
    schema = f"{', '.join(f'`{k}` {kinds[k]}' for k in keys)}, seq int, Longitude double, Latitude double"

    def run(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        x, y = (rows.column(len(keys) + k).to_numpy(zero_copy_only=False) for k in (0, 1))
        at = kernels.simplify_many(np.column_stack([x, y]), starts, eps)
        line = np.searchsorted(starts, at, "right") - 1
        seq = np.arange(len(at)) - np.searchsorted(line, np.arange(len(starts)))[line]
        mine = [rows.column(k).take(pa.array(at)) for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([*mine, pa.array(seq.astype(np.int32)), pa.array(x[at]), pa.array(y[at])], names=[*keys, "seq", "Longitude", "Latitude"])

    return map_groups(points, keys, ["PointDate", "RowId"], ["Longitude", "Latitude"], schema, run)


def segments(vertices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, seq, ax, ay, bx, by): consecutive vertices; repeated places make no segment."""
    keys = keys or ["TrackId"]
    w = Window.partitionBy(*keys).orderBy("seq")
    lead = lambda c: F.lead(c).over(w)
    out = vertices.select(*keys, "seq", F.col("Longitude").alias("ax"), F.col("Latitude").alias("ay"), lead("Longitude").alias("bx"), lead("Latitude").alias("by"))
    return out.where("bx is not null and (ax <> bx or ay <> by)")


def corridor_ring(ax, ay, bx, by, width: float, left: bool = True, right: bool = True) -> Column:
    """The rectangle along a segment as a ring of four corners."""
    n = planar(ax, ay, bx, by)
    nx, ny = F.try_divide(ay - by, n) * width, F.try_divide(bx - ax, n) * width
    up, down = (1.0 if left else 0.0), (1.0 if right else 0.0)
    corners = [(ax + nx * up, ay + ny * up), (bx + nx * up, by + ny * up), (bx - nx * down, by - ny * down), (ax - nx * down, ay - ny * down)]
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners))


def corridors(points: DataFrame, simplify_m: float = 50.0, width_m: float = 30.0, keys: list[str] | None = None) -> DataFrame:
    """(keys, ring list): each trip's two-sided corridor as rectangles; membership is any of them."""
    keys = keys or ["TrackId"]
    seg = segments(simplify(points, simplify_m, keys), keys)
    ring = corridor_ring(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), width_m * DEGREES_PER_METRE)
    return seg.select(*keys, F.struct("seq", ring.alias("ring")).alias("part")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["ring"]).alias("rings"))


def country_of(points: DataFrame, countries: DataFrame, lat: str, lon: str, keys: list[str]) -> DataFrame:
    """Rows of points (by keys) with iso2 of each country (iso2, rings) they are in.

    A place is in a country if it is in an odd number of the rings of one of its rows, so holes count.
    The border is in no country, and a hole's edge isn't in the hole.
    Places meet the rings on cells of one degree in both axes, and then by the rings' boxes.
    """
    ring = countries.withColumn("__row", F.monotonically_increasing_id()).select("__row", "iso2", F.posexplode("rings").alias("__ring", "ring"))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = ring.withColumn("x0", F.array_min(xs)).withColumn("x1", F.array_max(xs)).withColumn("y0", F.array_min(ys)).withColumn("y1", F.array_max(ys))
    for c in "xy":
        box = box.withColumn(f"__c{c}", F.explode(F.sequence(F.floor(f"{c}0"), F.floor(f"{c}1"))))
    p = points.select(*keys, F.col(lon).alias("__px"), F.col(lat).alias("__py")).withColumn("__cx", F.floor("__px")).withColumn("__cy", F.floor("__py"))
    inside = F.col("__px").between(F.col("x0"), F.col("x1")) & F.col("__py").between(F.col("y0"), F.col("y1")) & in_ring(F.col("__px"), F.col("__py"), F.col("ring"))
    met = p.join(box, ["__cx", "__cy"]).where(inside)
    # a repeated point meets each ring as often as it is there, so points are kept apart by place
    odd = met.select(*keys, "__px", "__py", "__row", "iso2", "__ring").distinct().groupBy(*keys, "__px", "__py", "__row", "iso2").count()
    return odd.where("count % 2 = 1").select(*keys, "iso2").distinct()


def left_hand(points: DataFrame, countries: DataFrame, left_traffic: DataFrame) -> DataFrame:
    """(TrackId, left): whether the trip's median place is in a country that drives on the left."""
    mid = points.groupBy("TrackId").agg(F.median("Latitude").alias("lat"), F.median("Longitude").alias("lon"))
    found = country_of(mid, countries, "lat", "lon", ["TrackId"]).join(left_traffic.select(F.col("ISO2").alias("iso2")), "iso2", "left_semi")
    return mid.select("TrackId").join(found.select("TrackId", F.lit(True).alias("left")).distinct(), "TrackId", "left").fillna(False, ["left"])


def _distinct(stops: DataFrame) -> DataFrame:
    return stops.select("name", "lon", "lat").where("lon is not null and lat is not null").distinct()


def bus_stops(points: DataFrame, stops: DataFrame, sides: DataFrame, simplify_m: float = 10.0, width_m: float = 50.0) -> DataFrame:
    """(TrackId, name, lon, lat): stops on the driving side, in the corridor of the simplified trip."""
    sent = beside.few(_distinct(stops))
    if sent is not None:
        return beside.stops_of(points, sent, sides, simplify_m, width_m)
    return stops_along(segments(simplify(points, simplify_m)).join(sides, "TrackId"), stops, width_m)


def right_stops(points: DataFrame, stops: DataFrame, width_m: float = 50.0, nearest: bool = False) -> DataFrame:
    """(TrackId, name, lon, lat): stops to the right of each trip; nearest: with idx, see ``project_stops``."""
    sent = beside.few(_distinct(stops))
    if sent is not None:
        return beside.stops_of(points, sent, None, None, width_m, nearest)
    n = F.row_number().over(Window.partitionBy("TrackId").orderBy("PointDate", "RowId"))
    found = stops_along(segments(points.select("TrackId", n.alias("seq"), "Longitude", "Latitude")).withColumn("left", F.lit(False)), stops, width_m)
    return project_stops(points, found) if nearest else found


def right_stop_speeds(points: DataFrame, stops: DataFrame, width_m: float = 50.0) -> DataFrame:
    """``stop_speeds`` of the stops to the right of each trip."""
    sent = beside.few(_distinct(stops))
    if sent is not None:
        return beside.stop_features(points, sent, None, None, width_m)
    return stop_speeds(points, right_stops(points, stops, width_m, nearest=True))


def bus_stop_features(track: DataFrame, stops: DataFrame, sides: DataFrame, simplify_m: float = 10.0, width_m: float = 50.0) -> DataFrame:
    """``stop_speeds`` and ``last_stop`` of the bus stops of each trip. track: with is_walk."""
    sent = beside.few(_distinct(stops))
    if sent is not None:
        return beside.stop_features(track, sent, sides, simplify_m, width_m)
    found = materialised(bus_stops(track, stops, sides, simplify_m, width_m))  # two branches each read the stops and the line
    first = F.struct("PointDate", "RowId")
    walk = track.where("is_walk").groupBy("TrackId").agg(F.min_by("Latitude", first).alias("lat"), F.min_by("Longitude", first).alias("lon"))
    return last_stop(walk, found).join(stop_speeds(track, project_stops(track, found)), "TrackId")


def stops_along(seg: DataFrame, stops: DataFrame, width_m: float = 50.0) -> DataFrame:
    """Stops in the one-sided rectangles of segments (TrackId, ax, ay, bx, by, left).

    Segments meet the stops on the grid cells that they cross, so a long one meets all its cells; a
    stop that several segments hold counts once.
    """
    width = width_m * DEGREES_PER_METRE
    size = 4 * width
    seg = segment_cells(seg, "ax", "ay", "bx", "by", width, size)
    at = stops.select("name", "lon", "lat", cell(F.col("lon"), size).alias("cx"), cell(F.col("lat"), size).alias("cy"))
    inside = in_corridor(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), width, F.col("left"), ~F.col("left"))
    return seg.join(at, ["cx", "cy"]).where(inside).select("TrackId", "name", "lon", "lat").distinct()


def project_stops(points: DataFrame, stops: DataFrame) -> DataFrame:
    """Adds idx: position of the trip's nearest point to each stop, the first at a tie. stops: with TrackId."""
    n = F.row_number().over(Window.partitionBy("TrackId").orderBy("PointDate", "RowId")) - 1
    p = points.select("TrackId", n.alias("i"), "Longitude", "Latitude")
    d = planar(F.col("Longitude"), F.col("Latitude"), F.col("lon"), F.col("lat"))
    return stops.join(p, "TrackId").groupBy(*stops.columns).agg(F.min_by("i", F.struct(d, F.col("i"))).alias("idx"))


def stop_speeds(points: DataFrame, projected: DataFrame, before: int = 7, after: int = 3) -> DataFrame:
    """Statistics of the least speed around each stop; -999 for trips without stops."""
    n = F.row_number().over(Window.partitionBy("TrackId").orderBy("PointDate", "RowId")) - 1
    p = points.select("TrackId", n.alias("i"), "Speed")
    near = projected.select("TrackId", "name", "lon", "lat", F.explode(F.sequence(F.greatest(F.lit(0), F.col("idx") - before), F.col("idx") + after)).alias("i"))
    v = near.join(p, ["TrackId", "i"]).groupBy("TrackId", "name", "lon", "lat").agg(F.min("Speed").alias("v"))
    x = F.col("v")
    stats = v.groupBy("TrackId").agg(
        F.mean(x).alias("bus_stop_speed_mean"), F.median(x).alias("bus_stop_speed_median"), F.stddev_pop(x).alias("bus_stop_speed_std"),
        kurtosis(x).alias("bus_stop_speed_kurtosis"), skewness(x).alias("bus_stop_speed_skew"), F.count("*").alias("bus_stop_num"),
    )
    trips = points.select("TrackId").distinct()
    return trips.join(stats, "TrackId", "left").fillna(0, ["bus_stop_num"]).fillna(-999.0, [c for c in stats.columns if c.startswith("bus_stop_speed")])


def last_stop(walk_start: DataFrame, stops: DataFrame, metres: float = 50.0) -> DataFrame:
    """(TrackId, ped_last_stop): stops within 50 m of where walking began; -1 where it isn't known.

    walk_start: (TrackId, lat, lon), null for trips without a walking part.
    """
    s = stops.select("TrackId", F.col("lat").alias("__la"), F.col("lon").alias("__lo"))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("__la"), F.col("__lo"))
    both = walk_start.join(s, "TrackId", "left").groupBy("TrackId").agg(F.count(F.when(d < metres, 1)).alias("k"), F.max(F.col("lat").isNotNull().cast("int")).alias("known"))
    return both.select("TrackId", F.when(F.col("known") == 1, F.col("k")).otherwise(-1).alias("ped_last_stop"))


# ---- map coverage --------------------------------------------------------------------------------


def flat_segments(vertices: DataFrame) -> DataFrame:
    """(TrackId, labels, seq, ax, ay, bx, by, lat0, before, size): segments in degrees, and their place on the line.

    before and size are metres on a plane that touches the line's mean latitude lat0.
    """
    keys = ["TrackId", "labels"]
    w = Window.partitionBy(*keys)
    v = vertices.select(*keys, "seq", F.col("Longitude").alias("ax"), F.col("Latitude").alias("ay"), F.mean("Latitude").over(w).alias("lat0"))
    order = w.orderBy("seq")
    v = v.withColumn("bx", F.lead("ax").over(order)).withColumn("by", F.lead("ay").over(order))
    step = planar(*(f(F.col(c)) for x in "ab" for f, c in ((_flat_x, f"{x}x"), (_flat_y, f"{x}y"))))
    v = v.withColumn("size", F.coalesce(step, F.lit(0.0)))
    v = v.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return v.where("bx is not null and size > 0")


def _flat_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH_M * F.cos(F.radians("lat0"))


def _flat_y(lat: Column) -> Column:
    return F.radians(lat) * EARTH_M


def ways_near(seg: DataFrame, ways: DataFrame, metres: float = 50.0) -> DataFrame:
    """seg with way_type and the ends px, py, qx, qy of each segment of a map line in a grid cell along it."""
    size = 0.01
    pad = metres * DEGREES_PER_METRE * 1.01
    lines = ways.where(F.col("way_type").isin(RAIL_TYPES + BUS_TYPES)).select("way_type", "line", F.posexplode("line").alias("k", "p"))
    lines = lines.withColumn("q", F.get("line", F.col("k") + 1)).where("q is not null")
    lines = lines.select("way_type", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("q.x").alias("qx"), F.col("q.y").alias("qy")).withColumn("__id", F.monotonically_increasing_id())
    wide = F.greatest(F.cos(F.radians(F.greatest(F.abs("ay"), F.abs("by")) + size)), F.lit(0.05))  # degrees of longitude are shorter
    grown = segment_cells(seg, "ax", "ay", "bx", "by", F.lit(pad) / wide, size, pad)
    found = grown.join(segment_cells(lines, "px", "py", "qx", "qy", 0.0, size), ["cx", "cy"])
    return found.dropDuplicates(["TrackId", "labels", "seq", "__id"]).drop("cx", "cy", "__id")


def coverage(vertices: DataFrame, ways: DataFrame, metres: float = 50.0) -> DataFrame:
    """(TrackId, name, length): km of each trip along each way type, and its own length as 'track'.

    Where a map segment is within 50 m of a trip segment, that part is put on the trip segment, and the
    intervals of one type along the trip are merged, so nothing counts twice. Distances are taken on a
    plane. All is column arithmetic: segments meet on grid cells and the near part has a closed form.
    """
    keys = ["TrackId", "labels"]
    near = ways_near(flat_segments(vertices), ways, metres)
    flat = {c: (_flat_x if c[1] == "x" else _flat_y)(F.col(c)) for c in ("px", "py", "qx", "qy", "ax", "ay", "bx", "by")}
    near = near_part(near.select(*keys, "way_type", "before", "size", *(x.alias(c) for c, x in flat.items())), metres)
    # the feet of both ends of the part on the trip segment, from foot = f0 + t * f1
    place = {t: F.col("before") + F.col("size") * F.least(F.greatest(F.col("f0") + F.col(t) * F.col("f1"), F.lit(0.0)), F.lit(1.0)) for t in ("lo", "hi")}
    pieces = near.select(*keys, "way_type", place["lo"].alias("one"), place["hi"].alias("two")).select(*keys, "way_type", F.least("one", "two").alias("m0"), F.greatest("one", "two").alias("m1"))
    w = Window.partitionBy(*keys, "way_type").orderBy("m0", "m1")
    reach = F.max("m1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0.0), F.col("m1") - F.greatest(F.col("m0"), F.coalesce(reach, F.col("m0"))))
    by_type = pieces.withColumn("km", fresh / 1000).groupBy("TrackId", F.col("way_type").alias("name")).agg(F.sum("km").alias("length"))
    d = haversine_m(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx")) / 1000
    own = segments(vertices, keys).groupBy("TrackId").agg(F.sum(d).alias("length")).select("TrackId", F.lit("track").alias("name"), "length")
    return own.unionByName(by_type)


def way_features(lengths: DataFrame) -> DataFrame:
    """Largest share of a rail and of a bus type, and the kilometres not covered by it."""
    track = F.max(F.when(F.col("name") == "track", F.col("length")))
    most = lambda kinds: F.coalesce(F.max(F.when(F.col("name").isin(kinds), F.col("length"))), F.lit(0.0))
    out = lengths.groupBy("TrackId").agg(track.alias("km"), most(RAIL_TYPES).alias("rail"), most(BUS_TYPES).alias("bus"))
    rail, bus = ratio(F.col("rail"), F.col("km")), ratio(F.col("bus"), F.col("km"))
    return out.select("TrackId", rail.alias("rail_frequency"), bus.alias("bus_frac"), ((1 - bus) * F.col("km")).alias("bus_uncovered_len"), ((1 - rail) * F.col("km")).alias("rail_uncovered_len"))


def speed_profile(track: DataFrame, others: DataFrame, metres: float = 35.0) -> DataFrame:
    """(TrackId, src, RowId, dist, Speed): speeds of a trip and of others near it on its distance axis.

    track: clustered points; the clusters of a trip follow each other on the axis. Other trips'
    points are those in the trip's box and within 35 m of its line in the web projection.
    """
    own = _on_axis(track)
    mine = own.where("k > 1").select("TrackId", F.lit("own").alias("src"), "RowId", F.col("before").alias("dist"), "Speed")
    o = others.select("RowId", "Latitude", "Longitude", "Speed")
    sent = beside.few(_flat_places(o.select("Latitude", "Longitude").distinct()))
    if sent is not None:
        theirs = beside.places_near(own, sent, metres).join(o, ["Latitude", "Longitude"])
    else:
        theirs = _profile_joined(own, others, metres)
    return mine.unionByName(theirs.select("TrackId", F.lit("other").alias("src"), "RowId", "dist", "Speed"))


def _on_axis(track: DataFrame) -> DataFrame:
    """Points on their trip's axis: ax, ay, the step's size, the distance before, and k, the points of their cluster."""
    keys = ["TrackId", "labels"]
    trip, part = Window.partitionBy("TrackId"), Window.partitionBy(*keys)
    order = part.orderBy("PointDate", "RowId")
    own = track.select(*keys, "PointDate", "RowId", "Speed", "Latitude", "Longitude", mercator_x("Longitude").alias("ax"), mercator_y("Latitude").alias("ay"), F.count("*").over(part).alias("k"))
    own = own.withColumn("bx", F.lead("ax").over(order)).withColumn("by", F.lead("ay").over(order))
    own = own.withColumn("size", F.coalesce(planar(*map(F.col, ("ax", "ay", "bx", "by"))), F.lit(0.0)))
    # the clusters follow each other: what lies before a point are the earlier clusters and its own one's steps
    before = F.coalesce(F.sum("size").over(trip.orderBy("labels", "PointDate", "RowId").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return own.withColumn("before", before)


def _flat_places(places: DataFrame) -> DataFrame:
    return places.where("Latitude is not null and Longitude is not null").withColumns({"x": mercator_x("Longitude"), "y": mercator_y("Latitude")})


def _profile_joined(own: DataFrame, others: DataFrame, metres: float) -> DataFrame:
    """(TrackId, labels, RowId, dist, Speed) of others' points, by joins of grid cells."""
    order = Window.partitionBy("TrackId", "labels").orderBy("PointDate", "RowId")
    trip = Window.partitionBy("TrackId")
    own = own.withColumns({f"{n}_{c}": f(c).over(trip) for n, f in (("lo", F.min), ("hi", F.max)) for c in ("Latitude", "Longitude")}).withColumn("seq", F.row_number().over(order))
    size = 4 * metres
    seg = segment_cells(own.where("bx is not null").drop("RowId", "Speed", "PointDate", "Latitude", "Longitude", "k"), "ax", "ay", "bx", "by", metres, size)
    o = others.select("RowId", "Latitude", "Longitude", "Speed", mercator_x("Longitude").alias("x"), mercator_y("Latitude").alias("y"))
    o = o.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    inside = F.col("Latitude").between(F.col("lo_Latitude"), F.col("hi_Latitude")) & F.col("Longitude").between(F.col("lo_Longitude"), F.col("hi_Longitude"))
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    u = F.least(F.greatest(F.coalesce(along(F.col("x"), F.col("y"), *ends), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    met = o.join(seg, ["cx", "cy"]).where(inside).withColumn("u", u)
    gap = planar(F.col("x"), F.col("y"), F.col("ax") + F.col("u") * (F.col("bx") - F.col("ax")), F.col("ay") + F.col("u") * (F.col("by") - F.col("ay")))
    met = met.withColumn("gap", gap).where(F.col("gap") <= metres)
    return met.groupBy("TrackId", "labels", "RowId").agg(F.min_by(F.col("before") + F.col("u") * F.col("size"), F.struct("gap", "seq")).alias("dist"), F.first("Speed").alias("Speed"))


def speed_curves(track: DataFrame, others: DataFrame, metres: float = 35.0, degree: int = 10, step_m: float = 25.0) -> DataFrame:
    """``speed_curve`` of the profiles of ``speed_profile``, without a row for each point of others."""
    speed = F.coalesce("Speed", F.lit(float("nan")))  # a missing speed leaves no curve
    sent = beside.few(_flat_places(others.groupBy("Latitude", "Longitude").agg(F.count("*").alias("n"), F.mean(speed).alias("v"))))
    if sent is None:
        return speed_curve(speed_profile(track, others, metres), degree, step_m)
    return beside.curves(_on_axis(track), sent, metres, degree, step_m)


def speed_curve(profile: DataFrame, degree: int = 10, step_m: float = 25.0) -> DataFrame:
    """(TrackId, dist, Speed): a polynomial through a profile, sampled about every 25 m."""

    def run(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        x, y = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        sizes, found = [], [(np.zeros(0), np.zeros(0))]
        for a, b in spans(starts, rows.num_rows):
            found.append(kernels.curve(x[a:b], y[a:b], np.ones(b - a), degree, step_m))
            sizes.append(len(found[-1][0]))
        dist, speed = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(np.repeat(starts, sizes))), pa.array(dist), pa.array(speed)], names=["TrackId", "dist", "Speed"])

    return map_groups(profile, ["TrackId"], ["dist", "Speed"], ["dist", "Speed"], f"TrackId {dict(profile.dtypes)['TrackId']}, dist double, Speed double", run)
