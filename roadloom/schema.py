"""Input tables of the engine as Spark schemas, and the small enumerations that rules use."""

from __future__ import annotations

TRACKS = """
DeviceToken string, Id int, TrackToken string, IncomingTrackId int, StartDate timestamp_ntz, EndDate timestamp_ntz,
Distance double, Duration double, AccelerationCount int, DecelerationCount int, Rating int, CompanyId int,
PhoneUsage boolean, TrackOrigin string, OriginChanged boolean, AddressStart string, AddressFinish string,
DistanceGPS double, Urban boolean, Region string, Country string, OverSpeedMileage double, MidOverSpeedMileage double, HighOverSpeedMileage double
"""
INCOMING_POINTS = """
DeviceToken string, IncomingTrackId int, RichTrackId int, TotalMeters double, Speed double, Midspeed double,
Latitude double, Longitude double, Height double, Course double, Yaw double, Lateral double, Acceleration double,
Deceleration double, PointDate timestamp_ntz, TickTimestamp timestamp_ntz, EstablishedIndexA boolean, EstablishedIndexB boolean,
Number bigint, AccelerationXOriginal double, AccelerationYOriginal double, AccelerationZOriginal double,
GyroscopeXOriginal double, GyroscopeYOriginal double, GyroscopeZOriginal double
"""
RICH_POINTS = """
DeviceToken string, RichTrackId int, LinkIdMatched int, RoadType int, Interval int, Turn int, StartNo int, LaneCount int,
SpeedLimitSource int, MidrouteGPS int, TotalMeters double, Speed double, Midspeed double, Latitude double, Longitude double,
Height double, Course double, Yaw double, Lateral double, AlertValue double, SpeedLimit double, Acceleration double,
Deceleration double, TypicalSpeed double, Midroute double, TotalMetersGPS double, PointDate timestamp_ntz, TickTimestamp timestamp_ntz,
AlertType string, SpeedType string, PhoneUsage boolean, EstablishedIndexA boolean, EstablishedIndexB boolean, Urban boolean, FromSource boolean
"""
#: Columns of a trip header that are features as they are.
HEADER_FEATURES = [
    "Distance", "Duration", "AccelerationCount", "DecelerationCount", "Rating", "PhoneUsage",
    "DistanceGPS", "Urban", "OverSpeedMileage", "MidOverSpeedMileage", "HighOverSpeedMileage",
]

NOT_AIRPORT, NEAR_AIRPORT, AIRPORT = 0, 1, 2
SMALL_GAP, VERY_BIG_GAP, BIG_GAP = 0, 1, 2
RAIL_TYPES = ["rail", "subway", "tram", "monorail", "light_rail", "narrow_gauge"]
BUS_TYPES = ["bus", "trolleybus", "share_taxi"]
