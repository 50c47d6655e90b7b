"""Queries over the map-shaped views, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import polyline as P
from roadloom.operators import joins as J
from roadloom.operators import quality as Q
from roadloom.plans import bridge as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a function under its name; sql may use the views of bridge.SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            head, comma = ("WITH RECURSIVE " if recursive else "WITH "), "" if sql.lstrip().upper().startswith("SELECT") else ","
            ORACLE_SQL[f.__name__] = head + B.SQL.strip() + comma + "\n" + sql.strip()
        return f

    return put


# --- polylines -----------------------------------------------------------------------------------


@query("SELECT way_id, CAST(count(*) + 1 AS BIGINT) AS n_points, round(sum(d), 6) AS length FROM b_seg GROUP BY way_id")
def way_polyline_length(spark, sf):
    return B.lines(spark, sf).select("way_id", F.size("line").cast("long").alias("n_points"), F.round(P.length(F.col("line")), 6).alias("length"))


@query("""SELECT way_id, (1 << CAST(floor(((degrees(atan2(ey - sy, ex - sx)) + 360) % 360 + 22.5) / 45) AS INT) % 8)::INT AS bit FROM b_end""")
def way_direction_bit(spark, sf):
    return B.ends(spark, sf).select("way_id", P.direction_bit(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")).alias("bit"))


@query("SELECT way_id, min(x) - 5 AS x0, min(y) - 5 AS y0, max(x) + 5 AS x1, max(y) + 5 AS y1 FROM b_pt GROUP BY way_id")
def way_bbox(spark, sf):
    return B.points(spark, sf).groupBy("way_id").agg((F.min("x") - 5).alias("x0"), (F.min("y") - 5).alias("y0"), (F.max("x") + 5).alias("x1"), (F.max("y") + 5).alias("y1"))


@query("""SELECT map_id, CAST(count(*) AS BIGINT) AS ways, round(sum(len), 4) AS length, bit_or(bit)::INT AS directions, CAST(sum(adj) AS BIGINT) AS adjacent FROM (
  SELECT w.map_id, w.way_id, l.len, (1 << CAST(floor(((degrees(atan2(ey - sy, ex - sx)) + 360) % 360 + 22.5) / 45) AS INT) % 8)::INT AS bit,
    (CASE WHEN w.way_id % 5 < 4 AND w.way_id < (SELECT max(way_id) FROM b_way) THEN 1 ELSE 0 END) + (CASE WHEN w.way_id % 5 > 0 THEN 1 ELSE 0 END) AS adj
  FROM b_way w JOIN (SELECT way_id, sum(d) AS len FROM b_seg GROUP BY way_id) l USING (way_id) JOIN b_end e USING (way_id)) GROUP BY map_id""")
def map_report(spark, sf):
    """Ways, length, directions and lateral adjacency of each map."""
    lines = B.lines(spark, sf)
    first, last = F.col("line")[0], F.element_at("line", -1)
    measured = lines.select("way_id", P.length(F.col("line")).alias("len"), P.direction_bit(last["x"] - first["x"], last["y"] - first["y"]).alias("bit"))
    adjacent = J.lateral_adjacency(B.lanes(spark, sf)).groupBy(F.col("src").alias("way_id")).agg(F.count("*").alias("adj"))
    rows = B.ways(spark, sf).select("way_id", "map_id").join(measured, "way_id").join(adjacent, "way_id", "left")
    return rows.groupBy("map_id").agg(F.count("*").alias("ways"), F.round(F.sum("len"), 4).alias("length"), F.bit_or("bit").alias("directions"), F.sum(F.coalesce("adj", F.lit(0))).alias("adjacent"))


@query("""k AS (SELECT unnest(range(5)) AS k),
q AS (SELECT DISTINCT way_id, k, total, total * k / 4 AS s FROM b_chain, k),
r AS (SELECT q.way_id, q.k, arg_max(CASE WHEN c.d > 0 THEN x0 + (x1 - x0) * least(greatest((q.s - s0) / d, 0), 1) ELSE x0 END, pos) AS x,
  arg_max(CASE WHEN c.d > 0 THEN y0 + (y1 - y0) * least(greatest((q.s - s0) / d, 0), 1) ELSE y0 END, pos) AS y
  FROM q JOIN b_chain c ON c.way_id = q.way_id AND (q.s > c.s0 OR c.pos = 1) GROUP BY q.way_id, q.k)
SELECT way_id, CAST(k AS INT) AS k, round(x, 4) AS x, round(y, 4) AS y FROM r""")
def resample_polyline(spark, sf):
    """Five points at equal distances along each way."""
    lines = B.lines(spark, sf).withColumn("total", P.length(F.col("line")))
    five = P.resample(F.col("line"), F.col("total"), 5)
    return lines.select("way_id", F.posexplode(five).alias("k", "p")).select("way_id", "k", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("""k AS (SELECT unnest(range(5)) AS k),
q AS (SELECT DISTINCT way_id, k, total * k / 4 AS s FROM b_chain, k),
r AS (SELECT q.way_id, q.k, arg_max(CASE WHEN c.d > 0 THEN x0 + (x1 - x0) * least(greatest((q.s - s0) / d, 0), 1) ELSE x0 END, pos) AS x,
  arg_max(CASE WHEN c.d > 0 THEN y0 + (y1 - y0) * least(greatest((q.s - s0) / d, 0), 1) ELSE y0 END, pos) AS y
  FROM q JOIN b_chain c ON c.way_id = q.way_id AND (q.s > c.s0 OR c.pos = 1) GROUP BY q.way_id, q.k)
SELECT lane_id, round(median(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 4) AS width, round(avg((a.x + b.x) / 2), 4) AS cx, round(avg((a.y + b.y) / 2), 4) AS cy
FROM b_lane l JOIN r a ON a.way_id = l.left_way JOIN r b ON b.way_id = l.right_way AND a.k = b.k GROUP BY lane_id""")
def centerline_width_median(spark, sf):
    """Median width and mean centre of lanes from paired samples of their boundaries."""
    lines = B.lines(spark, sf).withColumn("total", P.length(F.col("line")))
    five = lines.select("way_id", P.resample(F.col("line"), F.col("total"), 5).alias("p"))
    lanes = B.lanes(spark, sf).join(five.toDF("left_way", "l"), "left_way").join(five.toDF("right_way", "r"), "right_way")
    pair = F.explode(F.arrays_zip("l", "r")).alias("z")
    rows = lanes.select("lane_id", pair).select("lane_id", F.hypot(F.col("z.l.x") - F.col("z.r.x"), F.col("z.l.y") - F.col("z.r.y")).alias("w"), ((F.col("z.l.x") + F.col("z.r.x")) / 2).alias("x"), ((F.col("z.l.y") + F.col("z.r.y")) / 2).alias("y"))
    return rows.groupBy("lane_id").agg(F.round(F.median("w"), 4).alias("width"), F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("y"), 4).alias("cy"))


@query("""t AS (SELECT way_id, pos, d, s0, x0, y0, x1, y1, (way_id % 50) * 10.0::DOUBLE + 3 AS px, (way_id % 20) * 10.0::DOUBLE + 4 AS py FROM b_chain),
f AS (SELECT *, CASE WHEN d > 0 THEN least(greatest(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (d * d), 0), 1) ELSE 0 END AS t FROM t),
g AS (SELECT way_id, pos, s0 + t * d AS station, round(sqrt((x0 + t * (x1 - x0) - px) ** 2 + (y0 + t * (y1 - y0) - py) ** 2), 6) AS distance FROM f)
SELECT way_id, min(distance) AS distance, round(arg_min(station, (distance, pos)), 4) AS station FROM g GROUP BY way_id""")
def polyline_station(spark, sf):
    """Distance to a point, and the station of its foot along the way."""
    x, y = (F.col("way_id") % 50) * F.lit(10.0) + 3, (F.col("way_id") % 20) * F.lit(10.0) + 4
    return B.lines(spark, sf).withColumn("p", P.project(F.col("line"), x, y)).select("way_id", F.round("p.distance", 6).alias("distance"), F.round("p.station", 4).alias("station"))


@query("""h AS (SELECT way_id, pos, degrees(atan2(y1 - y0, x1 - x0)) AS a FROM b_seg WHERE d > 0),
c AS (SELECT way_id, a - lag(a) OVER (PARTITION BY way_id ORDER BY pos) AS t FROM h),
n AS (SELECT way_id, ((t + 540) % 360 + 360) % 360 - 180 AS t FROM c WHERE t IS NOT NULL)
SELECT way_id, CAST(count(*) AS BIGINT) AS bends, round(sum(abs(t)), 4) AS turned, round(max(abs(t)), 4) AS sharpest FROM n GROUP BY way_id""")
def heading_change(spark, sf):
    w = Window.partitionBy("way_id").orderBy("pos")
    seg = B.points(spark, sf).withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).where("x1 <> x or y1 <> y")
    turned = seg.select("way_id", "pos", P.degrees(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")).alias("a")).withColumn("t", P.turn_degrees(F.lag("a").over(w), F.col("a"))).where("t is not null")
    return turned.groupBy("way_id").agg(F.count("*").alias("bends"), F.round(F.sum(F.abs("t")), 4).alias("turned"), F.round(F.max(F.abs("t")), 4).alias("sharpest"))


@query("""r AS (SELECT way_id, pos, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM b_pt
  WINDOW w AS (PARTITION BY way_id ORDER BY pos))
SELECT way_id, round(sum(x * y1 - x1 * y) / 2, 4) AS area, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy FROM r GROUP BY way_id HAVING count(*) > 2""")
def ring_area_centroid(spark, sf):
    lines = B.lines(spark, sf).where(F.size("line") > 2)
    mean = lambda c: F.round(F.aggregate("line", F.lit(0.0), lambda s, p: s + p[c]) / F.size("line"), 4)
    return lines.select("way_id", F.round(P.ring_area(F.col("line")), 4).alias("area"), mean("x").alias("cx"), mean("y").alias("cy"))


@query("""s AS (SELECT way_id, pos, x0, y0, x1, y1 FROM b_seg WHERE d > 0 AND pos = 1),
v AS (SELECT way_id, 100.0::DOUBLE AS a, 0.0::DOUBLE AS b, 100.0::DOUBLE AS c, 500.0::DOUBLE AS e, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM s),
u AS (SELECT way_id, (a - x0) / dx AS t, (y0 + (a - x0) / dx * dy - b) / (e - b) AS u FROM v WHERE dx <> 0)
SELECT way_id, round(t, 6) + 0 AS t, round(u, 6) + 0 AS u, t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 AS crosses FROM u""")
def segment_intersection(spark, sf):
    """Where the first segment of each way meets the upright line x = 100 from y = 0 to 500, as fractions of both."""
    line = F.col("line")
    s = B.lines(spark, sf).select("way_id", line[0]["x"].alias("x0"), line[0]["y"].alias("y0"), line[1]["x"].alias("x1"), line[1]["y"].alias("y1")).where("x1 <> x0")
    t = (F.lit(100.0) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    u = (F.col("y0") + t * (F.col("y1") - F.col("y0"))) / 500.0
    return s.select("way_id", (F.round(t, 6) + 0.0).alias("t"), (F.round(u, 6) + 0.0).alias("u"), (t.between(0, 1) & u.between(0, 1)).alias("crosses"))


# --- joins ---------------------------------------------------------------------------------------


@query("SELECT way_id, map_id FROM b_way WHERE way_id NOT IN (SELECT way_id FROM b_way_node)")
def missing_way_anti(spark, sf):
    """Ways without a node."""
    return B.ways(spark, sf).join(B.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("way_id")), "way_id", "left_anti").select("way_id", "map_id")


@query("SELECT node_id, x, y FROM b_node WHERE node_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def node_usage_semi(spark, sf):
    used = B.load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("node_id"))
    return B.nodes(spark, sf).join(used, "node_id", "left_semi").select("node_id", "x", "y")


@query("""SELECT a.lane_id AS src, b.lane_id AS dst, 'left' AS role FROM b_lane a JOIN b_lane b ON a.left_way = b.right_way AND a.lane_id <> b.lane_id
UNION ALL SELECT a.lane_id, b.lane_id, 'right' FROM b_lane a JOIN b_lane b ON a.right_way = b.left_way AND a.lane_id <> b.lane_id""")
def lateral_adjacency(spark, sf):
    return J.lateral_adjacency(B.lanes(spark, sf))


@query("""u AS (SELECT lane_id, 'left' AS side, left_way AS way FROM b_lane UNION ALL SELECT lane_id, 'right', right_way FROM b_lane WHERE right_way IS NOT NULL)
SELECT DISTINCT a.lane_id AS src, b.lane_id AS dst, a.side FROM u a JOIN u b ON a.way = b.way AND a.lane_id <> b.lane_id""")
def any_user_adjacency(spark, sf):
    return J.boundary_users(B.lanes(spark, sf))


_PAIRS = "SELECT a.way_id AS src, b.way_id AS dst, a.map_id FROM b_end a JOIN b_end b ON a.map_id = b.map_id AND a.way_id <> b.way_id AND sqrt((a.ex - b.sx) ** 2 + (a.ey - b.sy) ** 2) <= 0.5"


def successors(spark, sf, tolerance: float = 0.5) -> DataFrame:
    """(src, dst, map_id, distance): ways that start where another one of the map ends."""
    e = B.ends(spark, sf)
    a = e.select(F.col("way_id").alias("src"), "map_id", "ex", "ey")
    b = e.select(F.col("way_id").alias("dst"), "map_id", "sx", "sy")
    return J.epsilon_join(a, b, ("ex", "ey"), ("sx", "sy"), tolerance, ["map_id"]).where("src <> dst").select("src", "dst", "map_id", "distance")


@query(_PAIRS)
def endpoint_successors(spark, sf):
    return successors(spark, sf).select("src", "dst", "map_id")


@query("""l AS (SELECT l.lane_id, l.map_id, a.start_node AS ls, a.end_node AS le, b.start_node AS rs, b.end_node AS re FROM b_lane l JOIN b_end a ON a.way_id = l.left_way JOIN b_end b ON b.way_id = l.right_way)
SELECT a.lane_id AS src, b.lane_id AS dst, CASE WHEN a.le = b.ls AND a.re = b.rs THEN 'both' WHEN a.le = b.ls THEN 'left' ELSE 'right' END AS shared
FROM l a JOIN l b ON a.lane_id <> b.lane_id AND (a.le = b.ls OR a.re = b.rs) AND a.map_id = b.map_id""")
def endpoint_key_successors(spark, sf):
    """Lanes whose left or right boundary goes on in another lane's of the map: both ends, or one."""
    e = B.ends(spark, sf)
    lanes = B.lanes(spark, sf).join(e.select(F.col("way_id").alias("left_way"), F.col("start_node").alias("ls"), F.col("end_node").alias("le")), "left_way")
    lanes = lanes.join(e.select(F.col("way_id").alias("right_way"), F.col("start_node").alias("rs"), F.col("end_node").alias("re")), "right_way")
    a = lanes.select(F.col("lane_id").alias("src"), "map_id", "le", "re")
    b = lanes.select(F.col("lane_id").alias("dst"), "map_id", "ls", "rs")
    left = a.join(b, (a["map_id"] == b["map_id"]) & (a["le"] == b["ls"])).select("src", "dst", F.lit(1).alias("l"), F.lit(0).alias("r"))
    right = a.join(b, (a["map_id"] == b["map_id"]) & (a["re"] == b["rs"])).select("src", "dst", F.lit(0).alias("l"), F.lit(1).alias("r"))
    both = left.unionAll(right).where("src <> dst").groupBy("src", "dst").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return both.select("src", "dst", F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left").otherwise("right").alias("shared"))


@query("""m AS (SELECT way_id, map_id, (sx + ex) / 2 AS mx, (sy + ey) / 2 AS my FROM b_end),
p AS (SELECT a.way_id, b.way_id AS near_id, round(sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2), 6) AS distance FROM m a JOIN m b ON a.map_id = b.map_id AND a.way_id <> b.way_id
  AND sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2) <= 25)
SELECT m.way_id, arg_min(near_id, (distance, near_id)) AS near_id, min(distance) AS distance FROM m LEFT JOIN p USING (way_id) GROUP BY m.way_id""")
def nearest_lane(spark, sf):
    """The nearest other midpoint of the map within 25 m; unmatched ways stay."""
    e = B.ends(spark, sf)
    a = e.select("way_id", "map_id", ((F.col("sx") + F.col("ex")) / 2).alias("mx"), ((F.col("sy") + F.col("ey")) / 2).alias("my"))
    b = e.select(F.col("way_id").alias("near_id"), "map_id", ((F.col("sx") + F.col("ex")) / 2).alias("nx"), ((F.col("sy") + F.col("ey")) / 2).alias("ny"))
    return J.nearest_within(a, b, "way_id", "near_id", ("mx", "my"), ("nx", "ny"), 25.0, ["map_id"]).select("way_id", "near_id", "distance")


@query("""l AS (SELECT way_id, sum(d) AS len FROM b_seg GROUP BY way_id), e AS (SELECT * FROM b_end JOIN l USING (way_id))
SELECT a.way_id AS kept, b.way_id AS dropped FROM e a JOIN e b ON a.map_id = b.map_id AND a.way_id < b.way_id AND sqrt((a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2) <= 30
  AND sqrt((a.ex - b.ex) ** 2 + (a.ey - b.ey) ** 2) <= 30 AND abs(a.len - b.len) <= 60""")
def duplicate_boundary(spark, sf):
    """Ways of a map with ends within 30 m and lengths within 60 m: the smaller id stays."""
    size = B.lines(spark, sf).select("way_id", P.length(F.col("line")).alias("len"))
    e = B.ends(spark, sf).join(size, "way_id")
    a = e.select(F.col("way_id").alias("kept"), "map_id", "sx", "sy", F.col("ex").alias("ax"), F.col("ey").alias("ay"), F.col("len").alias("al"))
    b = e.select(F.col("way_id").alias("dropped"), "map_id", F.col("sx").alias("tx"), F.col("sy").alias("ty"), "ex", "ey", "len")
    near = J.epsilon_join(a, b, ("sx", "sy"), ("tx", "ty"), 30.0, ["map_id"])
    return near.where((F.col("kept") < F.col("dropped")) & (F.hypot(F.col("ax") - F.col("ex"), F.col("ay") - F.col("ey")) <= 30) & (F.abs(F.col("al") - F.col("len")) <= 60)).select("kept", "dropped")


@query("""SELECT event_id, track_id, last_value(CASE WHEN kind = 'view' THEN v END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS limit_v FROM b_track""")
def asof_speed(spark, sf):
    """The value of a track's last view event at or before each event."""
    t = B.load(spark, sf, "events").select("event_id", F.col("user_id").alias("track_id"), "ts", F.col("event_type").alias("kind"), F.col("value").alias("v"))
    return J.as_of(t, "track_id", ["ts", "event_id"], F.col("kind") == "view", F.col("v"), "limit_v").select("event_id", "track_id", "limit_v")


@query("""i AS (SELECT track_id, t AS lo, t + 3600000000 * (1 + event_id % 24) AS hi FROM b_track),
m AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY track_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT track_id, min(lo) AS lo, max(hi) AS hi, CAST(count(*) AS BIGINT) AS parts FROM g GROUP BY track_id, island""")
def merged_intervals(spark, sf):
    t = B.load(spark, sf, "events").select(F.col("user_id").alias("track_id"), B.micros("ts").alias("lo"), "event_id")
    spans = t.select("track_id", "lo", (F.col("lo") + F.lit(3600000000) * (1 + F.col("event_id") % 24)).alias("hi"))
    return J.merged_intervals(spans, "track_id", "lo", "hi")


@query("""SELECT track_id, pos, coalesce(lead(t) OVER w, 1800000000000000) - t AS length FROM b_track WINDOW w AS (PARTITION BY track_id ORDER BY pos)""")
def section_lengths(spark, sf):
    """From each station to the next; the last one to the end of the road."""
    w = Window.partitionBy("track_id").orderBy("pos")
    return B.tracks(spark, sf).select("track_id", "pos", (F.coalesce(F.lead("t").over(w), F.lit(1800000000000000)) - F.col("t")).alias("length"))


@query("""SELECT track_id, round(regr_slope(v, pos), 6) AS slope, round(greatest(regr_intercept(v, pos), 0), 6) AS base FROM b_track GROUP BY track_id""")
def linear_width_fit(spark, sf):
    pos = F.col("pos").cast("double")
    return B.tracks(spark, sf).groupBy("track_id").agg(F.round(F.regr_slope("v", pos), 6).alias("slope"), F.round(F.greatest(F.regr_intercept("v", pos), F.lit(0.0)), 6).alias("base"))


@query("""c AS (SELECT a.way_id AS src, b.way_id AS dst, a.prio = wb.prio AS same, cos(atan2(a.ey - a.sy, a.ex - a.sx) - atan2(b.ey - b.sy, b.ex - b.sx)) AS turn
  FROM (SELECT e.*, prio FROM b_end e JOIN b_way USING (way_id)) a JOIN b_end b ON a.end_node = b.start_node AND a.map_id = b.map_id AND a.way_id <> b.way_id JOIN b_way wb ON wb.way_id = b.way_id),
s AS (SELECT src, dst, round((CASE WHEN same THEN 40 ELSE 20 END) + 20 * turn, 6) AS score FROM c WHERE turn >= 0.3 - 1e-9),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM s WHERE score >= 40)
SELECT src, dst, score FROM r WHERE n = 1""")
def best_successor(spark, sf):
    """Scored successors: like class, straight on; the best of those with 40 points or more."""
    e = B.ends(spark, sf).join(B.ways(spark, sf).select("way_id", "prio"), "way_id").withColumn("a", F.atan2(F.col("ey") - F.col("sy"), F.col("ex") - F.col("sx")))
    a = e.select(F.col("way_id").alias("src"), "map_id", F.col("end_node").alias("node"), F.col("prio").alias("pa"), F.col("a").alias("aa"))
    b = e.select(F.col("way_id").alias("dst"), "map_id", F.col("start_node").alias("node"), "prio", "a")
    turn = F.cos(F.col("aa") - F.col("a"))
    s = a.join(b, ["map_id", "node"]).where("src <> dst").withColumn("turn", turn).where(F.col("turn") >= 0.3 - 1e-9)
    s = s.withColumn("score", F.round(F.when(F.col("pa") == F.col("prio"), 40).otherwise(20) + 20 * F.col("turn"), 6)).where("score >= 40")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where("n = 1").select("src", "dst", "score")


@query("""o AS (SELECT way_id, start_node AS node, (degrees(atan2(ey - sy, ex - sx)) + 360) % 360 AS a FROM b_end)
SELECT node, way_id, CAST(row_number() OVER (PARTITION BY node ORDER BY round(a, 6), way_id) AS INT) AS place FROM o""")
def ccw_edge_order(spark, sf):
    """Ways that leave a node, counter-clockwise."""
    e = B.ends(spark, sf).select("way_id", F.col("start_node").alias("node"), F.round(P.degrees(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")), 6).alias("a"))
    return e.select("node", "way_id", F.row_number().over(Window.partitionBy("node").orderBy("a", "way_id")).alias("place"))


_TURNS = """c AS (SELECT a.way_id AS src, b.way_id AS dst, degrees(atan2(b.ey - b.sy, b.ex - b.sx)) - degrees(atan2(a.ey - a.sy, a.ex - a.sx)) AS t
  FROM b_end a JOIN b_end b ON a.end_node = b.start_node AND a.map_id = b.map_id AND a.way_id <> b.way_id),
n AS (SELECT src, dst, round(((t + 540) % 360 + 360) % 360 - 180, 6) AS t, count(*) OVER (PARTITION BY src) AS k FROM c),
m AS (SELECT src, dst, CASE WHEN t = -180 THEN 180 ELSE t END AS t, k FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t DESC, dst) AS place FROM m)"""


def turns(spark, sf) -> DataFrame:
    """(src, dst, t, k): successors by node with the turn in degrees and the number of them."""
    e = B.ends(spark, sf).withColumn("a", P.degrees(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")))
    a = e.select(F.col("way_id").alias("src"), "map_id", F.col("end_node").alias("node"), F.col("a").alias("before"))
    b = e.select(F.col("way_id").alias("dst"), "map_id", F.col("start_node").alias("node"), F.col("a").alias("after"))
    t = F.round(P.turn_degrees(F.col("before"), F.col("after")), 6)
    return a.join(b, ["map_id", "node"]).where("src <> dst").select("src", "dst", F.when(t == -180.0, 180.0).otherwise(t).alias("t")).withColumn("k", F.count("*").over(Window.partitionBy("src")))


@query(_TURNS + """ SELECT src, dst, CASE WHEN k = 3 THEN CASE place WHEN 1 THEN 'left' WHEN 2 THEN 'through' ELSE 'right' END
  WHEN t > 35 THEN 'left' WHEN t < -35 THEN 'right' ELSE 'through' END AS turn FROM p""")
def turn_direction(spark, sf):
    """Three successors are left, through and right in order; else 35 degrees decide."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("t"), "dst"))
    t = turns(spark, sf).withColumn("place", place)
    by_place = F.when(F.col("place") == 1, "left").when(F.col("place") == 2, "through").otherwise("right")
    return t.select("src", "dst", F.when(F.col("k") == 3, by_place).when(F.col("t") > 35, "left").when(F.col("t") < -35, "right").otherwise("through").alias("turn"))


@query(_TURNS + """, q AS (SELECT src, dst, t, row_number() OVER (PARTITION BY src ORDER BY abs(t), dst) AS n FROM p) SELECT src, dst, t FROM q WHERE n = 1 AND abs(t) < 18""")
def straight_successor(spark, sf):
    """The successor that turns least, when it is within 18 degrees of straight on (an angle over 0.9 pi)."""
    n = F.row_number().over(Window.partitionBy("src").orderBy(F.abs("t"), "dst"))
    return turns(spark, sf).withColumn("n", n).where("n = 1 and abs(t) < 18").select("src", "dst", "t")


@query("""g AS (SELECT way_id, start_node AS node FROM b_end), p AS (SELECT a.way_id AS a, b.way_id AS b FROM g a JOIN g b ON a.node = b.node AND a.way_id < b.way_id)
SELECT CAST(least(a, b) // 5 AS BIGINT) AS src, CAST(greatest(a, b) // 5 AS BIGINT) AS dst, CAST(count(*) AS BIGINT) AS links FROM p WHERE a // 5 <> b // 5 GROUP BY 1, 2""")
def road_links(spark, sf):
    """Roads (five lanes each) joined by any lane pair that starts at one node."""
    g = B.ends(spark, sf).select("way_id", F.col("start_node").alias("node"))
    p = g.toDF("a", "node").join(g.toDF("b", "node"), "node").where("a < b").select(F.expr("a div 5").alias("src"), F.expr("b div 5").alias("dst"))
    return p.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


@query("""t AS (SELECT track_id, pos, kind, v, lag(v) OVER w AS before FROM b_track WINDOW w AS (PARTITION BY track_id ORDER BY pos))
SELECT track_id, pos, kind, round(v - before, 6) AS change FROM t WHERE before IS NOT NULL AND abs(v - before) > 0.01""")
def speed_changes(spark, sf):
    w = Window.partitionBy("track_id").orderBy("pos")
    t = B.tracks(spark, sf).withColumn("before", F.lag("v").over(w)).where("before is not null and abs(v - before) > 0.01")
    return t.select("track_id", "pos", "kind", F.round(F.col("v") - F.col("before"), 6).alias("change"))


# --- aggregates, sets, order ---------------------------------------------------------------------


@query("SELECT map_id, kind, CAST(count(*) AS BIGINT) AS n FROM b_way GROUP BY map_id, kind")
def kind_histogram(spark, sf):
    return B.ways(spark, sf).groupBy("map_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS way_id, l_linenumber AS pos, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return B.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("pos")).agg(F.count("*").alias("n")).where("n > 1")


@query("""u AS (SELECT node_id, count(DISTINCT way_id) AS ways FROM b_way_node GROUP BY node_id)
SELECT node_id, CAST(ways AS BIGINT) AS ways, CAST(CASE WHEN ways > 1 THEN 1 ELSE 0 END AS INT) AS splits FROM u""")
def split_nodes(spark, sf):
    """Nodes of several ways, where roads are split into edges."""
    u = B.load(spark, sf, "lineitem").select("l_partkey", "l_orderkey").distinct().groupBy(F.col("l_partkey").alias("node_id")).agg(F.count("*").alias("ways"))
    return u.withColumn("splits", (F.col("ways") > 1).cast("int"))


_SETS = """a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'),
u AS (SELECT id, 'union' AS part FROM (SELECT id FROM a UNION SELECT id FROM r)), i AS (SELECT id, 'both' AS part FROM (SELECT id FROM a INTERSECT SELECT id FROM r)),
e AS (SELECT id, 'left only' AS part FROM (SELECT id FROM a EXCEPT SELECT id FROM r))"""


@query(_SETS + " SELECT * FROM u UNION ALL SELECT * FROM i UNION ALL SELECT * FROM e")
def candidate_union_intersect_except(spark, sf):
    li = B.load(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_returnflag")
    a, r = (li.where(F.col("l_returnflag") == k).select("id").distinct() for k in ("A", "R"))
    name = lambda df, part: df.withColumn("part", F.lit(part))
    return name(a.union(r).distinct(), "union").unionAll(name(a.intersect(r), "both")).unionAll(name(a.exceptAll(r), "left only"))


@query("""i AS (SELECT way_id, CASE WHEN way_id % 3 = 0 THEN '-' || way_id ELSE CAST(way_id AS VARCHAR) END AS id FROM b_way)
SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN id LIKE '-%' THEN 0 ELSE 1 END, abs(CAST(id AS BIGINT)), id) AS BIGINT) AS place FROM i""")
def natural_id_order(spark, sf):
    """Places of ids, temporary (negative) ones first, each by magnitude: a range sort and offsets of partitions, no single task."""
    i = B.ways(spark, sf).select(F.when(F.col("way_id") % 3 == 0, F.concat(F.lit("-"), F.col("way_id").cast("string"))).otherwise(F.col("way_id").cast("string")).alias("id"))
    keyed = i.select("id", F.when(F.startswith("id", F.lit("-")), 0).otherwise(1).alias("r"), F.abs(F.col("id").cast("long")).alias("m"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartitionByRange(n, "r", "m", "id").sortWithinPartitions("r", "m", "id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("c"))
    before = sizes.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, "part").select("id", (F.col("before") + F.col("at") + 1).alias("place"))


@query("""r AS (SELECT map_id, way_id, price, row_number() OVER (PARTITION BY map_id ORDER BY price DESC, way_id) AS n FROM b_way) SELECT map_id, way_id, price FROM r WHERE n <= 500""")
def capped_details(spark, sf):
    """The 500 detail rows a report keeps of each map."""
    n = F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("price"), "way_id"))
    return B.ways(spark, sf).withColumn("n", n).where("n <= 500").select("map_id", "way_id", "price")


# --- quality -------------------------------------------------------------------------------------

_COUNTS = """c AS (SELECT map_id, kind, count(*) AS expected, count(*) FILTER (WHERE prio <> '1-URGENT' AND (kind <> 'P' OR way_id % 3 > 0)) AS found FROM b_way GROUP BY map_id, kind),
s AS (SELECT map_id, kind, CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found,
  CASE WHEN expected = 0 THEN 'SKIP' WHEN found = 0 THEN 'FAIL' WHEN found < 0.8 * expected THEN 'WARN' ELSE 'PASS' END AS status FROM c)"""


def coverage_rows(spark, sf) -> DataFrame:
    found = (F.col("prio") != "1-URGENT") & ((F.col("kind") != "P") | (F.col("way_id") % 3 > 0))
    rows = B.ways(spark, sf).groupBy("map_id", "kind").agg(F.count("*").alias("expected"), F.count_if(found).alias("found"))
    return rows.withColumn("status", Q.coverage(F.col("found"), F.col("expected"), 0.8))


@query(_COUNTS + " SELECT * FROM s")
def coverage_status(spark, sf):
    return coverage_rows(spark, sf)


@query(_COUNTS + """ SELECT map_id, CAST(count(*) FILTER (WHERE status = 'PASS') AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE status = 'WARN') AS BIGINT) AS warned,
  CAST(count(*) FILTER (WHERE status = 'FAIL') AS BIGINT) AS failed, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' WHEN bool_or(status = 'PASS') THEN 'PASS' ELSE 'SKIP' END AS worst
  FROM s GROUP BY map_id""")
def status_rollup(spark, sf):
    s = F.col("status")
    return coverage_rows(spark, sf).groupBy("map_id").agg(F.count_if(s == "PASS").alias("passed"), F.count_if(s == "WARN").alias("warned"), F.count_if(s == "FAIL").alias("failed"), Q.worst(s).alias("worst"))


@query(_COUNTS + " SELECT map_id, kind, CASE WHEN kind IN ('F', 'O') THEN status ELSE 'SKIP' END AS status FROM s")
def disabled_groups(spark, sf):
    return Q.only_enabled(coverage_rows(spark, sf).withColumn("category", F.col("kind")), ["F", "O"]).select("map_id", "kind", "status")


@query("""p AS (""" + _PAIRS + """), t AS (SELECT src, dst FROM p WHERE (src + dst) % 7 > 0), m AS (SELECT way_id FROM b_way WHERE way_id % 11 > 0)
SELECT src, dst FROM p WHERE src IN (SELECT * FROM m) AND dst IN (SELECT * FROM m) AND (src, dst) NOT IN (SELECT src, dst FROM t)""")
def topology_preservation(spark, sf):
    """Successor edges of mapped ways that a target without every seventh edge has lost."""
    source = successors(spark, sf).select("src", "dst", F.lit("successor").alias("role"))
    target = source.where("(src + dst) % 7 > 0")
    mapping = B.ways(spark, sf).where("way_id % 11 > 0").select(F.col("way_id").alias("node"), F.col("way_id").alias("target"))
    return Q.missing_edges(source, target, mapping).select("src", "dst")


@query("""k AS (SELECT unnest(range(20)) AS k), q AS (SELECT way_id, any_value(total) AS total FROM b_chain GROUP BY way_id),
d AS (SELECT q.way_id, k, abs(0.2 * (way_id % 10) * (k % 3)) AS e FROM q, k)
SELECT b_way.map_id, CAST(count(*) AS BIGINT) AS lanes, CAST(count(*) FILTER (WHERE e <= 1) AS BIGINT) AS passed, round(avg(e), 6) AS mean, round(max(e), 6) AS worst,
  round(count(*) FILTER (WHERE e <= 1) / count(*), 6) AS rate FROM (SELECT way_id, avg(e) AS e FROM d GROUP BY way_id) JOIN b_way USING (way_id) GROUP BY b_way.map_id""")
def roundtrip_metrics(spark, sf):
    """Mean distance of 20 paired samples of each way to a copy that is off by a known amount, judged at 1 m, by map."""
    line = F.col("line")
    ways = B.lines(spark, sf).withColumn("total", P.length(line)).withColumn("p", P.resample(line, F.col("total"), 20))
    shift = 0.2 * (F.col("way_id") % 10)
    copy = F.transform("p", lambda p, k: F.struct((p["x"] + shift * (k % 3)).alias("x"), p["y"].alias("y")))
    far = F.zip_with("p", copy, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    e = ways.select("way_id", F.round(F.aggregate(far, F.lit(0.0), lambda s, v: s + v) / 20, 9).alias("e")).join(B.ways(spark, sf).select("way_id", "map_id"), "way_id")
    ok = F.count_if(F.col("e") <= 1)
    return e.groupBy("map_id").agg(F.count("*").alias("lanes"), ok.alias("passed"), F.round(F.avg("e"), 6).alias("mean"), F.round(F.max("e"), 6).alias("worst"), F.round(ok / F.count("*"), 6).alias("rate"))


@query("""e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
p AS (SELECT event_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS other FROM e)
SELECT event_id, k IS NOT DISTINCT FROM other AS same, CASE WHEN k IS NULL AND other IS NULL THEN 'absent' WHEN k = other THEN 'kept' WHEN other IS NULL THEN 'added' ELSE 'changed' END AS verdict FROM p""")
def attribute_match(spark, sf):
    """Whether the tag k of each record equals that of the record before."""
    k = F.from_json("props", "k bigint")["k"]
    e = B.load(spark, sf, "events").select("event_id", "user_id", k.alias("k")).withColumn("other", F.lag("k").over(Window.partitionBy("user_id").orderBy("event_id")))
    kk, other = F.col("k"), F.col("other")
    verdict = F.when(kk.isNull() & other.isNull(), "absent").when(kk == other, "kept").when(other.isNull(), "added").otherwise("changed")
    return e.select("event_id", kk.eqNullSafe(other).alias("same"), verdict.alias("verdict"))
