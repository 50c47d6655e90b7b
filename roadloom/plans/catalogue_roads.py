"""Queries of road assembly and its checks: lane groups, junctions, layers, signals, raster agreement, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadloom.functions import polyline as P
from roadloom.operators import graphs as G
from roadloom.operators import joins as J
from roadloom.operators import lanes as L
from roadloom.operators import quality as Q
from roadloom.plans import bridge as B
from roadloom.plans.catalogue import _COUNTS, _PAIRS, coverage_rows, query, successors
from roadloom.plans.catalogue_more import _CELLS, cells


@query("""m AS (SELECT way_id, map_id, way_id // 5 AS road, (sx + ex) / 2 AS mx, (sy + ey) / 2 AS my, ex - sx AS dx, ey - sy AS dy FROM b_end WHERE ex <> sx OR ey <> sy),
f AS (SELECT road, arg_min(dx, way_id) AS rx, arg_min(dy, way_id) AS ry FROM m GROUP BY road),
o AS (SELECT m.*, CASE WHEN dx * rx + dy * ry >= 0 THEN 1 ELSE 0 END AS forward, round((ry * mx - rx * my) / sqrt(rx * rx + ry * ry), 6) AS side, 3 + way_id % 3 * 0.5::DOUBLE AS width FROM m JOIN f USING (road))
SELECT road, CAST(count(*) AS BIGINT) AS lanes, CAST(sum(forward) AS BIGINT) AS forward, round(sum(width), 4) AS width, string_agg(CAST(way_id AS VARCHAR), ',' ORDER BY side, way_id) AS left_to_right,
  min(side) AS leftmost, max(side) AS rightmost FROM o GROUP BY road""")
def lane_condensation(spark, sf):
    """A road from its lanes: direction of each against the first, total width, lanes from left to right by the projection on the
    normal, with the places of the outermost ones."""
    m = B.ends(spark, sf).where("ex <> sx or ey <> sy")
    m = m.select("way_id", F.expr("way_id div 5").alias("road"), ((F.col("sx") + F.col("ex")) / 2).alias("mx"), ((F.col("sy") + F.col("ey")) / 2).alias("my"), (F.col("ex") - F.col("sx")).alias("dx"), (F.col("ey") - F.col("sy")).alias("dy"))
    lead = F.min(F.struct("way_id", "dx", "dy")).over(Window.partitionBy("road"))
    o = m.withColumn("r", lead).select("road", "way_id", (F.col("dx") * F.col("r.dx") + F.col("dy") * F.col("r.dy") >= 0).cast("int").alias("forward"), F.round((F.col("r.dy") * F.col("mx") - F.col("r.dx") * F.col("my")) / F.hypot("r.dx", "r.dy"), 6).alias("side"), (F.lit(3.0) + (F.col("way_id") % 3) * 0.5).alias("width"))
    lanes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("side", "way_id"))), lambda v: v["way_id"].cast("string")), ",")
    return o.groupBy("road").agg(F.count("*").alias("lanes"), F.sum("forward").alias("forward"), F.round(F.sum("width"), 4).alias("width"), lanes.alias("left_to_right"), F.min("side").alias("leftmost"), F.max("side").alias("rightmost"))


@query()
def junction_clusters(spark, sf):
    """Connector chains that share an incoming or an outgoing road (never one's incoming with another's outgoing) make a junction."""
    c = B.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.min("l_partkey").alias("i"), F.max("l_partkey").alias("o"))
    # a chain is joined to the first chain of its roads, not to all: the same components from far fewer edges
    edges = None
    for end in ("i", "o"):
        e = c.join(c.groupBy(end).agg(F.min("node").alias("dst")), end).select(F.col("node").alias("src"), "dst")
        edges = e if edges is None else edges.unionAll(e)
    return G.components(c.select("node"), edges).groupBy("component").agg(F.count("*").alias("chains"))


_LAYERS = """a AS (SELECT DISTINCT node_id, map_id FROM b_way_node JOIN b_way USING (way_id) WHERE kind = 'F'), s AS (SELECT DISTINCT node_id, map_id FROM b_way_node JOIN b_way USING (way_id) WHERE kind = 'P')"""


@query(_LAYERS + " SELECT map_id, node_id FROM a INTERSECT SELECT map_id, node_id FROM s")
def layer_crossings(spark, sf):
    """Nodes where the main layer and the layer beside it meet."""
    used = B.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("node_id")).join(B.ways(spark, sf), "way_id")
    return used.where("kind = 'F'").select("map_id", "node_id").intersect(used.where("kind = 'P'").select("map_id", "node_id"))


@query("SELECT way_id, map_id, 'main' AS layer FROM b_way WHERE kind = 'F' UNION ALL SELECT way_id, map_id, 'sub' FROM b_way WHERE kind = 'P'")
def merged_layers(spark, sf):
    w = B.ways(spark, sf).select("way_id", "map_id", "kind")
    layer = lambda k, n: w.where(F.col("kind") == k).select("map_id", "way_id", F.lit(n).alias("layer"))
    return layer("F", "main").unionByName(layer("P", "sub"))


_SIGN = """CASE way_id % 6 WHEN 0 THEN 'de274' WHEN 1 THEN 'stop' WHEN 2 THEN 'traffic_light' WHEN 3 THEN 'limit ' || (way_id % 13 * 10) || ' mph' WHEN 4 THEN '' ELSE 'de' || (way_id % 300) END"""


@query(f"""s AS (SELECT way_id, {_SIGN} AS tag FROM b_way), n AS (SELECT *, TRY_CAST(nullif(regexp_extract(tag, '([0-9]+)', 1), '') AS DOUBLE) AS number FROM s)
SELECT way_id, tag, CASE WHEN tag = 'traffic_light' THEN '1000001' WHEN tag = 'stop' THEN '206' WHEN tag LIKE 'de%' THEN CAST(number AS INT)::VARCHAR ELSE 'unknown' END AS type,
  CASE WHEN tag LIKE 'limit%' THEN number END AS value, CASE WHEN tag LIKE '% mph' THEN 'mph' WHEN tag LIKE 'de274' THEN 'km/h' END AS unit FROM n""")
def signal_mapping(spark, sf):
    """Catalogue type, value and unit of signals from their tag text."""
    tag = F.col("tag")
    code = F.broadcast(spark.createDataFrame([("traffic_light", "1000001"), ("stop", "206")], "tag string, known string"))
    s = B.ways(spark, sf).select("way_id", F.expr(_SIGN).alias("tag")).join(code, "tag", "left")
    number = F.regexp_extract(tag, "([0-9]+)", 1).try_cast("double")
    kind = F.coalesce("known", F.when(F.startswith(tag, F.lit("de")), number.cast("int").cast("string")), F.lit("unknown"))
    return s.select("way_id", "tag", kind.alias("type"), F.when(F.startswith(tag, F.lit("limit")), number).alias("value"), F.when(F.endswith(tag, F.lit(" mph")), "mph").when(tag == "de274", "km/h").alias("unit"))


@query("""r AS (SELECT o_orderkey AS rel, o_custkey % 9 AS f, o_custkey % 7 AS t, o_orderkey % 11 AS lane, o_orderstatus AS s FROM orders)
SELECT rel, concat_ws(',', CASE WHEN f = 0 THEN 'no from' END, CASE WHEN t = 0 THEN 'no to' END, CASE WHEN lane > 8 THEN 'unknown lane' END, CASE WHEN s = 'P' THEN 'partial' END) AS issues,
  CASE WHEN f = 0 OR t = 0 OR lane > 8 OR s = 'P' THEN 'WARN' ELSE 'PASS' END AS status FROM r""")
def restriction_issues(spark, sf):
    """Issue codes of each turn restriction; any makes it a warning."""
    f, t, lane, s = F.col("o_custkey") % 9, F.col("o_custkey") % 7, F.col("o_orderkey") % 11, F.col("o_orderstatus")
    issues = F.array_compact(F.array(F.when(f == 0, "no from"), F.when(t == 0, "no to"), F.when(lane > 8, "unknown lane"), F.when(s == "P", "partial")))
    return B.load(spark, sf, "orders").select(F.col("o_orderkey").alias("rel"), issues.alias("i")).select("rel", F.array_join("i", ",").alias("issues"), F.when(F.size("i") > 0, "WARN").otherwise("PASS").alias("status"))


@query("""n AS (SELECT way_id, count(*) AS n FROM b_way_node GROUP BY way_id), z AS (SELECT way_id, sum(d) AS len FROM b_seg GROUP BY way_id),
c AS (SELECT map_id, count(*) AS ways, count(*) FILTER (WHERE n IS NULL) AS empty, count(*) FILTER (WHERE n = 1) AS short, count(*) FILTER (WHERE len = 0) AS flat FROM b_way LEFT JOIN n USING (way_id) LEFT JOIN z USING (way_id) GROUP BY map_id)
SELECT map_id, CAST(ways AS BIGINT) AS ways, CAST(empty AS BIGINT) AS empty, CAST(short AS BIGINT) AS short, CAST(flat AS BIGINT) AS flat, CASE WHEN ways = 0 OR flat > 0 THEN 'FAIL' WHEN empty + short > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM c""")
def structure_checks(spark, sf):
    n = B.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.count("*").alias("n"))
    z = B.lines(spark, sf).select("way_id", P.length(F.col("line")).alias("len"))
    w = B.ways(spark, sf).select("way_id", "map_id").join(n, "way_id", "left").join(z, "way_id", "left")
    c = w.groupBy("map_id").agg(F.count("*").alias("ways"), F.count_if(F.col("n").isNull()).alias("empty"), F.count_if(F.col("n") == 1).alias("short"), F.count_if(F.col("len") == 0).alias("flat"))
    return c.withColumn("status", F.when((F.col("ways") == 0) | (F.col("flat") > 0), "FAIL").when(F.col("empty") + F.col("short") > 0, "WARN").otherwise("PASS"))


@query(_CELLS + """, moved AS (SELECT map_id, row, col + CASE WHEN row % 9 = 0 THEN 1 ELSE 0 END AS col FROM g), t AS (SELECT DISTINCT map_id, row, col FROM moved),
u AS (SELECT map_id, count(*) AS shared FROM g JOIN t USING (map_id, row, col) GROUP BY map_id), n AS (SELECT map_id, count(*) AS a FROM g GROUP BY map_id), m AS (SELECT map_id, count(*) AS b FROM t GROUP BY map_id)
SELECT map_id, round(coalesce(shared, 0) / (a + b - coalesce(shared, 0)), 6) AS iou, CASE WHEN coalesce(shared, 0) >= 0.95 * (a + b - coalesce(shared, 0)) THEN 'PASS' ELSE 'FAIL' END AS status FROM n JOIN m USING (map_id) LEFT JOIN u USING (map_id)""")
def raster_iou(spark, sf):
    """Shared cells over all cells of a raster and a copy with shifted rows."""
    # cells are painted once: one of a shifted row stands for itself and its copy; all of another row are shared, and only counted
    one = lambda col, a, b: F.struct(col.alias("col"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    col = F.col("col")
    at = F.when(F.col("row") % 9 == 0, F.array(one(col, 1, 0), one(col + 1, 0, 1))).otherwise(F.array(one(F.lit(None).cast("long"), 1, 1)))
    marked = cells(spark, sf).select("map_id", "row", F.explode(at).alias("at")).groupBy("map_id", "row", "at.col").agg(F.max("at.a").alias("a"), F.max("at.b").alias("b"), F.count("*").alias("n"))
    weight = F.when(F.col("col").isNull(), F.col("n")).otherwise(1)
    c = marked.groupBy("map_id").agg(F.sum(F.col("a") * F.col("b") * weight).alias("both"), F.sum(weight).alias("any"))
    return c.select("map_id", F.round(F.col("both") / F.col("any"), 6).alias("iou"), F.when(F.col("both") >= 0.95 * F.col("any"), "PASS").otherwise("FAIL").alias("status"))


@query("""e AS (SELECT way_id, map_id, ex AS x, ey AS y FROM b_end), r AS (SELECT *, unnest(range(floor((y - 25) / 20)::BIGINT, ceil((y + 25) / 20)::BIGINT + 1)) AS row FROM e),
c AS (SELECT *, unnest(range(floor((x - 25) / 20)::BIGINT, ceil((x + 25) / 20)::BIGINT + 1)) AS col FROM r)
SELECT map_id, row, col, CAST(count(*) AS BIGINT) AS anchors FROM c WHERE sqrt((col * 20 + 10 - x) ** 2 + (row * 20 + 10 - y) ** 2) <= 25 GROUP BY map_id, row, col""")
def topology_anchors(spark, sf):
    """Cells whose centre lies within 25 m of a lane's end."""
    e = B.ends(spark, sf).select("way_id", "map_id", F.col("ex").alias("x"), F.col("ey").alias("y"))
    span = lambda v: F.explode(F.sequence(F.floor((F.col(v) - 25) / 20), F.ceil((F.col(v) + 25) / 20)))
    c = e.withColumn("row", span("y")).withColumn("col", span("x"))
    return c.where(F.hypot(F.col("col") * 20 + 10 - F.col("x"), F.col("row") * 20 + 10 - F.col("y")) <= 25).groupBy("map_id", "row", "col").agg(F.count("*").alias("anchors"))


@query("""p AS (SELECT way_id, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM b_pt WINDOW w AS (PARTITION BY way_id)),
s AS (SELECT way_id, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * (u * u + v * v)) / 2 AS a, sum(v * (u * u + v * v)) / 2 AS b FROM p GROUP BY way_id),
c AS (SELECT *, uu * vv - uv * uv AS det FROM s WHERE n > 2)
SELECT way_id, round(mx + (a * vv - b * uv) / det, 3) AS cx, round(my + (b * uu - a * uv) / det, 3) AS cy, round(sqrt(((a * vv - b * uv) / det) ** 2 + ((b * uu - a * uv) / det) ** 2 + (uu + vv) / n), 3) AS radius FROM c WHERE det > 1""")
def circle_fit(spark, sf):
    """Least-squares circles through the points of ways, from sums of products."""
    w = Window.partitionBy("way_id")
    p = B.points(spark, sf).select("way_id", F.avg("x").over(w).alias("mx"), F.avg("y").over(w).alias("my"), "x", "y").withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
    u, v = F.col("u"), F.col("v")
    s = p.groupBy("way_id").agg(F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"), (F.sum(u * (u * u + v * v)) / 2).alias("a"), (F.sum(v * (u * u + v * v)) / 2).alias("b"))
    s = s.withColumn("det", F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")).where("n > 2 and det > 1")
    x, y = (F.col("a") * F.col("vv") - F.col("b") * F.col("uv")) / F.col("det"), (F.col("b") * F.col("uu") - F.col("a") * F.col("uv")) / F.col("det")
    return s.select("way_id", F.round(F.col("mx") + x, 3).alias("cx"), F.round(F.col("my") + y, 3).alias("cy"), F.round(F.sqrt(x * x + y * y + (F.col("uu") + F.col("vv")) / F.col("n")), 3).alias("radius"))


@query("""o AS (SELECT way_id, map_id, prio, start_node AS node, 'out' AS d, (degrees(atan2(ey - sy, ex - sx)) + 360) % 360 AS a FROM (SELECT e.*, prio FROM b_end e JOIN b_way USING (way_id)) WHERE ex <> sx OR ey <> sy
  UNION ALL SELECT way_id, map_id, prio, end_node, 'in', (degrees(atan2(sy - ey, sx - ex)) + 360) % 360 FROM (SELECT e.*, prio FROM b_end e JOIN b_way USING (way_id)) WHERE ex <> sx OR ey <> sy)
SELECT a.way_id AS leaves, b.way_id AS enters FROM o a JOIN o b ON a.map_id = b.map_id AND a.node = b.node AND a.d = 'out' AND b.d = 'in' AND a.way_id <> b.way_id AND a.prio = b.prio
  AND round(least(abs(a.a - b.a), 360 - abs(a.a - b.a)), 6) < 5""")
def one_way_pairs(spark, sf):
    """One-way edges of a class that leave and enter a node within 5 degrees: one road of two directions."""
    e = B.ends(spark, sf).where("ex <> sx or ey <> sy").join(B.ways(spark, sf).select("way_id", "prio"), "way_id")
    out = e.select(F.col("way_id").alias("leaves"), "map_id", "prio", F.col("start_node").alias("node"), P.degrees(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")).alias("a"))
    into = e.select(F.col("way_id").alias("enters"), "map_id", "prio", F.col("end_node").alias("node"), P.degrees(F.col("sx") - F.col("ex"), F.col("sy") - F.col("ey")).alias("b"))
    far = F.abs(F.col("a") - F.col("b"))
    return out.join(into, ["map_id", "prio", "node"]).where("leaves <> enters").where(F.round(F.least(far, 360 - far), 6) < 5).select("leaves", "enters")


@query("""c AS (SELECT s_suppkey AS city, s_suppkey % 50 * 10.0::DOUBLE AS cx, s_suppkey % 37 * 10.0::DOUBLE AS cy FROM supplier),
d AS (SELECT node_id, city, round((x - cx) ** 2 + (y - cy) ** 2, 6) AS far FROM b_node, c) SELECT node_id, arg_min(city, (far, city)) AS city FROM d GROUP BY node_id""")
def nearest_city(spark, sf):
    """Labels nodes with the nearest place of a gazetteer, however far."""
    s = F.col("s_suppkey")
    places = B.load(spark, sf, "supplier").select(s.alias("city"), ((s % 50) * F.lit(10.0)).alias("cx"), ((s % 37) * F.lit(10.0)).alias("cy"))
    return J.nearest_any(B.nodes(spark, sf), places, "node_id", "city", ("x", "y"), ("cx", "cy")).select("node_id", "city")


@query(_COUNTS + """, r AS (SELECT map_id, kind, status, expected - found AS missing FROM s WHERE status <> 'PASS')
SELECT map_id, kind, status, CAST(missing AS BIGINT) AS missing, CAST(row_number() OVER (PARTITION BY status ORDER BY missing DESC, map_id, kind) AS INT) AS place FROM r""")
def issue_index(spark, sf):
    """What isn't a pass, ranked within its status by what is missing."""
    r = coverage_rows(spark, sf).where("status <> 'PASS'").select("map_id", "kind", "status", (F.col("expected") - F.col("found")).alias("missing"))
    # one order of all issues, by ranges; a status begins where its least place is
    placed = L.numbered(r, [F.col("status"), F.desc("missing"), F.col("map_id"), F.col("kind")])
    begins = placed.groupBy("status").agg(F.min("place").alias("begin"))
    return placed.join(F.broadcast(begins), "status").select("map_id", "kind", "status", "missing", (F.col("place") - F.col("begin") + 1).cast("int").alias("place"))


@query(_COUNTS + """, m AS (SELECT map_id, max(CASE status WHEN 'FAIL' THEN 3 WHEN 'WARN' THEN 2 WHEN 'PASS' THEN 1 ELSE 0 END) AS r FROM s GROUP BY map_id)
SELECT CASE r WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARN' WHEN 1 THEN 'PASS' ELSE 'SKIP' END AS result, CAST(count(*) AS BIGINT) AS maps FROM m GROUP BY r""")
def batch_summary(spark, sf):
    """Maps of a batch by their worst status."""
    return coverage_rows(spark, sf).groupBy("map_id").agg(Q.worst(F.col("status")).alias("result")).groupBy("result").agg(F.count("*").alias("maps"))


@query("""n AS (SELECT DISTINCT end_node AS node_id FROM b_end), p AS (SELECT node_id, x, y FROM b_node WHERE node_id IN (SELECT node_id FROM n)),
e AS (SELECT a.node_id AS a, b.node_id AS b FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 10),
w AS (SELECT node_id AS node, node_id AS component FROM p UNION SELECT e.b, w.component FROM w JOIN e ON e.a = w.node), m AS (SELECT node, min(component) AS component FROM w GROUP BY node)
SELECT component, CAST(count(*) AS BIGINT) AS merged, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM m JOIN p ON p.node_id = m.node GROUP BY component""", recursive=True)
def close_intersections(spark, sf):
    """Intersections within 10 m of one another become one at their centre."""
    used = B.ends(spark, sf).select(F.col("end_node").alias("node_id")).distinct()
    p = B.nodes(spark, sf).join(used, "node_id", "left_semi").select(F.col("node_id").alias("src"), "x", "y")
    near = J.epsilon_join(p, p.toDF("dst", "bx", "by"), ("x", "y"), ("bx", "by"), 10.0).where("src < dst").select("src", "dst")
    c = G.components(p.select(F.col("src").alias("node")), near)
    return c.join(p.withColumnRenamed("src", "node"), "node").groupBy("component").agg(F.count("*").alias("merged"), F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"))


@query("""l AS (SELECT lane_id, lane_id // 5 AS road, CASE WHEN lane_id % 4 = 1 THEN 0 ELSE 3 END AS width FROM b_lane), k AS (SELECT lane_id, road, lead(lane_id) OVER (PARTITION BY road ORDER BY lane_id) AS right_lane, lag(lane_id) OVER (PARTITION BY road ORDER BY lane_id) AS left_lane FROM l WHERE width > 0)
SELECT lane_id, left_lane, right_lane FROM k""")
def zero_width_lanes(spark, sf):
    """Lanes without width go, and hand their neighbours to each other."""
    l = B.lanes(spark, sf).select("lane_id", F.expr("lane_id div 5").alias("road")).where("lane_id % 4 <> 1")
    w = Window.partitionBy("road").orderBy("lane_id")
    return l.select("lane_id", F.lag("lane_id").over(w).alias("left_lane"), F.lead("lane_id").over(w).alias("right_lane"))


@query("""SELECT c.way_id, CAST(count(*) AS BIGINT) AS points FROM b_chain c WHERE s0 >= 15 AND s0 <= total - 15 AND total > 30 GROUP BY c.way_id""")
def cropped_polyline(spark, sf):
    """Points that are left of ways when 15 m are cut off at both ends (segment starts)."""
    w = Window.partitionBy("way_id").orderBy("pos")
    seg = B.points(spark, sf).withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).where("x1 is not null").withColumn("d", F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")))
    chain = seg.withColumn("s0", F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total", F.sum("d").over(Window.partitionBy("way_id")))
    return chain.where("s0 >= 15 and s0 <= total - 15 and total > 30").groupBy("way_id").agg(F.count("*").alias("points"))


@query("""l AS (SELECT l.lane_id, a.sx AS asx, a.sy AS asy, a.ex AS aex, a.ey AS aey, b.sx AS bsx, b.sy AS bsy, b.ex AS bex, b.ey AS bey FROM b_lane l JOIN b_end a ON a.way_id = l.left_way JOIN b_end b ON b.way_id = l.right_way),
c AS (SELECT lane_id, sqrt((asx - bsx) ** 2 + (asy - bsy) ** 2) + sqrt((aex - bex) ** 2 + (aey - bey) ** 2) AS same, sqrt((asx - bex) ** 2 + (asy - bey) ** 2) + sqrt((aex - bsx) ** 2 + (aey - bsy) ** 2) AS turned FROM l)
SELECT lane_id, round(same, 6) > round(turned, 6) AS reversed FROM c""")
def boundary_alignment(spark, sf):
    """Whether a lane's right boundary runs against its left one, by the sums of the distances of their ends."""
    e = B.ends(spark, sf).select("way_id", "sx", "sy", "ex", "ey")
    l = B.lanes(spark, sf).select("lane_id", "left_way", "right_way").join(e.toDF("left_way", "asx", "asy", "aex", "aey"), "left_way").join(e.toDF("right_way", "bsx", "bsy", "bex", "bey"), "right_way")
    far = lambda a, b: F.hypot(F.col(f"a{a}x") - F.col(f"b{b}x"), F.col(f"a{a}y") - F.col(f"b{b}y"))
    return l.select("lane_id", (F.round(far("s", "s") + far("e", "e"), 6) > F.round(far("s", "e") + far("e", "s"), 6)).alias("reversed"))


@query(f"""p AS ({_PAIRS}), d AS (SELECT map_id, src, count(*) AS o FROM p GROUP BY map_id, src), i AS (SELECT map_id, dst, count(*) AS n FROM p GROUP BY map_id, dst)
SELECT w.map_id, CAST(coalesce((SELECT count(*) FROM d WHERE d.map_id = w.map_id AND o > 1), 0) AS BIGINT) AS splits, CAST(coalesce((SELECT count(*) FROM i WHERE i.map_id = w.map_id AND n > 1), 0) AS BIGINT) AS merges FROM (SELECT DISTINCT map_id FROM b_end) w""")
def split_merge_counts(spark, sf):
    s = successors(spark, sf)
    out = s.groupBy("map_id", "src").agg(F.count("*").alias("c")).groupBy("map_id").agg(F.count_if(F.col("c") > 1).alias("splits"))
    into = s.groupBy("map_id", "dst").agg(F.count("*").alias("c")).groupBy("map_id").agg(F.count_if(F.col("c") > 1).alias("merges"))
    maps = B.ends(spark, sf).select("map_id").distinct()
    j = maps.join(out, "map_id", "left").join(into, "map_id", "left")
    return j.select("map_id", F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("merges", F.lit(0)).alias("merges"))
