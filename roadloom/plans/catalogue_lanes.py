"""Queries of lanes from roads, repairs of sources, sign texts, raster products and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import frames as FR
from roadloom.functions import signs as S
from roadloom.operators import joins as J
from roadloom.operators import lanes as L
from roadloom.operators import products as PR
from roadloom.operators import quality as Q
from roadloom.operators import raster as R
from roadloom.plans import bridge as B
from roadloom.plans.catalogue import _PAIRS, query, successors
from roadloom.plans.catalogue_more import _CELLS, _LANE_EDGES, ranges
from roadloom.sources import repairs as RE


def by_rest(n: int, values: list) -> Column:
    """A value by the rest of a way's id."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("way_id") % n + 1).cast("int"))


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"


# --- signs and repairs ---------------------------------------------------------------------------

TEXTS = ["DE:274-50", "DE:274.1[30],260", "DE:274[50];DE:206", "DE:y_limit,274:7x", "DE:252[3.5],274:100", "US:R1-1;DE:274.1-20,y_limit", ""]


@query(f"""t AS (SELECT way_id, {sql_list(TEXTS)}[way_id % 7 + 1] AS text FROM b_way), b AS (SELECT way_id, unnest(string_split(text, ';')) AS b FROM t),
s AS (SELECT way_id, unnest(string_split(substr(b, 4), ',')) AS s FROM b), r AS (SELECT way_id, s, CASE WHEN s LIKE '274.1%' THEN substr(s, 6) ELSE substr(s, 5) END AS rest FROM s),
v AS (SELECT way_id, s, try_cast(CASE WHEN rest LIKE '-%' OR rest LIKE ':%' THEN substr(rest, 2) WHEN rest LIKE '[%]%' THEN regexp_extract(rest, '^\\[([^\\]]*)\\]', 1) ELSE rest END AS DOUBLE) AS n FROM r),
e AS (SELECT way_id, CASE WHEN s LIKE '274.1%' THEN 'zone' WHEN s LIKE '274%' THEN 'limit' WHEN s = 'y_limit' THEN 'town' ELSE regexp_extract(s, '^([^\\[]*)', 1) END AS sign,
  CASE WHEN s LIKE '274.1%' THEN n WHEN s LIKE '274%' THEN n / 3.6 WHEN s = 'y_limit' THEN NULL ELSE try_cast(regexp_extract(s, '\\[([^\\]]*)\\]', 1) AS DOUBLE) END AS value FROM v WHERE NOT (s LIKE '274%' AND n IS NULL))
SELECT way_id, sign, CAST(count(*) AS BIGINT) AS signs, round(sum(value), 4) AS value FROM e GROUP BY way_id, sign""")
def traffic_sign_text(spark, sf):
    """Signs and their values from sign texts."""
    t = B.ways(spark, sf).select("way_id", F.explode(S.elements(by_rest(7, TEXTS))).alias("e"))
    return t.groupBy("way_id", F.col("e.sign").alias("sign")).agg(F.count("*").alias("signs"), F.round(F.sum("e.value"), 4).alias("value"))


BANS = ["no_left_turn", "no_straight_on", "no_right_turn", "no_u_turn"]


@query(f"""r AS (SELECT way_id, {sql_list(BANS)}[way_id % 4 + 1] AS a, {sql_list(BANS)}[way_id // 4 % 4 + 1] AS b FROM b_way)
SELECT way_id, 'no_left_turn' IN (a, b) OR ('no_straight_on' IN (a, b) AND way_id % 2 = 0) AS "left", false AS through, 'no_right_turn' IN (a, b) OR ('no_straight_on' IN (a, b) AND way_id % 2 = 1) AS "right" FROM r""")
def turn_bans(spark, sf):
    """Turns that restrictions forbid at forks, where a ban of going straight on is one of the turn to a side."""
    listed = F.array_distinct(F.array(by_rest(4, BANS), F.element_at(F.array(*map(F.lit, BANS)), (F.expr("way_id div 4") % 4 + 1).cast("int"))))
    side = F.when(F.col("way_id") % 2 == 0, "left").otherwise("right")
    return B.ways(spark, sf).select("way_id", S.turn_bans(S.turned_bans(listed, side)).alias("b")).select("way_id", "b.*")


HIGHWAYS, SIGNS = ["stop", "give_way", " yield ", "primary", "service"], [None, "none", "DE:274.1", "DE:206", "DE:205;DE:260", "DE:274.1[30]", " "]


@query(f"""t AS (SELECT way_id, {sql_list(HIGHWAYS)}[way_id % 5 + 1] AS highway, {sql_list(SIGNS)}[way_id % 7 + 1] AS sign, CASE WHEN way_id % 3 > 0 THEN '2' END AS version FROM b_way),
u AS (SELECT *, CASE WHEN sign IS NULL OR lower(trim(sign)) IN ('', 'none', 'unknown') OR sign = 'DE:274.1' THEN NULL ELSE sign END AS kept, CASE WHEN trim(highway) = 'stop' THEN 'DE:206' WHEN trim(highway) IN ('give_way', 'yield') THEN 'DE:205' END AS wanted FROM t),
f AS (SELECT *, CASE WHEN wanted IS NULL OR list_contains(string_split(coalesce(kept, ''), ';'), wanted) THEN kept WHEN kept IS NULL THEN wanted ELSE kept || ';' || wanted END AS full_ FROM u)
SELECT way_id, coalesce(version, '1') AS version, full_ AS traffic_sign, concat_ws(',', CASE WHEN version IS NULL THEN 'version' END, CASE WHEN sign IS NOT NULL AND kept IS NULL THEN 'traffic_sign' END, CASE WHEN full_ IS DISTINCT FROM kept THEN 'priority_sign' END) AS repairs FROM f""")
def osm_repairs(spark, sf):
    """Versions, unreadable signs and signs of stop and give-way tags, repaired in a copy, with the rules that changed it."""
    tags = F.map_filter(F.create_map(F.lit("highway"), by_rest(5, HIGHWAYS), F.lit("traffic_sign"), by_rest(7, SIGNS)), lambda _, v: v.isNotNull())
    rows = B.ways(spark, sf).select("map_id", "way_id", F.when(F.col("way_id") % 3 > 0, "2").alias("version"), tags.alias("tags"))
    return RE.osm_repairs(rows).select("way_id", "version", F.col("tags")["traffic_sign"].alias("traffic_sign"), F.array_join("repairs", ",").alias("repairs"))


@query("""i AS (SELECT DISTINCT c_nationkey AS map_id, CASE WHEN c_custkey % 4 = 0 THEN 'junction' ELSE 'road' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_custkey % 50 AS VARCHAR) END AS id FROM customer),
t AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY CASE WHEN kind = 'road' THEN 0 ELSE 1 END, kind, id) AS k FROM i WHERE try_cast(id AS BIGINT) IS NULL),
n AS (SELECT map_id, unnest(range(1, CAST(count(*) AS BIGINT) + 1)) AS number FROM i GROUP BY map_id),
f AS (SELECT map_id, number, row_number() OVER (PARTITION BY map_id ORDER BY number) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.map_id = n.map_id AND try_cast(i.id AS BIGINT) = n.number))
SELECT t.map_id, kind, id, number FROM t JOIN f ON f.map_id = t.map_id AND f.k = t.k""")
def integer_ids(spark, sf):
    """Numbers for ids of roads and junctions that aren't integers, none of them taken in the map."""
    c = B.load(spark, sf, "customer")
    k = F.col("c_custkey")
    ids = c.select(F.col("c_nationkey").alias("map_id"), F.when(k % 4 == 0, "junction").otherwise("road").alias("kind"), F.when(k % 3 == 0, F.col("c_name")).otherwise((k % 50).cast("string")).alias("id"))
    return RE.integer_ids(ids)


@query("""g AS (SELECT way_id, ['line', 'arc', 'spiral', 'spiral'][way_id % 4 + 1] AS kind, way_id % 3 * 0.01::DOUBLE AS a, CASE WHEN way_id % 5 = 0 THEN 0.02 ELSE way_id % 3 * 0.01 END::DOUBLE AS b FROM b_way)
SELECT way_id, CASE WHEN kind = 'arc' AND abs(a) <= 1e-9 THEN 'line' WHEN kind = 'spiral' AND abs(a - b) <= 1e-9 THEN CASE WHEN abs(a) <= 1e-9 THEN 'line' ELSE 'arc' END ELSE kind END AS kind FROM g""")
def plain_geometry(spark, sf):
    """Arcs without curvature and constant spirals as lines and arcs."""
    w = F.col("way_id")
    a = (w % 3) * F.lit(0.01)
    return B.ways(spark, sf).select("way_id", RE.plain_geometry(by_rest(4, ["line", "arc", "spiral", "spiral"]), a, F.when(w % 5 == 0, F.lit(0.02)).otherwise(a)).alias("kind"))


@query("""c AS (SELECT p.way_id, pos, CASE WHEN (p.way_id + pos) % 6 > 0 THEN x - sx END AS u, y - sy AS v FROM b_pt p JOIN b_end e USING (way_id))
SELECT way_id, CAST(count(u) AS BIGINT) AS corners, round(sum(u), 4) AS u, round(sum(v) FILTER (WHERE u IS NOT NULL), 4) AS v FROM c GROUP BY way_id HAVING count(u) >= 4""")
def crosswalk_outlines(spark, sf):
    """Crosswalks' corners from along the road to their own place; crosswalks of fewer than four corners go."""
    p = B.points(spark, sf).withColumn("s", F.when((F.col("way_id") + F.col("pos")) % 6 > 0, F.col("x")))
    o = p.groupBy("way_id").agg(F.collect_list(F.struct("s", F.col("y").alias("t"), F.lit(None).cast("double").alias("dz"))).alias("corners"))
    o = o.join(B.ends(spark, sf).select("way_id", "sx", "sy"), "way_id").withColumn("c", RE.local_corners(F.col("corners"), F.col("sx"), F.col("sy"))).where(RE.usable_crosswalk(F.col("c")))
    total = lambda k: F.round(F.aggregate("c", F.lit(0.0), lambda a, e: a + e[k]), 4)
    return o.select("way_id", F.size("c").cast("long").alias("corners"), total("u").alias("u"), total("v").alias("v"))


# --- lanes ---------------------------------------------------------------------------------------


@query("""r AS (SELECT way_id AS road, CAST(way_id % 3 + 1 AS INT) AS f, CAST(way_id % 4 AS INT) AS b FROM b_way), l AS (SELECT *, CAST(unnest(range(f + b)) AS INT) AS place FROM r)
SELECT road, place, place >= b AS forward, CASE WHEN place >= b AND f > 1 THEN ['left', 'through', 'right'][place - b + 1] ELSE 'none' END AS turn,
  CASE WHEN place > b OR (place = b AND b > 0) THEN place - 1 WHEN place < b AND place < f + b - 1 THEN place + 1 ELSE -1 END AS "left", CASE WHEN place >= b THEN CASE WHEN place < f + b - 1 THEN place + 1 ELSE -1 END WHEN place > 0 THEN place - 1 ELSE -1 END AS "right",
  CASE WHEN place > b THEN true WHEN place = b THEN false ELSE place < b - 1 END AS left_same, round((place - (f + b - 1) / 2.0) * 3.5, 4) AS "offset" FROM l""")
def generated_lanes(spark, sf):
    """Lanes of roads with their neighbours (-1 for none), turns and distances from the middle."""
    w = F.col("way_id")
    forward, back = (w % 3 + 1).cast("int"), (w % 4).cast("int")
    turns = F.when(forward > 1, F.slice(F.array(*map(F.lit, ("left", "through", "right"))), F.lit(1), forward))
    roads = B.ways(spark, sf).select(w.alias("road"), forward.alias("forward_lanes"), back.alias("backward_lanes"), turns.alias("turns_forward"), F.lit(None).cast("array<string>").alias("turns_backward"))
    rows = L.generated(roads, 3.5).withColumn("offset", F.round("offset", 4))
    return rows.withColumns({"left": F.coalesce("left", F.lit(-1)), "right": F.coalesce("right", F.lit(-1)), "left_same": F.coalesce("left_same", F.lit(False))})


@query(f"""p AS (SELECT DISTINCT src, dst FROM ({_PAIRS})), c AS (SELECT src, dst, CAST(src % 4 AS INT) AS i, CAST(dst % 4 AS INT) AS o, CASE WHEN src % 5 = 0 THEN 'slight_left' ELSE 'none' END AS li, CASE WHEN dst % 3 = 0 THEN 'right' ELSE 'none' END AS lo FROM p WHERE src % 4 > 0 AND dst % 4 > 0),
m AS (SELECT *, NOT ((i > o AND li LIKE '%left%') OR (i < o AND lo LIKE '%right%')) AS at_left FROM c), k AS (SELECT *, CAST(unnest(range(greatest(i, o))) AS INT) AS k FROM m)
SELECT src, dst, CASE WHEN i >= o THEN k WHEN at_left THEN greatest(k - (o - i), 0) ELSE least(k, i - 1) END AS lane, CASE WHEN o >= i THEN k WHEN at_left THEN greatest(k - (i - o), 0) ELSE least(k, o - 1) END AS next_lane FROM k""")
def linked_lanes(spark, sf):
    """Lanes that are joined where one road goes on in another, with lanes that come or go at one side."""
    p = successors(spark, sf).select("src", "dst").distinct()
    s, d = F.col("src"), F.col("dst")
    pairs = p.select(F.struct("src", "dst").alias("link"), (s % 4).cast("int").alias("incoming"), (d % 4).cast("int").alias("outgoing"), F.when(s % 5 == 0, "slight_left").otherwise("none").alias("last_in"), F.when(d % 3 == 0, "right").otherwise("none").alias("last_out"))
    return L.linked(pairs).select("link.src", "link.dst", F.col("src").alias("lane"), F.col("dst").alias("next_lane"))


_ENDS2 = """z AS (SELECT way_id, arg_min(x, pos) AS sx, arg_min(y, pos) AS sy, arg_min(x1, pos) AS sx1, arg_min(y1, pos) AS sy1, arg_max(x1, pos) AS ex, arg_max(y1, pos) AS ey, arg_max(x, pos) AS ex1, arg_max(y, pos) AS ey1 FROM (SELECT way_id, pos, x0 AS x, y0 AS y, x1, y1 FROM b_seg) GROUP BY way_id)"""


@query(_ENDS2 + """, p AS (SELECT a.way_id AS src, b.way_id AS dst, a.ex AS x1, a.ey AS y1, b.sx AS x4, b.sy AS y4, a.ex - a.ex1 AS ax, a.ey - a.ey1 AS ay, b.sx - b.sx1 AS bx, b.sy - b.sy1 AS by_ FROM z a JOIN z b ON b.way_id = a.way_id + 1),
d AS (SELECT *, sqrt((x1 - x4) ** 2 + (y1 - y4) ** 2) AS far, sqrt(ax ** 2 + ay ** 2) AS sa, sqrt(bx ** 2 + by_ ** 2) AS sb FROM p),
w AS (SELECT *, ax / nullif(sa, 0) * far * 0.35 AS wx, ay / nullif(sa, 0) * far * 0.35 AS wy, bx / nullif(sb, 0) * far * 0.35 AS vx, by_ / nullif(sb, 0) * far * 0.35 AS vy FROM d),
c AS (SELECT *, wy * vx - wx * vy AS cr, (vy * (x1 - x4) - vx * (y1 - y4)) / nullif(wy * vx - wx * vy, 0) AS s1, (wy * (x1 - x4) - wx * (y1 - y4)) / nullif(wy * vx - wx * vy, 0) AS s2 FROM w),
m AS (SELECT *, x1 + wx * s1 AS mx, y1 + wy * s1 AS my FROM c), n AS (SELECT *, least(sqrt((mx - x1) ** 2 + (my - y1) ** 2), sqrt((mx - x4) ** 2 + (my - y4) ** 2)) AS near FROM m),
k AS (SELECT *, CASE WHEN far < 1e-9 OR sa < 1e-9 OR sb < 1e-9 THEN 'straight' WHEN abs(cr) > 1e-9 AND s1 > 0 AND s2 > 0 AND (near > 1 OR near / far > 0.1) THEN 'quadratic' ELSE 'cubic' END AS kind FROM n)
SELECT src, dst, kind, round(CASE kind WHEN 'straight' THEN (x1 + x4) / 2 WHEN 'quadratic' THEN (x1 + 2 * mx + x4) / 4 ELSE (x1 + 3 * (x1 + wx) + 3 * (x4 + vx) + x4) / 8 END, 3) AS x, round(CASE kind WHEN 'straight' THEN (y1 + y4) / 2 WHEN 'quadratic' THEN (y1 + 2 * my + y4) / 4 ELSE (y1 + 3 * (y1 + wy) + 3 * (y4 + vy) + y4) / 8 END, 3) AS y FROM k""")
def link_courses(spark, sf):
    """Curves between the ends of one way and the start of the next, at their middle."""
    l = F.col("line")
    z = B.lines(spark, sf).select("way_id", l[0].alias("s"), l[1].alias("s1"), F.element_at(l, -1).alias("e"), F.element_at(l, -2).alias("e1"))
    a = z.select(F.col("way_id").alias("src"), F.col("e").alias("p1"), F.col("e1").alias("a"), (F.col("way_id") + 1).alias("dst"))
    b = z.select(F.col("way_id").alias("dst"), F.col("s").alias("p4"), F.col("s1").alias("b"))
    c = a.join(b, "dst").withColumn("course", L.link_course(F.col("p1"), F.col("a"), F.col("p4"), F.col("b")))
    c = c.withColumn("m", L.course_point(F.col("p1"), F.col("course"), F.col("p4"), 0.5))
    return c.select("src", "dst", F.col("course.kind").alias("kind"), F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


@query("""t AS (SELECT way_id // 5 AS road, 'kind' AS key, kind AS value FROM b_way UNION ALL SELECT way_id // 5, 'prio', prio FROM b_way WHERE way_id % 2 = 0 OR prio < '4' UNION ALL SELECT way_id // 5, 'map', CAST(map_id AS VARCHAR) FROM b_way),
n AS (SELECT way_id // 5 AS road, count(*) AS n FROM b_way GROUP BY road) SELECT road, key, min(value) AS value FROM t JOIN n USING (road) GROUP BY road, key HAVING count(*) = any_value(n) AND count(DISTINCT value) = 1""")
def common_tags(spark, sf):
    """Tags that all lanes of a road agree on."""
    w = B.ways(spark, sf)
    tags = F.map_filter(F.create_map(F.lit("kind"), F.col("kind"), F.lit("prio"), F.when((F.col("way_id") % 2 == 0) | (F.col("prio") < "4"), F.col("prio")), F.lit("map"), F.col("map_id").cast("string")), lambda _, v: v.isNotNull())
    return L.common_tags(w.select(F.expr("way_id div 5").alias("road"), tags.alias("tags")), "road")


@query(f"""e AS (SELECT src, dst, 'right' AS role FROM ({_LANE_EDGES}) UNION ALL SELECT dst, src, 'left' FROM ({_LANE_EDGES}) UNION ALL SELECT src, dst, 'successor' FROM ({_PAIRS}))
SELECT src, role, array_to_string(list_sort(list(DISTINCT dst)), ' ') AS neighbours FROM e GROUP BY src, role""")
def adjacency_lists(spark, sf):
    """Sorted neighbours of each lane by role."""
    e = J.lateral_adjacency(B.lanes(spark, sf)).unionByName(successors(spark, sf).select("src", "dst", F.lit("successor").alias("role")))
    return L.adjacency_lists(e).select("src", "role", F.array_join(F.transform("neighbours", lambda n: n.cast("string")), " ").alias("neighbours"))


_GRAPH = """g AS (SELECT node_id AS node, x, y FROM b_node), ed AS (SELECT DISTINCT start_node AS src, end_node AS dst FROM b_end WHERE way_id % 3 = 0),
s AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed)"""


@query(_GRAPH + """, w AS (SELECT arg_min(node, (round(sqrt(x * x + y * y), 6), node)) AS node FROM g UNION SELECT s.dst FROM w JOIN s ON s.src = w.node) SELECT node FROM w""", recursive=True)
def reachable_from_centre(spark, sf):
    """Nodes of a road graph that are joined to its most central one."""
    nodes = B.nodes(spark, sf).select(F.col("node_id").alias("node"), "x", "y")
    edges = B.ends(spark, sf).where("way_id % 3 = 0").select(F.col("start_node").alias("src"), F.col("end_node").alias("dst")).distinct()
    return L.reachable(nodes, edges).select("node")


@query(f"""e AS ({_LANE_EDGES}), c AS (SELECT lane_id AS lane, min(lane_id) OVER (PARTITION BY lane_id // 5) AS road FROM b_lane), f AS (SELECT DISTINCT dst FROM ({_PAIRS})),
s AS (SELECT road, bool_or(dst IS NULL) AS seed FROM c LEFT JOIN f ON f.dst = c.lane GROUP BY road), n AS (SELECT road, row_number() OVER (ORDER BY seed DESC, road) AS place FROM s)
SELECT lane, road, CAST(place AS BIGINT) AS place FROM c JOIN n USING (road)""")
def road_groups(spark, sf):
    """Roads of lanes side by side, those that begin somewhere first."""
    lanes = B.lanes(spark, sf)
    return L.road_groups(lanes.select(F.col("lane_id").alias("lane")), J.lateral_adjacency(lanes).select("src", "dst"), successors(spark, sf).select("src", "dst"))


# --- raster products and inventories -------------------------------------------------------------

_LAYERS = _CELLS + ", y AS (SELECT map_id, row, col, bits AS drivable, CASE WHEN (row + col) % 5 = 0 THEN 1 ELSE 0 END AS boundary, CASE WHEN (row * 3 + col) % 7 = 0 THEN 1 ELSE 0 END AS centerline, CASE WHEN (row + col) % 31 = 0 THEN 1 ELSE 0 END AS anchor, CASE WHEN map_id % 9 = 0 AND row = 3 THEN 1 ELSE 0 END AS occupied FROM g)"


def layers(spark, sf) -> DataFrame:
    """(map_id, row, col, layers): without the ways' numbers, so equal pieces of ways are one."""
    one = lambda test: F.when(test, 1).otherwise(0)
    r, c = F.col("row"), F.col("col")
    cells = R.painted(ranges(spark, sf), ["bits"], [])
    return cells.select("map_id", "row", "col", F.col("bits").alias("drivable"), one((r + c) % 5 == 0).alias("boundary"), one((r * 3 + c) % 7 == 0).alias("centerline"), one((r + c) % 31 == 0).alias("anchor"), one((F.col("map_id") % 9 == 0) & (r == 3)).alias("occupied"))


@query(_LAYERS + " SELECT map_id, CASE WHEN anchor > 0 THEN 'anchor' WHEN centerline > 0 THEN 'centerline' WHEN boundary > 0 THEN 'boundary' WHEN drivable > 0 THEN 'drivable' ELSE 'none' END AS layer, CAST(count(*) AS BIGINT) AS cells FROM y GROUP BY ALL")
def raster_preview(spark, sf):
    """Cells of each colour of a map's preview."""
    return layers(spark, sf).groupBy("map_id", PR.preview(*(F.col(c) for c in ("drivable", "boundary", "centerline", "anchor"))).alias("layer")).agg(F.count("*").alias("cells"))


@query(_LAYERS + " SELECT map_id, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (WHERE (drivable > 0) <> (occupied > 0)) AS BIGINT) AS matching, CASE WHEN count(*) = count(*) FILTER (WHERE (drivable > 0) <> (occupied > 0)) THEN 'PASS' ELSE 'FAIL' END AS status FROM y GROUP BY map_id")
def raster_consistency(spark, sf):
    return PR.consistent(layers(spark, sf))


@query(_LAYERS + " SELECT map_id, CAST(count(*) FILTER (WHERE drivable > 0) AS BIGINT) AS drivable, CAST(count(*) FILTER (WHERE centerline > 0) AS BIGINT) AS centerline, CAST(count(*) FILTER (WHERE anchor > 0) AS BIGINT) AS anchor, CASE WHEN bool_or(drivable > 0) AND bool_or(centerline > 0) AND bool_or(anchor > 0) THEN 'PASS' ELSE 'FAIL' END AS status FROM y GROUP BY map_id")
def raster_layers(spark, sf):
    """Layers that have no cell."""
    return PR.populated(layers(spark, sf), ["drivable", "centerline", "anchor"])


_KEYS = """s AS (SELECT map_id, way_id AS key FROM b_way WHERE kind <> 'P'), t AS (SELECT map_id, way_id AS key FROM b_way WHERE (kind <> 'P' AND map_id % 4 <> 1 AND NOT (map_id % 5 = 0 AND way_id % 7 = 0)) OR (map_id % 6 = 2 AND kind = 'P')),
c AS (SELECT map_id, count(*) AS expected FROM s GROUP BY map_id), d AS (SELECT map_id, count(*) AS actual FROM t GROUP BY map_id),
i AS (SELECT map_id, expected, coalesce(actual, 0) AS actual, (SELECT count(*) FROM s WHERE s.map_id = c.map_id AND NOT EXISTS (SELECT 1 FROM t WHERE t.map_id = s.map_id AND t.key = s.key)) AS missing,
  (SELECT count(*) FROM t WHERE t.map_id = c.map_id AND NOT EXISTS (SELECT 1 FROM s WHERE s.map_id = t.map_id AND s.key = t.key)) AS extra FROM c LEFT JOIN d USING (map_id))"""


@query(_KEYS + " SELECT map_id, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, CAST(missing AS BIGINT) AS missing, CAST(extra AS BIGINT) AS extra, CASE WHEN expected > 0 AND actual = 0 THEN 'FAIL' WHEN missing > 0 THEN 'FAIL' WHEN extra > 0 THEN 'WARN' WHEN actual < greatest(1, floor(expected * 0.35)) THEN 'WARN' ELSE 'PASS' END AS status FROM i")
def lane_inventory(spark, sf):
    """Lanes of a source that its target names, and names without a lane."""
    w = B.ways(spark, sf).select("map_id", F.col("way_id").alias("key"), "kind")
    m = F.col("map_id")
    kept = ((F.col("kind") != "P") & (m % 4 != 1) & ~((m % 5 == 0) & (F.col("key") % 7 == 0))) | ((m % 6 == 2) & (F.col("kind") == "P"))
    return Q.inventory(w.where("kind <> 'P'").select("map_id", "key"), w.where(kept).select("map_id", "key"))


@query("""l AS (SELECT l_orderkey AS link, l_partkey AS road, l_linenumber AS lane, CASE WHEN (l_partkey + l_linenumber) % 37 = 0 THEN -1 ELSE l_suppkey END AS other FROM lineitem), r AS (SELECT p_partkey AS road FROM part WHERE p_partkey % 41 > 0), o AS (SELECT s_suppkey AS other FROM supplier)
SELECT road, CAST(count(*) AS BIGINT) AS links, CAST(count(*) FILTER (WHERE NOT known OR not other_known) AS BIGINT) AS unresolved, CASE WHEN bool_or(NOT known OR NOT other_known) THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT l.road, r.road IS NOT NULL AS known, o.other IS NOT NULL AS other_known FROM l LEFT JOIN r ON r.road = l.road LEFT JOIN o ON o.other = l.other) GROUP BY road""")
def link_integrity(spark, sf):
    """Lane links whose incoming or connecting road isn't there."""
    l = B.load(spark, sf, "lineitem").select(F.col("l_partkey").alias("road"), F.when((F.col("l_partkey") + F.col("l_linenumber")) % 37 == 0, F.lit(-1).cast("long")).otherwise(F.col("l_suppkey")).alias("other"))
    roads = B.load(spark, sf, "part").where("p_partkey % 41 > 0").select(F.col("p_partkey").alias("road"))
    others = B.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("other"))
    return Q.link_integrity(l, roads, others)


@query("""s AS (SELECT user_id % 20 AS map_id, event_type AS category, count(*) AS expected FROM events GROUP BY ALL), t AS (SELECT user_id % 20 AS map_id, event_type AS category, count(*) AS found FROM events WHERE value > 95 AND event_type <> 'view' GROUP BY ALL)
SELECT s.map_id, CAST(count(*) AS BIGINT) AS categories, CAST(count(*) FILTER (WHERE found IS NULL) AS BIGINT) AS missing, CASE WHEN bool_or(found IS NULL) THEN 'WARN' ELSE 'PASS' END AS status FROM s LEFT JOIN t ON t.map_id = s.map_id AND t.category = s.category GROUP BY s.map_id""")
def signal_categories(spark, sf):
    """Categories of signals that a source has and nothing in its target carries."""
    e = B.load(spark, sf, "events").select((F.col("user_id") % 20).alias("map_id"), F.col("event_type").alias("category"), "value")
    return Q.carriers(e, e.where("value > 95 and category <> 'view'"))


@query("""c AS (SELECT map_id, kind, count(*) AS expected, count(*) FILTER (WHERE way_id % (3 + map_id) > 0) AS found FROM b_way GROUP BY map_id, kind)
SELECT map_id, kind, CAST(found AS BIGINT) AS found, CAST(expected AS BIGINT) AS expected, CASE WHEN found >= expected THEN 'PASS' WHEN found >= 0.95 * expected THEN 'WARN' ELSE 'FAIL' END AS status FROM c""")
def coverage_grades(spark, sf):
    """Elements of a source that its target covers: all of them, nearly all, or fewer."""
    c = B.ways(spark, sf).groupBy("map_id", "kind").agg(F.count_if(F.col("way_id") % (F.col("map_id") + 3) > 0).alias("found"), F.count("*").alias("expected"))
    return c.withColumn("status", Q.graded(F.col("found"), F.col("expected")))


# --- frames, signs near lanes, borders that coincide ---------------------------------------------

KINDS, NAMES = ["geographic", "projected", "engineering", "geographic", "engineering"], [None, "site", "yard"]


@query(f"""f AS (SELECT way_id, map_id, 11 + sx / 1000 AS lon, 48 + sy / 10000 AS lat, {sql_list(KINDS)}[way_id % 5 + 1] AS a, {sql_list(KINDS)}[way_id // 5 % 5 + 1] AS b, {sql_list(NAMES)}[way_id % 3 + 1] AS ia, {sql_list(NAMES)}[map_id % 3 + 1] AS ib FROM b_end),
h AS (SELECT *, CASE WHEN a = b AND a <> 'engineering' AND ia IS NOT DISTINCT FROM ib THEN 'identity' WHEN a = 'engineering' AND b = 'engineering' AND ia IS NOT DISTINCT FROM ib THEN 'identity' WHEN a = 'geographic' AND b = 'projected' THEN 'project' ELSE 'refused' END AS how FROM f)
SELECT how, CAST(count(*) AS BIGINT) AS points, round(min(CASE WHEN how = 'identity' THEN lon END), 4) AS least FROM h GROUP BY how""")
def frame_transform(spark, sf):
    """How points get from one frame to another, or that there is no way."""
    w = F.col("way_id")
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    frame = lambda kind, name: F.struct(kind.alias("kind"), name.alias("id"), F.lit(32).alias("zone"), F.lit(False).alias("south"))
    e = B.ends(spark, sf).select((F.lit(11.0) + F.col("sx") / 1000).alias("lon"), (F.lit(48.0) + F.col("sy") / 10000).alias("lat"), frame(of(KINDS, w % 5), of(NAMES, w % 3)).alias("a"), frame(of(KINDS, F.expr("way_id div 5") % 5), of(NAMES, F.col("map_id") % 3)).alias("b"))
    h = e.select("lon", FR.how(F.col("a"), F.col("b")).alias("how"), FR.transformed(F.col("lon"), F.col("lat"), F.col("a"), F.col("b"), strict=False).alias("p"))
    return h.groupBy("how").agg(F.count("*").alias("points"), F.round(F.min(F.when(F.col("how") == "identity", F.col("p.x"))), 4).alias("least"))


@query("""s AS (SELECT s_suppkey AS sign, s_suppkey % 50 * 10.0::DOUBLE + 1 AS px, s_suppkey % 37 * 10.0::DOUBLE + 2 AS py FROM supplier), d AS (SELECT way_id, sign, round(sqrt((sx - px) ** 2 + (sy - py) ** 2), 6) AS far FROM b_end, s)
SELECT way_id, arg_min(sign, (far, sign)) AS sign, min(far) AS distance FROM d GROUP BY way_id""")
def nearest_sign(spark, sf):
    """The sign nearest to each lane's start, however far."""
    k = F.col("s_suppkey")
    s = B.load(spark, sf, "supplier").select(k.alias("sign"), ((k % 50) * F.lit(10.0) + 1).alias("px"), ((k % 37) * F.lit(10.0) + 2).alias("py"))
    return J.nearest_any(B.starts(spark, sf), s, "way_id", "sign", ("x", "y"), ("px", "py"), unique=True)


@query("""c AS (SELECT l.lane_id FROM b_lane l JOIN b_n a ON a.way_id = l.left_way JOIN b_n b ON b.way_id = l.right_way)
SELECT lane_id AS lane, 'left' AS side, lane_id - 1 AS other, true AS same_direction FROM c WHERE lane_id - 1 IN (SELECT lane_id FROM c) AND lane_id % 5 > 0 AND lane_id % 3 > 0
UNION ALL SELECT lane_id - 1, 'right', lane_id, true FROM c WHERE lane_id - 1 IN (SELECT lane_id FROM c) AND lane_id % 5 > 0 AND lane_id % 3 > 0""")
def coincident_adjacency(spark, sf):
    """Lanes beside one another by borders that are drawn twice, the copies 1 mm apart, or 10 cm for each third."""
    w = F.col("way_id")
    e = B.lines(spark, sf)
    # the nodes of a border are its own, so that only its two copies share them
    drawn = lambda name, line: e.select(F.concat(F.lit(name), w.cast("string")).alias("border"), F.concat(w.cast("string"), F.lit("s")).alias("start_node"), F.concat(w.cast("string"), F.lit("e")).alias("end_node"), line.alias("line"))
    off = F.when(w % 3 == 0, 0.1).otherwise(0.001)
    moved = F.transform("line", lambda p: F.struct(p["x"].alias("x"), (p["y"] + off).alias("y")))
    lanes = B.lanes(spark, sf).where("right_way is not null")
    both = lanes.join(e.select(w.alias("left_way")), "left_way", "left_semi").join(e.select(w.alias("right_way")), "right_way", "left_semi")
    named = both.select(F.col("lane_id").alias("lane"), F.concat(F.lit("l"), F.col("left_way").cast("string")).alias("left"), F.concat(F.lit("r"), F.col("right_way").cast("string")).alias("right"))
    return J.coincident_adjacency(named, drawn("l", moved).unionAll(drawn("r", F.col("line"))), 0.01)
