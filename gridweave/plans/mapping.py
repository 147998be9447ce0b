"""Map queries: features, rooms, paths, audits, pins, archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import fixtures as fx
from gridweave.functions import labels
from gridweave.operators import dataset as ds
from gridweave.operators import grid as g
from gridweave.operators import maps as mp
from gridweave.plans.corpus import BIG, R6
from gridweave.plans.registry import query

M = fx.MAP_SQL
R = "WITH RECURSIVE " + M


def cells(spark, d):
    return mp.with_affordance(fx.map_cells(spark, d), fx.affordances(spark))


ROOM_SQL = """,
wk AS (SELECT map_id, x, y, y * 100 + x AS id FROM acell WHERE aff = 'walkable'),
nb AS (SELECT a.map_id, a.id AS a, b.id AS b FROM wk a JOIN wk b ON a.map_id = b.map_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
fl(map_id, a, b) AS (SELECT map_id, id, id FROM wk UNION SELECT fl.map_id, fl.a, nb.b FROM fl JOIN nb ON nb.map_id = fl.map_id AND nb.a = fl.b),
lbl AS (SELECT map_id, a AS id, min(b) AS room FROM fl GROUP BY ALL),
rs AS (SELECT map_id, room, count(*) AS k FROM lbl GROUP BY ALL),
rm AS (SELECT d.map_id, count(room) AS room_count, coalesce(max(k), 0) AS largest_room, coalesce(sum(k), 0)::bigint AS walkable FROM dims d LEFT JOIN rs USING (map_id) GROUP BY ALL)
"""
FEAT = M + ROOM_SQL + """,
lay AS (SELECT map_id, any_value(w) AS w, any_value(h) AS h, count(*) FILTER (aff = 'obstacle') / count(*)::double AS wall_ratio, count(*) FILTER (aff = 'walkable') / count(*)::double AS walkable_ratio,
  sum(bw) FILTER (aff = 'obstacle') / sum(bw)::double AS border_solidity FROM (SELECT *, (y = 0)::int + (y = h - 1)::int + CASE WHEN y > 0 AND y < h - 1 THEN (x = 0)::int + (x = w - 1)::int ELSE 0 END AS bw FROM acell JOIN dims USING (map_id)) GROUP BY map_id),
tr AS (SELECT a.map_id, count(*) FILTER (a.base <> b.base) AS transition_count FROM cell a JOIN cell b ON a.map_id = b.map_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY ALL),
mf AS (SELECT map_id, w, h, wall_ratio, walkable_ratio, coalesce(border_solidity, 0) AS border_solidity, coalesce(transition_count, 0) AS transition_count, room_count, largest_room, walkable,
  CASE WHEN walkable > 0 THEN largest_room / walkable::double ELSE 0 END AS connectivity, 'theme' || map_id % 4 AS theme, 1 + 0.5 * CASE WHEN walkable > 0 THEN largest_room / walkable::double ELSE 0 END AS quality
  FROM lay LEFT JOIN tr USING (map_id) JOIN rm USING (map_id)),
ml AS (SELECT *, 'theme:' || theme || ', size:' || w || 'x' || h || ', layout:' || CASE WHEN wall_ratio < 0.3 THEN 'open' WHEN wall_ratio < 0.6 THEN 'mixed' ELSE 'dense' END
  || ', rooms:' || CASE WHEN room_count <= 1 THEN 'single' WHEN room_count <= 3 THEN 'few' WHEN room_count <= 6 THEN 'several' ELSE 'many' END
  || ', border:' || CASE WHEN border_solidity > 0.8 THEN 'enclosed' WHEN border_solidity > 0.4 THEN 'partial' ELSE 'open' END AS label FROM mf)"""
WF = "WITH RECURSIVE " + FEAT


def measured(spark, d):
    return mp.map_quality(mp.map_features(cells(spark, d))).withColumn("theme", F.concat(F.lit("theme"), (F.col("map_id") % 4).cast("string")))


@query("map_features", WF + " SELECT map_id, round(wall_ratio, 6) AS wall_ratio, round(walkable_ratio, 6) AS walkable_ratio, room_count, largest_room, round(border_solidity, 6) AS border_solidity, transition_count FROM mf")
def map_features(spark, d):
    f = mp.map_features(cells(spark, d))
    return f.select("map_id", R6("wall_ratio"), R6("walkable_ratio"), BIG("room_count"), BIG("largest_room"), R6("border_solidity"), BIG("transition_count"))


@query("map_rooms", R + ROOM_SQL + " SELECT map_id, room_count, largest_room, walkable FROM rm")
def map_rooms(spark, d):
    return mp.rooms(cells(spark, d)).select("map_id", BIG("room_count"), BIG("largest_room"), BIG("walkable"))


@query("map_rooms_join", R + ROOM_SQL + " SELECT map_id, room_count, largest_room, walkable FROM rm")
def map_rooms_join(spark, d):
    return mp.rooms(cells(spark, d), "join").select("map_id", BIG("room_count"), BIG("largest_room"), BIG("walkable"))


@query("path_connectivity", WF + " SELECT map_id, round(connectivity, 6) AS connectivity FROM mf")
def path_connectivity(spark, d):
    return mp.connectivity(mp.rooms(cells(spark, d))).select("map_id", R6("connectivity"))


@query("map_quality", WF + " SELECT map_id, round(quality, 6) AS quality, round(wall_ratio, 6) AS wall_ratio, room_count::double AS room_count FROM mf")
def map_quality(spark, d):
    return measured(spark, d).select("map_id", R6("quality"), R6("wall_ratio"), "room_count")


@query("map_label", WF + " SELECT map_id, label FROM ml")
def map_label(spark, d):
    return measured(spark, d).select("map_id", labels.map_label().alias("label"))


@query("path_check", R + ROOM_SQL + """, pth AS (SELECT map_id, o_orderkey AS path_id, o_orderkey % 12 AS fx, (o_orderkey % 96) // 12 AS fy, o_custkey % 13 AS tx, o_custkey % 9 AS ty FROM (SELECT *, o_orderkey // 96 AS map_id FROM orders)),
st AS (SELECT DISTINCT map_id, path_id, room FROM (SELECT map_id, path_id, fx + dx AS x, fy + dy AS y FROM pth, (VALUES (0, 0), (0, -1), (0, 1), (-1, 0), (1, 0)) v(dx, dy)) s JOIN wk USING (map_id, x, y) JOIN lbl USING (map_id, id)),
gl AS (SELECT pth.map_id, path_id, room FROM pth JOIN wk ON wk.map_id = pth.map_id AND wk.x = tx AND wk.y = ty JOIN lbl ON lbl.map_id = wk.map_id AND lbl.id = wk.id)
SELECT path_id, (fx = tx AND fy = ty) OR EXISTS (SELECT 1 FROM st JOIN gl USING (map_id, path_id, room) WHERE st.path_id = pth.path_id) AS reachable FROM pth""")
def path_check(spark, d):
    o = fx.table(spark, d, "orders")
    paths = o.select(F.expr("o_orderkey div 96").alias("map_id"), F.col("o_orderkey").alias("path_id"), (F.col("o_orderkey") % 12).alias("fx"),
                     F.expr("(o_orderkey % 96) div 12").alias("fy"), (F.col("o_custkey") % 13).alias("tx"), (F.col("o_custkey") % 9).alias("ty"))
    return mp.path_ok(cells(spark, d), paths).select("path_id", "reachable")


@query("prompt_label", """WITH p AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, 'theme:t, size:12x8, layout:' || CASE WHEN t LIKE '%open%' OR t LIKE '%spacious%' OR t LIKE '%wide%' OR t LIKE '%empty%' OR t LIKE '%field%' THEN 'open' WHEN t LIKE '%dense%' OR t LIKE '%tight%' OR t LIKE '%maze%' OR t LIKE '%narrow%' OR t LIKE '%packed%' THEN 'dense' ELSE 'mixed' END
 || ', rooms:' || CASE WHEN t LIKE '%single%' OR t LIKE '%one room%' OR t LIKE '%1 room%' OR t LIKE '%arena%' THEN 'single' WHEN t LIKE '%many%' OR t LIKE '%lots%' OR t LIKE '%complex%' OR t LIKE '%labyrinth%' THEN 'many' WHEN t LIKE '%few%' OR t LIKE '%2%' OR t LIKE '%3%' OR t LIKE '%couple%' THEN 'few' ELSE 'several' END
 || ', border:' || CASE WHEN t LIKE '%enclosed%' OR t LIKE '%walled%' OR t LIKE '%dungeon%' OR t LIKE '%indoor%' THEN 'enclosed' WHEN t LIKE '%open border%' OR t LIKE '%outdoor%' OR t LIKE '%field%' THEN 'open' ELSE 'partial' END AS label FROM p""")
def prompt_label(spark, d):
    p = fx.table(spark, d, "conversations").where("role = 'user'")
    return p.select("conv_id", "turn", labels.prompt_label(F.col("text"), F.lit("t"), F.lit("12x8")).alias("label"))


# --- audits: maps over the part tilesets --------------------------------------
def part_cells(spark, d):
    """Each map uses one tileset of parts; the customer picks the tile."""
    sets = fx.table(spark, d, "part").count() // 100  # from the Parquet footers
    o = fx.table(spark, d, "orders")
    return o.select(F.expr("o_orderkey div 96").alias("map_id"), F.expr(f"(o_orderkey div 96) % {sets}").alias("tileset_id"),
                    (F.col("o_orderkey") % 12).alias("x"), F.expr("(o_orderkey % 96) div 12").alias("y"),
                    F.concat(F.lit("t"), F.expr(f"(o_orderkey div 96) % {sets} * 100 + o_custkey % 100").cast("string")).alias("tile"))


PC = f"""WITH {fx.tile_edges_sql()}, pc AS (SELECT o_orderkey // 96 AS map_id, (o_orderkey // 96) % ((SELECT count(*) FROM part) // 100) AS tileset_id, o_orderkey % 12 AS x, (o_orderkey % 96) // 12 AS y,
 't' || ((o_orderkey // 96) % ((SELECT count(*) FROM part) // 100) * 100 + o_custkey % 100) AS tile FROM orders), pe AS (SELECT pc.*, te.* EXCLUDE (tileset_id) FROM pc LEFT JOIN te ON te.tileset_id = pc.tileset_id AND te.name = pc.tile)"""


@query("map_violations", PC + """, pr AS (SELECT a.map_id, a.x, a.y, 'e' AS dir, a.tile, b.tile AS tile_n, coalesce(a.e = b.w AND (a.ne IS NULL OR b.se IS NULL OR a.ne = b.se), false) AS fits FROM pe a JOIN pe b ON b.map_id = a.map_id AND b.x = a.x + 1 AND b.y = a.y
 UNION ALL SELECT a.map_id, a.x, a.y, 's', a.tile, b.tile, coalesce(a.s = b.n AND (a.se IS NULL OR b.sw IS NULL OR a.se = b.sw), false) FROM pe a JOIN pe b ON b.map_id = a.map_id AND b.x = a.x AND b.y = a.y + 1)
SELECT map_id, x, y, dir, tile, tile_n FROM pr WHERE NOT fits""")
def map_violations(spark, d):
    return mp.map_violations(part_cells(spark, d), fx.tile_edges(spark, d))


RULES = ["affordance:walkable forbids affordance:hazard adjacent", "affordance:hazard forbids type:hazard adjacent",
         "affordance:walkable requires affordance:obstacle adjacent_any", "affordance:walkable requires affordance:walkable adjacent_any",
         "affordance:obstacle requires affordance:hazard adjacent_any", "not a rule"]


def rules(spark):
    return mp.parse_rules(spark.createDataFrame([(r,) for r in RULES], "rule string"))


NB4 = "nb4 AS (SELECT a.map_id, a.x, a.y, a.tile, a.aff, dir, b.tile AS tile_n, b.aff AS aff_n FROM acell a, (VALUES ('n', 0, -1), ('e', 1, 0), ('s', 0, 1), ('w', -1, 0)) v(dir, dx, dy) JOIN acell b ON b.map_id = a.map_id AND b.x = a.x + dx AND b.y = a.y + dy)"


@query("forbid_violations", f"WITH {M}, {NB4} SELECT map_id, x, y, dir, tile, tile_n FROM nb4 WHERE (aff, aff_n) IN (('walkable', 'hazard'), ('hazard', 'hazard'))")
def forbid_violations(spark, d):
    return mp.forbid_violations(cells(spark, d), rules(spark)).select("map_id", BIG("x"), BIG("y"), "dir", "tile", "tile_n")


@query("require_bias", f"""WITH {M}, {NB4}, s AS (SELECT map_id, x, y, bool_or(aff_n = 'obstacle') AS ob, bool_or(aff_n = 'walkable') AS wa, bool_or(aff_n = 'hazard') AS ha FROM nb4 GROUP BY ALL)
SELECT map_id, x, y, tile, round(CASE aff WHEN 'walkable' THEN (CASE WHEN ob THEN 3.0::double ELSE 0.1::double END) * (CASE WHEN wa THEN 3.0::double ELSE 0.1::double END) WHEN 'obstacle' THEN CASE WHEN ha THEN 3.0::double ELSE 0.1::double END ELSE 1.0::double END, 6) AS bias
FROM acell LEFT JOIN s USING (map_id, x, y)""")
def require_bias(spark, d):
    return mp.require_bias(cells(spark, d), rules(spark), 3.0).select("map_id", BIG("x"), BIG("y"), "tile", R6("bias"))


# --- pins ---------------------------------------------------------------------
def pin_inputs(spark, d):
    sets = fx.table(spark, d, "part").count() // 100
    o = fx.table(spark, d, "orders")
    req = o.groupBy(F.expr("o_orderkey div 96").alias("map_id")).agg(
        F.min(F.expr(f"(o_orderkey div 96) % {sets}")).alias("tileset_id"), (F.max(F.col("o_orderkey") % 12) + 1).cast("int").alias("w"), (F.max(F.expr("(o_orderkey % 96) div 12")) + 1).cast("int").alias("h"))
    pos = F.element_at(F.array(*[F.lit(p) for p in ("north", "SE", "center", "left", "somewhere")]), (F.col("map_id") % 5 + 1).cast("int"))
    own = F.when(F.col("map_id") % 2 == 0, F.concat(F.lit("t"), (F.col("tileset_id") * 100 + 1).cast("string"))).otherwise("t1")
    kind = F.when(F.col("map_id") % 3 == 0, own).when(F.col("map_id") % 3 == 1, "hazard").otherwise("nothing")
    preds = req.select("map_id", F.posexplode(F.array(
        F.lit("border:obstacle"), F.concat(F.lit("region:a:"), kind, F.lit(":4x2:"), pos),
        F.concat(F.lit("region:b:walkable:"), F.when(F.col("map_id") % 2 == 0, "2x2:e").otherwise("5")),
        F.lit("path:0,5:9,5"))).alias("ord", "rule"))
    tiles = fx.tile_edges(spark, d).select("tileset_id", "name", F.expr("cast(substring(name, 2) as bigint)").alias("idx"), "affordance")
    explicit = o.where("o_custkey % 6 = 0").select(F.expr("o_orderkey div 96").alias("map_id"), (F.col("o_custkey") % 14).cast("int").alias("x"),
                                                   F.expr("(o_orderkey % 96) div 12").cast("int").alias("y"), F.lit("t3").alias("tile")).distinct()
    return req, preds, tiles, explicit


PINS = f"""WITH {fx.tile_edges_sql()}, rq AS (SELECT o_orderkey // 96 AS map_id, min((o_orderkey // 96) % ((SELECT count(*) FROM part) // 100)) AS tileset_id, (max(o_orderkey % 12) + 1)::int AS w, (max((o_orderkey % 96) // 12) + 1)::int AS h FROM orders GROUP BY ALL),
ft AS (SELECT tileset_id, affordance, arg_min(name, substr(name, 2)::bigint) AS name FROM te WHERE affordance IS NOT NULL GROUP BY 1, 2),
bp AS (SELECT map_id, 1 AS ord, 0 AS seq, x, y, 'obstacle' AS ty FROM rq, range(0, 12) a(x), range(0, 8) b(y) WHERE x < w AND y < h AND (x = 0 OR y = 0 OR x = w - 1 OR y = h - 1)),
rg AS (SELECT map_id, w, h, 2 AS ord, [CASE WHEN map_id % 2 = 0 THEN 't' || (tileset_id * 100 + 1) ELSE 't1' END, 'hazard', 'nothing'][map_id % 3 + 1] AS ty, 4 AS rw, 2 AS rh, [0.5, 0.8, 0.5, 0.2, 0.5][map_id % 5 + 1] AS fx, [0.2, 0.8, 0.5, 0.5, 0.5][map_id % 5 + 1] AS fy FROM rq
  UNION ALL SELECT map_id, w, h, 3, 'walkable', CASE WHEN map_id % 2 = 0 THEN 2 ELSE 3 END, CASE WHEN map_id % 2 = 0 THEN 2 ELSE 3 END, CASE WHEN map_id % 2 = 0 THEN 0.8 ELSE 0.5 END, 0.5 FROM rq),
rp AS (SELECT map_id, ord, dy * 3 + dx AS seq, least(greatest(floor(fx * w)::int + dx - rw // 2, 0), w - 1) AS x, least(greatest(floor(fy * h)::int + dy - rh // 2, 0), h - 1) AS y, ty FROM rg, range(0, 3) a(dx), range(0, 3) b(dy) WHERE dx < rw AND dy < rh),
al AS (SELECT u.*, coalesce(te.name, ft.name) AS tile FROM (SELECT * FROM bp UNION ALL SELECT * FROM rp) u JOIN rq USING (map_id)
 LEFT JOIN te ON te.tileset_id = rq.tileset_id AND te.name = ty LEFT JOIN ft ON ft.tileset_id = rq.tileset_id AND ft.affordance = ty),
pp AS (SELECT map_id, x, y, arg_max(tile, ord * 100 + seq) AS tile FROM al WHERE tile IS NOT NULL GROUP BY ALL),
ex AS (SELECT DISTINCT o_orderkey // 96 AS map_id, o_custkey % 14 AS x, (o_orderkey % 96) // 12 AS y FROM orders WHERE o_custkey % 6 = 0),
pins AS (SELECT map_id, x::bigint AS x, y::bigint AS y, tile FROM pp UNION ALL SELECT map_id, x, y, 't3' FROM ex JOIN rq USING (map_id) WHERE x < w AND y < h AND (map_id, x, y) NOT IN (SELECT map_id, x, y FROM pp))"""


@query("pin_expand", PINS + " SELECT * FROM pins")
def pin_expand(spark, d):
    return mp.expand_pins(*pin_inputs(spark, d)).select("map_id", BIG("x"), BIG("y"), "tile")


def set_pins(spark, d):
    """Pins for every map cell, drawn from the map's own tileset."""
    req = pin_inputs(spark, d)[0]
    return part_cells(spark, d).select("map_id", "x", "y", "tile"), req


@query("pin_conflicts", PC + """, rq AS (SELECT map_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pc GROUP BY 1), dr(dir, opp, dx, dy) AS (VALUES ('n', 's', 0, -1), ('e', 'w', 1, 0), ('s', 'n', 0, 1), ('w', 'e', -1, 0)),
sd AS (SELECT tileset_id, name, unnest(['n', 'e', 's', 'w']) AS dir, unnest([n, e, s, w]) AS cls, unnest([nw, ne, se, sw]) AS ac FROM te), od AS (SELECT tileset_id, name, unnest(['n', 'e', 's', 'w']) AS dir, unnest([s, w, n, e]) AS cls, unnest([ne, se, sw, nw]) AS bc FROM te),
cm AS (SELECT sd.tileset_id, sd.name AS a, sd.dir, od.name AS b FROM sd JOIN od USING (tileset_id, dir, cls) WHERE ac IS NULL OR bc IS NULL OR ac = bc),
q AS (SELECT pc.*, w, h, dir, opp, pc.x + dx AS nx, pc.y + dy AS ny FROM pc JOIN rq USING (map_id), dr WHERE pc.x + dx >= 0 AND pc.y + dy >= 0 AND pc.x + dx < w AND pc.y + dy < h),
hasc AS (SELECT DISTINCT tileset_id, a, dir FROM cm), qq AS (SELECT q.*, hasc.a IS NOT NULL AS has FROM q LEFT JOIN hasc ON hasc.tileset_id = q.tileset_id AND hasc.a = q.tile AND hasc.dir = q.dir),
kp AS (SELECT DISTINCT q.tileset_id, q.dir, q.opp, q.tile, p.tile AS tile_n FROM qq q JOIN pc p ON p.map_id = q.map_id AND p.x = q.nx AND p.y = q.ny WHERE has AND (q.x = 0 OR q.y = 0 OR q.x = w - 1 OR q.y = h - 1)),
sv AS (SELECT DISTINCT kp.tileset_id, kp.dir, kp.tile, kp.tile_n FROM kp JOIN cm u ON u.tileset_id = kp.tileset_id AND u.a = kp.tile AND u.dir = kp.dir JOIN cm v ON v.tileset_id = kp.tileset_id AND v.a = kp.tile_n AND v.dir = kp.opp AND v.b = u.b)
SELECT map_id, x, y, dir, 'no compatible neighbour' AS issue FROM qq WHERE NOT has
UNION ALL SELECT q.map_id, q.x, q.y, q.dir, 'no tile fits both pins' FROM qq q JOIN pc p ON p.map_id = q.map_id AND p.x = q.nx AND p.y = q.ny WHERE has AND (q.x = 0 OR q.y = 0 OR q.x = w - 1 OR q.y = h - 1) AND (q.tileset_id, q.dir, q.tile, p.tile) NOT IN (SELECT * FROM sv)""")
def pin_conflicts(spark, d):
    pins, req = set_pins(spark, d)
    return mp.pin_conflicts(pins, req, fx.tile_edges(spark, d)).select("map_id", BIG("x"), BIG("y"), "dir", "issue")


@query("pin_density", PINS + ", n AS (SELECT map_id, count(DISTINCT x * 1000 + y) AS pinned FROM pins GROUP BY 1) SELECT map_id, coalesce(pinned, 0) AS pinned, coalesce(pinned, 0) * 100 // (w * h) AS percent, coalesce(pinned, 0) * 100 // (w * h) > 40 AS dense FROM rq LEFT JOIN n USING (map_id)")
def pin_density(spark, d):
    req, preds, tiles, explicit = pin_inputs(spark, d)
    return mp.pin_density(mp.expand_pins(req, preds, tiles, explicit), req).select("map_id", "pinned", BIG("percent"), "dense")


# --- autotile -------------------------------------------------------------------
AUTO = f"""WITH {M}, raw AS (SELECT a.map_id, a.x, a.y, coalesce(bit_or(CASE WHEN b.base = a.base THEN bit END), 0) AS m FROM cell a CROSS JOIN (VALUES (-1, -1, 1), (0, -1, 2), (1, -1, 4), (-1, 0, 8), (1, 0, 16), (-1, 1, 32), (0, 1, 64), (1, 1, 128)) v(dx, dy, bit) LEFT JOIN cell b ON b.map_id = a.map_id AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL),
cl(m, c) AS (SELECT m, (m & 90) + CASE WHEN m & 1 > 0 AND m & 10 = 10 THEN 1 ELSE 0 END + CASE WHEN m & 4 > 0 AND m & 18 = 18 THEN 4 ELSE 0 END + CASE WHEN m & 32 > 0 AND m & 72 = 72 THEN 32 ELSE 0 END + CASE WHEN m & 128 > 0 AND m & 80 = 80 THEN 128 ELSE 0 END FROM range(0, 256) t(m)),
ix AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM (SELECT DISTINCT c FROM cl))"""


@query("autotile_mask", AUTO + " SELECT map_id, x, y, c AS mask FROM raw JOIN cl USING (m)")
def autotile_mask(spark, d):
    return mp.autotile_mask(cells(spark, d)).select("map_id", BIG("x"), BIG("y"), BIG("mask"))


@query("autotile_index", AUTO + " SELECT map_id, i AS tile_index, count(*) AS n FROM raw JOIN cl USING (m) JOIN ix USING (c) GROUP BY ALL")
def autotile_index(spark, d):
    return mp.autotile_index(mp.autotile_mask(cells(spark, d))).groupBy("map_id", BIG("tile_index")).agg(F.count("*").alias("n"))


# --- archive ---------------------------------------------------------------------
BINS = WF + """, bn AS (SELECT *, greatest(0, least(19, floor((wall_ratio - 0.05) / (0.95 - 0.05) * 20)))::int AS wall_bin, greatest(0, least(9, floor((room_count - 0.5) / (10.5 - 0.5) * 10)))::int AS room_bin FROM ml),
el AS (SELECT * FROM bn QUALIFY row_number() OVER (PARTITION BY theme, wall_bin, room_bin ORDER BY quality DESC, map_id) = 1)"""


@query("elite_archive", BINS + " SELECT theme, wall_bin, room_bin, map_id, round(quality, 6) AS quality FROM el")
def elite_archive(spark, d):
    return ds.elites(measured(spark, d)).select("theme", "wall_bin", "room_bin", "map_id", R6("quality"))


@query("archive_merge", BINS + """, o AS (SELECT * FROM bn WHERE map_id // 4 % 2 = 1 QUALIFY row_number() OVER (PARTITION BY theme, wall_bin, room_bin ORDER BY quality DESC, map_id) = 1),
u AS (SELECT *, 1 AS old FROM o UNION ALL SELECT *, 0 FROM bn WHERE map_id // 4 % 2 = 0) SELECT theme, wall_bin, room_bin, map_id, round(quality, 6) AS quality FROM u QUALIFY row_number() OVER (PARTITION BY theme, wall_bin, room_bin ORDER BY quality DESC, old DESC, map_id) = 1""")
def archive_merge(spark, d):
    m = measured(spark, d)
    old, new = ds.elites(m.where("map_id div 4 % 2 = 1")), m.where("map_id div 4 % 2 = 0")
    return ds.merge_elites(old, new).select("theme", "wall_bin", "room_bin", "map_id", R6("quality"))


@query("archive_coverage", BINS + " SELECT theme, count(*) FILTER (quality = 0) AS failures, any_value(n) AS elite_count, any_value(n) / 200.0::double AS coverage, round(max(quality), 6) AS best_quality FROM bn JOIN (SELECT theme, count(*) AS n FROM el GROUP BY 1) e USING (theme) GROUP BY theme")
def archive_coverage(spark, d):
    m = measured(spark, d)
    return ds.archive_stats(ds.elites(m), m).select("theme", "failures", "elite_count", "coverage", R6("best_quality"))


TEXT = "tx AS (SELECT map_id, string_agg(rt, chr(10) ORDER BY y) AS grid_text FROM (SELECT map_id, y, string_agg(tile, ' ' ORDER BY x) AS rt FROM acell GROUP BY ALL) GROUP BY ALL)"


@query("archive_export", BINS + f", {TEXT} SELECT map_id, label, grid_text, w, h, round(quality, 6) AS quality FROM el JOIN tx USING (map_id)")
def archive_export(spark, d):
    e = ds.elites(measured(spark, d)).withColumn("label", labels.map_label())
    return e.join(ds.map_text(fx.map_cells(spark, d)), "map_id").select("map_id", "label", "grid_text", BIG("w"), BIG("h"), R6("quality"))


@query("grid_names_text", f"WITH {M}, {TEXT} SELECT * FROM tx")
def grid_names_text(spark, d):
    return ds.map_text(fx.map_cells(spark, d))


@query("resolve_suffix", f"WITH {M} SELECT map_id, x, y, base, CASE sfx WHEN '_90' THEN 1 WHEN '_180' THEN 2 ELSE 0 END AS turns, false AS flipped FROM acell")
def resolve_suffix(spark, d):
    names = fx.affordances(spark).select(F.col("tile").alias("name"))
    return g.resolve_suffix(fx.map_cells(spark, d), names).select("map_id", BIG("x"), BIG("y"), "base", "turns", "flipped")
