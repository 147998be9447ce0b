"""Tileset queries: rotation pools, compatibility, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import fixtures as fx
from gridweave.operators import adjacency as adj
from gridweave.operators import grid as g
from gridweave.plans.corpus import BIG, R6
from gridweave.plans.registry import query

TE = fx.tile_edges_sql()
SIDES = """
a_s AS (SELECT tileset_id, name AS a, unnest(['n', 'e', 's', 'w']) AS dir, unnest([n, e, s, w]) AS cls, unnest([nw, ne, se, sw]) AS ac FROM te),
b_s AS (SELECT tileset_id, name AS b, unnest(['n', 'e', 's', 'w']) AS dir, unnest([s, w, n, e]) AS cls, unnest([ne, se, sw, nw]) AS bc FROM te),
hit AS (SELECT a_s.tileset_id, a, dir, cls, b FROM a_s JOIN b_s USING (tileset_id, dir, cls) WHERE ac IS NULL OR bc IS NULL OR ac = bc)"""
ADJ = f"WITH {TE}, {SIDES}"


@query("adjacency", ADJ + " SELECT tileset_id, a, dir, b FROM hit")
def adjacency(spark, d):
    return adj.adjacency(fx.tile_edges(spark, d))


@query("adjacency_classes", ADJ + " SELECT tileset_id, dir, cls, bc AS b_corner, count(*) AS members FROM b_s GROUP BY ALL")
def adjacency_classes(spark, d):
    return adj.adjacency_classes(fx.tile_edges(spark, d))


GROUPS_SQL = "grps AS (SELECT tileset_id, affordance AS grp, name AS tile FROM te WHERE affordance IS NOT NULL)"


def groups(te):
    return te.where("affordance IS NOT NULL").select("tileset_id", F.col("affordance").alias("grp"), F.col("name").alias("tile"))


@query("variant_group_expand", f"""{ADJ}, {GROUPS_SQL}, more AS (SELECT DISTINCT h.tileset_id, h.a, h.dir, m.b FROM hit h JOIN grps x ON x.tileset_id = h.tileset_id AND x.tile = h.b
 JOIN grps y ON y.tileset_id = x.tileset_id AND y.grp = x.grp JOIN b_s m ON m.tileset_id = h.tileset_id AND m.dir = h.dir AND m.b = y.tile AND m.cls = h.cls),
u AS (SELECT tileset_id, a, dir, b FROM hit UNION SELECT * FROM more) SELECT tileset_id, a, dir, count(*) AS n FROM u GROUP BY ALL""")
def variant_group_expand(spark, d):
    te = fx.tile_edges(spark, d)
    return adj.adjacency(te, groups(te)).groupBy("tileset_id", "a", "dir").agg(F.count("*").alias("n"))


@query("edge_pair_check", f"""WITH {TE}, rq AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey // 100 AS tileset_id, 't' || l_partkey AS a, 't' || (l_suppkey % 7 + l_partkey) AS b,
  ['north', 'east', 'south', 'west', 'up'][(l_orderkey % 5) + 1] AS direction FROM lineitem),
j AS (SELECT rq.*, x.name AS xn, y.name AS yn, CASE direction WHEN 'north' THEN x.n WHEN 'east' THEN x.e WHEN 'south' THEN x.s WHEN 'west' THEN x.w END AS ea,
  CASE direction WHEN 'north' THEN y.s WHEN 'east' THEN y.w WHEN 'south' THEN y.n WHEN 'west' THEN y.e END AS eb FROM rq LEFT JOIN te x ON x.tileset_id = rq.tileset_id AND x.name = rq.a LEFT JOIN te y ON y.tileset_id = rq.tileset_id AND y.name = rq.b)
SELECT tileset_id, direction, CASE WHEN xn IS NULL THEN 'tile not found: ' || a WHEN yn IS NULL THEN 'tile not found: ' || b WHEN direction = 'up' THEN 'invalid direction: up' END AS error,
 CASE WHEN xn IS NOT NULL AND yn IS NOT NULL AND direction <> 'up' THEN coalesce(ea = eb, false) END AS compatible, count(*) AS n FROM j GROUP BY ALL""")
def edge_pair_check(spark, d):
    li = fx.table(spark, d, "lineitem")
    words = F.array(*[F.lit(x) for x in ("north", "east", "south", "west", "up")])
    rq = li.select(F.expr("l_partkey div 100").alias("tileset_id"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("a"),
                   F.concat(F.lit("t"), (F.col("l_suppkey") % 7 + F.col("l_partkey")).cast("string")).alias("b"),
                   F.element_at(words, (F.col("l_orderkey") % 5 + 1).cast("int")).alias("direction"))
    return adj.check_pairs(rq, fx.tile_edges(spark, d)).groupBy("tileset_id", "direction", "error", "compatible").agg(F.count("*").alias("n"))


@query("compatible_neighbors", f"""{ADJ}, nw AS (SELECT * FROM a_s WHERE a IN (SELECT 't' || p_partkey FROM part WHERE p_type = 'ECONOMY'))
SELECT tileset_id, a, b, string_agg(dir, '' ORDER BY dir) AS dirs FROM (SELECT DISTINCT nw.tileset_id, a, b, dir FROM nw JOIN b_s USING (tileset_id, dir, cls) WHERE a <> b) GROUP BY ALL""")
def compatible_neighbors(spark, d):
    te = fx.tile_edges(spark, d)
    new = fx.table(spark, d, "part").where("p_type = 'ECONOMY'").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("name"))
    return adj.compatible_neighbors(te.join(new, "name", "left_semi"), te)


DEG = ADJ + ", deg AS (SELECT a_s.tileset_id, a_s.a AS name, a_s.dir, count(hit.b) AS degree FROM a_s LEFT JOIN hit USING (tileset_id, a, dir) GROUP BY ALL)"


@query("adjacency_degree", DEG + " SELECT * FROM deg")
def adjacency_degree(spark, d):
    return adj.adjacency_degree(fx.tile_edges(spark, d))


@query("isolated_tiles", DEG.replace(TE, fx.tile_edges_sql(4)) + " SELECT *, CASE WHEN degree = 0 THEN 'isolated' ELSE 'poor' END AS issue FROM deg WHERE degree <= 1")
def isolated_tiles(spark, d):
    return adj.isolated_tiles(fx.tile_edges(spark, d, 4))


@query("compat_totals", ADJ + " SELECT t.tileset_id, total_pairs, coalesce(c, 0) AS compatible_pairs FROM (SELECT tileset_id, count(*) * count(*) * 4 AS total_pairs FROM te GROUP BY ALL) t LEFT JOIN (SELECT tileset_id, count(*) AS c FROM hit GROUP BY ALL) h USING (tileset_id)")
def compat_totals(spark, d):
    return adj.compat_totals(fx.tile_edges(spark, d)).select("tileset_id", "total_pairs", BIG("compatible_pairs"))


# The pool of four-tile tilesets, so that some come out only partly connected.
COMP = f"""WITH RECURSIVE {fx.tile_edges_sql(4)}, lk AS (SELECT DISTINCT tileset_id, unnest([n, s, e, w]) AS a, unnest([s, n, w, e]) AS b FROM te WHERE NOT is_template),
rc(tileset_id, a, b) AS (SELECT tileset_id, a, a FROM lk UNION SELECT rc.tileset_id, rc.a, lk.b FROM rc JOIN lk ON lk.tileset_id = rc.tileset_id AND lk.a = rc.b),
comp AS (SELECT tileset_id, a AS cls, min(b) AS comp FROM rc GROUP BY ALL)"""


def comps(spark, d):
    return adj.edge_components(fx.tile_edges(spark, d, 4))


@query("edge_connectivity", COMP + " SELECT * FROM comp")
def edge_connectivity(spark, d):
    return comps(spark, d).select("tileset_id", "cls", "comp")


@query("completeness", COMP + """, c AS (SELECT x.tileset_id, count(*) FILTER (x.comp = y.comp) AS connected, count(*) FILTER (x.comp <> y.comp) AS disconnected FROM comp x JOIN comp y ON x.tileset_id = y.tileset_id AND x.cls < y.cls GROUP BY ALL),
n AS (SELECT tileset_id, count(*) AS n_classes FROM comp GROUP BY ALL)
SELECT n.tileset_id, n_classes, coalesce(connected, 0) AS connected, coalesce(disconnected, 0) AS disconnected, round(coalesce(connected, 0) / greatest(n_classes * (n_classes - 1) // 2, 1)::double, 6) AS score FROM n LEFT JOIN c USING (tileset_id)""")
def completeness(spark, d):
    return adj.completeness(comps(spark, d)).select("tileset_id", BIG("n_classes"), BIG("connected"), BIG("disconnected"), R6("score"))


@query("missing_tiles", COMP + " SELECT x.tileset_id, 'transition_' || x.cls || '_' || y.cls AS name, x.cls AS n, x.cls AS e, y.cls AS s, x.cls AS w, '4way' AS auto_rotate FROM comp x JOIN comp y ON x.tileset_id = y.tileset_id AND x.cls < y.cls AND x.comp <> y.comp")
def missing_tiles(spark, d):
    return adj.missing_tiles(comps(spark, d))


@query("rotation_variants", f"""WITH {TE}, v(mode, sfx, k, flip, cnt) AS (VALUES ('4way', '_90', 1, 0, 3), ('4way', '_180', 2, 0, 3), ('4way', '_270', 3, 0, 3), ('flip', '_flip', 0, 1, 1),
 ('8way', '_90', 1, 0, 7), ('8way', '_180', 2, 0, 7), ('8way', '_270', 3, 0, 7), ('8way', '_flip', 0, 1, 7), ('8way', '_90f', 1, 1, 7), ('8way', '_180f', 2, 1, 7), ('8way', '_270f', 3, 1, 7)),
x AS (SELECT te.*, v.*, CASE WHEN flip = 1 THEN [n, w, s, e] ELSE [n, e, s, w] END AS ring FROM te JOIN v ON v.mode = te.auto_rotate)
SELECT tileset_id, name || sfx AS name, ring[(0 - k + 4) % 4 + 1] AS n, ring[(1 - k + 4) % 4 + 1] AS e, ring[(2 - k + 4) % 4 + 1] AS s, ring[(3 - k + 4) % 4 + 1] AS w,
 round(CASE WHEN auto_rotate_weight = 'equal' THEN weight / (cnt + 1) ELSE 0.1 END, 6)::double AS weight, true AS is_variant FROM x
UNION ALL SELECT tileset_id, name, n, e, s, w, round(weight, 6)::double, false FROM te""")
def rotation_variants(spark, d):
    return g.expand_variants(fx.tile_edges(spark, d)).select("tileset_id", "name", "n", "e", "s", "w", R6("weight"), "is_variant")
