"""Variant queries with an oracle per mutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import fixtures as fx
from gridweave.operators import variants as va
from gridweave.plans.registry import query

SEED = 7
D = lambda *k: f"('0x' || left(md5('{SEED}:' || tile_id || ':' || i || ':' || {' || '.join(repr(x) if isinstance(x, str) and x != 'j' else str(x) for x in _colon(k))}), 8))::bigint"


def _colon(parts):
    out = []
    for p in parts:
        out += [":", p] if out else [p]
    return [str(p) if p != "j" else "j" for p in out]


BASE = f"""WITH {fx.TILE_SQL}, {fx.PALETTE_SQL}, us AS (SELECT tile_id, list(sym ORDER BY sym) AS used, arg_min(sym, v * 1000 + ascii(sym)) AS dark, arg_max(sym, n * 1000 + ascii(sym)) AS common
  FROM (SELECT tile_id, px.sym, count(*) AS n, coalesce(max(r + g + b), 0) AS v FROM px LEFT JOIN palette USING (sym) WHERE px.sym <> '.' GROUP BY ALL) GROUP BY tile_id),
v AS (SELECT tile_id, flat, used, dark, common, 1 AS i FROM tile JOIN us USING (tile_id)),
s AS (SELECT *, {D(0)} AS d0, {D(1)} AS d1, len(used) AS n FROM v),
c AS (SELECT *, p % 16 AS x, p // 16 AS y, substr(flat, p + 1, 1) AS c FROM (SELECT *, unnest(range(0, 256)) AS p FROM s))
"""
OUT = " SELECT tile_id, md5(string_agg(z, '' ORDER BY p)) AS digest FROM o GROUP BY tile_id"
DRAWS = f"j AS (SELECT *, {D('x', 'j')} AS dx, {D('y', 'j')} AS dy, {D('s', 'j')} AS dsy FROM (SELECT *, unnest(range(0, CNT)) AS j FROM s))"
INNER = "x BETWEEN 1 AND 14 AND y BETWEEN 1 AND 14"
SQLS = {
    "noise": BASE + ", " + DRAWS.replace("CNT", "22") + ", h AS (SELECT tile_id, (1 + dy % 14) * 16 + 1 + dx % 14 AS p, arg_max(used[dsy % n + 1], j) AS z FROM j GROUP BY ALL), o AS (SELECT c.tile_id, c.p, CASE WHEN c.c <> '.' AND h.z IS NOT NULL THEN h.z ELSE c.c END AS z FROM c LEFT JOIN h USING (tile_id, p))" + OUT,
    "erode": BASE + ", " + DRAWS.replace("CNT", "3") + ", h AS (SELECT DISTINCT tile_id, CASE dsy % 4 WHEN 0 THEN 16 + 1 + dx % 14 WHEN 1 THEN 224 + 1 + dx % 14 WHEN 2 THEN (1 + dy % 14) * 16 + 1 ELSE (1 + dy % 14) * 16 + 14 END AS p, 1 AS hit FROM j), o AS (SELECT c.tile_id, c.p, CASE WHEN hit = 1 THEN common ELSE c.c END AS z FROM c LEFT JOIN h USING (tile_id, p))" + OUT,
    "row": BASE + ", o AS (SELECT tile_id, p, CASE WHEN y = 2 + d0 % 12 AND x BETWEEN 1 AND 14 THEN substr(flat, y * 16 + CASE WHEN d1 % 2 = 0 THEN CASE WHEN x = 1 THEN 14 ELSE x - 1 END ELSE CASE WHEN x = 14 THEN 1 ELSE x + 1 END END + 1, 1) ELSE c END AS z FROM c)" + OUT,
    "col": BASE + ", o AS (SELECT tile_id, p, CASE WHEN x = 2 + d0 % 12 AND y BETWEEN 1 AND 14 THEN substr(flat, 16 * CASE WHEN d1 % 2 = 0 THEN CASE WHEN y = 1 THEN 14 ELSE y - 1 END ELSE CASE WHEN y = 14 THEN 1 ELSE y + 1 END END + x + 1, 1) ELSE c END AS z FROM c)" + OUT,
    "swap": BASE + f", o AS (SELECT tile_id, p, CASE WHEN n > 1 AND {INNER} AND c = used[d0 % n + 1] THEN used[(d0 % n + 1 + d1 % greatest(n - 1, 1)) % n + 1] WHEN n > 1 AND {INNER} AND c = used[(d0 % n + 1 + d1 % greatest(n - 1, 1)) % n + 1] THEN used[d0 % n + 1] ELSE c END AS z FROM c)" + OUT,
    "crack": BASE + f", k AS (SELECT *, CASE WHEN d0 % 2 = 0 THEN y ELSE x END AS t, CASE WHEN d0 % 2 = 0 THEN x ELSE y END AS q, 2 + d1 % 12 AS line FROM c), k2 AS (SELECT *, 2 * t AS j FROM k), k3 AS (SELECT * REPLACE (j + 1 AS j), {D('c', 'j')} % 10 AS c1 FROM k2), k4 AS (SELECT *, {D('c', 'j')} % 10 AS c2 FROM k3), o AS (SELECT tile_id, p, CASE WHEN t BETWEEN 1 AND 14 AND ((q = line AND c1 < 7) OR (q = line + 1 AND q < 15 AND c2 < 3)) THEN dark ELSE c END AS z FROM k4)" + OUT,
}


def _register(kind: str, name: str) -> None:
    @query(name, SQLS[kind])
    def run(spark, d):
        v = va.vary(fx.tiles(spark, d), 1, SEED, fx.palette(spark), (kind,))
        return v.select("tile_id", F.md5(F.replace("grid", F.lit("\n"), F.lit(""))).alias("digest"))


for _k, _n in (("noise", "variants_noise"), ("crack", "variants_crack"), ("row", "variants_shift"), ("col", "variants_shift_col"), ("swap", "variants_swap"), ("erode", "variants_erode")):
    _register(_k, _n)


@query("variants", f"WITH {fx.TILE_SQL}, u AS (SELECT DISTINCT tile_id, tileset_id FROM px WHERE sym <> '.') SELECT tileset_id, ['noise', 'crack', 'row', 'col', 'swap', 'erode'][i % 6 + 1] AS mutation, count(*) AS n, count(DISTINCT 't' || tile_id || '_' || (i + 1)) AS names FROM u, range(0, 8) t(i) GROUP BY ALL")
def variants(spark, d):
    v = va.vary(fx.tiles(spark, d), 8, SEED, fx.palette(spark), keep=("tileset_id",))
    return v.groupBy("tileset_id", "mutation").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))
