"""Rule audits and definition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import fixtures as fx
from gridweave.functions.color import hex_channels
from gridweave.functions.grids import grid_text
from gridweave.operators import audit as au
from gridweave.operators import definitions as df_
from gridweave.operators import grid as g
from gridweave.plans.corpus import BIG, R6
from gridweave.plans.registry import query

POOL = ".#+=~gorhwXY"
# --- bindings -------------------------------------------------------------------
B = f"""
sets(tileset_id, n) AS (SELECT source, substr(source, 4)::int FROM documents UNION SELECT 'parts' || (p_partkey // 100), p_partkey // 100 FROM part
  UNION SELECT c_nationkey::varchar, c_nationkey FROM customer UNION SELECT 'themes' || (c_custkey // 40), c_custkey // 40 FROM customer),
pal AS (SELECT tileset_id, palette, sym, (r + n) % 256 AS r, g, b FROM sets, (VALUES {", ".join(f"({i}, '{s}', {r}, {g_}, {b})" for i, (s, r, g_, b, _) in enumerate(fx.PALETTE))}) v(pos, sym, r, g, b), (VALUES ('base'), ('small')) w(palette)
  WHERE CASE palette WHEN 'base' THEN pos < 9 OR n % 3 <> 0 ELSE pos < 5 AND n % 2 = 0 END),
kp AS (SELECT DISTINCT tileset_id, palette FROM pal),
ds AS (SELECT doc_id, source, {fx.SYMBOL_TEXT_SQL.format('text')} AS s FROM documents),
dh AS (SELECT doc_id, source, s, (length(s) + 15) // 16 AS rows FROM ds),
tl AS (SELECT source AS tileset_id, 'd' || doc_id AS name, CASE doc_id % 9 WHEN 8 THEN 'ghost' WHEN 7 THEN 'small' ELSE 'base' END AS palette,
  CASE WHEN doc_id % 19 = 6 THEN NULL WHEN doc_id % 17 = 4 THEN 'bad' WHEN doc_id % 23 = 9 THEN '0x16' WHEN doc_id % 11 = 3 THEN '16x' || (rows + 1) ELSE '16x' || rows END AS size,
  CASE WHEN doc_id % 29 = 1 THEN 'horizontal' END AS symmetry, CASE WHEN doc_id % 5 = 0 THEN '4way' END AS auto_rotate,
  CASE WHEN doc_id % 10 = 7 THEN 'd' || (CASE doc_id % 4 WHEN 0 THEN doc_id + 20 WHEN 1 THEN doc_id - 20 WHEN 2 THEN doc_id + 1000000 ELSE doc_id - 4 END) END AS template,
  CASE WHEN doc_id % 13 <> 5 AND (doc_id % 10 <> 7 OR doc_id % 3 = 0) THEN rpad(s, (rows * 16)::int, '.') END AS flat, NULL AS rle FROM dh
 UNION ALL SELECT 'parts' || (p_partkey // 100), 'p' || p_partkey, 'base', CASE WHEN p_partkey % 5 = 2 THEN '16x3' ELSE '16x2' END, NULL, NULL, NULL, NULL,
  (p_size % 20 + 1) || '# ' || (15 - p_size % 15) || CASE WHEN p_partkey % 6 = 1 THEN 'Q' ELSE '+' END || chr(10) || CASE WHEN p_partkey % 7 = 3 THEN '#9 16.' ELSE '16.' END FROM part),
sz AS (SELECT *, TRY_CAST(regexp_extract(size, '^(\\d+)x(\\d+)$', 1) AS INT) AS w, TRY_CAST(regexp_extract(size, '^(\\d+)x(\\d+)$', 2) AS INT) AS h FROM tl),
own AS (SELECT * FROM sz WHERE template IS NULL AND w > 0 AND h > 0 AND (tileset_id, palette) IN (SELECT tileset_id, palette FROM kp)),
fr AS (SELECT conv_id, turn, 'conv' AS spriteset, conv_id::varchar AS sprite, turn AS ord, turn + 1 + CASE WHEN conv_id % 5 = 0 AND turn >= 2 THEN 1 ELSE 0 END AS idx, CASE turn % 3 WHEN 0 THEN 'grid' WHEN 1 THEN 'delta' ELSE 'linked' END AS encoding,
  CASE WHEN turn % 3 = 1 AND conv_id % 11 <> 3 THEN CASE WHEN conv_id % 7 = 0 THEN turn + 1 ELSE turn END END AS base,
  CASE WHEN turn % 3 = 2 AND conv_id % 11 <> 5 THEN idx - 1 END AS link_to,
  CASE WHEN turn % 4 = 2 THEN 'h' WHEN conv_id % 3 = 1 THEN 'v' WHEN conv_id % 3 = 2 AND turn % 4 = 0 THEN 'vh' END AS mirror, text FROM conversations),
cy AS (SELECT c_nationkey::varchar AS tileset_id, 'c' || c_custkey AS name, CASE c_custkey % 8 WHEN 5 THEN 'ghost' WHEN 6 THEN 'small' ELSE 'base' END AS palette, CASE c_custkey % 4 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' WHEN 2 THEN 'ping-pong' ELSE 'sideways' END AS direction,
  c_custkey % 6 AS fps, c_custkey AS k, c_custkey % 5 AS n FROM customer),
cs AS (SELECT cy.*, p, substr('{POOL}', ((k + p) % 12 + 1)::bigint, 1) AS sym FROM cy, range(0, 5) t(p) WHERE p < n),
th AS (SELECT 'themes' || (c_custkey // 40) AS tileset_id, 'th' || c_custkey % 40 AS name, CASE c_custkey % 7 WHEN 6 THEN 'ghost' WHEN 5 THEN 'small' ELSE 'base' END AS palette, CASE WHEN c_custkey % 20 = 10 THEN 'th' || (c_custkey % 40 + 2) WHEN c_custkey % 20 = 15 THEN 'nowhere' WHEN c_custkey % 5 = 0 THEN NULL ELSE 'th' || (c_custkey % 40 - 1) END AS extends,
  CASE WHEN c_custkey % 3 = 0 THEN (c_nationkey % 4 + 1)::int END AS scale, CASE WHEN c_custkey % 4 = 1 THEN 8 END AS canvas, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS max_palette_size, CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment END AS light_source, c_custkey AS k FROM customer),
ro AS (SELECT tileset_id, name, k, 'bg' AS role, substr('{POOL}', (k % 12 + 1)::bigint, 1) AS sym FROM th UNION ALL SELECT tileset_id, name, k, 'fg', substr('{POOL}', (k * 7 % 12 + 1)::bigint, 1) FROM th WHERE k % 2 = 0
 UNION ALL SELECT tileset_id, name, k, 'shadow', CASE WHEN k % 30 = 3 THEN 'ab' ELSE '#' END FROM th WHERE k % 3 = 0 UNION ALL SELECT tileset_id, name, k, 'accent', 'g' FROM th WHERE k % 4 = 2),
cns AS (SELECT tileset_id, name, 'fg_brighter_than_bg' AS con, 'true' AS val FROM th WHERE k % 2 = 1 UNION ALL SELECT tileset_id, name, 'shadow_darker_than_bg', 'true' FROM th
 UNION ALL SELECT tileset_id, name, 'accent_hue_distinct_from_bg', 'true' FROM th WHERE k % 3 = 1 UNION ALL SELECT tileset_id, name, 'palette_granularity', (k % 12)::varchar FROM th WHERE k % 5 = 2)
"""


def tables(spark, d) -> dict:
    col = F.col
    # A letter folds to a symbol, so sizes are those of the text and rules on sizes fold none.
    docs = fx.spread(fx.table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id").select("doc_id", "source", "text", F.length("text").alias("chars"))
    k = col("doc_id")
    docs = docs.withColumns({"rows": F.ceil(col("chars") / 16).cast("int")})
    flat = F.rpad(fx.symbol_text(col("text")), col("chars") + F.pmod(-col("chars"), F.lit(16)), F.lit("."))
    grid = grid_text(F.regexp_extract_all(flat, F.lit("(.{16})"), F.lit(1)))
    target = F.when(k % 4 == 0, k + 20).when(k % 4 == 1, k - 20).when(k % 4 == 2, k + 1000000).otherwise(k - 4)
    s = lambda e: e.cast("string")
    none = F.lit(None).cast("string")
    dt = docs.select(
        col("source").alias("tileset_id"), F.concat(F.lit("d"), s(k)).alias("name"),
        F.when(k % 9 == 8, "ghost").when(k % 9 == 7, "small").otherwise("base").alias("palette"),
        F.when(k % 19 == 6, none).when(k % 17 == 4, "bad").when(k % 23 == 9, "0x16").when(k % 11 == 3, F.concat(F.lit("16x"), s(col("rows") + 1))).otherwise(F.concat(F.lit("16x"), s(col("rows")))).alias("size"),
        F.when(k % 29 == 1, "horizontal").alias("symmetry"), F.when(k % 5 == 0, "4way").alias("auto_rotate"),
        F.when(k % 10 == 7, F.concat(F.lit("d"), s(target))).alias("template"),
        F.when((k % 13 != 5) & ((k % 10 != 7) | (k % 3 == 0)), grid).alias("grid"), none.alias("rle"), none.alias("layout"))
    part, pk, ps = fx.table(spark, d, "part"), col("p_partkey"), col("p_size")
    pt = part.select(
        F.concat(F.lit("parts"), s(F.expr("p_partkey div 100"))).alias("tileset_id"), F.concat(F.lit("p"), s(pk)).alias("name"), F.lit("base").alias("palette"),
        F.when(pk % 5 == 2, "16x3").otherwise("16x2").alias("size"), none.alias("symmetry"), none.alias("auto_rotate"), none.alias("template"), none.alias("grid"),
        F.concat(s(ps % 20 + 1), F.lit("# "), s(15 - ps % 15), F.when(pk % 6 == 1, "Q").otherwise("+"), F.lit("\n"), F.when(pk % 7 == 3, "#9 16.").otherwise("16.")).alias("rle"), none.alias("layout"))
    cust, c = fx.table(spark, d, "customer"), col("c_custkey")
    number = lambda e: e.cast("bigint").alias("n")
    pset, tset, nation = F.expr("p_partkey div 100"), F.expr("c_custkey div 40"), col("c_nationkey")
    sets = docs.select(col("source").alias("tileset_id"), number(F.substring("source", 4, 9))).union(part.select(F.concat(F.lit("parts"), s(pset)), number(pset))).union(
        cust.select(s(nation), number(nation))).union(cust.select(F.concat(F.lit("themes"), s(tset)), number(tset))).distinct()
    # Each tileset has its own colours; some lack the last one, and only every other has the small palette.
    colours = F.array(*[F.struct(F.lit(p).alias("palette"), F.lit(i).alias("pos"), F.lit(e[0]).alias("sym"), *[F.lit(v).alias(f) for f, v in zip("rgba", e[1:])])
                        for p, most in (("base", 10), ("small", 5)) for i, e in enumerate(fx.PALETTE[:most])])
    pal = sets.select("tileset_id", "n", F.inline(colours)).where(
        "CASE palette WHEN 'base' THEN pos < 9 OR n % 3 <> 0 ELSE n % 2 = 0 END").withColumn("r", ((col("r") + col("n")) % 256).cast("int")).drop("n")
    raw = cust.select(s(col("c_nationkey")).alias("tileset_id"), F.concat(F.lit("n"), s(col("c_nationkey"))).alias("palette"),
                      F.when(c % 15 == 4, "ab").otherwise(F.substring(F.lit(POOL), (c % 12 + 1).cast("int"), F.lit(1))).alias("sym"),
                      F.concat(F.lit("#"), F.when(c % 10 == 3, "zz").otherwise(F.substring(F.md5("c_name"), 1, 6)), F.when(c % 4 == 1, "80").otherwise("")).alias("hex"))
    cyc = cust.select(s(col("c_nationkey")).alias("tileset_id"), F.concat(F.lit("c"), s(c)).alias("name"), F.when(c % 8 == 5, "ghost").when(c % 8 == 6, "small").otherwise("base").alias("palette"),
                      F.element_at(F.array(*[F.lit(x) for x in ("forward", "backward", "ping-pong", "sideways")]), (c % 4 + 1).cast("int")).alias("direction"), (c % 6).alias("fps"),
                      F.transform(F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), (c % 5).cast("int")), lambda p: F.substring(F.lit(POOL), ((c + p) % 12 + 1).cast("int"), F.lit(1))).alias("symbols"))
    up = F.when(c % 20 == 10, F.concat(F.lit("th"), s(c % 40 + 2))).when(c % 20 == 15, "nowhere").when(c % 5 == 0, none).otherwise(F.concat(F.lit("th"), s(c % 40 - 1)))
    at = lambda e: F.substring(F.lit(POOL), (e % 12 + 1).cast("int"), F.lit(1))
    entry = lambda name, v, cond=None: (F.struct(F.lit(name).alias("key"), v.alias("value")) if cond is None else F.when(cond, F.struct(F.lit(name).alias("key"), v.alias("value"))))
    roles = F.array_compact(F.array(entry("bg", at(c)), entry("fg", at(c * 7), c % 2 == 0), entry("shadow", F.when(c % 30 == 3, "ab").otherwise("#"), c % 3 == 0), entry("accent", F.lit("g"), c % 4 == 2)))
    cons = F.array_compact(F.array(entry("fg_brighter_than_bg", F.lit("true"), c % 2 == 1), entry("shadow_darker_than_bg", F.lit("true")), entry("accent_hue_distinct_from_bg", F.lit("true"), c % 3 == 1), entry("palette_granularity", s(c % 12), c % 5 == 2)))
    theme = cust.select(F.concat(F.lit("themes"), s(tset)).alias("tileset_id"), F.concat(F.lit("th"), s(c % 40)).alias("name"), F.when(c % 7 == 6, "ghost").when(c % 7 == 5, "small").otherwise("base").alias("palette"), up.alias("extends"),
                        F.when(c % 3 == 0, (col("c_nationkey") % 4 + 1).cast("int")).alias("scale"), F.when(c % 4 == 1, 8).alias("canvas"), F.when(c % 2 == 0, col("c_nationkey")).alias("max_palette_size"),
                        F.when(c % 6 == 0, col("c_mktsegment")).alias("light_source"), F.map_from_entries(roles).alias("roles"), F.map_from_entries(cons).alias("constraints"))
    conv, v, t = fx.table(spark, d, "conversations"), col("conv_id"), col("turn")
    ctext = fx.symbol_text(col("text"))
    cgrid = grid_text(F.regexp_extract_all(F.rpad(ctext, F.length(ctext) + F.pmod(-F.length(ctext), F.lit(16)), F.lit(".")), F.lit("(.{16})"), F.lit(1)))
    idx = (t + 1 + F.when((v % 5 == 0) & (t >= 2), 1).otherwise(0)).cast("int")
    frame = conv.select(
        F.lit("conv").alias("spriteset"), s(v).alias("sprite"), t.alias("ord"), idx.alias("index"), F.when(t % 3 == 0, "grid").when(t % 3 == 1, "delta").otherwise("linked").alias("encoding"),
        F.when(t % 3 == 0, cgrid).alias("grid"), F.when((t % 3 == 1) & (v % 11 != 3), F.when(v % 7 == 0, t + 1).otherwise(t)).cast("int").alias("base"), F.when((t % 3 == 2) & (v % 11 != 5), idx - 1).alias("link_to"),
        F.when(v % 2 == 0, 120).alias("duration_ms"), F.when(t % 4 == 2, "h").when(v % 3 == 1, "v").when((v % 3 == 2) & (t % 4 == 0), "vh").alias("mirror"),
        F.when(t % 3 == 1, F.array(F.struct((v % 16).cast("int").alias("x"), F.lit(0).alias("y"), F.lit("#").alias("sym")), F.struct(F.lit(99).alias("x"), F.lit(0).alias("y"), F.lit("+").alias("sym")))).alias("changes"))
    te = fx.tile_edges(spark, d)
    nth = F.expr("cast(substring(name, 2) as bigint)")
    run = te.select("tileset_id", F.concat(F.lit("r"), F.expr("substring(name, 2)")).alias("name"), col("name").alias("left"), F.concat(F.lit("t"), s(nth + 1)).alias("middle"), F.concat(F.lit("t"), s(nth + 2)).alias("right"))
    stamp = part.select(F.concat(F.lit("parts"), s(pset)).alias("tileset_id"), F.concat(F.lit("s"), s(pk)).alias("name"), F.when(pk % 50 == 7, "ghost").when(pk % 50 == 8, "small").otherwise("base").alias("palette"))
    active = fx.table(spark, d, "documents").select(col("source").alias("tileset_id")).distinct().withColumn("max_palette_size", F.expr("6 + cast(substring(tileset_id, 4) as int) % 6"))
    return {"tile": dt.unionByName(pt), "palette": pal, "palette_raw": raw, "cycle": cyc, "theme": theme, "frame": frame, "tile_edges": te, "tile_run": run, "stamp": stamp, "active_theme": active}


RULE_SQL: dict[str, str] = {}


def rule(name: str, sql: str, recursive: bool = False):
    fn = getattr(au, name)

    RULE_SQL[name] = ("WITH RECURSIVE " if recursive else "WITH ") + B + sql

    @query(name, RULE_SQL[name])
    def run(spark, d):
        return fn(tables(spark, d)).select(F.col("tileset_id").cast("string").alias("tileset_id"), "name", "detail")


rule("v_palette_parse", """SELECT c_nationkey::varchar AS tileset_id, 'n' || c_nationkey AS name, sym || ': ' || CASE WHEN length(sym) <> 1 THEN 'key must be one character' ELSE 'bad colour' END AS detail
 FROM (SELECT *, CASE WHEN c_custkey % 15 = 4 THEN 'ab' ELSE substr('""" + POOL + """', c_custkey % 12 + 1, 1) END AS sym FROM customer) WHERE length(sym) <> 1 OR c_custkey % 10 = 3""")
rule("v_palette_ref", """SELECT tileset_id, name, palette AS detail FROM (SELECT tileset_id, name, palette FROM tl WHERE template IS NULL
 UNION ALL SELECT 'parts' || (p_partkey // 100), 's' || p_partkey, CASE p_partkey % 50 WHEN 7 THEN 'ghost' WHEN 8 THEN 'small' ELSE 'base' END FROM part) WHERE (tileset_id, palette) NOT IN (SELECT tileset_id, palette FROM kp)""")
rule("v_size", "SELECT tileset_id, name, CASE WHEN size IS NULL THEN 'missing' WHEN size = 'bad' THEN 'malformed' ELSE 'zero' END AS detail FROM tl WHERE template IS NULL AND (size IS NULL OR size = 'bad' OR size LIKE '0x%' OR size LIKE '%x0')")
rule("v_pixels", "SELECT tileset_id, name, 'no grid, rle or layout' AS detail FROM tl WHERE template IS NULL AND flat IS NULL AND rle IS NULL")
rule("v_grid_shape", "SELECT tileset_id, name, array_to_string(list_filter([CASE WHEN h <> length(flat) // 16 THEN 'height' END, CASE WHEN symmetry = 'horizontal' THEN 'width' END], lambda z: z IS NOT NULL), ',') AS detail FROM own WHERE flat IS NOT NULL AND (h <> length(flat) // 16 OR symmetry = 'horizontal')")
rule("v_symbols", "SELECT DISTINCT tileset_id, name, sym AS detail FROM (SELECT tileset_id, name, palette, unnest(string_split(flat, '')) AS sym FROM own WHERE flat IS NOT NULL UNION ALL SELECT tileset_id, name, palette, unnest(['Q', '#', '+', '.']) FROM own WHERE rle IS NOT NULL) z JOIN kp USING (tileset_id, palette) WHERE (sym <> 'Q' OR (substr(name, 2)::int % 6 = 1)) AND (tileset_id, palette, sym) NOT IN (SELECT tileset_id, palette, sym FROM pal)")
rule("v_rle", """SELECT tileset_id, name, array_to_string(list_filter([CASE WHEN p_partkey % 7 = 3 THEN 'token' END, CASE WHEN p_size % 20 + 1 + 15 - p_size % 15 <> 16 THEN 'width' END, CASE WHEN p_partkey % 5 = 2 THEN 'height' END], lambda z: z IS NOT NULL), ',') AS detail
 FROM own JOIN part ON name = 'p' || p_partkey WHERE p_partkey % 7 = 3 OR p_size % 20 + 1 + 15 - p_size % 15 <> 16 OR p_partkey % 5 = 2""")
rule("v_palette_size", "SELECT tileset_id, name, n || '>' || m AS detail FROM (SELECT tileset_id, name, len(list_distinct(string_split(flat, ''))) AS n, 6 + substr(tileset_id, 4)::int % 6 AS m FROM own WHERE flat IS NOT NULL) WHERE n > m")
rule("v_rotate_square", "SELECT tileset_id, name, size AS detail FROM own WHERE auto_rotate = '4way' AND w <> h")
rule("v_template", """SELECT tileset_id, name, detail FROM (SELECT t.tileset_id, t.name, unnest(list_filter([CASE WHEN b.name IS NULL THEN 'missing' END, CASE WHEN b.template IS NOT NULL THEN 'chain' END,
  CASE WHEN b.name IS NOT NULL AND t.flat IS NOT NULL THEN 'own pixels' END, CASE WHEN b.name IS NOT NULL AND b.flat IS NULL AND b.rle IS NULL THEN 'base has no pixels' END], lambda z: z IS NOT NULL)) AS detail FROM tl t LEFT JOIN tl b ON b.tileset_id = t.tileset_id AND b.name = t.template WHERE t.template IS NOT NULL)""")
TE = fx.tile_edges_sql()
rule("v_tile_run", "SELECT tileset_id, name, detail FROM (SELECT l.tileset_id::varchar AS tileset_id, 'r' || substr(l.name, 2) AS name, unnest(list_filter([CASE WHEN l.e <> m.w THEN 'left' END, CASE WHEN m.e <> m.w THEN 'middle' END, CASE WHEN m.e <> r.w THEN 'right' END], lambda z: z IS NOT NULL)) AS detail FROM te l JOIN te m ON m.tileset_id = l.tileset_id AND substr(m.name, 2)::int = substr(l.name, 2)::int + 1 JOIN te r ON r.tileset_id = l.tileset_id AND substr(r.name, 2)::int = substr(l.name, 2)::int + 2)".replace("SELECT tileset_id, name, detail FROM (", ", " + TE.strip() + " SELECT tileset_id, name, detail FROM (", 1))
rule("v_frames", "SELECT DISTINCT spriteset AS tileset_id, sprite AS name, 'indices are not 1..n' AS detail FROM (SELECT *, row_number() OVER (PARTITION BY sprite ORDER BY ord) AS i FROM fr) WHERE i <> idx")
rule("v_delta_base", "SELECT tileset_id, name, idx || ': ' || why AS detail FROM (SELECT f.spriteset AS tileset_id, f.sprite AS name, f.idx, unnest(list_filter([CASE WHEN f.base >= f.idx THEN 'not before frame' END, CASE WHEN b.encoding <> 'grid' THEN 'not a grid' END], lambda z: z IS NOT NULL)) AS why FROM fr f LEFT JOIN fr b ON b.sprite = f.sprite AND b.idx = f.base WHERE f.encoding = 'delta' AND f.base IS NOT NULL)")
rule("v_cycle", """SELECT tileset_id, name, 'palette' AS detail FROM cy WHERE (tileset_id, palette) NOT IN (SELECT tileset_id, palette FROM kp) UNION ALL SELECT tileset_id, name, 'too few symbols' FROM cy JOIN kp USING (tileset_id, palette) WHERE n < 2
 UNION ALL SELECT tileset_id, name, 'direction' FROM cy JOIN kp USING (tileset_id, palette) WHERE direction = 'sideways' UNION ALL SELECT tileset_id, name, 'fps' FROM cy JOIN kp USING (tileset_id, palette) WHERE fps = 0
 UNION ALL SELECT tileset_id, name, 'symbol ' || sym FROM cs JOIN kp USING (tileset_id, palette) WHERE (tileset_id, palette, sym) NOT IN (SELECT tileset_id, palette, sym FROM pal)""")
CHAIN = """, tc(tileset_id, name, anc, depth, path, up) AS (SELECT tileset_id, name, name, 0, [name], extends FROM th
 UNION ALL SELECT tc.tileset_id, tc.name, th.name, depth + 1, list_append(path, th.name), th.extends FROM tc JOIN th ON th.tileset_id = tc.tileset_id AND th.name = tc.up WHERE NOT list_contains(path, tc.up)),
cst AS (SELECT tileset_id, name, max(CASE WHEN up IS NULL THEN 'ok' WHEN list_contains(path, up) THEN 'cycle' WHEN (tileset_id, up) NOT IN (SELECT tileset_id, name FROM th) THEN 'missing' END) AS status FROM tc GROUP BY 1, 2),
rs AS (SELECT tc.tileset_id, tc.name, arg_min(palette, depth) AS palette, coalesce(arg_min(scale, depth) FILTER (scale IS NOT NULL), 1) AS scale, coalesce(arg_min(canvas, depth) FILTER (canvas IS NOT NULL), 16) AS canvas, arg_min(max_palette_size, depth) FILTER (max_palette_size IS NOT NULL) AS max_palette_size, arg_min(light_source, depth) FILTER (light_source IS NOT NULL) AS light_source FROM tc JOIN th ON th.tileset_id = tc.tileset_id AND th.name = tc.anc GROUP BY 1, 2),
rr AS (SELECT tc.tileset_id, tc.name, role, arg_min(sym, depth) AS sym FROM tc JOIN ro ON ro.tileset_id = tc.tileset_id AND ro.name = tc.anc GROUP BY 1, 2, 3) """
rule("v_theme", CHAIN + """SELECT tileset_id, name, status AS detail FROM cst WHERE status <> 'ok'
 UNION ALL SELECT tileset_id, name, 'palette ' || palette FROM rs JOIN cst USING (tileset_id, name) WHERE status = 'ok' AND (tileset_id, palette) NOT IN (SELECT tileset_id, palette FROM kp)
 UNION ALL SELECT tileset_id, name, 'role ' || role || CASE WHEN length(sym) <> 1 THEN ' is not one symbol' ELSE ' not in palette' END FROM rr JOIN rs USING (tileset_id, name) JOIN cst USING (tileset_id, name) JOIN kp USING (tileset_id, palette)
 WHERE status = 'ok' AND (length(sym) <> 1 OR (tileset_id, palette, sym) NOT IN (SELECT tileset_id, palette, sym FROM pal))""", True)
LINS = "CASE WHEN {0} / 255.0::double <= 0.04045 THEN {0} / 255.0::double / 12.92 ELSE pow(({0} / 255.0::double + 0.055) / 1.055, 2.4) END"
METRIC = CHAIN + f""", mt AS (SELECT rr.tileset_id, rr.name, role, 0.2126 * {LINS.format('r')} + 0.7152 * {LINS.format('g')} + 0.0722 * {LINS.format('b')} AS lum, CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN greatest(r, g, b) = r THEN ((60 * (g - b) / (greatest(r, g, b) - least(r, g, b))::double) + 360) % 360
  WHEN greatest(r, g, b) = g THEN 60 * ((b - r) / (greatest(r, g, b) - least(r, g, b))::double + 2) ELSE 60 * ((r - g) / (greatest(r, g, b) - least(r, g, b))::double + 4) END AS hue
 FROM rr JOIN rs ON rs.tileset_id = rr.tileset_id AND rs.name = rr.name JOIN cst ON cst.tileset_id = rr.tileset_id AND cst.name = rr.name JOIN pal ON pal.tileset_id = rr.tileset_id AND pal.palette = rs.palette AND pal.sym = rr.sym WHERE status = 'ok'),
tm AS (SELECT tileset_id, name, max(lum) FILTER (role = 'fg') AS fl, max(lum) FILTER (role = 'bg') AS bl, max(lum) FILTER (role = 'shadow') AS sl, max(hue) FILTER (role = 'bg') AS bh, max(hue) FILTER (role = 'accent') AS ah FROM mt GROUP BY 1, 2) """
rule("v_theme_constraints", METRIC + """SELECT tileset_id, name, con AS detail FROM cns JOIN cst USING (tileset_id, name) LEFT JOIN tm USING (tileset_id, name) WHERE status = 'ok' AND ((con = 'fg_brighter_than_bg' AND fl <= bl) OR (con = 'shadow_darker_than_bg' AND sl >= bl)
 OR (con = 'accent_hue_distinct_from_bg' AND least(abs(ah - bh), 360 - abs(ah - bh)) < 40) OR (con = 'palette_granularity' AND (TRY_CAST(val AS INT) < 1 OR TRY_CAST(val AS INT) > 8)))""", True)


@query("theme_metrics", "WITH RECURSIVE " + B + METRIC + "SELECT tileset_id, name, round(fl, 6) AS fg_lum, round(bl, 6) AS bg_lum, round(sl, 6) AS shadow_lum, round(bh, 6) AS bg_hue, round(ah, 6) AS accent_hue FROM tm")
def theme_metrics(spark, d):
    ts = tables(spark, d)
    return au.theme_metrics(ts, df_.resolve_themes(ts["theme"])).select("tileset_id", "name", R6("fg_lum"), R6("bg_lum"), R6("shadow_lum"), R6("bg_hue"), R6("accent_hue"))


@query("v_stats", "WITH " + B + """SELECT c_nationkey::varchar AS tileset_id, 'palette' AS entity_type, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'parts' || (p_partkey // 100), 'stamp', count(*) FROM part GROUP BY 1 UNION ALL SELECT tileset_id, 'theme', count(*) FROM th GROUP BY 1 UNION ALL SELECT tileset_id, 'tile', count(*) FROM tl GROUP BY 1
 UNION ALL SELECT tileset_id, 'cycle', count(*) FROM cy GROUP BY 1 UNION ALL SELECT (p_partkey // 100)::varchar, 'tile_run', count(*) FROM part GROUP BY 1 UNION ALL SELECT 'conv', 'sprite', count(DISTINCT sprite) FROM fr""")
def v_stats(spark, d):
    return au.v_stats(tables(spark, d)).select("tileset_id", "entity_type", "n")


def _validate_sql() -> str:
    """All rules' own SQL, counted."""
    kinds = {"v_palette_parse": "palette", "v_tile_run": "tile_run", "v_frames": "sprite", "v_delta_base": "sprite", "v_cycle": "cycle", "v_theme": "theme", "v_theme_constraints": "theme"}
    parts = []
    for name, sql in RULE_SQL.items():
        kind = "CASE WHEN left(name, 1) = 's' THEN 'stamp' ELSE 'tile' END" if name == "v_palette_ref" else f"'{kinds.get(name, 'tile')}'"
        level = "warning" if name in ("v_cycle", "v_theme_constraints") else "error"
        parts.append(f"SELECT tileset_id::varchar AS tileset_id, {kind} AS entity_type, '{name[2:]}' AS rule, '{level}' AS severity FROM ({sql})")
    return "SELECT tileset_id, entity_type, rule, severity, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


@query("validate", _validate_sql())
def validate(spark, d):
    return au.validate(tables(spark, d)).groupBy("tileset_id", "entity_type", "rule", "severity").agg(F.count("*").alias("n"))


# --- definitions ---------------------------------------------------------------------
@query("theme_resolve", "WITH RECURSIVE " + B + CHAIN + "SELECT tileset_id, name, palette, scale, canvas, max_palette_size, light_source, status, coalesce((SELECT string_agg(role || '=' || sym, ',' ORDER BY role) FROM rr WHERE rr.tileset_id = rs.tileset_id AND rr.name = rs.name), '') AS roles FROM rs JOIN cst USING (tileset_id, name)")
def theme_resolve(spark, d):
    r = df_.resolve_themes(tables(spark, d)["theme"])
    text = F.array_join(F.array_sort(F.transform(F.map_entries("roles"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return r.select("tileset_id", "name", "palette", "scale", "canvas", "max_palette_size", "light_source", "status", F.coalesce(text, F.lit("")).alias("roles"))


@query("palette_resolve", f"""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE left(md5(c_name), 6) END AS x, c_custkey % 4 = 1 AS al FROM customer)
SELECT c_custkey, ('0x' || substr(x, 1, 2))::int AS r, ('0x' || substr(x, 3, 2))::int AS g, ('0x' || substr(x, 5, 2))::int AS b, CASE WHEN x IS NOT NULL THEN CASE WHEN al THEN 128 ELSE 255 END END AS a FROM p""")
def palette_resolve(spark, d):
    c = F.col("c_custkey")
    h = F.concat(F.lit("#"), F.when(c % 10 == 3, "zz").otherwise(F.substring(F.md5("c_name"), 1, 6)), F.when(c % 4 == 1, "80").otherwise(""))
    return fx.table(spark, d, "customer").withColumn("hex", h).withColumns(hex_channels(F.col("hex"))).select("c_custkey", *"rgba")


PALETTE_EXT_SQL = "WITH " + B + """,
raw AS (SELECT c_nationkey::varchar AS tileset_id, c_custkey % 3 AS e, CASE WHEN c_custkey % 11 = 2 THEN '#' ELSE (2 + c_custkey % 4) || chr((97 + c_custkey % 26)::int) END AS sym,
  CASE WHEN c_custkey % 10 = 3 THEN 'zz' ELSE left(md5(c_name), 6) END AS x FROM customer),
ex AS (SELECT tileset_id, 'e' || e AS palette, CASE e WHEN 0 THEN 'base' WHEN 1 THEN 'small' ELSE 'ghost' END AS base, sym, max(x) AS x FROM raw GROUP BY ALL),
link AS (SELECT DISTINCT tileset_id, palette, base, (tileset_id, base) IN (SELECT tileset_id, palette FROM kp) AS found FROM ex),
mine AS (SELECT ex.tileset_id, ex.palette, sym, ('0x' || substr(nullif(x, 'zz'), 1, 2))::int AS r, ('0x' || substr(nullif(x, 'zz'), 3, 2))::int AS g,
  ('0x' || substr(nullif(x, 'zz'), 5, 2))::int AS b, CASE WHEN x = 'zz' THEN 'bad colour' END AS error FROM ex JOIN link USING (tileset_id, palette) WHERE found)
SELECT * FROM mine
UNION ALL SELECT l.tileset_id, l.palette, p.sym, p.r, p.g, p.b, NULL FROM link l JOIN pal p ON p.tileset_id = l.tileset_id AND p.palette = l.base
  WHERE NOT EXISTS (SELECT 1 FROM mine m WHERE m.tileset_id = l.tileset_id AND m.palette = l.palette AND m.sym = p.sym)
UNION ALL SELECT tileset_id, palette, NULL, NULL, NULL, NULL, 'base palette not found' FROM link WHERE NOT found"""


@query("palette_ext_merge", PALETTE_EXT_SQL)
def palette_ext_merge(spark, d):
    c, e = F.col("c_custkey"), F.col("c_custkey") % 3
    hexes = F.concat(F.lit("#"), F.when(c % 10 == 3, "zz").otherwise(F.substring(F.md5("c_name"), 1, 6)))
    sym = F.when(c % 11 == 2, "#").otherwise(F.concat((c % 4 + 2).cast("string"), F.char(F.lit(97) + c % 26)))
    ext = fx.table(spark, d, "customer").select(
        F.col("c_nationkey").cast("string").alias("tileset_id"), F.concat(F.lit("e"), e.cast("string")).alias("palette"),
        F.when(e == 0, "base").when(e == 1, "small").otherwise("ghost").alias("base"), sym.alias("sym"), hexes.alias("hex"))
    ext = ext.groupBy("tileset_id", "palette", "base", "sym").agg(F.max("hex").alias("hex"))
    keys = ext.select("tileset_id", "palette", "base").distinct().select("*", F.lit("base").alias("sym"), F.lit("#000000").alias("hex"))  # the link itself
    return df_.merge_palette_ext(tables(spark, d)["palette"], ext.unionByName(keys)).select("tileset_id", "palette", "sym", "r", "g", "b", "error")


COLOR = f"WITH {fx.TILE_SQL}, {fx.PALETTE_SQL}"


@query("colorize", COLOR + " SELECT tileset_id, coalesce(p.r, 255) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 255) AS b, coalesce(p.a, 255) AS a, count(*) AS n FROM px LEFT JOIN (SELECT * FROM palette WHERE sym <> 'w') p USING (sym) GROUP BY ALL")
def colorize(spark, d):
    px = g.to_pixels(fx.tiles(spark, d), ("tileset_id",))
    return df_.colorize(px, fx.palette(spark).where("sym <> 'w'").drop("palette"), []).groupBy("tileset_id", *"rgba").agg(F.count("*").alias("n"))


@query("palette_swap", COLOR + " SELECT theme, CASE sym WHEN '#' THEN 1 WHEN 'q' THEN 2 WHEN 'r' THEN 3 ELSE p.r END AS r, count(*) AS n FROM px LEFT JOIN palette p USING (sym) GROUP BY ALL")
def palette_swap(spark, d):
    swap = spark.createDataFrame([("#", 1, 1, 1, 255), ("q", 2, 2, 2, 255), ("r", 3, 3, 3, 255)], "sym string, r int, g int, b int, a int")
    px = g.to_pixels(fx.tiles(spark, d), ("theme",))
    return df_.colorize(px, fx.palette(spark).drop("palette"), [], swap, []).groupBy("theme", "r").agg(F.count("*").alias("n"))


@query("cycle_remap", "WITH " + B + """, k AS (SELECT name, direction, k, n, tick, CASE direction WHEN 'forward' THEN tick % n WHEN 'backward' THEN (n - tick % n) % n WHEN 'ping-pong' THEN CASE WHEN tick % greatest(2 * (n - 1), 1) < n THEN tick % greatest(2 * (n - 1), 1) ELSE greatest(2 * (n - 1), 1) - tick % greatest(2 * (n - 1), 1) END ELSE 0 END AS sh FROM cy, (VALUES (0), (1), (3), (6), (7)) t(tick) WHERE n > 0)
SELECT cs.name AS cycle, cs.p AS pos, k.tick, o.sym AS shown FROM cs JOIN k USING (name) JOIN cs o ON o.name = cs.name AND o.p = (cs.p + k.sh) % k.n""")
def cycle_remap(spark, d):
    c = tables(spark, d)["cycle"].select(F.col("name").alias("cycle"), "direction", F.posexplode("symbols").alias("pos", "sym"))
    out = df_.apply_cycle(c.select("cycle", "sym", "pos"), c, [0, 1, 3, 6, 7])
    return out.select("cycle", BIG("pos"), "tick", "shown")


# Frame by frame in listed order; each step sees all earlier frames of its sprite as shown.
FRAMES = f"""
seqf AS (SELECT *, rpad(t, ((length(t) + 15) // 16 * 16)::int, '.') AS flat, row_number() OVER (PARTITION BY sprite ORDER BY ord) AS k FROM (SELECT *, {fx.SYMBOL_TEXT_SQL.format('text')} AS t FROM fr)),
rec(sprite, conv_id, k, done) AS (
 SELECT sprite, conv_id, 0::bigint, []::STRUCT(i INTEGER, f VARCHAR)[] FROM (SELECT DISTINCT sprite, conv_id FROM fr)
 UNION ALL
 SELECT sprite, conv_id, k, list_append(done, {{'i': idx::int, 'f': CASE mirror WHEN 'v' THEN up WHEN 'h' THEN reverse(up) WHEN 'vh' THEN reverse(body) ELSE body END}})
 FROM (SELECT *, array_to_string(list_reverse(regexp_extract_all(body, '.{{16}}')), '') AS up
  FROM (SELECT *, CASE WHEN encoding = 'grid' THEN flat WHEN encoding = 'linked' OR src = '' THEN src ELSE left(src, conv_id % 16) || '#' || substr(src, conv_id % 16 + 2) END AS body
   FROM (SELECT s.sprite, s.conv_id, s.k, s.idx, s.encoding, s.flat, s.mirror, r.done,
          list_filter(r.done, lambda z: z.i = coalesce(CASE s.encoding WHEN 'delta' THEN s.base ELSE s.link_to END, 1))[-1].f AS src
         FROM rec r JOIN seqf s ON s.sprite = r.sprite AND s.k = r.k + 1))))"""


@query("sprite_frames", "WITH RECURSIVE " + B + "," + FRAMES + """
SELECT sprite, done[-1].i AS index, CASE WHEN conv_id % 2 = 0 THEN 120 ELSE 125 END AS duration_ms, md5(done[-1].f) AS digest FROM rec WHERE k > 0 AND done[-1].f IS NOT NULL""")
def sprite_frames(spark, d):
    f = df_.resolve_grids(tables(spark, d)["frame"])
    return f.select("sprite", BIG("index"), "duration_ms", F.md5(F.replace("grid", F.lit("\n"), F.lit(""))).alias("digest"))


@query("frame_errors", "WITH RECURSIVE " + B + "," + FRAMES + " SELECT sprite, done[-1].i AS index FROM rec WHERE k > 0 AND done[-1].f IS NULL")
def frame_errors(spark, d):
    return df_.frame_errors(tables(spark, d)["frame"]).select("sprite", BIG("index"))


REF = "base || CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '!h' WHEN 2 THEN '!vd' ELSE '!hvd' END || CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ':shadow' WHEN 2 THEN ':hi' WHEN 3 THEN ':glow' ELSE ':s' END"


@query("tile_ref_parse", f"""WITH {fx.MAP_SQL}, r AS (SELECT o_orderkey, o_custkey, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'wall' WHEN left(o_orderpriority, 1) = '5' THEN 'water' ELSE 'floor' END AS base FROM orders)
SELECT o_orderkey, base || CASE WHEN o_custkey % 5 = 3 AND o_custkey % 4 = 0 THEN ':glow' ELSE '' END AS name, o_custkey % 4 IN (1, 3) AS flip_h, o_custkey % 4 IN (2, 3) AS flip_v, o_custkey % 4 IN (2, 3) AS flip_d, CASE o_custkey % 5 WHEN 1 THEN 'shadow' WHEN 4 THEN 'shadow' WHEN 2 THEN 'highlight' END AS modifier FROM r""")
def tile_ref_parse(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    o = fx.table(spark, d, "orders").withColumn("base", F.when(p.isin("1", "2"), "wall").when(p == "5", "water").otherwise("floor"))
    return o.select("o_orderkey", df_.parse_ref(F.expr(REF)).alias("_r")).select("o_orderkey", "_r.*")


@query("map_cells", f"""WITH {fx.MAP_SQL}, c AS (SELECT map_id, y, x, base FROM cell WHERE base <> 'water') SELECT map_id, 'ground' AS layer, 1 - map_id % 2 AS depth, 'custom' AS role, 1.0::double AS scroll, x, y, base AS name FROM c
UNION ALL SELECT map_id, 'over', map_id % 2, 'overlay', 0.5, x, y, base FROM c""")
def map_cells(spark, d):
    from gridweave.operators.dataset import map_text
    from gridweave.operators.maps import base_name
    m = fx.map_cells(spark, d).withColumn("tile", base_name(F.col("tile")))
    text = map_text(m.withColumn("tile", F.when(F.col("tile") == "water", ".").otherwise(F.col("tile")))).withColumnRenamed("grid_text", "grid")
    k = F.col("map_id") % 2
    layer = F.array(F.struct(F.lit("ground").alias("layer"), (1 - k).cast("int").alias("z_order"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("double").alias("scroll")),
                    F.struct(F.lit("over").alias("layer"), k.cast("int").alias("z_order"), F.lit("overlay").alias("role"), F.lit(0.5).alias("scroll")))
    l = text.select("map_id", "grid", F.explode(layer).alias("_l")).select("map_id", "grid", "_l.*", F.lit(None).cast("string").alias("collision_mode"))
    return df_.map_cells(l).select("map_id", "layer", BIG("depth"), "role", "scroll", BIG("x"), BIG("y"), "name")


@query("resolve_template", "WITH " + B + "SELECT t.tileset_id, t.name, CASE WHEN t.template IS NOT NULL THEN coalesce(t.size, b.size) ELSE t.size END AS size, md5(CASE WHEN t.template IS NOT NULL THEN b.flat ELSE t.flat END) AS digest FROM tl t LEFT JOIN (SELECT * FROM tl WHERE template IS NULL) b ON b.tileset_id = t.tileset_id AND b.name = t.template")
def resolve_template(spark, d):
    r = g.resolve_templates(tables(spark, d)["tile"])
    return r.select("tileset_id", "name", "size", F.md5(F.replace("grid", F.lit("\n"), F.lit(""))).alias("digest"))


@query("compose_layout", """WITH s(name, w, h, flat) AS (VALUES ('wall', 2, 2, '##++'), ('floor', 3, 2, 'ggg==='), ('tall', 1, 3, 'rho')),
c AS (SELECT o_orderkey // 96 AS id, (o_orderkey % 96) // 12 AS r, o_orderkey % 12 AS c, CASE WHEN left(o_orderpriority, 1) = '5' THEN NULL WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'wall' WHEN (o_orderkey % 96) // 12 % 3 = 2 THEN 'tall' ELSE 'floor' END AS name FROM orders),
j AS (SELECT c.*, s.w, s.h, s.flat, first_value(s.h IGNORE NULLS) OVER (PARTITION BY id, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rh FROM c LEFT JOIN s USING (name)),
k AS (SELECT *, coalesce(sum(coalesce(w, rh)) OVER (PARTITION BY id, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM j),
ro AS (SELECT id, r, any_value(rh) AS rh FROM j GROUP BY ALL), ry AS (SELECT id, r, coalesce(sum(rh) OVER (PARTITION BY id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0 FROM ro),
p AS (SELECT id, r, c, x0 + i % coalesce(w, rh) AS x, y0 + i // coalesce(w, rh) AS y, CASE WHEN name IS NULL THEN '.' ELSE substr(flat, (i + 1)::bigint, 1) END AS sym FROM (SELECT k.*, unnest(range(0, coalesce(w * h, rh * rh))) AS i FROM k) z JOIN ry USING (id, r))
SELECT id AS layout_id, x::bigint AS x, y::bigint AS y, arg_max(sym, r * 1000 + c) AS sym FROM p GROUP BY ALL""")
def compose_layout(spark, d):
    o = fx.table(spark, d, "orders")
    p, r = F.substring("o_orderpriority", 1, 1), F.expr("(o_orderkey % 96) div 12")
    tok = F.when(p == "5", "_").when(p.isin("1", "2"), "@wall").when(r % 3 == 2, "@tall").otherwise("@floor")
    cells = o.select(F.expr("o_orderkey div 96").alias("map_id"), (F.col("o_orderkey") % 12).alias("x"), r.alias("y"), tok.alias("tile"))
    from gridweave.operators.dataset import map_text
    layouts = map_text(cells).select(F.col("map_id").alias("layout_id"), F.col("grid_text").alias("layout"))
    stamps = spark.createDataFrame([("wall", 2, 2, "##\n++"), ("floor", 3, 2, "ggg\n==="), ("tall", 1, 3, "r\nh\no")], "name string, w int, h int, grid string")
    return g.compose(layouts, stamps).select("layout_id", BIG("x"), BIG("y"), "sym")
