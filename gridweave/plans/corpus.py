"""Tile corpus queries: codecs, features, style and training-set assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import fixtures as fx
from gridweave.functions import labels
from gridweave.functions.grids import flip_rows, grid_text, rotate_rows, rows_of
from gridweave.operators import dataset as ds
from gridweave.operators import features as ft
from gridweave.operators import grid as g
from gridweave.operators import style as st
from gridweave.operators.manifest import affordance_of
from gridweave.operators.ranking import draw
from gridweave.plans.registry import query

R6 = lambda c: F.round(F.col(c), 6).alias(c)
BIG = lambda c: F.col(c).cast("bigint").alias(c)
T = fx.TILE_SQL
ROWTEXT = "array_to_string([substr(flat, (r * 16 + 1)::bigint, 16) FOR r IN range(0, 16)], chr(10))"


# --- codecs ---------------------------------------------------------------
@query("grid_to_pixels", f"WITH {T} SELECT tileset_id, x, y, sym, count(*) AS n FROM px GROUP BY ALL")
def grid_to_pixels(spark, d):
    px = g.to_pixels(fx.tiles(spark, d), ("tile_id", "tileset_id"))
    return px.groupBy("tileset_id", BIG("x"), BIG("y"), "sym").agg(F.count("*").alias("n"))


@query("pixels_to_grid", f"WITH {T} SELECT tile_id, md5({ROWTEXT}) AS digest FROM tile")
def pixels_to_grid(spark, d):
    px = g.to_pixels(fx.tiles(spark, d))
    return g.to_grid(px).select("tile_id", F.md5("grid").alias("digest"))


RLE_SQL = f"""WITH {T},
mark AS (SELECT *, CASE WHEN x = 0 OR lag(sym) OVER (PARTITION BY tile_id, y ORDER BY x) <> sym THEN 1 ELSE 0 END AS b FROM px),
isl AS (SELECT *, sum(b) OVER (PARTITION BY tile_id, y ORDER BY x) AS i FROM mark),
runs AS (SELECT tile_id, y, i, count(*) AS n, any_value(sym) AS sym FROM isl GROUP BY ALL),
rrow AS (SELECT tile_id, y, string_agg(CASE WHEN n = 1 THEN sym ELSE n || sym END, ' ' ORDER BY i) AS t FROM runs GROUP BY ALL)
SELECT tile_id, md5(string_agg(t, chr(10) ORDER BY y)) AS digest FROM rrow GROUP BY tile_id"""


@query("rle_encode", RLE_SQL)
def rle_encode(spark, d):
    return g.rle_encode(fx.tiles(spark, d)).select("tile_id", F.md5("rle").alias("digest"))


@query("rle_encode_pixels", RLE_SQL)
def rle_encode_pixels(spark, d):
    return g.pixels_to_rle(g.to_pixels(fx.tiles(spark, d))).select("tile_id", F.md5("rle").alias("digest"))


@query("rle_decode", f"WITH {T} SELECT tile_id, sym, count(*) AS n, sum(x)::bigint AS sx, sum(y)::bigint AS sy FROM px GROUP BY ALL")
def rle_decode(spark, d):
    coded = g.rle_encode(fx.tiles(spark, d))
    return g.rle_decode(coded).groupBy("tile_id", "sym").agg(
        F.count("*").alias("n"), F.sum("x").cast("bigint").alias("sx"), F.sum("y").cast("bigint").alias("sy"))


@query("symmetry_expand", f"""WITH {T}, mode AS (SELECT *, CASE tile_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'horizontal' WHEN 2 THEN 'vertical' ELSE 'quad' END AS m FROM px),
e AS (SELECT tile_id, sym, x, y, m, unnest(CASE WHEN m IN ('horizontal', 'quad') THEN [x, 31 - x] ELSE [x] END) AS ex,
  CASE WHEN m IN ('vertical', 'quad') THEN [y, 31 - y] ELSE [y] END AS eys FROM mode),
f AS (SELECT tile_id, sym, ex, unnest(eys) AS ey FROM e)
SELECT tile_id, sym, count(*) AS n, sum(ex)::bigint AS sx, sum(ey)::bigint AS sy FROM f GROUP BY ALL""")
def symmetry_expand(spark, d):
    t = fx.tiles(spark, d)
    m = F.element_at(F.array(*[F.lit(v) for v in ("none", "horizontal", "vertical", "quad")]), (F.col("tile_id") % 4 + 1).cast("int"))
    t = t.withColumn("symmetry", m)
    px = g.to_pixels(t, ("tile_id", "symmetry")).withColumns({
        "w": F.when(F.col("symmetry").isin("horizontal", "quad"), 32).otherwise(16),
        "h": F.when(F.col("symmetry").isin("vertical", "quad"), 32).otherwise(16)})
    return g.expand_symmetry(px).groupBy("tile_id", "sym").agg(
        F.count("*").alias("n"), F.sum("x").cast("bigint").alias("sx"), F.sum("y").cast("bigint").alias("sy"))


@query("rotate_flip", f"""WITH {T}, r AS (SELECT tile_id, sym, unnest([
  struct_pack(op := 'rot90', nx := 15 - y, ny := x), struct_pack(op := 'rot180', nx := 15 - x, ny := 15 - y),
  struct_pack(op := 'rot270', nx := y, ny := 15 - x), struct_pack(op := 'flip_h', nx := 15 - x, ny := y), struct_pack(op := 'flip_v', nx := x, ny := 15 - y)]) AS o FROM px)
SELECT tile_id, o.op AS op, md5(string_agg(sym, '' ORDER BY o.ny, o.nx)) AS digest FROM r GROUP BY ALL""")
def rotate_flip(spark, d):
    rows = rows_of(F.col("grid"))
    ops = {"rot90": rotate_rows(rows, 1), "rot180": rotate_rows(rows, 2), "rot270": rotate_rows(rows, 3),
           "flip_h": flip_rows(rows, "h"), "flip_v": flip_rows(rows, "v")}
    arr = F.array(*[F.struct(F.lit(k).alias("op"), F.md5(F.array_join(v, "")).alias("digest")) for k, v in ops.items()])
    return fx.tiles(spark, d).select("tile_id", F.explode(arr).alias("_o")).select("tile_id", "_o.*")


@query("rotate_pixels", f"""WITH {T} SELECT tileset_id, sym, 15 - y AS x, x AS y, count(*) AS n FROM px GROUP BY ALL""")
def rotate_pixels(spark, d):
    px = g.to_pixels(fx.tiles(spark, d), ("tile_id", "tileset_id", "w", "h"))
    r = g.flip(g.flip(g.rotate(g.rotate(px, 3), 2), "h"), "h")
    return r.groupBy("tileset_id", "sym", BIG("x"), BIG("y")).agg(F.count("*").alias("n"))


@query("augment_rotations", f"""WITH {T}, r AS (SELECT tile_id, sym, unnest([struct_pack(rotation := '', nx := x, ny := y),
  struct_pack(rotation := '90', nx := 15 - y, ny := x), struct_pack(rotation := '180', nx := 15 - x, ny := 15 - y),
  struct_pack(rotation := '270', nx := y, ny := 15 - x)]) AS o FROM px)
SELECT tile_id, o.rotation AS rotation, md5(string_agg(sym, '' ORDER BY o.ny, o.nx)) AS digest FROM r GROUP BY ALL""")
def augment_rotations(spark, d):
    a = g.augment4(fx.tiles(spark, d).select("tile_id", "grid"))
    return a.select("tile_id", "rotation", F.md5(F.replace("grid", F.lit("\n"), F.lit(""))).alias("digest"))


# --- features and labels ---------------------------------------------------
FEAT_SQL = T + """,
pxf AS (SELECT tile_id, tileset_id, i, i % 16 AS x, i // 16 AS y, substr(flat, i + 1, 1) AS sym,
   substr(flat, (i // 16) * 16 + 16 - i % 16, 1) AS mh, substr(flat, (15 - i // 16) * 16 + i % 16 + 1, 1) AS mv,
   substr(flat, i + 2, 1) AS rt, substr(flat, i + 17, 1) AS dn
  FROM (SELECT *, unnest(range(0, 256)) AS i FROM tile)),
f0 AS (SELECT tile_id, any_value(tileset_id) AS tileset_id, count(*) FILTER (sym <> '.') AS filled,
   count(*) FILTER (x < 8 AND sym = mh) / 128.0::double AS symmetry_h, count(*) FILTER (y < 8 AND sym = mv) / 128.0::double AS symmetry_v,
   (count(*) FILTER (x < 15 AND sym <> rt) + count(*) FILTER (y < 15 AND sym <> dn)) / 480.0::double AS edge_complexity
  FROM pxf GROUP BY tile_id),
sc AS (SELECT tile_id, sym, count(*) AS n, min(i) AS first FROM pxf WHERE sym <> '.' GROUP BY ALL),
top AS (SELECT tile_id, count(*) AS unique_symbols, max(n) AS top_n, arg_max(sym, n * 1000 - first) AS dominant_symbol FROM sc GROUP BY tile_id),
feat AS (SELECT tile_id, tileset_id, filled / 256.0::double AS density, symmetry_h, symmetry_v, edge_complexity,
   coalesce(unique_symbols, 0) AS unique_symbols, coalesce(dominant_symbol, '.') AS dominant_symbol,
   coalesce(top_n / filled::double, 1.0) AS dominant_ratio FROM f0 LEFT JOIN top USING (tile_id)),
lab AS (SELECT *, 'tileset:' || tileset_id || ', density:' || CASE WHEN density < 0.2 THEN 'sparse' WHEN density < 0.5 THEN 'moderate' WHEN density < 0.8 THEN 'dense' ELSE 'solid' END
  || ', symmetry:' || CASE WHEN greatest(symmetry_h, symmetry_v) > 0.85 THEN 'high' WHEN greatest(symmetry_h, symmetry_v) > 0.6 THEN 'medium' ELSE 'low' END
  || ', detail:' || CASE WHEN edge_complexity < 0.15 THEN 'flat' WHEN edge_complexity < 0.35 THEN 'simple' WHEN edge_complexity < 0.55 THEN 'moderate' ELSE 'complex' END
  || ', colors:' || CASE WHEN unique_symbols <= 2 THEN 'minimal' WHEN unique_symbols <= 4 THEN 'few' ELSE 'rich' END AS label FROM feat)
"""


def features(spark, d):
    return ft.tile_features(fx.tiles(spark, d))


@query("tile_features", f"""WITH {FEAT_SQL} SELECT tile_id, round(density, 6) AS density, round(symmetry_h, 6) AS symmetry_h, round(symmetry_v, 6) AS symmetry_v,
 round(edge_complexity, 6) AS edge_complexity, unique_symbols, dominant_symbol, round(dominant_ratio, 6) AS dominant_ratio FROM feat""")
def tile_features(spark, d):
    return features(spark, d).select("tile_id", R6("density"), R6("symmetry_h"), R6("symmetry_v"), R6("edge_complexity"),
                                     BIG("unique_symbols"), "dominant_symbol", R6("dominant_ratio"))


@query("tile_label", f"""WITH {FEAT_SQL} SELECT tile_id, rot AS rotation, label || CASE WHEN rot <> '' THEN ', rotation:' || rot ELSE '' END AS label
 FROM lab, (VALUES (''), ('90'), ('180'), ('270')) v(rot)""")
def tile_label(spark, d):
    f = features(spark, d).withColumn("rotation", F.explode(F.array(*[F.lit(r) for r in ("", "90", "180", "270")])))
    return f.select("tile_id", "rotation", labels.tile_label(F.col("rotation")).alias("label"))


EDGE_SQL = T + """,
ed AS (SELECT tile_id, tileset_id, doc_id, flat, substr(flat, 1, 16) AS en, substr(flat, 241, 16) AS es,
  array_to_string([substr(flat, (r * 16 + 16)::bigint, 1) FOR r IN range(0, 16)], '') AS ee,
  array_to_string([substr(flat, (r * 16 + 1)::bigint, 1) FOR r IN range(0, 16)], '') AS ew FROM tile),
el AS (SELECT tile_id, unnest(['n', 'e', 's', 'w']) AS side, unnest([en, ee, es, ew]) AS edge FROM ed),
ec0 AS (SELECT tile_id, side, edge, unnest(string_split(edge, '')) AS ch FROM el),
ecn AS (SELECT tile_id, side, any_value(edge) AS edge, ch, count(*) AS n FROM ec0 GROUP BY tile_id, side, ch),
ec AS (SELECT tile_id, side, CASE WHEN max(n) = 16 THEN CASE WHEN max(ch) = '.' THEN 'open' ELSE 'solid_' || max(ch) END
  WHEN max(n) > 8 THEN CASE WHEN arg_max(ch, n) = '.' THEN 'open' ELSE 'edge_' || arg_max(ch, n) END
  ELSE 'mixed_' || left(md5(any_value(edge)), 16) END AS cls FROM ecn GROUP BY tile_id, side)
"""


@query("edge_strings", f"WITH {EDGE_SQL} SELECT tile_id, en AS edge_n, ee AS edge_e, es AS edge_s, ew AS edge_w FROM ed")
def edge_strings(spark, d):
    return ft.edges(fx.tiles(spark, d)).select("tile_id", "edge_n", "edge_e", "edge_s", "edge_w")


@query("edge_class", f"""WITH {EDGE_SQL} SELECT tile_id, max(cls) FILTER (side = 'n') AS class_n, max(cls) FILTER (side = 'e') AS class_e,
 max(cls) FILTER (side = 's') AS class_s, max(cls) FILTER (side = 'w') AS class_w FROM ec GROUP BY tile_id""")
def edge_class(spark, d):
    c = ft.classify_edges(ft.edges(fx.tiles(spark, d)))
    return c.select("tile_id", "class_n", "class_e", "class_s", "class_w")


@query("edge_audit", f"""WITH {EDGE_SQL},
decl AS (SELECT tile_id, side, cls, CASE WHEN tile_id % 4 = 3 THEN NULL WHEN tile_id % 4 = 0 THEN cls WHEN side = 'n' THEN 'open' WHEN side = 'e' THEN 'edge' WHEN side = 's' THEN 'mixed' ELSE 'solid' END AS dec FROM ec),
chk AS (SELECT *, coalesce(dec = cls OR starts_with(cls, dec || '_') OR (dec IN ('floor', 'water') AND starts_with(cls, 'solid_')), false) AS fits FROM decl)
SELECT tile_id, CASE WHEN count(dec) = 0 THEN 'filled' WHEN bool_and(fits) THEN 'ok' ELSE 'updated' END AS status,
 CASE WHEN count(dec) = 0 THEN 0 ELSE count(*) FILTER (NOT fits) END AS stale_sides,
 CASE WHEN bool_and(fits) THEN max(dec) FILTER (side = 'e') ELSE max(cls) FILTER (side = 'e') END AS final_e FROM chk GROUP BY tile_id""")
def edge_audit(spark, d):
    c = ft.classify_edges(ft.edges(fx.tiles(spark, d)))
    k = F.col("tile_id") % 4
    word = {"n": "open", "e": "edge", "s": "mixed", "w": "solid"}
    c = c.withColumns({s: F.when(k == 3, F.lit(None)).when(k == 0, F.col(f"class_{s}")).otherwise(F.lit(word[s])) for s in "nesw"})
    a = ft.edge_audit(c)
    n = F.when(F.col("stale") == "", 0).otherwise(F.size(F.split("stale", ", ")))
    return a.select("tile_id", "status", n.cast("bigint").alias("stale_sides"), "final_e")


@query("affordance_map", f"""WITH {fx.MAP_SQL}, kw AS (SELECT upper(base) AS keyword FROM cell UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT lower(p_type) FROM part)
SELECT keyword, CASE lower(keyword) WHEN 'wall' THEN 'obstacle' WHEN 'floor' THEN 'walkable' WHEN 'water' THEN 'hazard' END AS affordance, count(*) AS n FROM kw GROUP BY ALL""")
def affordance_map(spark, d):
    part = fx.table(spark, d, "part")
    words = fx.map_cells(spark, d).select(F.upper(F.split_part("tile", F.lit("_"), F.lit(1))).alias("keyword")).unionByName(
        part.select(F.explode(F.split("p_name", " ")).alias("keyword"))).unionByName(part.select(F.lower("p_type").alias("keyword")))
    return words.groupBy("keyword", affordance_of(F.col("keyword")).alias("affordance")).agg(F.count("*").alias("n"))


# --- style -------------------------------------------------------------------
LIN = "(CASE WHEN {0} / 255.0::double <= 0.04045 THEN {0} / 255.0::double / 12.92 ELSE pow(({0} / 255.0::double + 0.055) / 1.055, 2.4) END)"
OKLAB_SQL = lambda src, cols: f"""(SELECT {cols}, 0.2104542553 * l_ + 0.7936177850 * m_ - 0.0040720468 * s_ AS ok_l, 1.9779984951 * l_ - 2.4285922050 * m_ + 0.4505937099 * s_ AS ok_a,
  0.0259040371 * l_ + 0.7827717662 * m_ - 0.8086757660 * s_ AS ok_b FROM (SELECT *, cbrt(0.4122214708::double * lr + 0.5363325363::double * lg + 0.0514459929::double * lb) AS l_,
  cbrt(0.2119034982::double * lr + 0.6806995451::double * lg + 0.1073969566::double * lb) AS m_, cbrt(0.0883024619::double * lr + 0.2817188376::double * lg + 0.6299787005::double * lb) AS s_
  FROM (SELECT *, {LIN.format('r')} AS lr, {LIN.format('g')} AS lg, {LIN.format('b')} AS lb FROM {src})))"""  # noqa: E731
HUE = "CASE WHEN degrees(atan2(ok_b, ok_a)) < 0 THEN degrees(atan2(ok_b, ok_a)) + 360 ELSE degrees(atan2(ok_b, ok_a)) END"


def latent_sql(by: str, out: str = "latent", extra: str = "", src: str = "px") -> str:
    """CTEs computing the fingerprint per ``by`` from px."""
    return f"""
{fx.PALETTE_SQL},
pal AS (SELECT *, {HUE} AS hue, ok_l <= 1.5 * (SELECT min(ok_l) FROM {OKLAB_SQL('palette', 'pos, sym')} WHERE sym <> '.') AS shadow FROM {OKLAB_SQL('palette', 'pos, sym')} WHERE sym <> '.'),
pcol AS (SELECT {src}.*, ok_l AS lum, hue, shadow, CASE WHEN x = 0 OR lag({src}.sym) OVER (PARTITION BY tile_id, y ORDER BY x) <> {src}.sym THEN 1 ELSE 0 END AS brk FROM {src} LEFT JOIN pal USING (sym) {extra}),
pt AS (SELECT {by}, tile_id, sum(brk) AS runs, count(DISTINCT sym) AS br FROM pcol GROUP BY {by}, tile_id),
pt2 AS (SELECT {by}, count(*) AS tiles, sum(runs) AS runs, avg(br) AS br FROM pt GROUP BY {by}),
ent AS (SELECT {by}, -sum(p * ln(p)) AS h FROM (SELECT {by}, sym, count(*) / (sum(count(*)) OVER (PARTITION BY {by}))::double AS p FROM pcol GROUP BY {by}, sym) GROUP BY {by}),
m AS (SELECT {by}, avg(CASE WHEN lum > 0.3 THEN (x / 16.0::double + y / 16.0::double) / 2 END) AS ld, count(*) AS cells, count(*) FILTER (shadow) AS sh, count(*) FILTER (sym <> '.') AS fil,
  sum(lum) AS lums, coalesce(sum(cos(radians(hue))), 0) AS c, coalesce(sum(sin(radians(hue))), 0) AS s FROM pcol GROUP BY {by}),
{out} AS (SELECT {by}, coalesce(ld, 0.5) AS light_direction, cells / runs::double AS run_length_mean, CASE WHEN fil > 0 THEN sh / fil::double ELSE 0 END AS shadow_ratio,
  br::double AS palette_breadth, fil / cells::double AS pixel_density, h AS palette_entropy, CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END AS hue_bias,
  CASE WHEN fil > 0 THEN lums / fil ELSE 0 END AS luminance_mean, tiles AS sample_count FROM m JOIN pt2 USING ({by}) JOIN ent USING ({by}))"""


MEAS = ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in st.MEASURES)
meas = lambda: [(F.round(F.col(m), 6) + 0.0).alias(m) for m in st.MEASURES]


@query("style_latent", f"WITH {T}, {latent_sql('tileset_id')} SELECT tileset_id, {MEAS}, sample_count FROM latent")
def style_latent(spark, d):
    s = st.style_latent(fx.tiles(spark, d), fx.palette(spark), ["tileset_id"])
    return s.select("tileset_id", *meas(), "sample_count")


@query("learn_style", f"""WITH {T}, {latent_sql('theme', extra=f"WHERE px.tile_id // {fx.CHUNKS} IN (SELECT doc_id FROM labels WHERE quality = 1)")} SELECT theme, {MEAS}, sample_count FROM latent""")
def learn_style(spark, d):
    good = fx.table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    s = st.learn_style(fx.tiles(spark, d), fx.palette(spark), ["theme"], good)
    return s.select("theme", *meas(), "sample_count")


def score_sql(ref_by: str) -> str:
    def diff(m):
        return {"light_direction": f"abs(r.{m} - t.{m}) * 2", "run_length_mean": f"abs((r.{m} - t.{m}) / greatest(r.{m}, 1))",
                "shadow_ratio": f"abs(r.{m} - t.{m}) * 3", "palette_breadth": f"abs((r.{m} - t.{m}) / greatest(r.{m}, 1))",
                "pixel_density": f"abs(r.{m} - t.{m}) * 2", "palette_entropy": f"abs((r.{m} - t.{m}) / greatest(r.{m}, 0.1))",
                "hue_bias": f"least(abs(r.{m} - t.{m}), 360 - abs(r.{m} - t.{m})) / 180", "luminance_mean": f"abs(r.{m} - t.{m}) * 2"}[m]
    return "greatest(0, least(1, 1 - (" + " + ".join(diff(m) for m in st.MEASURES) + ") / 8.0))"


SCORE_SQL = f"""WITH {T}, {latent_sql('tileset_id', 'ref')}, t0 AS (SELECT tile_id, any_value(tileset_id) AS tileset_id FROM px GROUP BY tile_id),
""" + latent_sql("tile_id", "lat").replace(fx.PALETTE_SQL + ",\n", "").replace("pal AS", "pal_2 AS").replace("pcol AS", "pcol2 AS").replace("FROM pcol", "FROM pcol2").replace(
    "pt AS", "pt_2 AS").replace("FROM pt ", "FROM pt_2 ").replace("pt2 AS", "pt2_2 AS").replace("JOIN pt2 ", "JOIN pt2_2 ").replace("ent AS", "ent_2 AS").replace("JOIN ent ", "JOIN ent_2 ").replace(
    "\nm AS", "\nm_2 AS").replace("FROM m JOIN", "FROM m_2 JOIN").replace("GROUP BY tile_id, tile_id", "GROUP BY tile_id").replace("SELECT tile_id, tile_id,", "SELECT tile_id,").replace(
    "JOIN pal USING", "JOIN pal_2 USING") + f""",
sc AS (SELECT t.tile_id, {score_sql('')} AS s, t.* EXCLUDE (tile_id) FROM lat t JOIN t0 USING (tile_id) JOIN ref r ON r.tileset_id = t0.tileset_id)
"""


def scored(spark, d):
    return st.style_against(fx.tiles(spark, d), fx.palette(spark), ["tile_id", "tileset_id"], ["tileset_id"])


@query("style_score", SCORE_SQL + "SELECT tile_id, round(s, 5) + 0.0 AS style_score FROM sc")
def style_score(spark, d):
    return scored(spark, d).select("tile_id", (F.round("style_score", 5) + 0.0).alias("style_score"))


@query("style_assess", SCORE_SQL + """SELECT CASE WHEN s > 0.85 THEN 'excellent match' WHEN s > 0.7 THEN 'good match' WHEN s > 0.5 THEN 'moderate match' ELSE 'poor match' END AS assessment,
 'tiles=' || sample_count || ' light=' || CASE WHEN light_direction < 0.35 THEN 'top-left' WHEN light_direction < 0.65 THEN 'center/even' ELSE 'bottom-right' END
 || ' density=' || CASE WHEN pixel_density > 0.8 THEN 'dense' WHEN pixel_density > 0.5 THEN 'moderate' ELSE 'sparse' END
 || ' shadows=' || CASE WHEN shadow_ratio > 0.25 THEN 'heavy' WHEN shadow_ratio > 0.1 THEN 'moderate' ELSE 'light' END AS description, count(*) AS n FROM sc GROUP BY ALL""")
def style_assess(spark, d):
    return st.style_report(scored(spark, d)).groupBy("assessment", "description").agg(F.count("*").alias("n"))


# --- dataset -------------------------------------------------------------------
U = "('0x' || left(md5('42:' || {0}), 8))::bigint / 4294967296.0::double"
SPLIT = lambda e: f"CASE WHEN {U.format(e)} < 0.9 THEN 'train' WHEN {U.format(e)} < 0.95 THEN 'valid' ELSE 'test' END"
SPLIT_SQL = SPLIT("tile_id")
BINS_SQL = FEAT_SQL + ", bins AS (SELECT *, least(floor(density * 5), 4)::int AS d_bin, least(floor(edge_complexity * 5), 4)::int AS e_bin FROM lab)"
STRAT_SQL = BINS_SQL + ", strat AS (SELECT *, row_number() OVER (PARTITION BY d_bin, e_bin ORDER BY md5('42:' || tile_id), tile_id) AS bin_rank FROM bins QUALIFY bin_rank <= 50)"


@query("stratify", f"WITH {STRAT_SQL} SELECT tile_id, d_bin, e_bin, bin_rank FROM strat")
def stratify(spark, d):
    return ds.stratify(features(spark, d), 50, ["tile_id"]).select("tile_id", "d_bin", "e_bin", BIG("bin_rank"))


@query("stratify_report", f"""WITH {BINS_SQL}, c AS (SELECT d_bin, e_bin, count(*) AS n FROM bins GROUP BY ALL),
fr AS (SELECT a::int AS d_bin, b::int AS e_bin FROM range(0, 5) x(a), range(0, 5) y(b))
SELECT d_bin, e_bin, coalesce(n, 0) AS n, (SELECT count(*) FROM c) AS filled FROM fr LEFT JOIN c USING (d_bin, e_bin)""")
def stratify_report(spark, d):
    return ds.coverage(features(spark, d)).select("d_bin", "e_bin", "n", BIG("filled"))


def training_set(spark, d):
    """Features -> label -> capped bins -> split: the flagship slice."""
    s = ds.stratify(features(spark, d), 50, ["tile_id"])
    return ds.split(s.withColumn("label", labels.tile_label()), ["tile_id"])


@query("training_slice", f"WITH {STRAT_SQL} SELECT {SPLIT_SQL} AS split, d_bin, e_bin, count(*) AS n, count(DISTINCT label) AS n_labels FROM strat GROUP BY ALL")
def training_slice(spark, d):
    return training_set(spark, d).groupBy("split", "d_bin", "e_bin").agg(
        F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


@query("split_hash", f"WITH {T} SELECT tile_id, {SPLIT_SQL} AS split, {SPLIT('doc_id')} AS doc_split FROM tile")
def split_hash(spark, d):
    t = ds.split(fx.tiles(spark, d), ["tile_id"])
    t = t.withColumnRenamed("split", "_s")
    return ds.split(t, ["tile_id"], group=["doc_id"]).select("tile_id", F.col("_s").alias("split"), F.col("split").alias("doc_split"))


@query("split_exact", f"""WITH {T}, r AS (SELECT tile_id, row_number() OVER (ORDER BY md5('42:' || tile_id), tile_id) AS k, count(*) OVER () AS n FROM tile)
SELECT tile_id, CASE WHEN k <= floor(n * 0.9::double) THEN 'train' WHEN k <= floor(n * 0.95::double) THEN 'valid' ELSE 'test' END AS split FROM r""")
def split_exact(spark, d):
    return ds.split(fx.tiles(spark, d).select("tile_id"), ["tile_id"], mode="exact").select("tile_id", "split")


@query("deterministic_shuffle", f"WITH {T} SELECT tile_id, row_number() OVER (ORDER BY md5('42:' || tile_id), tile_id) AS position FROM tile")
def deterministic_shuffle(spark, d):
    from gridweave.operators.ranking import exact_rank
    t = fx.tiles(spark, d).select("tile_id")
    return exact_rank(t, draw(42, F.col("tile_id")), ["tile_id"], "position").select("tile_id", BIG("position"))


PAL_INLINE = " ".join(f"'{s}'=({r},{g_},{b})" for s, r, g_, b, _ in fx.PALETTE if s != ".")
PAL_LINES = "\n".join("  '.' = transparent" if s == "." else f"  '{s}' = ({r},{g_},{b})" for s, r, g_, b, _ in fx.PALETTE)


@query("palette_prompt", f"""WITH {fx.PALETTE_SQL} SELECT 'base' AS palette, string_agg('''' || sym || '''=(' || r || ',' || g || ',' || b || ')', ' ' ORDER BY pos) FILTER (sym <> '.') AS inline_text,
 string_agg(CASE WHEN sym = '.' THEN '  ''.'' = transparent' ELSE '  ''' || sym || ''' = (' || r || ',' || g || ',' || b || ')' END, chr(10) ORDER BY pos) AS lines_text, (SELECT count(*) FROM documents) AS documents FROM palette""")
def palette_prompt(spark, d):
    p = fx.palette(spark)
    a = ds.palette_prompt(p, ["palette"]).withColumnRenamed("palette_text", "inline_text")
    b = ds.palette_prompt(p, ["palette"], "lines").withColumnRenamed("palette_text", "lines_text")
    n = fx.table(spark, d, "documents").agg(F.count("*").alias("documents")).withColumn("palette", F.lit("base"))
    return a.join(b, "palette").join(n, "palette")


@query("chat_format", f"""WITH {FEAT_SQL.replace('feat AS', 'feat AS')} SELECT tile_id, md5('Palette: {PAL_INLINE.replace("'", "''")}' || chr(10) || label) AS user_digest, md5(g) AS grid_digest, 3 AS n_messages
 FROM lab JOIN (SELECT tile_id, {ROWTEXT} AS g FROM tile) USING (tile_id)""")
def chat_format(spark, d):
    pal = ds.palette_prompt(fx.palette(spark), ["palette"])
    f = features(spark, d).withColumns({"palette": F.lit("base"), "label": labels.tile_label()}).join(F.broadcast(pal), "palette")
    c = ds.to_chat(f, F.concat(F.lit("Palette: "), "palette_text", F.lit("\n"), "label"), F.col("grid"))
    return c.select("tile_id", F.md5(F.col("messages")[1]["content"]).alias("user_digest"),
                    F.md5(F.col("messages")[2]["content"]).alias("grid_digest"), F.size("messages").alias("n_messages"))


@query("dataset_stats", f"""WITH {FEAT_SQL}, w AS (SELECT tileset_id, text, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) AS toks FROM (SELECT *, source AS tileset_id FROM documents)),
s AS (SELECT count(*) AS n, avg(length(text)) AS a, avg(toks) AS b FROM w), h AS (SELECT CASE WHEN density < 0.2 THEN 'sparse' WHEN density < 0.5 THEN 'moderate' WHEN density < 0.8 THEN 'dense' ELSE 'solid' END AS density, count(*) AS tiles FROM feat GROUP BY ALL)
SELECT density, tiles, n, round(a, 6) AS avg_chars, round(b, 6) AS avg_tokens, floor(a * n / 4)::bigint AS token_estimate FROM h, s""")
def dataset_stats(spark, d):
    s = ds.dataset_stats(fx.table(spark, d, "documents"), "text")
    h = features(spark, d).groupBy(labels.density_word(F.col("density")).alias("density")).agg(F.count("*").alias("tiles"))
    return h.crossJoin(F.broadcast(s)).select("density", "tiles", "n", R6("avg_chars"), R6("avg_tokens"), BIG("token_estimate"))  # one-row side
