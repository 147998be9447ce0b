"""Image queries over the 8x8 images of the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import fixtures as fx
from gridweave.functions.color import delta_e, oklab, oklab_to_rgb, with_oklab
from gridweave.operators import image as im
from gridweave.plans.corpus import BIG, HUE, OKLAB_SQL, R6
from gridweave.plans.registry import query

I = fx.IMAGE_SQL  # noqa: E741
POOL = im.SYMBOL_POOL


def pal_sql(n: int = 8) -> str:
    return I + f""",
bk AS (SELECT tileset_id, r // 16 * 16 AS r, g // 16 * 16 AS g, b // 16 * 16 AS b, count(*) AS n FROM img WHERE a >= 128 GROUP BY ALL),
topn AS (SELECT * FROM bk QUALIFY row_number() OVER (PARTITION BY tileset_id ORDER BY n DESC, r, g, b) <= {n}),
ipal AS (SELECT *, row_number() OVER (PARTITION BY tileset_id ORDER BY r + g + b, r, g, b) AS pos FROM topn),
ip AS (SELECT tileset_id, pos, substr('{POOL}', pos + 1, 1) AS sym, r, g, b, n FROM ipal WHERE pos < {len(POOL)})
"""


def palettes(spark, d, n=8):
    return im.extract_palette(fx.images(spark, d), ["tileset_id"], n)


@query("void_filter", f"""WITH {I}, s AS (SELECT image_id, count(*) FILTER (a >= 128) / count(*)::double AS share FROM img GROUP BY image_id)
SELECT image_id, count(*) AS n, count(*) FILTER (a >= 128) AS opaque FROM img WHERE image_id IN (SELECT image_id FROM s WHERE share >= 0.95) GROUP BY image_id""")
def void_filter(spark, d):
    return im.drop_sparse(fx.images(spark, d), 0.95, ["image_id"]).groupBy("image_id").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("a") >= 128, 1)).alias("opaque"))


@query("extract_palette", f"WITH {pal_sql(10)} SELECT * FROM ip")
def extract_palette(spark, d):
    return palettes(spark, d, 10).select("tileset_id", BIG("pos"), "sym", "r", "g", "b", "n")


@query("void_filter_palette", f"WITH {I.replace('tileset_id', 'tileset_id')}, bk AS (SELECT image_id, r // 16 * 16 AS r, g // 16 * 16 AS g, b // 16 * 16 AS b, count(*) AS n FROM img WHERE a >= 128 GROUP BY ALL), c AS (SELECT image_id, least(count(*), 12) + 1 AS entries FROM bk GROUP BY image_id) SELECT image_id, entries FROM c WHERE entries >= 13")
def void_filter_palette(spark, d):
    p = im.extract_palette(fx.images(spark, d), ["image_id"], 12, min_entries=13)
    return p.groupBy("image_id").agg((F.count("*") + 1).alias("entries"))


DIST = {
    "w309": "(30 * (q.r - p.r) * (q.r - p.r) + 59 * (q.g - p.g) * (q.g - p.g) + 11 * (q.b - p.b) * (q.b - p.b))",
    "bucket": "((q.r // 16 * 16 - p.r) * (q.r // 16 * 16 - p.r) + (q.g // 16 * 16 - p.g) * (q.g // 16 * 16 - p.g) + (q.b // 16 * 16 - p.b) * (q.b // 16 * 16 - p.b))",
    "i243": "(2 * (q.r - p.r) * (q.r - p.r) + 4 * (q.g - p.g) * (q.g - p.g) + 3 * (q.b - p.b) * (q.b - p.b))",
}
ROOT = {"w309": "sqrt(dd / 100.0::double)", "bucket": "sqrt(dd::double)", "i243": "sqrt(dd::double)"}


def quant_sql(metric: str, src: str = "img") -> str:
    return f""", q0 AS (SELECT q.image_id, q.tileset_id, q.x, q.y, q.a, p.sym, {DIST[metric]} AS dd, p.pos FROM {src} q JOIN ip p USING (tileset_id)
  QUALIFY row_number() OVER (PARTITION BY q.image_id, q.x, q.y ORDER BY dd, p.pos) = 1),
qz AS (SELECT image_id, tileset_id, x, y, CASE WHEN a < 128 THEN '.' ELSE sym END AS sym, CASE WHEN a < 128 THEN 0.0::double ELSE {ROOT[metric]} END AS dist FROM q0)"""


def summary(q):
    return q.groupBy("tileset_id", "sym").agg(
        F.count("*").alias("n"), F.sum(F.col("image_id") * 64 + F.col("y") * 8 + F.col("x")).cast("bigint").alias("position_sum"),
        F.round(F.sum("dist"), 4).alias("dist_sum"))


SUMMARY_SQL = "SELECT tileset_id, sym, count(*) AS n, sum(image_id * 64 + y * 8 + x)::bigint AS position_sum, round(sum(dist), 4) AS dist_sum FROM qz GROUP BY ALL"


def _register(name: str, metric: str) -> None:
    @query(name, f"WITH {pal_sql()}{quant_sql(metric)} {SUMMARY_SQL}")
    def run(spark, d):
        return summary(im.quantize(fx.images(spark, d), palettes(spark, d), ["tileset_id"], metric))


for _name, _metric in (("quantize_weighted", "w309"), ("quantize_bucketed", "bucket"), ("quantize_int", "i243")):
    _register(_name, _metric)

OKQ_SQL = lambda src: f""", {fx.PALETTE_SQL}, okp AS {OKLAB_SQL('palette', 'pos, sym')}, oki AS {OKLAB_SQL(src, 'image_id, tileset_id, x, y')},
q0 AS (SELECT i.image_id, i.tileset_id, i.x, i.y, p.sym, p.pos, sqrt((i.ok_l - p.ok_l) ** 2 + (i.ok_a - p.ok_a) ** 2 + (i.ok_b - p.ok_b) ** 2) AS dist FROM oki i, okp p
  QUALIFY row_number() OVER (PARTITION BY i.image_id, i.x, i.y ORDER BY dist, p.pos) = 1), qz AS (SELECT * FROM q0)"""  # noqa: E731


@query("quantize_oklab", f"WITH {I}{OKQ_SQL('img')} {SUMMARY_SQL}")
def quantize_oklab(spark, d):
    return summary(im.quantize(fx.images(spark, d), fx.palette(spark), [], "oklab"))


@query("quant_accuracy", f"WITH {pal_sql()}{quant_sql('w309')} SELECT image_id, round(1 - least(1, sum(dist) / count(*) / 255), 6) AS accuracy, count(*) FILTER (dist > 50) AS clipped FROM qz GROUP BY image_id")
def quant_accuracy(spark, d):
    q = im.quantize(fx.images(spark, d), palettes(spark, d), ["tileset_id"], "w309")
    return im.quant_quality(q, ["image_id"]).select("image_id", R6("accuracy"), "clipped")


BAYER_SQL = "[" + ",".join(map(str, im.BAYER)) + "][(y % 4) * 4 + x % 4 + 1] * 2 - 16"


@query("bayer_dither", f"""WITH {I}, dz AS (SELECT image_id, tileset_id, x, y, a, greatest(0, least(255, r + {BAYER_SQL})) AS r, greatest(0, least(255, g + {BAYER_SQL})) AS g, greatest(0, least(255, b + {BAYER_SQL})) AS b FROM img)
{OKQ_SQL('dz')} {SUMMARY_SQL}""")
def bayer_dither(spark, d):
    return summary(im.quantize(im.dither(fx.images(spark, d)), fx.palette(spark), [], "oklab"))


@query("resample", f"""WITH {I}, k AS (SELECT d, s, (least(s + 1, (d + 1) * 8 / 3.0::double) - greatest(s, d * 8 / 3.0::double)) / (8 / 3.0::double) AS w FROM range(0, 3) a(d), range(0, 8) b(s) WHERE s + 1 > d * 8 / 3.0::double AND s < (d + 1) * 8 / 3.0::double),
o AS (SELECT image_id, kx.d AS x, ky.d AS y, sum(r * kx.w * ky.w) AS r, sum(g * kx.w * ky.w) AS g, sum(b * kx.w * ky.w) AS b, sum(a * kx.w * ky.w) AS a FROM img JOIN k kx ON kx.s = x JOIN k ky ON ky.s = y GROUP BY ALL)
SELECT image_id, x, y, floor(round(r, 9) + 0.5)::int AS r, floor(round(g, 9) + 0.5)::int AS g, floor(round(b, 9) + 0.5)::int AS b, floor(round(a, 9) + 0.5)::int AS a FROM o""")
def resample(spark, d):
    r = im.resample(fx.images(spark, d), ["image_id"], F.lit(3), F.lit(3))
    return r.select("image_id", BIG("x"), BIG("y"), *"rgba")


@query("resample_lanczos")
def resample_lanczos(spark, d):
    return im.resample(fx.images(spark, d), ["image_id"], F.lit(4), F.lit(4), "lanczos3")


@query("median_cut")
def median_cut(spark, d):
    return im.median_cut(fx.images(spark, d), "image_id", 8)


@query("convert_presets")
def convert_presets(spark, d):
    out = im.convert(fx.images(spark, d), [("tiny", 4, 4), ("small", 6, 6), ("full", 8, 8)])
    return out.groupBy("image_id", "preset").agg(F.count("*").alias("pixels"), F.count_distinct("r", "g", "b").alias("colors"))


@query("sheet_slice", f"""WITH {I}, sh AS (SELECT image_id // 4 AS sheet, (image_id % 4) * 8 + x AS x, y, r, g, b, a FROM img),
w AS (SELECT sheet, max(x) + 1 AS sw, 5 + sheet % 3 AS cw, 8 - sheet % 2 AS ch, 2 + sheet % 5 AS cnt FROM sh GROUP BY sheet)
SELECT sheet AS image_id, x // cw AS variant, count(*) AS n, sum(r)::bigint AS r_sum, max(x - x // cw * cw) AS max_x, max(y) AS max_y FROM sh JOIN w USING (sheet) WHERE x // cw < least(cnt, sw // cw) AND y < ch GROUP BY ALL""")
def sheet_slice(spark, d):
    px = fx.images(spark, d)
    sheets = px.withColumns({"x": (F.col("image_id") % 4 * 8 + F.col("x")).cast("bigint"), "image_id": F.expr("image_id div 4")})
    meta = fx.table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("image_id")).distinct().select(
        "image_id", (F.col("image_id") % 3 + 5).alias("clip_width"), (8 - F.col("image_id") % 2).alias("clip_height"),
        (F.col("image_id") % 5 + 2).alias("count"))
    s = im.slice_sheet(sheets, meta)
    return s.groupBy("image_id", BIG("variant")).agg(F.count("*").alias("n"), F.sum("r").cast("bigint").alias("r_sum"),
                                                     F.max("x").alias("max_x"), F.max("y").cast("bigint").alias("max_y"))


@query("tile_slice_dedup", f"""WITH {pal_sql(3)}{quant_sql('i243')}, t AS (SELECT image_id, y // 2 AS row, x // 2 AS col, string_agg(sym, ';' ORDER BY y, x) AS v FROM qz GROUP BY ALL),
f AS (SELECT image_id, v, min(row * 100 + col) AS slot FROM t GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY slot) - 1 AS k FROM f)
SELECT image_id, row, col, printf('bt_%03d', k) AS name FROM t JOIN n USING (image_id, v)""")
def tile_slice_dedup(spark, d):
    q = im.quantize(fx.images(spark, d), palettes(spark, d, 3), ["tileset_id"], "i243")
    tilemap, _ = im.slice_dedup(q, 2, value=["sym"])
    return tilemap.select("image_id", BIG("row"), BIG("col"), "name")


@query("symbol_rank", f"""WITH {I}, c AS (SELECT tileset_id, r // 16 * 16 AS r, g // 16 * 16 AS g, b // 16 * 16 AS b, count(*) AS n FROM img WHERE a > 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY tileset_id ORDER BY n DESC, r, g, b) - 1 AS i FROM c)
SELECT tileset_id, r, g, b, n, CASE WHEN i < 16 THEN substr('{im.IMPORT_SYMBOLS}', i + 1, 1) ELSE (2 + (i - 16) // 26) || chr((97 + (i - 16) % 26)::int) END AS sym FROM k""")
def symbol_rank(spark, d):
    c = fx.images(spark, d).where("a > 0").groupBy("tileset_id", *[im.bucket(x).alias(x) for x in "rgb"]).agg(F.count("*").alias("n"))
    return im.assign_symbols(c, ["tileset_id"]).select("tileset_id", "r", "g", "b", "n", "sym")


@query("oklab", f"""WITH {I}, cols AS (SELECT DISTINCT r, g, b FROM img), o AS {OKLAB_SQL('cols', 'r, g, b')}
SELECT r, g, b, round(ok_l, 6) + 0.0 AS l, round(ok_a, 6) + 0.0 AS a, round(ok_b, 6) + 0.0 AS lab_b, round(sqrt(ok_a * ok_a + ok_b * ok_b), 6) + 0.0 AS chroma,
 CASE WHEN sqrt(ok_a * ok_a + ok_b * ok_b) > 0.001 THEN round({HUE}, 6) + 0.0 ELSE 0.0 END AS hue, r AS back_r, g AS back_g, b AS back_b, round(abs(ok_l - 0.5), 6) AS gap FROM o""")
def oklab_q(spark, d):
    c = with_oklab(fx.images(spark, d).select("r", "g", "b").distinct())
    lab = oklab(F.col("r"), F.col("g"), F.col("b"))
    back = oklab_to_rgb(*lab)
    z = lambda e: F.round(e, 6) + 0.0
    gap = delta_e(F.col("ok_l"), F.col("ok_a"), F.col("ok_b"), F.lit(0.5), F.col("ok_a"), F.col("ok_b"))
    return c.select("r", "g", "b", z(F.col("ok_l")).alias("l"), z(F.col("ok_a")).alias("a"), z(F.col("ok_b")).alias("lab_b"),
                    z(F.col("ok_chroma")).alias("chroma"), F.when(F.col("ok_chroma") > 0.001, z(F.col("ok_hue"))).otherwise(0.0).alias("hue"),
                    back[0].alias("back_r"), back[1].alias("back_g"), back[2].alias("back_b"), z(gap).alias("gap"))
