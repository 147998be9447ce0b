"""Rule audits: each rule is its own plan; ``validate`` is their union.

``ts`` is a dict of domain tables.  A tileset is one name space: palettes, themes
and cycles are looked up in the entity's own tileset.  Every rule returns
``violation(tileset_id, entity_type, name, rule, detail, severity)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridweave.functions.color import hsv_hue, hue_distance, luminance709
from gridweave.operators.definitions import parse_palette, resolve_themes, theme_chain
from gridweave.operators.grid import rle_runs
from gridweave.session import cut

Tables = dict[str, DataFrame]
PALETTE = ["tileset_id", "palette"]
SIZE = r"^(\d+)x(\d+)$"


def violation(df: DataFrame, entity: str, rule: str, detail: Column | str, severity: str = "error") -> DataFrame:
    d = F.lit(detail) if isinstance(detail, str) else detail
    return df.select("tileset_id", F.lit(entity).alias("entity_type"), "name", F.lit(rule).alias("rule"), d.alias("detail"), F.lit(severity).alias("severity"))


def sized(tiles: DataFrame) -> DataFrame:
    n = lambda i: F.when(F.col("size").rlike(SIZE), F.regexp_extract("size", SIZE, i)).cast("int")
    return tiles.withColumns({"w": n(1), "h": n(2)})


def outline(grid: str) -> tuple[int, list[int], list[str]]:
    """Row count, distinct row widths and distinct symbols of a grid; trailing blanks and blank rows don't count."""
    rows = [r for r in (line.rstrip(" ") for line in grid.split("\n")) if r]
    return len(rows), sorted(set(map(len, rows))), sorted(set("".join(rows))) or [""]


def outlined(tiles: DataFrame) -> DataFrame:
    """Tiles whose ``grid`` is replaced by what the rules ask of it: ``rows, widths, syms``, null without a grid.

    Each grid is read once and stays behind, so what joins and rules move is small.
    """
    if "grid" not in tiles.columns:
        return tiles
    keep = [c for c in tiles.columns if c != "grid"]

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            seen = [outline(g) if g is not None else (None, None, None) for g in batch.column(len(keep)).to_pylist()]
            rows, widths, syms = zip(*seen) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.int32()), pa.array(widths, pa.list_(pa.int32())), pa.array(syms, pa.list_(pa.string()))],
                                             names=[*keep, "rows", "widths", "syms"])

    kept = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in keep)
    return tiles.select(*keep, "grid").mapInArrow(run, f"{kept}, rows int, widths array<int>, syms array<string>")


def has_grid(tiles: DataFrame) -> Column:
    """Whether a tile has a grid, of tiles as they are or outlined."""
    return F.col("grid" if "grid" in tiles.columns else "widths").isNotNull()


def has_pixels(tiles: DataFrame) -> Column:
    return has_grid(tiles) | F.coalesce("rle", "layout").isNotNull()


def own_tiles(ts: Tables, gridded: bool = False) -> DataFrame:
    """Tiles that carry their own pixels (template tiles are skipped) with a usable size and palette; ``gridded``: outlined, those with a grid."""
    t = sized(ts["tile"]).where("template IS NULL AND w > 0 AND h > 0")
    if gridded:
        t = outlined(t.where(has_grid(t)))
    return t.join(ts["palette"].select(*PALETTE).distinct(), PALETTE, "left_semi")


def v_palette_parse(ts: Tables) -> DataFrame:
    p = parse_palette(ts["palette_raw"]).where("error IS NOT NULL")
    return violation(p.withColumn("name", F.col("palette")), "palette", "palette_parse", F.concat(F.col("sym"), F.lit(": "), F.col("error")))


def v_palette_ref(ts: Tables) -> DataFrame:
    known = ts["palette"].select(*PALETTE).distinct()
    t = ts["tile"].where("template IS NULL").join(known, PALETTE, "left_anti")
    s = ts["stamp"].join(known, PALETTE, "left_anti")
    return violation(t, "tile", "palette_ref", F.col("palette")).unionByName(violation(s, "stamp", "palette_ref", F.col("palette")))


def v_size(ts: Tables) -> DataFrame:
    t = sized(ts["tile"]).where("template IS NULL")
    why = F.when(F.col("size").isNull(), "missing").when(F.col("w").isNull(), "malformed").when((F.col("w") == 0) | (F.col("h") == 0), "zero")
    return violation(t.withColumn("_why", why).where("_why IS NOT NULL"), "tile", "size", F.col("_why"))


def v_pixels(ts: Tables) -> DataFrame:
    t = ts["tile"]
    return violation(t.where(F.col("template").isNull() & ~has_pixels(t)), "tile", "pixels", "no grid, rle or layout")


def v_grid_shape(ts: Tables) -> DataFrame:
    """Row count and widths of the authored part of each grid; row-local."""
    t = own_tiles(ts, gridded=True)
    half = lambda n, modes: F.when(F.coalesce(F.col("symmetry").isin(*modes), F.lit(False)), F.floor(F.col(n) / 2)).otherwise(F.col(n))
    t = t.withColumns({"_w": half("w", ["horizontal", "quad"]), "_h": half("h", ["vertical", "quad"])})
    odd = (F.coalesce(F.col("symmetry").isin("horizontal", "quad"), F.lit(False)) & (F.col("w") % 2 == 1)) | (
        F.coalesce(F.col("symmetry").isin("vertical", "quad"), F.lit(False)) & (F.col("h") % 2 == 1))
    why = F.concat_ws(",", F.when(odd, "odd"), F.when(F.col("rows") != F.col("_h"), "height"),
                      F.when(F.col("widths") != F.array(F.col("_w").cast("int")), "width"))
    return violation(t.withColumn("_why", why).where("_why <> ''"), "tile", "grid_shape", F.col("_why"))


def v_symbols(ts: Tables) -> DataFrame:
    """Symbols outside the palette: a tile's few symbols meet the palette's as arrays, grids stay behind."""
    key = ["tileset_id", "name", "palette"]
    t = sized(ts["tile"]).where("template IS NULL AND w > 0 AND h > 0")
    held = has_grid(t)
    g = outlined(t.where(held)).select(*key, F.col("syms").alias("_syms"))
    r = rle_runs(t.where(~held & F.col("rle").isNotNull()), tuple(key)).where("ok").groupBy(*key).agg(F.collect_set("sym").alias("_syms"))
    known = ts["palette"].groupBy(*PALETTE).agg(F.collect_set("sym").alias("_known"))
    bad = g.unionByName(r).join(known, PALETTE).select("tileset_id", "name", F.explode(F.array_except("_syms", "_known")).alias("sym"))
    return violation(bad, "tile", "symbols", F.col("sym"))


def v_rle(ts: Tables) -> DataFrame:
    """Malformed tokens, row widths and the row count of run-length tiles."""
    t = own_tiles(ts)
    t = t.where(~has_grid(t) & F.col("rle").isNotNull())
    runs = rle_runs(t, ("tileset_id", "name", "w", "h"))
    rows = runs.groupBy("tileset_id", "name", "w", "h", "y").agg(F.count(F.when(~F.col("ok"), 1)).alias("bad"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("width"))
    per = rows.groupBy("tileset_id", "name", "w", "h").agg(
        F.sum("bad").alias("bad"), F.count(F.when((F.col("bad") == 0) & (F.col("width") != F.col("w")), 1)).alias("wide"), F.count("*").alias("rows"))
    why = F.concat_ws(",", F.when(F.col("bad") > 0, "token"), F.when(F.col("wide") > 0, "width"), F.when(F.col("rows") != F.col("h"), "height"))
    return violation(per.withColumn("_why", why).where("_why <> ''"), "tile", "rle", F.col("_why"))


def v_palette_size(ts: Tables) -> DataFrame:
    """Distinct symbols of the un-expanded grid, void included, against the active theme's maximum."""
    t = own_tiles(ts, gridded=True).withColumn("_n", F.size("syms"))
    t = t.join(ts["active_theme"].select("tileset_id", "max_palette_size"), "tileset_id").where("_n > max_palette_size")
    return violation(t, "tile", "palette_size", F.concat(F.col("_n").cast("string"), F.lit(">"), F.col("max_palette_size").cast("string")))


def v_rotate_square(ts: Tables) -> DataFrame:
    t = own_tiles(ts).where("auto_rotate IS NOT NULL AND auto_rotate <> 'none' AND w <> h")
    return violation(t, "tile", "rotate_square", F.col("size"))


def v_template(ts: Tables) -> DataFrame:
    every = ts["tile"].select("tileset_id", "name", "template", has_pixels(ts["tile"]).alias("_own"))
    t = every.where("template IS NOT NULL")
    b = every.select("tileset_id", F.col("name").alias("template"), F.lit(True).alias("_hit"), F.col("template").alias("_up"), F.col("_own").alias("_pixels"))
    j = t.join(b, ["tileset_id", "template"], "left")
    found = F.col("_hit").isNotNull()
    why = F.array_compact(F.array(
        F.when(~found, "missing"), F.when(F.col("_up").isNotNull(), "chain"),
        F.when(found & F.col("_own"), "own pixels"), F.when(found & ~F.col("_pixels"), "base has no pixels")))
    return violation(j.select("*", F.explode(why).alias("_why")), "tile", "template", F.col("_why"))


def v_tile_run(ts: Tables) -> DataFrame:
    """Left-middle-right strips whose touching edges differ; only when all three tiles exist."""
    e = lambda side: ts["tile_edges"].select("tileset_id", F.col("name").alias(side), F.col("e").alias(f"_{side}_e"), F.col("w").alias(f"_{side}_w"))
    j = ts["tile_run"]
    for side in ("left", "middle", "right"):
        j = j.join(e(side), ["tileset_id", side])
    why = F.array_compact(F.array(F.when(F.col("_left_e") != F.col("_middle_w"), "left"), F.when(F.col("_middle_e") != F.col("_middle_w"), "middle"),
                                  F.when(F.col("_middle_e") != F.col("_right_w"), "right")))
    return violation(j.select("*", F.explode(why).alias("_why")), "tile_run", "tile_run", F.col("_why"))


def v_frames(ts: Tables) -> DataFrame:
    """Frame indices must read 1..n in order; a sprite is a short list of frames."""
    w = W.partitionBy("spriteset", "sprite").orderBy("ord")
    f = ts["frame"].withColumn("_i", F.row_number().over(w)).where("_i <> index")
    s = f.select(F.col("spriteset").alias("tileset_id"), F.col("sprite").alias("name")).distinct()
    return violation(s, "sprite", "frames", "indices are not 1..n")


def v_delta_base(ts: Tables) -> DataFrame:
    d = ts["frame"].where("encoding = 'delta' AND base IS NOT NULL")
    b = ts["frame"].groupBy("spriteset", "sprite", F.col("index").alias("base")).agg(F.min_by("encoding", "ord").alias("_enc"))
    j = d.join(b, ["spriteset", "sprite", "base"], "left")
    why = F.array_compact(F.array(F.when(F.col("base") >= F.col("index"), "not before frame"), F.when(F.col("_enc") != "grid", "not a grid")))
    j = j.select(F.col("spriteset").alias("tileset_id"), F.col("sprite").alias("name"), "index", F.explode(why).alias("_why"))
    return violation(j, "sprite", "delta_base", F.concat(F.col("index").cast("string"), F.lit(": "), F.col("_why")))


def v_cycle(ts: Tables) -> DataFrame:
    """Warnings; a cycle without its palette reports only that."""
    c = ts["cycle"]
    known = ts["palette"].select(*PALETTE).distinct()
    gone = c.join(known, PALETTE, "left_anti").withColumn("_why", F.lit("palette"))
    have = c.join(known, PALETTE, "left_semi")
    flat = F.array_compact(F.array(F.when(F.size("symbols") < 2, "too few symbols"), F.when(
        ~F.col("direction").isin("forward", "backward", "ping-pong"), "direction"), F.when(F.col("fps") == 0, "fps")))
    plain = have.withColumn("_why", F.explode(flat))
    syms = have.withColumn("sym", F.explode("symbols")).join(ts["palette"].select(*PALETTE, "sym").where(F.length("sym") == 1), [*PALETTE, "sym"], "left_anti")
    syms = syms.withColumn("_why", F.concat(F.lit("symbol "), "sym"))
    cols = ["tileset_id", "name", "_why"]
    return violation(gone.select(*cols).unionByName(plain.select(*cols)).unionByName(syms.select(*cols)), "cycle", "cycle", F.col("_why"), "warning")


def v_theme(ts: Tables, resolved: DataFrame | None = None) -> DataFrame:
    """Missing parents, loops, unknown palettes and bad role symbols."""
    r = resolve_themes(ts["theme"]) if resolved is None else resolved
    chain = r.where("status <> 'ok'").withColumn("_why", F.col("status"))
    ok = r.where("status = 'ok'")
    known = ts["palette"].select(*PALETTE).distinct()
    gone = ok.join(known, PALETTE, "left_anti").withColumn("_why", F.concat(F.lit("palette "), "palette"))
    role = ok.join(known, PALETTE, "left_semi").select(*PALETTE, "name", F.explode("roles").alias("role", "sym"))
    long = role.where(F.length("sym") != 1).withColumn("_why", F.concat(F.lit("role "), "role", F.lit(" is not one symbol")))
    miss = role.where(F.length("sym") == 1).join(ts["palette"].select(*PALETTE, "sym"), [*PALETTE, "sym"], "left_anti").withColumn(
        "_why", F.concat(F.lit("role "), "role", F.lit(" not in palette")))
    rows = None
    for part in (chain, gone, long, miss):
        p = part.select("tileset_id", "name", "_why")
        rows = p if rows is None else rows.unionByName(p)
    return violation(rows, "theme", "theme", F.col("_why"))


def theme_metrics(ts: Tables, resolved: DataFrame) -> DataFrame:
    """Luminance and hue of each role colour, one row per theme."""
    role = resolved.where("status = 'ok'").select(*PALETTE, "name", F.explode("roles").alias("role", "sym"))
    col = role.join(ts["palette"].select(*PALETTE, "sym", "r", "g", "b"), [*PALETTE, "sym"])
    rgb = [F.col(c) for c in "rgb"]
    m = col.withColumns({"lum": luminance709(*rgb), "hue": hsv_hue(*rgb)})
    pick = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}")
    return m.groupBy("tileset_id", "name").agg(*[pick(r, c) for r in ("fg", "bg", "shadow", "accent") for c in ("lum", "hue")])


def v_theme_constraints(ts: Tables, resolved: DataFrame | None = None) -> DataFrame:
    r = resolve_themes(ts["theme"]) if resolved is None else resolved
    key = ["tileset_id", "name"]
    c = ts["theme"].select(*key, F.explode("constraints").alias("constraint", "value"))
    j = c.join(r.where("status = 'ok'").select(*key), key, "left_semi").join(theme_metrics(ts, r), key, "left")
    n = F.expr("try_cast(value AS INT)")
    bad = F.when(F.col("constraint") == "fg_brighter_than_bg", F.col("fg_lum") <= F.col("bg_lum")).when(
        F.col("constraint") == "shadow_darker_than_bg", F.col("shadow_lum") >= F.col("bg_lum")).when(
        F.col("constraint") == "accent_hue_distinct_from_bg", hue_distance(F.col("accent_hue"), F.col("bg_hue")) < 40).when(
        F.col("constraint") == "palette_granularity", (n < 1) | (n > 8))
    return violation(j.where(F.coalesce(bad, F.lit(False))), "theme", "theme_constraints", F.col("constraint"), "warning")


def v_stats(ts: Tables) -> DataFrame:
    """Entity counts per tileset."""
    out = None
    for kind, key in (("palette", "palette"), ("stamp", "name"), ("tile", "name"), ("theme", "name"), ("cycle", "name"), ("tile_run", "name"), ("frame", "sprite")):
        t = ts["palette_raw"] if kind == "palette" else ts[kind]
        set_id = F.col("spriteset") if kind == "frame" else F.col("tileset_id").cast("string")
        c = t.groupBy(set_id.alias("tileset_id")).agg(F.countDistinct(key).alias("n")).withColumn("entity_type", F.lit("sprite" if kind == "frame" else kind))
        out = c if out is None else out.unionByName(c)
    return out


RULES = [v_palette_parse, v_palette_ref, v_size, v_pixels, v_grid_shape, v_symbols, v_rle, v_palette_size, v_rotate_square,
         v_template, v_tile_run, v_frames, v_delta_base, v_cycle, v_theme, v_theme_constraints]


def validate(ts: Tables) -> DataFrame:
    """Everything that is wrong; nothing stops at the first error.

    Outlined tiles and palettes are written once and read by all rules.
    """
    ts = ts | {"tile": cut(outlined(ts["tile"])), "palette": cut(ts["palette"])}
    resolved = cut(resolve_themes(ts["theme"], cut(theme_chain(ts["theme"]))))
    out = None
    for rule in RULES:
        v = rule(ts, resolved) if rule in (v_theme, v_theme_constraints) else rule(ts)
        v = v.withColumn("tileset_id", F.col("tileset_id").cast("string"))
        out = v if out is None else out.unionByName(v)
    return out
