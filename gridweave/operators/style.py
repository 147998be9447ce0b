"""Style fingerprints: eight measures per group, from mergeable sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.color import with_oklab
from gridweave.functions.grids import VOID, cells_of, rows_of, run_count
from gridweave.session import cut

MEASURES = ["light_direction", "run_length_mean", "shadow_ratio", "palette_breadth",
            "pixel_density", "palette_entropy", "hue_bias", "luminance_mean"]


def symbol_sums(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Per (group, symbol): cell count and sum of normalised positions.

    Cells explode inside the map stage and collapse in the partial aggregate,
    so the shuffle carries at most one row per group, symbol and task.
    """
    t = tiles.select(*by, rows_of(F.col("grid")).alias("_rows"))
    t = t.select(*by, F.size("_rows").alias("_h"), F.length(F.col("_rows")[0]).alias("_w"),
                 F.posexplode("_rows").alias("y", "_row"))
    p = t.select(*by, "_h", "_w", "y", F.posexplode(cells_of(F.col("_row"))).alias("x", "sym"))
    return p.groupBy(*by, "sym").agg(
        F.count("*").alias("cells"),
        F.sum((F.col("x") / F.col("_w") + F.col("y") / F.col("_h")) / 2).alias("pos_sum"))


def tile_sums(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Per group: tiles, cells, runs and distinct symbols summed over tiles."""
    rows = rows_of(F.col("grid"))
    t = tiles.select(*by, rows.alias("_rows")).withColumn("_flat", F.array_join("_rows", ""))
    return t.groupBy(*by).agg(
        F.count("*").alias("tiles"), F.sum(F.length("_flat")).alias("cells"),
        F.sum(run_count(F.col("_rows"))).alias("runs"),
        F.sum(F.size(F.array_distinct(cells_of(F.col("_flat"))))).alias("breadth_sum"))


def palette_measures(palette: DataFrame, key: list[str], void: str = VOID) -> DataFrame:
    """OKLab lightness and hue per symbol, and whether it counts as shadow."""
    p = with_oklab(palette).where(F.col("sym") != void)
    dark = p.groupBy(*key).agg((F.min("ok_l") * 1.5).alias("_dark"))
    if key:
        p = p.join(dark, key)
    else:  # one palette: a one-row aggregate
        p = p.join(F.broadcast(dark))
    return p.select(*key, "sym", F.col("ok_l").alias("lum"), F.col("ok_hue").alias("hue"),
                    (F.col("ok_l") <= F.col("_dark")).alias("shadow"))


def latent_from_sums(symbols: DataFrame, totals: DataFrame, palette: DataFrame, by: list[str],
                     key: list[str] | None = None, void: str = VOID) -> DataFrame:
    """Project merged sums to the eight measures.

    Symbols missing from the palette still count in every denominator; void
    counts in runs, breadth and entropy only.
    """
    key = key or []
    m = palette_measures(palette, key, void)
    s = symbols.join(m, [*key, "sym"], "left")
    n, known = F.col("cells"), F.col("lum").isNotNull()
    bright = F.col("lum") > 0.3
    filled = F.sum(F.when(F.col("sym") != void, n).otherwise(0))
    rad = F.radians("hue")
    g = s.groupBy(*by).agg(
        filled.alias("_filled"),
        F.sum(F.when(known, n * F.col("lum"))).alias("_lum"),
        F.sum(F.when(F.col("shadow"), n)).alias("_shadow"),
        F.sum(F.when(bright, F.col("pos_sum"))).alias("_pos"),
        F.sum(F.when(bright, n)).alias("_bright"),
        F.sum(F.when(known, n * F.cos(rad))).alias("_cos"),
        F.sum(F.when(known, n * F.sin(rad))).alias("_sin"),
        F.sum(n * F.log(n.cast("double"))).alias("_nlogn"),
        F.sum(n).alias("_total"))
    g = g.join(totals, by)
    deg = F.degrees(F.atan2(F.coalesce("_sin", F.lit(0.0)), F.coalesce("_cos", F.lit(0.0))))
    over = lambda a, b, other: F.when(b > 0, F.coalesce(a, F.lit(0)) / b).otherwise(other)
    return g.select(
        *by,
        over(F.col("_pos"), F.col("_bright"), F.lit(0.5)).alias("light_direction"),
        over(F.col("cells"), F.col("runs"), F.lit(1.0)).alias("run_length_mean"),
        over(F.col("_shadow"), F.col("_filled"), F.lit(0.0)).alias("shadow_ratio"),
        over(F.col("breadth_sum"), F.col("tiles"), F.lit(0.0)).alias("palette_breadth"),
        over(F.col("_filled"), F.col("_total"), F.lit(0.0)).alias("pixel_density"),
        (F.log(F.col("_total").cast("double")) - F.col("_nlogn") / F.col("_total")).alias("palette_entropy"),
        F.when(deg < 0, deg + 360.0).otherwise(deg).alias("hue_bias"),
        over(F.col("_lum"), F.col("_filled"), F.lit(0.0)).alias("luminance_mean"),
        F.col("tiles").alias("sample_count"))


def style_latent(tiles: DataFrame, palette: DataFrame, by: list[str], key: list[str] | None = None,
                 void: str = VOID) -> DataFrame:
    """Fingerprint per group.  ``key`` names the columns that select the palette."""
    by_key = list(dict.fromkeys([*by, *(key or [])]))
    return latent_from_sums(symbol_sums(tiles, by_key), tile_sums(tiles, by_key), palette, by_key, key, void)


def merged(symbols: DataFrame, totals: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sums of finer groups added up to those of ``by``."""
    return (symbols.groupBy(*by, "sym").agg(*[F.sum(c).alias(c) for c in ("cells", "pos_sum")]),
            totals.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tiles", "cells", "runs", "breadth_sum")]))


def style_against(tiles: DataFrame, palette: DataFrame, by: list[str], ref: list[str]) -> DataFrame:
    """Fingerprints per ``by`` scored against those of the coarser groups ``ref`` (columns of ``by``).

    Cells are walked once: the sums per ``by`` are written and those of ``ref`` come from them.
    """
    symbols, totals = cut(symbol_sums(tiles, by)), cut(tile_sums(tiles, by))
    whole = latent_from_sums(*merged(symbols, totals, ref), palette, ref)
    return style_score(latent_from_sums(symbols, totals, palette, by), whole, ref)


def learn_style(tiles: DataFrame, palette: DataFrame, by: list[str], names: DataFrame | None = None) -> DataFrame:
    """Fingerprint of a named subset (or all) of the non-template grid tiles."""
    t = tiles.where("grid IS NOT NULL")
    if "template" in t.columns:
        t = t.where("template IS NULL")
    if names is not None:
        t = t.join(names, names.columns, "left_semi")
    return style_latent(t, palette, by)


def style_score(latents: DataFrame, ref: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Adds ``style_score``: one minus the mean of eight scaled differences, in 0..1.

    ``ref`` holds one row per ``on`` key (or exactly one row).
    """
    r = ref.select(*(on or []), *[F.col(m).alias(f"_r_{m}") for m in MEASURES])
    j = latents.join(r, on) if on else latents.join(F.broadcast(r))
    t, q = (lambda m: F.col(m)), (lambda m: F.col(f"_r_{m}"))
    gap = lambda m: F.abs(q(m) - t(m))
    rel = lambda m, floor: F.abs((q(m) - t(m)) / F.greatest(q(m), F.lit(floor)))
    diffs = [
        gap("light_direction") * 2, rel("run_length_mean", 1.0), gap("shadow_ratio") * 3,
        rel("palette_breadth", 1.0), gap("pixel_density") * 2, rel("palette_entropy", 0.1),
        F.least(gap("hue_bias"), 360.0 - gap("hue_bias")) / 180.0, gap("luminance_mean") * 2,
    ]
    total = sum(diffs[1:], diffs[0]) / 8.0
    return j.withColumn("style_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - total))).drop(
        *[f"_r_{m}" for m in MEASURES])


def assessment(score: Column) -> Column:
    return (F.when(score > 0.85, "excellent match").when(score > 0.7, "good match")
            .when(score > 0.5, "moderate match").otherwise("poor match"))


def describe(fmt: bool = True) -> Column:
    """One-line text of a latent row."""
    light = F.when(F.col("light_direction") < 0.35, "top-left").when(
        F.col("light_direction") < 0.65, "center/even").otherwise("bottom-right")
    density = F.when(F.col("pixel_density") > 0.8, "dense").when(
        F.col("pixel_density") > 0.5, "moderate").otherwise("sparse")
    shadow = F.when(F.col("shadow_ratio") > 0.25, "heavy").when(
        F.col("shadow_ratio") > 0.1, "moderate").otherwise("light")
    return F.concat(
        F.lit("tiles="), F.col("sample_count").cast("string"), F.lit(" light="), light,
        F.lit(" density="), density, F.lit(" shadows="), shadow)


def style_report(scored: DataFrame) -> DataFrame:
    return scored.withColumns({
        "assessment": assessment(F.col("style_score")),
        "style_score": F.round("style_score", 2), "description": describe()})
