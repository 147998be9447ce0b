"""Tile variants by small mutations.

Draws are digests of (seed, tile, variant, purpose), so results repeat exactly
and agree with any other drawing method in distribution only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.grids import VOID, cells_of, count_symbol, rows_of
from gridweave.operators.ranking import draw_int

MUTATIONS = ("noise", "crack", "row", "col", "swap", "erode")


def _inside(v: Column, n: Column) -> Column:
    """A draw turned into an interior coordinate 1..n-2."""
    return F.lit(1) + v % F.greatest(n - 2, F.lit(1))


def _touched(kind: str) -> Column:
    """``(p, s)`` of the cells that a mutation rewrites, oldest first; reads the prepared columns of :func:`vary`."""
    w, h, flat = F.col("w"), F.col("h"), F.col("_flat")
    d = [F.col(f"_d{k}") for k in range(2)]
    put = lambda p, s: F.struct(p.cast("int").alias("p"), s.alias("s"))
    none = F.array().cast("array<struct<p:int,s:string>>")

    if kind in ("row", "col"):
        across, along = (h, w) if kind == "row" else (w, h)
        line = F.lit(2) + d[0] % F.greatest(across - 4, F.lit(1))
        place = (lambda t: line * w + t) if kind == "row" else (lambda t: t * w + line)

        def shift(t):
            src = F.when(d[1] % 2 == 0, F.when(t == 1, along - 2).otherwise(t - 1)).otherwise(F.when(t == along - 2, F.lit(1)).otherwise(t + 1))
            return put(place(t), F.substring(flat, (place(src) + 1).cast("int"), F.lit(1)))

        return F.when((across > 4) & (along > 3), F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(along - 2, F.lit(1))), shift)).otherwise(none)

    if kind == "crack":
        vertical = d[0] % 2 == 0
        across, along = F.when(vertical, w).otherwise(h), F.when(vertical, h).otherwise(w)
        line = F.lit(2) + d[1] % F.greatest(across - 4, F.lit(1))

        def crack(k):
            t, s = F.floor(k / 2), line + k % 2
            hit = F.when(k % 2 == 0, (F.get("_coin", k) < 7) & (s < across)).otherwise((F.get("_coin", k) < 3) & (s < across - 1))
            return put(F.when(hit, F.when(vertical, t * w + s).otherwise(s * w + t)), F.col("_dark"))

        return F.when(along > 2, F.transform(F.sequence(F.lit(2), F.greatest(2 * along - 3, F.lit(2)).cast("int")), crack)).otherwise(none)

    if kind == "noise":  # void cells stay
        return F.transform("_spots", lambda e: put(F.when(F.substring(flat, (e["p"] + 1).cast("int"), F.lit(1)) != VOID, e["p"]), e["s"]))
    return F.transform("_spots", lambda e: put(e["p"], e["s"]))


def _swapped() -> Column:
    """The flat grid with two symbols exchanged in its interior, row by row."""
    w, h, used, n = F.col("w"), F.col("h"), F.col("_used"), F.size("_used")
    ia = F.col("_d0") % n
    a = F.get(used, ia.cast("int"))
    b = F.get(used, ((ia + 1 + F.col("_d1") % F.greatest(n - 1, F.lit(1))) % n).cast("int"))
    part = lambda text, x, y, size: F.substring(text, (y * w + x + 1).cast("int"), size.cast("int"))

    def rows(other):
        return F.transform(F.sequence(F.lit(0).cast("bigint"), h - 1), lambda y: F.when(
            (y >= 1) & (y <= h - 2), F.concat(part(F.col("_flat"), F.lit(0), y, F.lit(1)), part(other, F.lit(1), y, w - 2), part(F.col("_flat"), w - 1, y, F.lit(1)))).otherwise(
            part(F.col("_flat"), F.lit(0), y, w)))

    # The exchanged text is a lambda's argument, so it is made once a tile and not once a row.
    made = F.transform(F.array(F.call_function("translate", F.col("_flat"), F.concat(a, b), F.concat(b, a))), rows)
    return F.when((n > 1) & (w > 2), F.array_join(made[0], "")).otherwise(F.col("_flat"))


def _written(flat: Column, cells: Column) -> Column:
    """The text after all of ``cells`` were written, in order; places outside it and null ones are left out."""
    def write(text, c):
        return F.when((c["p"] >= 0) & (c["p"] < F.length(text)), F.concat(
            F.substring(text, F.lit(1), c["p"]), c["s"], F.substring(text, c["p"] + 2, F.length(text)))).otherwise(text)

    return F.aggregate(cells, flat, write)


def vary(tiles: DataFrame, n: int, seed: int, palette: DataFrame, kinds: tuple[str, ...] = MUTATIONS,
         id_col: str = "tile_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``n`` variants per tile, mutation ``i mod 6``, with the tile's columns ``keep``; a void-only tile yields none.

    Row-local after one broadcast of the palette's brightness map (a palette
    is bounded by its symbols); nothing shuffles.  What a variant draws are
    columns of its own, so a caller that doesn't read the grids draws nothing.
    """
    bright = palette.agg(F.map_from_entries(F.collect_list(F.struct("sym", F.expr("r + g + b").alias("v")))).alias("_bright"))
    t = tiles.withColumn("_flat", F.array_join(rows_of(F.col("grid")), ""))
    t = t.withColumns({"_cells": cells_of(F.col("_flat")), "w": F.length(F.split_part("grid", F.lit("\n"), F.lit(1))).cast("bigint")})
    t = t.withColumn("h", F.floor(F.length("_flat") / F.col("w")))
    t = t.withColumn("_used", F.array_sort(F.array_remove(F.array_distinct("_cells"), VOID))).where(F.size("_used") > 0)
    t = t.join(F.broadcast(bright)).withColumns({  # one-row side
        "_dark": F.array_min(F.transform("_used", lambda s: F.struct(F.coalesce(F.try_element_at("_bright", s), F.lit(0)).alias("v"), s.alias("s"))))["s"],
        "_common": F.array_max(F.transform("_used", lambda s: F.struct(count_symbol(F.col("_flat"), s).alias("v"), s.alias("s"))))["s"]})
    w, h = F.col("w"), F.col("h")

    t = t.select(id_col, *keep, *(["name"] if "name" in tiles.columns else []), "w", "h", "_flat", "_used", "_dark", "_common",
                 F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    i = F.col("i")
    t = t.withColumn("mutation", F.element_at(F.array(*[F.lit(k) for k in kinds]), ((i - 1) % len(kinds) + 1).cast("int")))
    # Everything a variant draws, computed once per variant before the cells are walked.
    noise = F.col("mutation") == "noise"
    count = F.when(noise, F.floor(w * h / 12) + 1).when(F.col("mutation") == "erode", 3).otherwise(0).cast("int")
    order = F.filter(F.sequence(F.lit(0), count), lambda j: j < count)  # oldest draw first: the last one of a cell wins
    draw = lambda what, j: draw_int(seed, F.col(id_col), i, F.lit(what), j)

    def spot(j):
        x, y, side = _inside(draw("x", j), w), _inside(draw("y", j), h), draw("s", j) % 4
        return F.when(noise, y * w + x).when(side == 0, w + x).when(side == 1, (h - 2) * w + x).when(
            side == 2, y * w + 1).otherwise(y * w + w - 2)

    symbol = lambda j: F.when(noise, F.get("_used", (draw("s", j) % F.size("_used")).cast("int"))).otherwise(F.col("_common"))
    t = t.withColumns({
        **{f"_d{k}": draw_int(seed, F.col(id_col), i, F.lit(k)) for k in range(2)},
        "_spots": F.transform(order, lambda j: F.struct(spot(j).alias("p"), symbol(j).alias("s"))),
        "_coin": F.when(F.col("mutation") == "crack", F.transform(F.sequence(F.lit(0), (2 * F.greatest(w, h)).cast("int")), lambda j: draw("c", j) % 10))})
    flat = None
    for k in kinds:
        one = _swapped() if k == "swap" else _written(F.col("_flat"), _touched(k))
        flat = F.when(F.col("mutation") == k, one) if flat is None else flat.when(F.col("mutation") == k, one)
    grid = F.regexp_replace(flat, F.concat(F.lit("(.{"), w.cast("string"), F.lit("})(?!$)")), F.lit("$1\n"))
    base = F.col("name") if "name" in tiles.columns else F.concat(F.lit("t"), F.col(id_col).cast("string"))
    return t.select(id_col, *keep, F.concat(base, F.lit("_"), F.col("i").cast("string")).alias("name"), "i", "mutation", grid.alias("grid"))
