"""Tile features, edges and edge classes - all row-local over compact grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.grids import VOID, cells_of, count_symbol, equal_cells, rows_of


def tile_features(tiles: DataFrame) -> DataFrame:
    """Adds the seven visual features of each grid; map-only, no shuffle.

    Symmetry is counted over the full width and halved: the middle column or
    row of an odd grid always matches itself and is taken out.
    """
    t = tiles.withColumn("_rows", rows_of(F.col("grid")))
    t = t.withColumns({"_flat": F.array_join("_rows", ""), "_h": F.size("_rows"), "_w": F.length(F.col("_rows")[0])})
    t = t.withColumn("_n", F.length("_flat"))
    full = F.col("_n") > 0
    w, h, n, flat, rows = (F.col(c) for c in ("_w", "_h", "_n", "_flat", "_rows"))
    mirror_h = F.array_join(F.transform(rows, F.reverse), "")
    mirror_v = F.array_join(F.reverse(rows), "")
    left = F.array_join(F.transform(rows, lambda r: F.substring(r, F.lit(1), w - 1)), "")
    right = F.array_join(F.transform(rows, lambda r: F.substring(r, F.lit(2), w - 1)), "")
    upper, lower = F.substring(flat, F.lit(1), n - w), F.substring(flat, w + 1, n - w)
    used = F.array_remove(F.array_distinct(cells_of(flat)), VOID)
    # Most frequent symbol; the first one met in scan order wins a tie.
    ranked = F.transform(used, lambda s: F.struct(
        count_symbol(flat, s).alias("n"), (-F.instr(flat, s)).alias("first"), s.alias("sym")))
    t = t.withColumns({
        "_match_h": (equal_cells(flat, mirror_h) - (w % 2) * h) / 2,
        "_match_v": (equal_cells(flat, mirror_v) - (h % 2) * w) / 2,
        "_same": equal_cells(left, right) + equal_cells(upper, lower),
        "_filled": n - count_symbol(flat, F.lit(VOID)),
        "_top": F.array_max(ranked),
        "unique_symbols": F.size(used),
    })
    pairs = 2 * n - w - h
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return t.where(full).withColumns({
        "density": F.col("_filled") / n,
        "symmetry_h": ratio(F.col("_match_h"), h * F.expr("_w div 2")),
        "symmetry_v": ratio(F.col("_match_v"), w * F.expr("_h div 2")),
        "edge_complexity": ratio(pairs - F.col("_same"), pairs),
        "dominant_symbol": F.coalesce(F.col("_top.sym"), F.lit(VOID)),
        "dominant_ratio": F.coalesce(F.col("_top.n") / F.col("_filled"), F.lit(1.0)),
    }).drop("_rows", "_flat", "_h", "_w", "_n", "_match_h", "_match_v", "_same", "_filled", "_top")


def edges(tiles: DataFrame) -> DataFrame:
    """Adds the border strings ``edge_n, edge_e, edge_s, edge_w``."""
    rows = rows_of(F.col("grid"))
    side = lambda pos: F.array_join(F.transform(rows, lambda r: F.substring(r, pos, 1)), "")
    return tiles.withColumns({
        "edge_n": rows[0], "edge_e": side(-1), "edge_s": F.element_at(rows, -1), "edge_w": side(1)})


def edge_class(edge: Column) -> Column:
    """``empty`` / ``open`` / ``solid_X`` / ``edge_X`` by strict majority / ``mixed_<digest>``."""
    n = F.length(edge)
    syms = F.array_distinct(cells_of(edge))
    major = F.get(F.filter(syms, lambda s: count_symbol(edge, s) * 2 > n), F.lit(0))
    return (
        F.when(n == 0, "empty")
        .when(count_symbol(edge, F.lit(VOID)) == n, "open")
        .when(F.size(syms) == 1, F.concat(F.lit("solid_"), F.substring(edge, 1, 1)))
        .when(major == VOID, "open")
        .when(major.isNotNull(), F.concat(F.lit("edge_"), major))
        .otherwise(F.concat(F.lit("mixed_"), F.substring(F.md5(edge), 1, 16)))
    )


def classify_edges(edged: DataFrame) -> DataFrame:
    return edged.withColumns({f"class_{d}": edge_class(F.col(f"edge_{d}")) for d in "nesw"})


def class_matches(declared: Column, computed: Column) -> Column:
    """Declared names may abbreviate: ``X`` stands for ``X_...``; floor and water for any solid."""
    return (
        (declared == computed)
        | F.startswith(computed, F.concat(declared, F.lit("_")))
        | (declared.isin("floor", "water") & computed.startswith("solid_"))
    )


def edge_audit(classified: DataFrame) -> DataFrame:
    """Declared ``n, e, s, w`` against computed classes, one row per tile.

    ``filled``: nothing was declared.  ``updated``: at least one side is stale,
    so all four are replaced.  ``ok``: the declared classes stay.
    """
    blank = F.col("n").isNull() & F.col("e").isNull() & F.col("s").isNull() & F.col("w").isNull()
    stale = F.concat_ws(", ", *[
        F.when(~F.coalesce(class_matches(F.col(d), F.col(f"class_{d}")), F.lit(False)),
               F.concat(F.lit(f"{d}="), F.coalesce(F.col(d), F.lit("?")), F.lit("->"), F.col(f"class_{d}")))
        for d in "nesw"])
    status = F.when(blank, "filled").when(stale == "", "ok").otherwise("updated")
    return classified.withColumns({
        "status": status,
        "stale": F.when(blank, "").otherwise(stale),
        **{f"final_{d}": F.when(status == "ok", F.col(d)).otherwise(F.col(f"class_{d}")) for d in "nesw"},
    })
