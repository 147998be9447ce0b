"""Manifest tables for exports: atlas positions, frame tags, ids, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The words that stand for each affordance.
AFFORDANCE_WORDS = {
    "walkable": ["walkable", "ground", "floor", "path", "road", "background", "sky", "void"],
    "obstacle": ["obstacle", "wall", "rock", "tree", "building"],
    "hazard": ["hazard", "lava", "spike", "acid", "fire", "water", "liquid", "pond", "river"],
    "collectible": ["collectible", "coin", "gem", "key", "heart"],
    "character": ["character", "npc", "player", "enemy", "hero"],
    "decoration": ["decoration", "prop", "furniture", "sign"],
    "interactive": ["interactive", "door", "chest", "lever", "switch"],
}


def affordance_of(word: Column) -> Column:
    """Exact lower-case match, else null."""
    pairs = [F.lit(x) for aff, words in AFFORDANCE_WORDS.items() for w in words for x in (w, aff)]
    return F.try_element_at(F.create_map(*pairs), F.lower(word))


def atlas_layout(tiles: DataFrame, columns: int = 16, padding: int = 0, scale: int = 1) -> tuple[DataFrame, DataFrame]:
    """Sheet positions ``(tileset_id, name, index, x, y)`` and sheets ``(tileset_id, sheet_w, sheet_h, tiles, mixed)``.

    A tileset with mixed tile sizes is flagged and gets no positions.  One
    atlas image holds one tileset, which bounds the ranking window.
    """
    s = tiles.groupBy("tileset_id").agg(F.count("*").alias("tiles"), F.min("w").alias("tw"), F.min("h").alias("th"),
                                        (F.count_distinct("w", "h") > 1).alias("mixed"))
    cell_w, cell_h = F.col("tw") * scale + padding, F.col("th") * scale + padding
    sheets = s.withColumns({"sheet_w": columns * cell_w + padding, "sheet_h": F.ceil(F.col("tiles") / columns) * cell_h + padding})
    i = F.row_number().over(W.partitionBy("tileset_id").orderBy("name")) - 1
    pos = tiles.withColumn("index", i).join(sheets.where("NOT mixed").select("tileset_id", "tw", "th"), "tileset_id")
    pos = pos.select("tileset_id", "name", "index", (padding + F.col("index") % columns * cell_w).alias("x"),
                     (padding + F.floor(F.col("index") / columns) * cell_h).alias("y"))
    return pos, sheets.drop("tw", "th")


def frame_tags(frames: DataFrame, tags: DataFrame) -> DataFrame:
    """``(spriteset, name, from, to)``: each tag of a sprite, or the whole sprite when it has none."""
    f = frames.groupBy("spriteset", "sprite").agg(F.max("index").alias("_last"))
    j = f.join(tags, ["spriteset", "sprite"], "left")
    named = F.col("tag").isNotNull()
    return j.select("spriteset", F.when(named, F.concat("sprite", F.lit("_"), "tag")).otherwise(F.col("sprite")).alias("name"),
                    F.when(named, F.col("from_frame")).otherwise(1).alias("from"), F.when(named, F.col("to_frame")).otherwise(F.col("_last")).alias("to"))


def map_gids(cells: DataFrame, tiles: DataFrame, by: list[str] = ["map_id"]) -> DataFrame:
    """Row-major 1-based tile ids per map (0 for an unknown tile), rows built before maps.

    ``tiles(name, gid)``; see :func:`tile_ids` for the dictionary.
    """
    c = cells.join(tiles.select(F.col("name").alias("tile"), "gid"), "tile", "left").na.fill(0, ["gid"])
    rows = c.groupBy(*by, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "gid"))), lambda s: s["gid"]).alias("_row"))
    return rows.groupBy(*by).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("y", "_row"))), lambda s: s["_row"])).alias("gids"))


def tile_ids(tiles: DataFrame, by: list[str] = []) -> DataFrame:
    """Name-ordered 1-based ids per tileset."""
    return tiles.withColumn("gid", F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy("name")))


def collision_rects(tiles: DataFrame) -> DataFrame:
    """Collision kind -> rectangle in tile pixels; null for ``none`` or unknown."""
    w, h, k = F.col("w").cast("double"), F.col("h").cast("double"), F.col("collision")

    def rect(x, y, rw, rh):
        return F.struct(x.alias("x"), y.alias("y"), rw.alias("w"), rh.alias("h"))

    zero = F.lit(0.0)
    return tiles.withColumn("rect", F.when(k.isin("full", "custom"), rect(zero, zero, w, h)).when(
        k.isin("top_half", "half_top"), rect(zero, zero, w, h / 2)).when(
        k == "bottom_half", rect(zero, h / 2, w, h / 2)).when(k == "center", rect(w * 0.25, h * 0.25, w * 0.5, h * 0.5)))


def list_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.select("tileset_id", "name", "size", "palette", (F.col("template").isNotNull()).alias("is_template"))


def layer_lists(tiles: DataFrame) -> DataFrame:
    """Tile counts per target layer of a tileset (the names stay in the tile table)."""
    return tiles.groupBy("tileset_id", "target_layer").agg(F.count("*").alias("tiles"))
