"""Threshold labels.  Thresholds and words are fixed values of the label grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(value: Column, limits: list[tuple[float, str]], last: str, strict_above: bool = False) -> Column:
    """First label whose limit holds: ``value < limit``, or ``value > limit`` when strict_above."""
    out = None
    for limit, word in limits:
        cond = value > limit if strict_above else value < limit
        out = F.when(cond, word) if out is None else out.when(cond, word)
    return out.otherwise(last)


def up_to(value: Column, limits: list[tuple[float, str]], last: str) -> Column:
    out = None
    for limit, word in limits:
        out = F.when(value <= limit, word) if out is None else out.when(value <= limit, word)
    return out.otherwise(last)


def density_word(d: Column) -> Column:
    return steps(d, [(0.2, "sparse"), (0.5, "moderate"), (0.8, "dense")], "solid")


def tile_label(rotation: Column | None = None) -> Column:
    """Label of a row of tile features; names the tileset, never the grid."""
    sym = F.greatest("symmetry_h", "symmetry_v")
    parts = [
        F.concat(F.lit("tileset:"), F.col("tileset_id")),
        F.concat(F.lit("density:"), density_word(F.col("density"))),
        F.concat(F.lit("symmetry:"), steps(sym, [(0.85, "high"), (0.6, "medium")], "low", True)),
        F.concat(F.lit("detail:"), steps(F.col("edge_complexity"), [
            (0.15, "flat"), (0.35, "simple"), (0.55, "moderate")], "complex")),
        F.concat(F.lit("colors:"), up_to(F.col("unique_symbols"), [(2, "minimal"), (4, "few")], "rich")),
    ]
    if rotation is not None:
        parts.append(F.when(rotation != "", F.concat(F.lit("rotation:"), rotation)))
    return F.concat_ws(", ", *parts)


def map_label() -> Column:
    return F.concat_ws(
        ", ",
        F.concat(F.lit("theme:"), F.col("theme")),
        F.concat(F.lit("size:"), F.col("w").cast("string"), F.lit("x"), F.col("h").cast("string")),
        F.concat(F.lit("layout:"), steps(F.col("wall_ratio"), [(0.3, "open"), (0.6, "mixed")], "dense")),
        F.concat(F.lit("rooms:"), up_to(F.col("room_count"), [(1, "single"), (3, "few"), (6, "several")], "many")),
        F.concat(F.lit("border:"), steps(F.col("border_solidity"), [(0.8, "enclosed"), (0.4, "partial")], "open", True)),
    )


# Keywords of the prompt grammar; the first group with a hit wins.
PROMPT_WORDS = {
    "layout": ([("open", ["open", "spacious", "wide", "empty", "field"]),
                ("dense", ["dense", "tight", "maze", "narrow", "packed"])], "mixed"),
    "rooms": ([("single", ["single", "one room", "1 room", "arena"]),
               ("many", ["many", "lots", "complex", "labyrinth"]),
               ("few", ["few", "2", "3", "couple"])], "several"),
    "border": ([("enclosed", ["enclosed", "walled", "dungeon", "indoor"]),
                ("open", ["open border", "outdoor", "field"])], "partial"),
}


def prompt_label(prompt: Column, theme: Column, size: Column) -> Column:
    text = F.lower(prompt)
    parts = [F.concat(F.lit("theme:"), theme), F.concat(F.lit("size:"), size)]
    for name, (groups, default) in PROMPT_WORDS.items():
        word = None
        for value, keys in groups:
            hit = text.rlike("|".join(keys))
            word = F.when(hit, value) if word is None else word.when(hit, value)
        parts.append(F.concat(F.lit(f"{name}:"), word.otherwise(default)))
    return F.concat_ws(", ", *parts)
