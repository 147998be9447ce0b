"""Edge-compatibility joins and tileset completeness.

Tiles are ``(tileset_id, name, n, e, s, w, ne, se, sw, nw)``.  Compatibility is
kept in factorised form - tiles grouped by (tileset, direction, class, corner) -
which is linear in the tiles.  Counts, degrees, pair checks and map audits all
work on that form; only :func:`adjacency` itself spells the pairs out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.components import connected_components

DIRS = ("n", "e", "s", "w")
OPPOSITE = {"n": "s", "s": "n", "e": "w", "w": "e"}
#: The corner tested on each side of a contact (fixed values): a's counter-clockwise, b's clockwise.
A_CORNER = {"n": "nw", "e": "ne", "s": "se", "w": "sw"}
B_CORNER = {"n": "ne", "e": "se", "s": "sw", "w": "nw"}
DELTA = {"n": (0, -1), "e": (1, 0), "s": (0, 1), "w": (-1, 0)}


def _side(tiles: DataFrame, edge_of: dict, corner_of: dict, out: str, empty_matches: bool) -> DataFrame:
    cls = lambda d: F.coalesce(F.col(edge_of[d]), F.lit("")) if empty_matches else F.col(edge_of[d])
    sides = F.array(*[F.struct(F.lit(d).alias("dir"), cls(d).alias("cls"), F.col(corner_of[d]).alias(f"{out}_corner")) for d in DIRS])
    s = tiles.select("tileset_id", F.col("name").alias(out), F.explode(sides).alias("_s")).select("tileset_id", out, "_s.*")
    return s.where("cls IS NOT NULL")


def a_side(tiles: DataFrame, empty_matches: bool = False) -> DataFrame:
    """What each tile shows in each direction."""
    return _side(tiles, {d: d for d in DIRS}, A_CORNER, "a", empty_matches)


def b_side(tiles: DataFrame, empty_matches: bool = False) -> DataFrame:
    """What each tile shows when it lies in that direction of another."""
    return _side(tiles, OPPOSITE, B_CORNER, "b", empty_matches)


def corners_fit(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def adjacency_classes(tiles: DataFrame) -> DataFrame:
    """Factorised relation: how many tiles offer each (direction, class, corner)."""
    return b_side(tiles).groupBy("tileset_id", "dir", "cls", "b_corner").agg(F.count("*").alias("members"))


def adjacency(tiles: DataFrame, groups: DataFrame | None = None, wanted: DataFrame | None = None,
              empty_matches: bool = False) -> DataFrame:
    """``(tileset_id, a, dir, b)`` for all tiles, or only for the ``wanted`` a's.

    One equi-join on (tileset, direction, class); the output is as large as the
    relation, so downstream audits use the factorised form instead.  Group
    members of a match share its class, so they are found inside the same
    class, and they skip the corner test.
    """
    a, b = a_side(tiles, empty_matches), b_side(tiles, empty_matches)
    if wanted is not None:
        a = a.join(wanted.select("tileset_id", F.col("name").alias("a")).distinct(), ["tileset_id", "a"], "left_semi")
    on = ["tileset_id", "dir", "cls"]
    hits = a.join(b, on).where(corners_fit(F.col("a_corner"), F.col("b_corner"))).select(*on, "a", "b")
    if groups is None:
        return hits.select("tileset_id", "a", "dir", "b").distinct()
    g = groups.select("tileset_id", "grp", F.col("tile").alias("b")).distinct()
    reach = hits.join(g, ["tileset_id", "b"]).select(*on, "a", "grp").distinct()
    members = b.join(g, ["tileset_id", "b"]).select(*on, "grp", "b")
    more = reach.join(members, [*on, "grp"]).select("tileset_id", "a", "dir", "b")
    return hits.select("tileset_id", "a", "dir", "b").unionByName(more).distinct()


def adjacency_degree(tiles: DataFrame) -> DataFrame:
    """Number of fitting tiles per (tile, direction), zeros included.

    Computed from class counts: all members of the class, less those whose
    corner is defined and different.  No pair is ever formed.
    """
    per = adjacency_classes(tiles)
    whole = per.groupBy("tileset_id", "dir", "cls").agg(
        F.sum("members").alias("_all"), F.sum(F.when(F.col("b_corner").isNull(), F.col("members")).otherwise(0)).alias("_open"))
    same = per.where("b_corner IS NOT NULL").select("tileset_id", "dir", "cls", F.col("b_corner").alias("a_corner"), F.col("members").alias("_same"))
    a = a_side(tiles)
    j = a.join(whole, ["tileset_id", "dir", "cls"], "left").join(same, ["tileset_id", "dir", "cls", "a_corner"], "left")
    deg = F.when(F.col("a_corner").isNull(), F.coalesce("_all", F.lit(0))).otherwise(
        F.coalesce("_open", F.lit(0)) + F.coalesce("_same", F.lit(0)))
    return j.select("tileset_id", F.col("a").alias("name"), "dir", deg.cast("bigint").alias("degree"))


def isolated_tiles(tiles: DataFrame) -> DataFrame:
    """(tile, direction) with no fitting tile, or with exactly one."""
    d = adjacency_degree(tiles).where("degree <= 1")
    return d.withColumn("issue", F.when(F.col("degree") == 0, "isolated").otherwise("poor"))


def compat_totals(tiles: DataFrame) -> DataFrame:
    """Compatible and possible pairs per tileset."""
    n = tiles.groupBy("tileset_id").agg((F.count("*") * F.count("*") * 4).alias("total_pairs"))
    d = adjacency_degree(tiles).groupBy("tileset_id").agg(F.sum("degree").alias("compatible_pairs"))
    return n.join(d, "tileset_id", "left").na.fill(0, ["compatible_pairs"])


def _one_side(tiles: DataFrame, name: str, prefix: str) -> DataFrame:
    return tiles.select("tileset_id", F.col("name").alias(name), *[F.col(d).alias(f"_{prefix}{d}") for d in DIRS],
                        F.lit(True).alias(f"_{prefix}hit"))


def _pick(prefix: str, names: dict[str, str]) -> Column:
    out = None
    for word, side in names.items():
        c = F.col(f"_{prefix}{side}")
        out = F.when(F.col("direction") == word, c) if out is None else out.when(F.col("direction") == word, c)
    return out


def check_pairs(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """``requests(tileset_id, a, b, direction)`` -> compatible / error, two lookups."""
    words = {"north": "n", "east": "e", "south": "s", "west": "w"}
    j = requests.join(_one_side(tiles, "a", "a"), ["tileset_id", "a"], "left").join(
        _one_side(tiles, "b", "b"), ["tileset_id", "b"], "left")
    ea, eb = _pick("a", words), _pick("b", {k: OPPOSITE[v] for k, v in words.items()})
    error = F.when(F.col("_ahit").isNull(), F.concat(F.lit("tile not found: "), "a")).when(
        F.col("_bhit").isNull(), F.concat(F.lit("tile not found: "), "b")).when(
        ~F.col("direction").isin(*words), F.concat(F.lit("invalid direction: "), "direction"))
    return j.select(*requests.columns, ea.alias("edge_a"), eb.alias("edge_b"), error.alias("error"),
                    F.when(error.isNull(), F.coalesce(ea == eb, F.lit(False))).alias("compatible"))


def compatible_neighbors(new: DataFrame, tiles: DataFrame) -> DataFrame:
    """Per new tile and other tile: the directions in which the edges agree (no corner test)."""
    a = a_side(new).select("tileset_id", "a", "dir", "cls")
    b = b_side(tiles).select("tileset_id", "b", "dir", "cls")
    return a.join(b, ["tileset_id", "dir", "cls"]).where("a <> b").groupBy("tileset_id", "a", "b").agg(
        F.array_join(F.array_sort(F.collect_set("dir")), "").alias("dirs"))


# --- completeness ---------------------------------------------------------------
def edge_components(tiles: DataFrame) -> DataFrame:
    """Edge classes linked through tiles, per tileset.

    A tile links its n-s and its e-w classes.  Quarter turns swap those two
    links, so auto-rotation adds nothing.  Template tiles and tiles without
    classes are left out.
    """
    t = tiles.where("n IS NOT NULL AND e IS NOT NULL AND s IS NOT NULL AND w IS NOT NULL")
    if "is_template" in t.columns:
        t = t.where("NOT is_template")
    links = t.select("tileset_id", F.explode(F.array(
        F.struct(F.col("n").alias("src"), F.col("s").alias("dst")), F.struct(F.col("e").alias("src"), F.col("w").alias("dst")))).alias("_l")).select("tileset_id", "_l.*").distinct()
    nodes = links.select("tileset_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return connected_components(nodes, links, ["tileset_id"]).withColumnRenamed("node", "cls")


def completeness(components: DataFrame) -> DataFrame:
    """Connected and disconnected class pairs from component sizes; no pair is formed.

    The denominator is one when there is at most one class, so such a tileset scores 0.
    """
    size = components.groupBy("tileset_id", "comp").agg(F.count("*").alias("k"))
    t = size.groupBy("tileset_id").agg(F.sum("k").alias("n_classes"), F.sum(F.expr("k * (k - 1) div 2")).alias("connected"))
    total = F.expr("n_classes * (n_classes - 1) div 2")
    summary = F.when(F.col("disconnected") == 0, F.concat(F.lit("fully connected, "), F.col("n_classes").cast("string"), F.lit(" classes"))).otherwise(
        F.concat(F.col("n_classes").cast("string"), F.lit(" classes, "), F.col("disconnected").cast("string"), F.lit(" disconnected pairs")))
    return t.withColumn("disconnected", total - F.col("connected")).withColumns({
        "score": F.col("connected") / F.greatest(total, F.lit(1)), "summary": summary})


def missing_tiles(components: DataFrame) -> DataFrame:
    """One transition tile per disconnected class pair (the result is those pairs)."""
    a = components.select("tileset_id", F.col("cls").alias("a"), F.col("comp").alias("_ca"))
    b = components.select("tileset_id", F.col("cls").alias("b"), F.col("comp").alias("_cb"))
    p = a.join(b, "tileset_id").where("a < b AND _ca <> _cb")
    return p.select("tileset_id", F.concat(F.lit("transition_"), "a", F.lit("_"), "b").alias("name"),
                    F.col("a").alias("n"), F.col("a").alias("e"), F.col("b").alias("s"), F.col("a").alias("w"),
                    F.lit("4way").alias("auto_rotate"))
