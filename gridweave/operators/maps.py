"""Tile-map features, rooms, paths, rule audits, pins and autotiling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.operators.adjacency import A_CORNER, B_CORNER, DELTA, OPPOSITE, adjacency_degree, corners_fit
from gridweave.operators.components import connected_components
from gridweave.operators.grid import suffix_parts
from gridweave.operators.lookup import lookup
from gridweave.session import cut

BLOCK = 64  # rooms are first labelled inside blocks of this side


def base_name(tile: Column, legacy: bool = False) -> Column:
    """Tile name without its rotation suffix; ``legacy`` knows only _90, _180, _270."""
    return F.regexp_replace(tile, "_(90|180|270)$", "") if legacy else suffix_parts(tile)[0]


def with_affordance(cells: DataFrame, affordance: DataFrame, legacy: bool = False) -> DataFrame:
    """Adds ``base`` and ``affordance``; an exact tile name wins over the base name.

    Few names cover most cells, so the affordances go to the cells where their
    number allows it.
    """
    c = cells.withColumn("base", base_name(F.col("tile"), legacy))
    exact = affordance.select("tile", F.col("affordance").alias("_exact"))
    stripped = affordance.select(F.col("tile").alias("base"), F.col("affordance").alias("_base"))
    return lookup(lookup(c, exact, ["tile"]), stripped, ["base"]).select(
        *cells.columns, "base", F.coalesce("_exact", "_base").alias("affordance"))


def neighbor_pairs(cells: DataFrame, deltas: dict[str, tuple[int, int]], left: list[str], right: list[str],
                   by: str = "map_id") -> DataFrame:
    """``(by, x, y, dir, *left, *right_n)`` for each cell and existing neighbour.

    An equi-join on (map, x, y): the key is unique, so no map can skew it.
    """
    offs = F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for d, (dx, dy) in deltas.items()])
    a = cells.select(by, "x", "y", *left, F.explode(offs).alias("_o"))
    a = a.select(by, "x", "y", *left, "_o.dir", (F.col("x") + F.col("_o.dx")).alias("_nx"), (F.col("y") + F.col("_o.dy")).alias("_ny"))
    b = cells.select(by, F.col("x").alias("_nx"), F.col("y").alias("_ny"), *[F.col(c).alias(f"{c}_n") for c in right])
    return a.join(b, [by, "_nx", "_ny"])


RIGHT_DOWN = {"e": (1, 0), "s": (0, 1)}


def transitions(cells: DataFrame) -> DataFrame:
    p = neighbor_pairs(cells, RIGHT_DOWN, ["base"], ["base"])
    return p.groupBy("map_id").agg(F.count(F.when(F.col("base") != F.col("base_n"), 1)).alias("transition_count"))


def layout_features(cells: DataFrame) -> DataFrame:
    """Wall and walkable share, border solidity, size; cells carry ``affordance``.

    Rows are summarised first and maps from rows, so no task holds a map.
    The border of a one-row or one-column map counts both of its sides.
    """
    hit = (F.col("affordance") == "obstacle").cast("int")
    hit = F.coalesce(hit, F.lit(0))
    rows = cells.groupBy("map_id", "y").agg(
        F.count("*").alias("n"), F.sum(hit).alias("walls"),
        F.count(F.when(F.col("affordance") == "walkable", 1)).alias("floors"),
        (F.min_by(hit, "x") + F.max_by(hit, "x")).alias("ends"), (F.max("x") + 1).alias("w"))
    m = rows.groupBy("map_id").agg(
        F.sum("n").alias("n"), F.sum("walls").alias("walls"), F.sum("floors").alias("floors"),
        F.max("w").alias("w"), (F.max("y") + 1).alias("h"), F.sum("ends").alias("ends"),
        F.min_by(F.struct("walls", "ends"), "y").alias("top"), F.max_by(F.struct("walls", "ends"), "y").alias("bottom"))
    inner = F.when(F.col("h") > 2, F.col("ends") - F.col("top.ends") - F.col("bottom.ends")).otherwise(0)
    border = 2 * F.col("w") + 2 * F.greatest(F.col("h") - 2, F.lit(0))
    return m.select(
        "map_id", "w", "h", (F.col("walls") / F.col("n")).alias("wall_ratio"), (F.col("floors") / F.col("n")).alias("walkable_ratio"),
        ((F.col("top.walls") + F.col("bottom.walls") + inner) / border).alias("border_solidity"), F.col("floors").alias("walkable_cells"))


def _label_block(idx: np.ndarray, side: int) -> np.ndarray:
    """4-connected labels of the set cells of one block; the label is the smallest index."""
    n = side + 2
    lab = np.full((n, n), n * n, dtype=np.int64)
    ys, xs = idx // side + 1, idx % side + 1
    lab[ys, xs] = ys * n + xs
    open_ = lab < n * n
    while True:
        near = lab.copy()
        near[1:, :] = np.minimum(near[1:, :], lab[:-1, :])
        near[:-1, :] = np.minimum(near[:-1, :], lab[1:, :])
        near[:, 1:] = np.minimum(near[:, 1:], lab[:, :-1])
        near[:, :-1] = np.minimum(near[:, :-1], lab[:, 1:])
        near[~open_] = n * n
        # Pointer jumping: a label takes the label of the cell it names.
        near[open_] = np.minimum(near[open_], near[near[open_] // n, near[open_] % n])
        if np.array_equal(near, lab):
            break
        lab = near
    out = lab[ys, xs]
    return (out // n - 1) * side + (out % n - 1)


def label_rooms(passable: DataFrame, by: str = "map_id", block: int = BLOCK) -> DataFrame:
    """``(by, x, y, room)``: 4-connected component of each passable cell.

    Blocks of ``block x block`` cells (a fixed bound, whatever the map) are
    labelled in vectorised Python; rooms that cross block borders are joined as
    components of the far smaller graph of touching block labels.
    """
    cell = F.pmod("y", F.lit(block)) * block + F.pmod("x", F.lit(block))
    b = passable.groupBy(by, F.floor(F.col("x") / block).alias("_bx"), F.floor(F.col("y") / block).alias("_by")).agg(
        F.collect_list(cell.cast("int")).alias("_idx"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def labels(batch: pd.Series) -> pd.Series:
        return batch.map(lambda a: _label_block(np.asarray(a, dtype=np.int64), block).astype(np.int32))

    z = b.withColumn("_lab", labels("_idx")).select(by, "_bx", "_by", F.explode(F.arrays_zip("_idx", "_lab")).alias("_z"))
    at = lambda f, o: (F.col(o) * block + f).cast("bigint")
    cells = z.select(
        by, at(F.col("_z._idx") % block, "_bx").alias("x"), at(F.floor(F.col("_z._idx") / block), "_by").alias("y"),
        (at(F.floor(F.col("_z._lab") / block), "_by") * (1 << 31) + at(F.col("_z._lab") % block, "_bx")).alias("room"))
    cells = cut(cells)  # read for the seams and for the result
    last = lambda c: F.pmod(c, F.lit(block)) == block - 1
    first = lambda c: F.pmod(c, F.lit(block)) == 0
    seams = None
    for axis, (dx, dy) in (("x", (1, 0)), ("y", (0, 1))):
        a = cells.where(last(axis)).select(by, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("room").alias("src"))
        s = a.join(cells.where(first(axis)).withColumnRenamed("room", "dst"), [by, "x", "y"]).select(by, "src", "dst")
        seams = s if seams is None else seams.unionByName(s)
    seams = seams.distinct()
    nodes = seams.select(by, F.explode(F.array("src", "dst")).alias("room")).distinct()
    merged = connected_components(nodes, seams, [by], "room")
    return cells.join(merged, [by, "room"], "left").select(by, "x", "y", F.coalesce("comp", "room").alias("room"))


def label_rooms_join(passable: DataFrame, by: str = "map_id") -> DataFrame:
    """The same labels by propagation over cell adjacency alone (no Python)."""
    c = passable.select(by, F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).withColumn(
        "room", F.col("y") * (1 << 31) + F.col("x"))
    e = neighbor_pairs(c, RIGHT_DOWN, ["room"], ["room"], by).select(by, F.col("room").alias("src"), F.col("room_n").alias("dst"))
    comp = connected_components(c.select(by, "room"), e, [by], "room")
    return c.join(comp, [by, "room"]).select(by, "x", "y", F.col("comp").alias("room"))


def rooms(cells: DataFrame, method: str = "block") -> DataFrame:
    """Room count, largest room and walkable cells per map; every map has a row."""
    walk = cells.where("affordance = 'walkable'").select("map_id", "x", "y")
    lab = label_rooms(walk) if method == "block" else label_rooms_join(walk)
    sizes = lab.groupBy("map_id", "room").agg(F.count("*").alias("cells"))
    r = sizes.groupBy("map_id").agg(F.count("*").alias("room_count"), F.max("cells").alias("largest_room"), F.sum("cells").alias("walkable"))
    return cells.select("map_id").distinct().join(r, "map_id", "left").na.fill(0)


def connectivity(room: DataFrame) -> DataFrame:
    return room.withColumn("connectivity", F.when(F.col("walkable") > 0, F.col("largest_room") / F.col("walkable")).otherwise(0.0))


def map_features(cells: DataFrame) -> DataFrame:
    """All measures of each map; ``cells`` come from :func:`with_affordance`."""
    f = layout_features(cells).join(transitions(cells), "map_id", "left").na.fill(0, ["transition_count"])
    return f.join(connectivity(rooms(cells)), "map_id")


def map_quality(features: DataFrame) -> DataFrame:
    """Quality from connectivity; a failed generation (null features) scores 0 at neutral measures."""
    ok = F.col("connectivity").isNotNull()
    return features.withColumns({
        "quality": F.when(ok, 1.0 + 0.5 * F.col("connectivity")).otherwise(0.0),
        "wall_ratio": F.when(ok, F.col("wall_ratio")).otherwise(0.5),
        "room_count": F.when(ok, F.col("room_count").cast("double")).otherwise(1.0)})


def path_ok(cells: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds ``reachable``; ``paths(map_id, path_id, fx, fy, tx, ty)``.

    The start cell itself is not tested: from an impassable start the rooms of
    its four neighbours count.
    """
    lab = label_rooms(cells.where(F.col("affordance").isin("walkable", "interactive")).select("map_id", "x", "y"))
    start = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in [(0, 0), (0, -1), (0, 1), (-1, 0), (1, 0)]]))
    s = paths.withColumn("_o", start).select("map_id", "path_id", (F.col("fx") + F.col("_o.dx")).alias("x"), (F.col("fy") + F.col("_o.dy")).alias("y"))
    s = s.join(lab, ["map_id", "x", "y"]).select("map_id", "path_id", "room").distinct()
    goal = paths.join(lab.withColumnsRenamed({"x": "tx", "y": "ty"}), ["map_id", "tx", "ty"]).select("map_id", "path_id", "room")
    hit = s.join(goal, ["map_id", "path_id", "room"], "left_semi").select("map_id", "path_id").distinct().withColumn("_hit", F.lit(True))
    same = (F.col("fx") == F.col("tx")) & (F.col("fy") == F.col("ty"))
    return paths.join(hit, ["map_id", "path_id"], "left").select(*paths.columns, (same | F.coalesce("_hit", F.lit(False))).alias("reachable"))


# --- audits ---------------------------------------------------------------
def map_violations(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """Right and lower neighbours whose edges or corners do not fit.

    ``cells(map_id, tileset_id, x, y, tile)``.  Both tiles' classes are looked
    up and compared; the pair relation is never built.
    """
    t = tiles.select("tileset_id", F.col("name").alias("tile"), *"nesw", "ne", "se", "sw", "nw")
    c = cells.join(t, ["tileset_id", "tile"], "left")
    sides = ["tile", *"nesw", "ne", "se", "sw", "nw"]
    p = neighbor_pairs(c, RIGHT_DOWN, sides, sides)
    fits = None
    for d in RIGHT_DOWN:
        ok = (F.col(d) == F.col(f"{OPPOSITE[d]}_n")) & corners_fit(F.col(A_CORNER[d]), F.col(f"{B_CORNER[d]}_n"))
        fits = F.when(F.col("dir") == d, ok) if fits is None else fits.when(F.col("dir") == d, ok)
    return p.where(~F.coalesce(fits, F.lit(False))).select("map_id", "x", "y", "dir", "tile", "tile_n")


def parse_rules(rules: DataFrame) -> DataFrame:
    """``affordance:X forbids|requires affordance:Y ...`` -> (kind, source, target); malformed rules drop out."""
    pat = r"^\s*affordance:(\S+)\s+(forbids|requires)\s+(?:affordance|type):(\S+)"
    return rules.select(F.regexp_extract("rule", pat, 2).alias("kind"), F.regexp_extract("rule", pat, 1).alias("source"),
                        F.regexp_extract("rule", pat, 3).alias("target")).where("kind <> ''").distinct()


def forbid_violations(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells with a neighbour that a ``forbids`` rule excludes."""
    f = rules.where("kind = 'forbids'").select(F.col("source").alias("affordance"), F.col("target").alias("affordance_n"))
    p = neighbor_pairs(cells, DELTA, ["tile", "affordance"], ["tile", "affordance"])
    return p.join(f, ["affordance", "affordance_n"], "left_semi").select("map_id", "x", "y", "dir", "tile", "tile_n")


def require_bias(cells: DataFrame, rules: DataFrame, boost: float) -> DataFrame:
    """Product over matching ``requires`` rules: ``boost`` when a neighbour fits, else 0.1."""
    r = rules.where("kind = 'requires'").select(F.col("source").alias("affordance"), "target")
    near = neighbor_pairs(cells, DELTA, [], ["affordance"]).groupBy("map_id", "x", "y").agg(F.collect_set("affordance_n").alias("_near"))
    c = cells.select("map_id", "x", "y", "tile", "affordance").join(near, ["map_id", "x", "y"], "left").join(r, "affordance", "left")
    factor = F.when(F.col("target").isNull(), 1.0).when(
        F.coalesce(F.array_contains("_near", F.col("target")), F.lit(False)), float(boost)).otherwise(0.1)
    return c.groupBy("map_id", "x", "y", "tile").agg(F.product(factor).alias("bias"))


# --- pins -------------------------------------------------------------------
# Position word -> centre as a fraction of the map.
POSITIONS = {
    (0.5, 0.2): ["north", "n", "top"], (0.5, 0.8): ["south", "s", "bottom"],
    (0.8, 0.5): ["east", "e", "right"], (0.2, 0.5): ["west", "w", "left"],
    (0.8, 0.2): ["northeast", "ne", "top-right"], (0.2, 0.2): ["northwest", "nw", "top-left"],
    (0.8, 0.8): ["southeast", "se", "bottom-right"], (0.2, 0.8): ["southwest", "sw", "bottom-left"],
}


def expand_pins(requests: DataFrame, predicates: DataFrame, tiles: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Predicate text -> pins ``(map_id, x, y, tile)``.

    ``requests(map_id, tileset_id, w, h)``, ``predicates(map_id, ord, rule)``,
    ``tiles(tileset_id, name, idx, affordance)``, ``explicit(map_id, x, y, tile)``.
    A type is an exact tile name of the map's tileset, else the first tile of that
    affordance in it.  Later predicate
    pins overwrite earlier ones; explicit pins only fill free cells in bounds.
    """
    p = predicates.join(requests, "map_id").withColumn("_p", F.split("rule", ":"))
    kind = F.get("_p", F.lit(0))
    p = p.withColumns({"kind": kind, "type": F.when(kind == "border", F.get("_p", F.lit(1))).when(kind == "region", F.get("_p", F.lit(2)))})
    p = p.where(F.col("type").isNotNull())
    names = tiles.select("tileset_id", F.col("name").alias("type"), F.col("name").alias("_exact")).distinct()
    firsts = tiles.where("affordance IS NOT NULL").groupBy("tileset_id", F.col("affordance").alias("type")).agg(F.min_by("name", "idx").alias("_first"))
    p = p.join(names, ["tileset_id", "type"], "left").join(firsts, ["tileset_id", "type"], "left").withColumn("tile", F.coalesce("_exact", "_first")).where("tile IS NOT NULL")

    b = p.where("kind = 'border'")
    across = b.select("map_id", "ord", "tile", F.lit(0).alias("seq"), F.explode(F.expr("sequence(0, w - 1)")).alias("x"),
                      F.expr("array(0, h - 1)").alias("_ys")).select("map_id", "ord", "tile", "seq", "x", F.explode("_ys").alias("y"))
    down = b.where("h > 2").select("map_id", "ord", "tile", F.lit(0).alias("seq"), F.explode(F.expr("sequence(1, h - 2)")).alias("y"),
                                   F.expr("array(0, w - 1)").alias("_xs")).select("map_id", "ord", "tile", "seq", F.explode("_xs").alias("x"), "y")

    size, pos = F.coalesce(F.get("_p", F.lit(3)), F.lit("3x3")), F.lower(F.coalesce(F.get("_p", F.lit(4)), F.lit("anywhere")))
    dim = lambda i: F.coalesce(F.try_to_number(F.regexp_extract(size, r"^(\d+)x(\d+)$", i), F.lit("99999")).cast("int"), F.lit(3))
    fx = fy = None
    for (cx, cy), words in POSITIONS.items():
        fx = F.when(pos.isin(words), cx) if fx is None else fx.when(pos.isin(words), cx)
        fy = F.when(pos.isin(words), cy) if fy is None else fy.when(pos.isin(words), cy)
    r = p.where("kind = 'region'").withColumns({
        "rw": dim(1), "rh": dim(2), "cx": F.floor(fx.otherwise(0.5) * F.col("w")).cast("int"), "cy": F.floor(fy.otherwise(0.5) * F.col("h")).cast("int")})
    r = r.where("rw > 0 AND rh > 0").withColumn("dy", F.explode(F.expr("sequence(0, least(rh, 3) - 1)"))).withColumn("dx", F.explode(F.expr("sequence(0, least(rw, 3) - 1)")))
    region = r.select("map_id", "ord", "tile", (F.col("dy") * 3 + F.col("dx")).alias("seq"),
                      F.expr("least(greatest(cx + dx - rw div 2, 0), w - 1)").cast("int").alias("x"),
                      F.expr("least(greatest(cy + dy - rh div 2, 0), h - 1)").cast("int").alias("y"))
    pins = across.unionByName(down).unionByName(region).groupBy("map_id", "x", "y").agg(F.max_by("tile", F.struct("ord", "seq")).alias("tile"))
    if explicit is None:
        return pins
    inside = explicit.join(requests, "map_id").where("x >= 0 AND y >= 0 AND x < w AND y < h").select("map_id", "x", "y", "tile")
    return pins.unionByName(inside.join(pins, ["map_id", "x", "y"], "left_anti").dropDuplicates(["map_id", "x", "y"]))


def pin_conflicts(pins: DataFrame, requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """``(map_id, x, y, dir, issue)``: a pin with no possible neighbour inside the
    map, or a border pin and an adjacent pin that no single tile can serve."""
    p = pins.join(requests, "map_id")
    offs = F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for d, (dx, dy) in DELTA.items()])
    q = p.withColumn("_o", F.explode(offs)).select("map_id", "tileset_id", "x", "y", "w", "h", "tile", "_o.dir",
                                                  (F.col("x") + F.col("_o.dx")).alias("_nx"), (F.col("y") + F.col("_o.dy")).alias("_ny"))
    q = q.where("_nx >= 0 AND _ny >= 0 AND _nx < w AND _ny < h")
    deg = adjacency_degree(tiles).withColumnRenamed("name", "tile")
    q = q.join(deg, ["tileset_id", "tile", "dir"], "left").na.fill(0, ["degree"])
    none = q.where("degree = 0").select("map_id", "x", "y", "dir", F.lit("no compatible neighbour").alias("issue"))

    other = pins.select("map_id", F.col("x").alias("_nx"), F.col("y").alias("_ny"), F.col("tile").alias("tile_n"))
    border = "(x = 0 OR y = 0 OR x = w - 1 OR y = h - 1)"
    near = q.where(f"degree > 0 AND {border}").join(other, ["map_id", "_nx", "_ny"])
    t = tiles.select("tileset_id", "name", *"nesw", "ne", "se", "sw", "nw")
    pairs = near.select("tileset_id", "dir", "tile", "tile_n").distinct()
    a = t.withColumnsRenamed({"name": "tile", **{c: f"a_{c}" for c in t.columns[2:]}})
    b = t.withColumnsRenamed({"name": "tile_n", **{c: f"b_{c}" for c in t.columns[2:]}})
    pr = pairs.join(a, ["tileset_id", "tile"]).join(b, ["tileset_id", "tile_n"])
    want = None
    for d in DELTA:
        o = OPPOSITE[d]
        # A shared tile lies in direction d of the pin and in direction o of the other pin.
        s = F.struct(F.col(f"a_{d}").alias("k1"), F.col(f"a_{A_CORNER[d]}").alias("c1"), F.col(f"b_{o}").alias("k2"), F.col(f"b_{A_CORNER[o]}").alias("c2"))
        want = F.when(F.col("dir") == d, s) if want is None else want.when(F.col("dir") == d, s)
    pr = pr.withColumn("_w", want).select("tileset_id", "dir", "tile", "tile_n", "_w.*")
    offer = F.array(*[F.struct(F.lit(d).alias("dir"), F.col(OPPOSITE[d]).alias("k1"), F.col(B_CORNER[d]).alias("o1"),
                               F.col(d).alias("k2"), F.col(B_CORNER[OPPOSITE[d]]).alias("o2")) for d in DELTA])
    offers = t.select("tileset_id", F.explode(offer).alias("_f")).select("tileset_id", "_f.*").distinct()
    served = pr.join(offers, ["tileset_id", "dir", "k1", "k2"]).where(
        corners_fit(F.col("c1"), F.col("o1")) & corners_fit(F.col("c2"), F.col("o2"))).select("tileset_id", "dir", "tile", "tile_n").distinct()
    clash = pairs.join(served, ["tileset_id", "dir", "tile", "tile_n"], "left_anti")
    shared = near.join(clash, ["tileset_id", "dir", "tile", "tile_n"], "left_semi").select(
        "map_id", "x", "y", "dir", F.lit("no tile fits both pins").alias("issue"))
    return none.unionByName(shared)


def pin_density(pins: DataFrame, requests: DataFrame) -> DataFrame:
    """Share of pinned cells; ``dense`` above forty percent."""
    n = pins.groupBy("map_id").agg(F.count_distinct("x", "y").alias("pinned"))
    r = requests.join(n, "map_id", "left").na.fill(0, ["pinned"])
    return r.withColumn("percent", F.expr("pinned * 100 div (w * h)")).withColumn("dense", F.col("percent") > 40)


# --- autotile -----------------------------------------------------------------
#: Neighbour offset -> bit (fixed values).
BITS = {(-1, -1): 1, (0, -1): 2, (1, -1): 4, (-1, 0): 8, (1, 0): 16, (-1, 1): 32, (0, 1): 64, (1, 1): 128}
CORNERS = {1: 2 | 8, 4: 2 | 16, 32: 64 | 8, 128: 64 | 16}


def clean_mask(mask: Column) -> Column:
    """A corner bit stays only when both of its cardinal bits are set."""
    out = mask.bitwiseAND(2 | 8 | 16 | 64)
    for bit, need in CORNERS.items():
        out = out + F.when((mask.bitwiseAND(bit) > 0) & (mask.bitwiseAND(need) == need), bit).otherwise(0)
    return out


def autotile_mask(cells: DataFrame, kind: str = "base") -> DataFrame:
    """Adds ``mask``: which of the eight neighbours share the cell's type."""
    deltas = {str(bit): d for d, bit in BITS.items()}
    p = neighbor_pairs(cells, deltas, [kind], [kind])
    bits = p.where(F.col(kind) == F.col(f"{kind}_n")).groupBy("map_id", "x", "y").agg(F.bit_or(F.col("dir").cast("int")).alias("_m"))
    j = cells.join(bits, ["map_id", "x", "y"], "left")
    return j.withColumn("mask", clean_mask(F.coalesce("_m", F.lit(0)))).drop("_m")


def autotile_index(masked: DataFrame) -> DataFrame:
    """Adds ``tile_index`` 0..46: the rank of the mask among the clean ones."""
    spark = masked.sparkSession
    from pyspark.sql import Window as W
    clean = spark.range(256).select(clean_mask(F.col("id").cast("int")).alias("mask")).distinct()
    table = clean.withColumn("tile_index", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("mask")) - 1)  # 47 rows
    return masked.join(F.broadcast(table), "mask")
