"""Definition tables: palettes, themes, sprites, cycles, tile refs, tilemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridweave.functions.color import hex_channels, hex_valid
from gridweave.functions.grids import rows_of
from gridweave.operators.grid import to_pixels
from gridweave.operators.lookup import lookup
from gridweave.session import cut

ERROR_COLOUR = (255, 0, 255, 255)  # fixed value


# --- palettes --------------------------------------------------------------
def parse_palette(df: DataFrame) -> DataFrame:
    """``(…, sym, hex)`` -> channels plus ``error`` for bad keys and colours."""
    error = F.when(F.length("sym") != 1, "key must be one character").when(~hex_valid(F.col("hex")), "bad colour")
    return df.withColumns({**hex_channels(F.col("hex")), "error": error})


def merge_palette_ext(palette: DataFrame, ext: DataFrame, scope: tuple[str, ...] = ("tileset_id",)) -> DataFrame:
    """``ext(*scope, palette, base, sym, hex)``: entries of the base palette of the same scope plus the extension's own.

    A key named ``base`` is the link, not a colour; an extension entry wins over
    a base one.  What can't be resolved is a row with an ``error``: an entry with
    a bad colour, and an extension whose base its scope lacks, which then has no
    other rows.
    """
    cols = [*scope, "palette", "sym", "r", "g", "b", "a"]
    links = ext.select(*scope, F.col("palette").alias("_ext"), F.col("base").alias("palette")).distinct()
    based = links.join(palette.select(*scope, "palette").distinct(), [*scope, "palette"], "left_semi")
    lost = links.join(based, [*scope, "_ext", "palette"], "left_anti").select(
        *scope, F.col("_ext").alias("palette"), F.lit(None).cast("string").alias("sym"), F.lit("base palette not found").alias("error"))
    own = ext.where("sym <> 'base'").join(based.select(*scope, F.col("_ext").alias("palette")), [*scope, "palette"], "left_semi")
    own = own.select(*scope, "palette", "sym", F.when(~hex_valid(F.col("hex")), "bad colour").alias("error"), "hex").withColumns(hex_channels(F.col("hex"))).drop("hex")
    inherited = palette.join(based, [*scope, "palette"]).select(*scope, F.col("_ext").alias("palette"), *cols[len(scope) + 1:])
    inherited = inherited.join(own, [*scope, "palette", "sym"], "left_anti")
    return own.unionByName(inherited, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True).select(*cols, "error")


def colorize(pixels: DataFrame, palette: DataFrame, on: list[str], swap: DataFrame | None = None,
             swap_on: list[str] | None = None) -> DataFrame:
    """Symbol -> channels: swap map first, then palette, then the error colour."""
    chan = ["r", "g", "b", "a"]
    p = palette.select(*on, "sym", *[F.col(c).alias(f"_p_{c}") for c in chan])
    j = lookup(pixels, p, [*on, "sym"])
    srcs = {c: [F.col(f"_p_{c}")] for c in chan}
    drop = [f"_p_{c}" for c in chan]
    if swap is not None:
        s = swap.select(*(swap_on or []), "sym", *[F.col(c).alias(f"_s_{c}") for c in chan])
        j = lookup(j, s, [*(swap_on or []), "sym"])
        srcs = {c: [F.col(f"_s_{c}"), *srcs[c]] for c in chan}
        drop += [f"_s_{c}" for c in chan]
    return j.withColumns({c: F.coalesce(*srcs[c], F.lit(e)) for c, e in zip(chan, ERROR_COLOUR)}).drop(*drop)


# --- cycles ------------------------------------------------------------------
def cycle_shift(n: Column, direction: Column, tick: Column, legacy: bool = False) -> Column:
    """Displacement at a tick.  True ping-pong by default; ``legacy`` folds the tick by ``n`` first."""
    t = F.pmod(tick, n)
    period = F.greatest(2 * (n - 1), F.lit(1))
    k = F.pmod(t if legacy else tick, period)
    return F.when(direction == "forward", t).when(direction == "backward", F.pmod(n - t, n)).when(
        direction == "ping-pong", F.when(k < n, k).otherwise(period - k)).otherwise(0)


def apply_cycle(cells: DataFrame, cycle: DataFrame, ticks: list[int], legacy: bool = False) -> DataFrame:
    """``cells(cycle, sym, …)`` x ticks -> ``shown``: the symbol whose colour appears.

    A cycle travels as one ordered symbol array, so the tick expansion needs no further join.
    """
    c = cycle.groupBy("cycle", "direction").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda s: s["sym"]).alias("_syms"))
    j = cells.join(c, "cycle", "left").withColumn("tick", F.explode(F.array(*[F.lit(t) for t in ticks])))
    n = F.size("_syms")
    pos = F.array_position("_syms", F.col("sym")) - 1
    at = F.pmod(pos + cycle_shift(n, F.col("direction"), F.col("tick"), legacy), n).cast("int")
    return j.withColumn("shown", F.when(pos >= 0, F.get("_syms", at)).otherwise(F.col("sym"))).drop("_syms", "direction")


# --- sprites -----------------------------------------------------------------
def _changed(rows: Column, changes: Column) -> Column:
    """Rows with sparse changes, the last of a cell winning; those outside the grid do nothing."""
    def row(text: Column, y: Column) -> Column:
        mine = F.filter(changes, lambda c: (c["y"] == y) & (c["x"] >= 0) & (c["x"] < F.length(text)))
        sym = lambda c: F.when(F.length(c["sym"]) > 0, F.substring(c["sym"], 1, 1)).otherwise(".")
        return F.aggregate(mine, text, lambda t, c: F.overlay(t, sym(c), (c["x"] + 1).cast("int"), F.lit(1)))

    return F.when(changes.isNull(), rows).otherwise(F.transform(rows, row))


def _mirrored(rows: Column, mirror: Column) -> Column:
    flat = F.when(mirror.isin("v", "hv", "vh"), F.reverse(rows)).otherwise(rows)
    return F.when(mirror.isin("h", "hv", "vh"), F.transform(flat, lambda r: F.reverse(r))).otherwise(flat)


def _in_order(frames: DataFrame) -> DataFrame:
    """One row per sprite: its few frames folded in listed order to ``done(index, rows, duration_ms)``, rows null where unresolved."""
    whole = lambda c: F.col(c).cast("int").alias(c)
    listed = F.array_sort(F.collect_list(F.struct(
        "ord", F.coalesce("encoding", F.lit("grid")).alias("encoding"), whole("index"), whole("base"), whole("link_to"),
        rows_of(F.col("grid")).alias("rows"), "changes", "mirror", whole("duration_ms"))))

    def step(done: Column, f: Column) -> Column:
        of = F.coalesce(F.when(f["encoding"] == "delta", f["base"]).otherwise(f["link_to"]), F.lit(1))
        earlier = F.try_element_at(F.filter(done, lambda d: d["index"] == of), F.lit(-1))["rows"]
        rows = F.when(f["encoding"] == "grid", f["rows"]).when(f["encoding"] == "linked", earlier).when(
            f["encoding"] == "delta", _changed(earlier, f["changes"]))
        return F.concat(done, F.array(F.struct(
            f["index"].alias("index"), _mirrored(rows, f["mirror"]).alias("rows"), f["duration_ms"].alias("duration_ms"))))

    start = F.array().cast("array<struct<index:int,rows:array<string>,duration_ms:int>>")
    return frames.groupBy("spriteset", "sprite").agg(listed.alias("_f")).select(
        "spriteset", "sprite", F.explode(F.aggregate("_f", start, step)).alias("f"))


def resolve_grids(frames: DataFrame, fps: int = 8) -> DataFrame:
    """``(spriteset, sprite, index, grid, duration_ms)`` for every frame.

    Frames stand in the order of ``ord``.  A delta or linked frame builds on any
    earlier frame as it was shown, mirror included; ``base`` and ``link_to`` are 1
    by default.  Frames without such a frame are in :func:`frame_errors`.
    """
    return _in_order(frames).where("f.rows IS NOT NULL").select(
        "spriteset", "sprite", "f.index", F.array_join("f.rows", "\n").alias("grid"),
        F.coalesce("f.duration_ms", F.lit(1000 // fps)).alias("duration_ms"))


def frame_errors(frames: DataFrame) -> DataFrame:
    """``(spriteset, sprite, index)`` of frames without a grid, of unknown encoding, or built on no earlier resolved frame."""
    return _in_order(frames).where("f.rows IS NULL").select("spriteset", "sprite", "f.index")


def resolve_frames(frames: DataFrame, fps: int = 8) -> DataFrame:
    """``(spriteset, sprite, index, duration_ms, x, y, sym)``: the cells of :func:`resolve_grids`."""
    return to_pixels(resolve_grids(frames, fps), ("spriteset", "sprite", "index", "duration_ms"))


# --- references and tilemaps ---------------------------------------------------
# Modifier spellings.
MODIFIERS = {"shadow": "shadow", "s": "shadow", "highlight": "highlight", "hi": "highlight"}


def parse_ref(ref: Column) -> Column:
    """``name[!hvd][:modifier]`` -> struct; an unknown modifier stays where it is."""
    table = F.create_map(*[F.lit(x) for kv in MODIFIERS.items() for x in kv])
    mod = F.try_element_at(table, F.regexp_extract(ref, ":([^:]*)$", 1))
    body = F.when(mod.isNotNull(), F.regexp_replace(ref, ":[^:]*$", "")).otherwise(ref)
    flags = F.regexp_extract(body, "!(.*)$", 1)
    has = lambda f: F.contains(flags, F.lit(f)).alias(f"flip_{f}")
    return F.struct(F.split_part(body, F.lit("!"), F.lit(1)).alias("name"), has("h"), has("v"), has("d"), mod.alias("modifier"))


def map_cells(layers: DataFrame) -> DataFrame:
    """``layers(map_id, layer, grid, z_order, role, scroll, collision_mode)`` -> one row per cell.

    ``depth`` ranks a map's few layers; blank cells (``.``) are left out.
    """
    depth = F.row_number().over(W.partitionBy("map_id").orderBy(F.coalesce("z_order", F.lit(0)), "layer")) - 1
    l = layers.withColumns({
        "depth": depth, "role": F.coalesce("role", F.lit("custom")), "scroll": F.coalesce("scroll", F.lit(1.0)),
        "collision_mode": F.coalesce("collision_mode", F.lit("full"))})
    meta = ["map_id", "layer", "depth", "role", "scroll", "collision_mode"]
    rows = l.select(*meta, F.posexplode(F.filter(F.split("grid", "\n"), lambda r: F.trim(r) != "")).alias("y", "_row"))
    c = rows.select(*meta, "y", F.posexplode(F.split(F.trim("_row"), r"\s+")).alias("x", "_ref")).where("_ref <> '.'")
    return c.select(*meta, "x", "y", parse_ref(F.col("_ref")).alias("ref")).select(*meta, "x", "y", "ref.*")


# --- themes ----------------------------------------------------------------------
#: Rows of themes or of chains that a task sorts: they pack so well in files that a task by bytes would hold millions.
THEME_ROWS = 50_000


#: Values of a theme besides its roles.
RESOLVED = ("palette", "scale", "canvas", "max_palette_size", "light_source")


def _dealt(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """``df``, of about ``rows`` rows, by ``key`` over as many tasks as keep each at ``THEME_ROWS``."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // THEME_ROWS)), *key)


def theme_chain(themes: DataFrame) -> DataFrame:
    """``(tileset_id, name, ancestor, depth, status)``: each theme with itself and its ancestors in its tileset.

    Depth-one joins until every chain ends, meets a missing parent or closes a
    loop (``status`` ok / missing / cycle); the frontier shrinks every round.
    """
    edge = cut(_dealt(themes.select("tileset_id", F.col("name").alias("ancestor"), F.col("extends").alias("_up")), themes.count(), "tileset_id", "ancestor"))
    front = edge.select("tileset_id", F.col("ancestor").alias("name"), "ancestor", F.lit(0).alias("depth"), F.array("ancestor").alias("_path"), "_up")
    known = edge.select("tileset_id", F.col("ancestor").alias("_up"), F.lit(True).alias("_hit"))
    out = None
    while True:
        j = front.join(known, ["tileset_id", "_up"], "left").withColumn("status", F.when(F.col("_up").isNull(), "ok").when(
            F.array_contains("_path", F.col("_up")), "cycle").when(F.col("_hit").isNull(), "missing"))
        j = cut(j)
        part = j.select("tileset_id", "name", "ancestor", "depth", "status")
        out = part if out is None else out.unionByName(part)
        more = j.where("status IS NULL")
        if more.isEmpty():
            return out
        front = more.select("tileset_id", "name", F.col("_up").alias("ancestor"), (F.col("depth") + 1).alias("depth"), "_path").join(
            edge, ["tileset_id", "ancestor"]).select("tileset_id", "name", "ancestor", "depth", F.concat("_path", F.array("ancestor")).alias("_path"), "_up")


def resolve_themes(themes: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """Overlay root to leaf: palette of the leaf, other values from the nearest theme that sets them."""
    chain = cut(theme_chain(themes)) if chain is None else chain
    key = ["tileset_id", "name"]
    mine = themes.select("tileset_id", F.col("name").alias("ancestor"), *RESOLVED, "roles")
    t = _dealt(chain.join(mine, ["tileset_id", "ancestor"]), chain.count(), *key)
    near = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    flat = t.groupBy(*key).agg(
        F.min_by("palette", "depth").alias("palette"), *[near(c) for c in RESOLVED[1:]], F.max("status").alias("status"))
    role = t.select(*key, "depth", F.explode("roles").alias("role", "sym")).where("sym <> ''")
    role = role.groupBy(*key, "role").agg(F.min_by("sym", "depth").alias("sym")).groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("role", "sym"))).alias("roles"))
    return flat.join(role.hint("merge"), key, "left").withColumns({
        "scale": F.coalesce("scale", F.lit(1)), "canvas": F.coalesce("canvas", F.lit(16))})
