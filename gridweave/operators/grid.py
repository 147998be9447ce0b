"""Grid codecs as relational reshapes (compact text <-> long pixels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridweave.functions.grids import cells_of, flip_rows, grid_text, rotate_rows, rows_of


def to_pixels(tiles: DataFrame, keep: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Explode grids to ``(*keep, x, y, sym)``; a narrow transformation."""
    rows = tiles.select(*keep, F.posexplode(rows_of(F.col("grid"))).alias("y", "_row"))
    return rows.select(*keep, "y", F.posexplode(cells_of(F.col("_row"))).alias("x", "sym"))


#: Pixels that are looked at together for pieces of lines.
PIECE_PIXELS = 1 << 15


def _packed(table):
    """``(*by, y, x, n, text)`` of one Arrow table ``(*by, y, x, sym)``: neighbours that follow each other are one piece."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    cols = [c.combine_chunks() for c in table.itercolumns()]
    x, sym = cols[-2], cols[-1]
    differ = lambda a, b: pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
    odd = pc.fill_null(pc.not_equal(pc.utf8_length(sym), 1), True).to_numpy(zero_copy_only=False)
    new = np.ones(len(sym), bool)
    new[1:] = odd[1:] | odd[:-1] | differ(x[1:], pc.add(x[:-1], pa.scalar(1, x.type)))
    for c in cols[:-2]:
        new[1:] |= differ(c[1:], c[:-1])
    start = np.flatnonzero(new)
    wide = pa.types.is_large_string(sym.type)
    ends = np.frombuffer(sym.buffers()[1], np.int64 if wide else np.int32)[sym.offset:sym.offset + len(sym) + 1]
    at, where = pa.array(start), np.append(start, len(sym))
    text = type(sym).from_buffers(len(start), pa.py_buffer(np.ascontiguousarray(ends[where])), sym.buffers()[2])
    text = pc.if_else(sym.take(at).is_valid(), text, pa.scalar(None, sym.type))
    n = pa.array(np.diff(where).astype(np.int32))
    return pa.RecordBatch.from_arrays([*[c.take(at) for c in cols[:-1]], n, text], names=[*table.column_names[:-1], "n", "text"])


def _lines(pixels: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each line ``(*by, y)`` of pixels ``(*by, y, x, sym)`` as ``_s``, its pieces ``(x, n, text)`` in order.

    Pixels that already follow each other (as ``to_pixels`` leaves them) are one
    piece before the only shuffle; others are pieces of one pixel, as is a
    symbol of more or less than one character.  Rows lie by ``by`` afterwards.
    """
    source = pixels.select(*by, "y", "x", "sym")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(parts):
        import pyarrow as pa

        held, rows = [], 0
        for batch in parts:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= PIECE_PIXELS:
                yield _packed(pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield _packed(pa.Table.from_batches(held))

    pieces = source.mapInArrow(run, f"{fields}, n int, text string").repartition(*by)
    return pieces.groupBy(*by, "y").agg(F.array_sort(F.collect_list(F.struct("x", "n", "text"))).alias("_s"))


def _cells() -> Column:
    """Cells ``(x, sym)`` of the pieces ``_s`` in order; pieces may lie over each other."""
    def cells(s: Column) -> Column:
        one = F.array(F.struct(s["x"].alias("x"), s["text"].alias("sym")))
        # Expanded by place only where it has several cells.
        more = F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.struct((s["x"] + i).alias("x"), F.substring(s["text"], i + 1, F.lit(1)).alias("sym")))
        return F.when(s["n"] == 1, one).otherwise(more)

    return F.array_sort(F.flatten(F.transform("_s", cells)))


def _stacked(rows: DataFrame, by: tuple[str, ...], out: str) -> DataFrame:
    return rows.groupBy(*by).agg(grid_text(
        F.transform(F.array_sort(F.collect_list(F.struct("y", "_row"))), lambda c: c["_row"])).alias(out))


def to_grid(pixels: DataFrame, by: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Inverse of :func:`to_pixels`: pieces are gathered to rows, rows to grids."""
    text = F.array_join(F.transform(_cells(), lambda c: c["sym"]), "")
    whole = F.coalesce(F.col("_s")[0]["text"], F.lit(""))
    rows = _lines(pixels, by).select(*by, "y", F.when(F.size("_s") == 1, whole).otherwise(text).alias("_row"))
    return _stacked(rows, by, "grid")


def rle_encode(tiles: DataFrame, extended: bool = False) -> DataFrame:
    """Grid text -> run-length rows; run of one drops its count, ``n:key`` when extended.

    Runs are found inside each row with one regular expression back-reference,
    so the whole encode is row-local.
    """
    def token(run: Column) -> Column:
        n, key = F.length(run), F.substring(run, 1, 1)
        if extended:
            return F.concat(n.cast("string"), F.lit(":"), key)
        return F.when(n == 1, key).otherwise(F.concat(n.cast("string"), key))

    rle = F.transform(
        rows_of(F.col("grid")),
        lambda r: F.array_join(
            F.transform(F.regexp_extract_all(r, F.lit(r"((.)\2*)"), F.lit(1)), token), " "
        ),
    )
    return tiles.withColumn("rle", grid_text(rle)).drop("grid")


def rle_runs(tiles: DataFrame, keep: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Parse run-length text to runs ``(*keep, y, i, n, sym, ok)``.

    Plain tokens are ``[count]symbol``; extended tokens are ``count:key``.
    """
    rows = tiles.select(*keep, F.posexplode(F.split("rle", "\n")).alias("y", "_row")).where(
        F.trim("_row") != ""
    )
    tok = rows.select(*keep, "y", F.posexplode(F.split(F.trim("_row"), "\\s+")).alias("i", "tok"))
    ext = F.col("tok").rlike(r"^[0-9]+:.+$")
    plain = F.col("tok").rlike(r"^[0-9]*[^0-9]$")
    count = F.regexp_extract("tok", r"^([0-9]*)", 1)
    return tok.select(
        *keep, "y", "i", "tok",
        F.when(count == "", 1).otherwise(F.expr("try_cast(regexp_extract(tok, '^([0-9]*)', 1) AS INT)")).alias("n"),
        F.when(ext, F.regexp_extract("tok", r"^[0-9]+:(.+)$", 1))
        .otherwise(F.regexp_extract("tok", r"^[0-9]*(.)$", 1)).alias("sym"),
        (ext | plain).alias("ok"),
    )


def rle_decode(tiles: DataFrame, keep: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Run-length text -> pixels, line by line without a shuffle.

    Every good token becomes its symbols; a symbol's place in the line is its x.
    :func:`rle_rejected` has the other tokens.
    """
    def symbols(tok: Column) -> Column:
        rest = F.ltrim(tok, F.lit("0123456789"))  # patterns are only searched where a key holds a line separator
        n = F.substring(tok, F.lit(1), F.length(tok) - F.length(rest))
        odd = F.regexp_extract(tok, r"^(?:[0-9]+:(.+)|[0-9]*([^0-9]))$", 1)
        odd = F.when(odd != "", odd).otherwise(F.regexp_extract(tok, r"^[0-9]*([^0-9])$", 1))
        sym = F.when(F.length(rest) <= 1, rest).when(rest.rlike(r"[\u0085\u2028\u2029]"), odd).when(
            (F.substring(rest, 1, 1) == ":") & (n != ""), F.substring(rest, F.lit(2), F.length(rest))).otherwise("")
        times = F.when(n == "", 1).otherwise(n.try_cast("int"))
        return F.when((times > 0) & (sym != ""), F.array_repeat(sym, times)).otherwise(F.array().cast("array<string>"))

    rows = tiles.select(*keep, F.posexplode(F.split("rle", "\n")).alias("y", "_row")).where(F.trim("_row") != "")
    return rows.select(*keep, "y", F.posexplode(F.flatten(F.transform(F.split(F.trim("_row"), "\\s+"), symbols))).alias("x", "sym"))


def rle_rejected(tiles: DataFrame, keep: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Tokens ``(*keep, y, i, tok)`` that decode to nothing: malformed, or of a count that is zero or too large."""
    return rle_runs(tiles, keep).where("NOT ok OR n IS NULL OR n <= 0").select(*keep, "y", "i", "tok")


def pixels_to_rle(pixels: DataFrame, by: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Long-form encoder: pieces of a line are gathered, then its runs become ordered text."""
    def token(sym: Column, n: Column) -> Column:
        single = F.length(sym) == 1
        return F.when(single & (n == 1), sym).when(single, F.concat(n.cast("string"), sym)).otherwise(
            F.concat(n.cast("string"), F.lit(":"), sym))

    def general(cells: Column) -> Column:
        n = F.size(cells)
        same = lambda i: F.get(cells, i)["sym"] == F.get(cells, i - 1)["sym"]
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.coalesce(same(i), F.lit(False)))
        run = lambda a: F.transform(a, lambda s, k: token(F.get(cells, s)["sym"], F.coalesce(F.get(a, k + 1), n) - s))
        return F.transform(F.array(first), run)[0]

    piece = F.col("_s")[0]
    plain = F.transform(F.regexp_extract_all(piece["text"], F.lit(r"(?s)((.)\2*)"), F.lit(1)), lambda r: token(F.substring(r, 1, 1), F.length(r)))
    some = F.transform(F.array(_cells()), general)[0]
    one = (F.size("_s") == 1) & (F.length(piece["text"]) == piece["n"])
    rows = _lines(pixels, by).select(*by, "y", F.array_join(F.when(one, plain).otherwise(some), " ").alias("_row"))
    return _stacked(rows, by, "rle")


def expand_symmetry(pixels: DataFrame) -> DataFrame:
    """Mirror the authored part of a grid; needs ``w, h, symmetry`` beside each pixel.

    ``w, h`` are the full size.  An odd dimension along a mirrored axis yields
    no rows here; the rule audit reports it.
    """
    mx = F.col("symmetry").isin("horizontal", "quad")
    my = F.col("symmetry").isin("vertical", "quad")
    ok = (~mx | (F.col("w") % 2 == 0)) & (~my | (F.col("h") % 2 == 0))
    xs = F.when(mx, F.array(F.col("x"), F.col("w") - 1 - F.col("x"))).otherwise(F.array("x"))
    ys = F.when(my, F.array(F.col("y"), F.col("h") - 1 - F.col("y"))).otherwise(F.array("y"))
    rest = [c for c in pixels.columns if c not in ("x", "y")]
    wide = pixels.where(ok).select(*rest, F.explode(xs).alias("x"), ys.alias("_ys"))
    return wide.select(*rest, "x", F.explode("_ys").alias("y"))


def rotate(pixels: DataFrame, k: int) -> DataFrame:
    """Clockwise quarter turns in long form; needs ``w, h`` beside each pixel."""
    k %= 4
    x, y, w, h = (F.col(c) for c in "xywh")
    nx, ny = {0: (x, y), 1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[k]
    nw, nh = (w, h) if k % 2 == 0 else (h, w)
    return pixels.withColumns({"x": nx, "y": ny, "w": nw, "h": nh})


def flip(pixels: DataFrame, axis: str) -> DataFrame:
    if axis == "h":
        return pixels.withColumn("x", F.col("w") - 1 - F.col("x"))
    return pixels.withColumn("y", F.col("h") - 1 - F.col("y"))


def augment4(tiles: DataFrame, limit: int = 4) -> DataFrame:
    """Each tile with its quarter turns; ``rotation`` is '' / 90 / 180 / 270."""
    turns = [
        F.struct(F.lit("" if k == 0 else str(90 * k)).alias("rotation"),
                 grid_text(rotate_rows(F.col("_rows"), k)).alias("grid"))
        for k in range(limit)
    ]
    rest = [c for c in tiles.columns if c != "grid"]
    return tiles.withColumn("_rows", rows_of(F.col("grid"))).select(*rest, F.explode(F.array(*turns)).alias("_t")).select(*rest, "_t.*")


#: Suffix, clockwise turns, flipped first?
VARIANTS = {
    "4way": [("_90", 1, False), ("_180", 2, False), ("_270", 3, False)],
    "flip": [("_flip", 0, True)],
    "8way": [("_90", 1, False), ("_180", 2, False), ("_270", 3, False), ("_flip", 0, True),
             ("_90f", 1, True), ("_180f", 2, True), ("_270f", 3, True)],
}


def _turn_edges(n: Column, e: Column, s: Column, w: Column, k: int, flipped: bool):
    if flipped:
        e, w = w, e
    for _ in range(k):
        n, e, s, w = w, n, e, s
    return n, e, s, w


def expand_variants(tiles: DataFrame) -> DataFrame:
    """Tiles plus their auto-rotate pool, with edge classes and weights turned.

    Input: ``name, auto_rotate, auto_rotate_weight, weight, n, e, s, w`` and, when
    present, ``grid``.  The original keeps its weight; a variant gets an equal
    share under ``equal`` and 0.1 otherwise.
    """
    has_grid = "grid" in tiles.columns
    if has_grid:
        tiles = tiles.withColumn("_rows", rows_of(F.col("grid")))
    rows = F.col("_rows")

    def variant(suffix: str, k: int, flipped: bool, share: int) -> Column:
        n, e, s, w = _turn_edges(*(F.col(c) for c in "nesw"), k, flipped)
        weight = F.col("weight").cast("double") if not suffix else F.when(
            F.col("auto_rotate_weight") == "equal", F.col("weight") / F.lit(float(share + 1))
        ).otherwise(F.lit(0.1))
        fields = [F.concat("name", F.lit(suffix)).alias("name"), n.alias("n"), e.alias("e"),
                  s.alias("s"), w.alias("w"), weight.alias("weight"),
                  F.lit(suffix != "").alias("is_variant")]
        if has_grid:
            r = rotate_rows(flip_rows(rows, "h") if flipped else rows, k)
            fields.append(grid_text(r).alias("grid"))
        return F.struct(*fields)

    pools = None
    for mode, members in VARIANTS.items():
        pool = F.array(*[variant(sfx, k, f, len(members)) for sfx, k, f in [("", 0, False)] + members])
        cond = F.col("auto_rotate") == mode
        pools = F.when(cond, pool) if pools is None else pools.when(cond, pool)
    alone = F.array(F.struct(
        F.col("name").alias("name"), *[F.col(c).alias(c) for c in "nesw"],
        F.col("weight").cast("double").alias("weight"), F.lit(False).alias("is_variant"),
        *([grid_text(rows).alias("grid")] if has_grid else [])))
    taken = {"name", "n", "e", "s", "w", "weight", "grid", "_rows", "auto_rotate", "auto_rotate_weight"}
    rest = [c for c in tiles.columns if c not in taken]
    return tiles.select(*rest, F.explode(pools.otherwise(alone)).alias("_v")).select(*rest, "_v.*")


SUFFIX = r"^(.*?)(_flip|_(?:90|180|270)f?)$"


def suffix_parts(name: Column) -> tuple[Column, Column, Column]:
    """``name_180f`` -> (base, clockwise turns, flipped)."""
    base, sfx = F.regexp_extract(name, SUFFIX, 1), F.regexp_extract(name, SUFFIX, 2)
    turns = F.when(sfx.startswith("_90"), 1).when(sfx.startswith("_180"), 2).when(
        sfx.startswith("_270"), 3).otherwise(0)
    return F.when(sfx == "", name).otherwise(base), turns, sfx.endswith("f") | (sfx == "_flip")


def resolve_suffix(cells: DataFrame, tiles: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Map cells to base tiles; an exact tile name wins over a parsed suffix.

    ``cells(tile, ...)`` gains ``base, turns, flipped``; unknown names get null base.
    """
    names = tiles.select(*on, F.col("name").alias("_name")).distinct()
    base, turns, flipped = suffix_parts(F.col("tile"))
    c = cells.withColumns({"_b": base, "_k": turns, "_f": flipped})
    exact = names.withColumnRenamed("_name", "tile").withColumn("_hit", F.lit(True))
    c = c.join(exact, [*on, "tile"], "left")
    c = c.join(names.withColumnRenamed("_name", "_b").withColumn("_base_hit", F.lit(True)), [*on, "_b"], "left")
    rest = [x for x in cells.columns]
    return c.select(
        *rest,
        F.when(F.col("_hit"), F.col("tile")).when(F.col("_base_hit"), F.col("_b")).alias("base"),
        F.when(F.col("_hit"), 0).when(F.col("_base_hit"), F.col("_k")).alias("turns"),
        F.when(F.col("_hit"), False).when(F.col("_base_hit"), F.col("_f")).alias("flipped"),
    )


def resolve_templates(tiles: DataFrame) -> DataFrame:
    """A tile with a template takes its grid and, if absent, its size; palette stays."""
    base = tiles.where("template IS NULL").select(
        "tileset_id", F.col("name").alias("template"), F.col("grid").alias("_g"), F.col("size").alias("_s"))
    out = tiles.join(base, ["tileset_id", "template"], "left")
    use = F.col("template").isNotNull()
    return out.withColumns({
        "grid": F.when(use, F.col("_g")).otherwise(F.col("grid")),
        "size": F.when(use, F.coalesce("size", "_s")).otherwise(F.col("size")),
    }).drop("_g", "_s")


def compose(layouts: DataFrame, stamps: DataFrame) -> DataFrame:
    """Blit rows of ``@stamp`` / ``_`` tokens left to right into pixels.

    ``layouts(layout_id, layout)``, ``stamps(name, w, h, grid)``.  A row is as
    high as its first stamp; ``_`` is a void square of that height.  Where
    blits overlap the later token wins.  Offsets are running sums inside one layout.
    """
    rows = layouts.select("layout_id", F.posexplode(F.split("layout", "\n")).alias("r", "_row")).where(
        F.trim("_row") != "")
    tok = rows.select("layout_id", "r", F.posexplode(F.split(F.trim("_row"), "\\s+")).alias("c", "tok"))
    tok = tok.withColumn("name", F.when(F.col("tok").startswith("@"), F.expr("substring(tok, 2)")))
    t = tok.join(stamps.select("name", "w", "h", "grid"), "name", "left")
    t = t.withColumn("row_h", F.min_by("h", F.when(F.col("h").isNotNull(), F.col("c"))).over(W.partitionBy("layout_id", "r")))
    t = t.withColumn("tw", F.coalesce("w", "row_h"))
    before = W.partitionBy("layout_id", "r").orderBy("c").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("x0", F.coalesce(F.sum("tw").over(before), F.lit(0)))
    above = W.partitionBy("layout_id").orderBy("r").rangeBetween(W.unboundedPreceding, -1)
    t = t.withColumn("y0", F.coalesce(F.sum(F.when(F.col("c") == 0, F.col("row_h"))).over(above), F.lit(0)))
    void = F.transform(F.expr("sequence(1, row_h)"), lambda _: F.expr("repeat('.', row_h)"))
    t = t.withColumn("_rows", F.when(F.col("name").isNull(), void).otherwise(rows_of(F.col("grid"))))
    p = t.where("row_h IS NOT NULL AND _rows IS NOT NULL").select(
        "layout_id", "r", "c", "x0", "y0", F.posexplode("_rows").alias("dy", "_line"))
    p = p.select("layout_id", "r", "c", "x0", (F.col("y0") + F.col("dy")).alias("y"),
                 F.posexplode(cells_of(F.col("_line"))).alias("dx", "sym"))
    return p.groupBy("layout_id", (F.col("x0") + F.col("dx")).alias("x"), "y").agg(
        F.max_by("sym", F.struct("r", "c")).alias("sym"))
