"""Image to tile: palettes, quantisation, dithering, resampling, slicing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridweave.functions.color import delta_e, with_oklab
from gridweave.functions.grids import VOID
from gridweave.operators.lookup import lookup
from gridweave.session import cut

# Fixed values.
SYMBOL_POOL = ".#+=~gorhwsABCDE"
IMPORT_SYMBOLS = ".#+-~bBwWghsmrcd"
BAYER = [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]
PRESETS = [("small", 128, 16), ("medium", 160, 32), ("large", 256, 48)]
OPAQUE = 128


def bucket(c: str) -> Column:
    return (F.floor(F.col(c) / 16) * 16).cast("int")


def drop_sparse(px: DataFrame, min_frac: float, by: list[str], filled: Column | None = None) -> DataFrame:
    """Keep images whose opaque (or quantised non-void) share reaches ``min_frac``."""
    filled = (F.col("a") >= OPAQUE) if filled is None else filled
    share = px.groupBy(*by).agg((F.count(F.when(filled, 1)) / F.count("*")).alias("_share"))
    return px.join(share.where(F.col("_share") >= min_frac).select(*by), by, "left_semi")


def extract_palette(px: DataFrame, by: list[str], n: int = 10, min_entries: int = 1) -> DataFrame:
    """Top ``n`` bucketed colours per group, re-ordered by brightness, with symbols.

    Counting combines map-side; after it a group has at most 4096 buckets, so
    the two ranking windows are bounded.  Ties go to the lower colour.
    """
    counts = px.where(F.col("a") >= OPAQUE).groupBy(
        *by, bucket("r").alias("r"), bucket("g").alias("g"), bucket("b").alias("b")).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    top = counts.withColumn("_k", F.row_number().over(w.orderBy(F.desc("n"), "r", "g", "b"))).where(F.col("_k") <= n)
    pal = top.withColumn("pos", F.row_number().over(w.orderBy(F.expr("r + g + b"), "r", "g", "b"))).where(
        F.col("pos") < len(SYMBOL_POOL))
    pal = pal.withColumn("sym", F.substring(F.lit(SYMBOL_POOL), F.col("pos") + 1, F.lit(1)))
    if min_entries > 1:
        size = F.count("*").over(w)
        pal = pal.withColumn("_n", size + 1).where(F.col("_n") >= min_entries).drop("_n")
    return pal.select(*by, "pos", "sym", "r", "g", "b", F.lit(255).alias("a"), "n")


def _distance(metric: str, p) -> Column:
    """Squared distance, integral for the RGB metrics."""
    if metric == "oklab":
        return delta_e(F.col("ok_l"), F.col("ok_a"), F.col("ok_b"), p["ok_l"], p["ok_a"], p["ok_b"])
    ch = {c: (bucket(c) if metric == "bucket" else F.col(c)) for c in "rgb"}
    terms = [(ch[c] - p[c]) * (ch[c] - p[c]) * w for c, w in zip("rgb", WEIGHTS[metric])]
    return (terms[0] + terms[1] + terms[2]).cast("double")


def scale_distance(metric: str, d: Column) -> Column:
    return {"w309": F.sqrt(d / 100.0), "bucket": F.sqrt(d), "i243": F.sqrt(d), "oklab": d}[metric]


#: Distinct colours up to which they are sent to every executor (some 60 bytes each).
COLOURS = 500_000
#: Channel values of a cube cell: 256 / CELL cells a channel.
CELL = 16
WEIGHTS = {"w309": (30, 59, 11), "bucket": (1, 1, 1), "i243": (2, 4, 3)}


def _palettes(palette: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """A palette is at most a symbol pool long, so it travels as one array per group."""
    entries = F.array_sort(F.collect_list(F.struct("pos", "sym", *cols))).alias("_pal")
    return palette.groupBy(*by).agg(entries) if by else palette.agg(entries)


def colour_cube(colours: DataFrame, palette: DataFrame, by: list[str], metric: str) -> DataFrame:
    """``(*by, r, g, b, d, sym)``: nearest entry of every distinct colour ``colours(*by, r, g, b)``.

    Colours fall into cells of a cube.  A cell keeps the entries that can be
    nearest to some colour in it: those whose least distance to the cell is no
    more than the smallest of all entries' largest distances.  A group has 4096
    cells at most, and a colour is only compared with what its cell keeps.
    """
    seen = {c: (bucket(c) if metric == "bucket" else F.col(c)) for c in "rgb"}
    cell = {f"_{c}": F.floor(e / CELL).cast("int") for c, e in seen.items()}
    placed = colours.withColumns(cell)
    cells = placed.select(*by, *cell).distinct()
    arr = _palettes(palette, by, ["r", "g", "b"])
    j = cells.join(arr, by) if by else cells.join(F.broadcast(arr))  # one-row side

    def bound(p: Column, far: bool) -> Column:
        total = F.lit(0)
        for c, w in zip("rgb", WEIGHTS[metric], strict=True):
            low, high = F.col(f"_{c}") * CELL - p[c], p[c] - (F.col(f"_{c}") * CELL + CELL - 1)
            gap = F.greatest(F.abs(low), F.abs(high)) if far else F.greatest(low, high, F.lit(0))
            total = total + gap * gap * w
        return total

    least = F.array_min(F.transform("_pal", lambda p: bound(p, True)))
    # The bound is a lambda's argument, so it is computed once a cell and not once an entry.
    some = F.transform(F.array(least), lambda m: F.filter("_pal", lambda p: bound(p, False) <= m))[0]
    kept = j.select(*by, *cell, some.alias("_pal"))
    best = F.array_min(F.transform("_pal", lambda p: F.struct(_distance(metric, p).alias("d"), p["pos"].alias("pos"), p["sym"].alias("sym"))))
    return placed.join(kept, [*by, *cell]).withColumn("_best", best).select(*by, "r", "g", "b", F.col("_best.d").alias("d"), F.col("_best.sym").alias("sym"))


def quantize(px: DataFrame, palette: DataFrame, by: list[str], metric: str = "w309", include_void: bool | None = None,
             cube: bool = True) -> DataFrame:
    """Nearest palette symbol per pixel; the first entry wins a tie.

    The RGB metrics take each distinct colour of a group through ``colour_cube``
    once and look pixels up by colour; without ``cube`` (for small groups, as one
    image each) every pixel meets its group's palette.  ``oklab`` follows the
    import rule: void is a candidate and alpha is ignored.
    """
    if include_void is None:
        include_void = metric == "oklab"
    pal = palette if include_void else palette.where(F.col("sym") != VOID)
    hit = F.lit(True) if include_void else F.col("a") >= OPAQUE
    if metric == "oklab" or not cube:
        cols = ["ok_l", "ok_a", "ok_b"] if metric == "oklab" else ["r", "g", "b"]
        arr, px = (_palettes(with_oklab(pal), by, cols), with_oklab(px)) if metric == "oklab" else (_palettes(pal, by, cols), px)
        j = px.join(arr, by, "left") if by else px.join(F.broadcast(arr))  # one-row side
        best = F.array_min(F.transform("_pal", lambda p: F.struct(_distance(metric, p).alias("d"), p["pos"].alias("pos"), p["sym"].alias("sym"))))
        j = j.withColumn("_best", best).withColumns({"_sym": F.col("_best.sym"), "_d": F.col("_best.d")}).drop("_pal", "_best")
        j = j.drop(*[c for c in j.columns if c.startswith("ok_")])
    else:
        key = [*by, "r", "g", "b"]
        near = cut(colour_cube(cut(px.where(hit).select(*key).distinct()), pal, by, metric))
        j = lookup(px, near.select(*key, F.col("sym").alias("_sym"), F.col("d").alias("_d")), key, most=COLOURS)
    found = hit & F.col("_sym").isNotNull()
    return j.withColumns({
        "sym": F.when(found, F.col("_sym")).otherwise(VOID),
        "dist": F.when(found, scale_distance(metric, F.col("_d"))).otherwise(0.0)}).drop("_sym", "_d")


def quant_quality(q: DataFrame, by: list[str], scale: float = 255.0, clip: float = 50.0) -> DataFrame:
    """Accuracy and clipped count; void adds nothing but counts in the denominator.

    ``scale`` and ``clip`` fit RGB distances; OKLab distances are of order one, so
    pass 1.0 and a small clip there (the defaults reproduce the legacy figure).
    """
    return q.groupBy(*by).agg(
        (1.0 - F.least(F.lit(1.0), F.sum("dist") / F.count("*") / scale)).alias("accuracy"),
        F.count(F.when(F.col("dist") > clip, 1)).alias("clipped"))


def dither(px: DataFrame) -> DataFrame:
    """Ordered 4x4 offset of the channels before a nearest-colour step."""
    cell = F.element_at(F.array(*[F.lit(b) for b in BAYER]), ((F.col("y") % 4) * 4 + F.col("x") % 4 + 1).cast("int"))
    shift = cell * 2 - 16  # (cell / 16 - 0.5) * 32
    return px.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(c) + shift)).cast("int") for c in "rgb"})


def kernel_table(sizes: DataFrame, kernel: str) -> DataFrame:
    """``(src_n, dst_n, dst, src, weight)`` for each distinct size pair; weights sum to one."""
    s = sizes.select("src_n", "dst_n").distinct().withColumn("ratio", F.col("src_n") / F.col("dst_n"))
    s = s.withColumn("dst", F.explode(F.expr("sequence(0, dst_n - 1)")))
    scale = F.greatest(F.col("ratio"), F.lit(1.0))
    if kernel == "box":
        lo, hi = F.floor(F.col("dst") * F.col("ratio")), F.ceil((F.col("dst") + 1) * F.col("ratio")) - 1
    else:
        center = (F.col("dst") + 0.5) * F.col("ratio")
        lo, hi = F.floor(center - scale * 3), F.ceil(center + scale * 3)
    lo, hi = F.greatest(F.lit(0), lo.cast("int")), F.least(F.col("src_n") - 1, hi.cast("int"))
    s = s.withColumn("src", F.explode(F.sequence(lo, hi)))
    if kernel == "box":
        wt = F.least(F.col("src") + 1, (F.col("dst") + 1) * F.col("ratio")) - F.greatest(F.col("src").cast("double"), F.col("dst") * F.col("ratio"))
    else:
        t = (F.col("src") + 0.5 - (F.col("dst") + 0.5) * F.col("ratio")) / scale
        pt = t * math.pi
        wt = F.when(t == 0, 1.0).when(F.abs(t) < 3, 3 * F.sin(pt) * F.sin(pt / 3) / (pt * pt)).otherwise(0.0)
    s = s.withColumn("_w", F.greatest(wt, F.lit(0.0)) if kernel == "box" else wt)
    total = F.sum("_w").over(W.partitionBy("src_n", "dst_n", "dst"))
    return s.select("src_n", "dst_n", "dst", "src", (F.col("_w") / total).alias("weight"))


def resample(px: DataFrame, by: list[str], w: Column, h: Column, kernel: str = "box") -> DataFrame:
    """Separable resize to ``w x h`` (expressions over ``src_w, src_h``).

    Two weight joins and two sums: the first runs along x, the second along y.
    The weights are one small table per distinct size pair, so pixels stay with
    their image and are not dealt by the few values of size and place.
    """
    dims = px.groupBy(*by).agg((F.max("x") + 1).cast("int").alias("src_w"), (F.max("y") + 1).cast("int").alias("src_h"))
    dims = dims.withColumns({"dst_w": w.cast("int"), "dst_h": h.cast("int")})
    p = px.join(dims, by)
    kx = kernel_table(dims.select(F.col("src_w").alias("src_n"), F.col("dst_w").alias("dst_n")), kernel).select(
        F.col("src_n").alias("src_w"), F.col("dst_n").alias("dst_w"), F.col("src").alias("x"), F.col("dst").alias("dx"), F.col("weight").alias("wx"))
    ky = kernel_table(dims.select(F.col("src_h").alias("src_n"), F.col("dst_h").alias("dst_n")), kernel).select(
        F.col("src_n").alias("src_h"), F.col("dst_n").alias("dst_h"), F.col("src").alias("y"), F.col("dst").alias("dy"), F.col("weight").alias("wy"))
    across = lookup(p, cut(kx), ["src_w", "dst_w", "x"], "inner").groupBy(*by, "src_h", "dst_h", "y", "dx").agg(
        *[F.sum(F.col(c) * F.col("wx")).alias(c) for c in "rgba"])
    down = lookup(across, cut(ky), ["src_h", "dst_h", "y"], "inner").groupBy(*by, F.col("dx").alias("x"), F.col("dy").alias("y")).agg(
        *[F.sum(F.col(c) * F.col("wy")).alias(c) for c in "rgba"])
    # Rounding to nine places first keeps exact halves stable under summation order.
    byte = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(F.col(c), 9))) + 0.5).cast("int")
    return down.select(*by, "x", "y", *[byte(c).alias(c) for c in "rgba"])


def _cut(colors: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Median cut over a weighted colour histogram; rows of r, g, b."""
    order = np.lexsort((colors[:, 2], colors[:, 1], colors[:, 0]))
    boxes = [(colors[order], counts[order])]

    def score(box):
        c, k = box
        return 0 if k.sum() <= 1 else int((c.max(0) - c.min(0)).max()) * int(k.sum())

    scores = [score(boxes[0])]
    while len(boxes) < n:
        top = max(scores)
        pick = len(scores) - 1 - scores[::-1].index(top)  # the last maximum
        c, k = boxes.pop(pick)
        scores.pop(pick)
        if k.sum() <= 1:
            boxes.append((c, k))
            break
        channel = int(np.argmax(c.max(0) - c.min(0)))
        by_channel = np.argsort(c[:, channel], kind="stable")
        c, k = c[by_channel], k[by_channel]
        mid = int(k.sum()) // 2
        left = np.clip(mid - (np.cumsum(k) - k), 0, k)
        for part in (left, k - left):
            boxes.append((c[part > 0], part[part > 0]))
            scores.append(score(boxes[-1]))
    return np.array([(c * k[:, None]).sum(0) // k.sum() for c, k in boxes], dtype=np.int64)


def median_cut(px: DataFrame, by: str, n: int | Column) -> DataFrame:
    """Palette per image.

    Spark first reduces pixels to a colour histogram; one image's histogram
    (never larger than the image, which was decoded as one row) is one row, and
    a batch of such rows is cut in one call.
    """
    budget = n if isinstance(n, Column) else F.lit(n)
    hist = px.where(F.col("a") > 0).groupBy(by, "r", "g", "b").agg(
        F.count("*").alias("n"), F.max(budget).alias("max_colors"))
    whole = hist.groupBy(by).agg(F.max("max_colors").cast("int").alias("_most"), F.collect_list(F.struct("r", "g", "b", "n")).alias("_h"))
    kind = dict(px.dtypes)[by]

    def boxes(parts):
        import pyarrow as pa

        for batch in parts:
            rows, ends = batch.column(2).flatten(), batch.column(2).offsets.to_numpy()
            ends = ends - ends[0]
            channels = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in rows.flatten()]
            colors, counts = np.stack(channels[:3], 1), channels[3]
            got = [_cut(colors[a:b], counts[a:b], m) for a, b, m in zip(ends[:-1], ends[1:], batch.column(1).to_pylist(), strict=True)]
            size = np.array([len(c) for c in got], np.int64)
            flat = np.concatenate(got) if got else np.zeros((0, 3), np.int64)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))), *[pa.array(v.astype(np.int32)) for v in (pos, *flat.T)]],
                names=[by, "pos", "r", "g", "b"])

    return whole.mapInArrow(boxes, f"{by} {kind}, pos int, r int, g int, b int")


def convert(px: DataFrame, presets: list[tuple[str, int, int]] = PRESETS, kernel: str = "lanczos3") -> DataFrame:
    """One output per image and preset: resample, median cut, snap to the palette."""
    opts = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(w).alias("max_w"), F.lit(c).alias("colors")) for n, w, c in presets])
    p = px.withColumn("_p", F.explode(opts)).select(
        F.concat_ws("|", F.col("image_id").cast("string"), "_p.preset").alias("out_id"), "image_id", "_p.*", "x", "y", *"rgba")
    tw = F.least(F.col("max_w"), F.col("src_w"))
    th = F.greatest(F.lit(1), F.round(tw * F.col("src_h") / F.col("src_w")))
    # Pixels and palettes have several readers below, so each is computed once.
    small = cut(resample(p, ["out_id", "image_id", "preset", "max_w", "colors"], tw, th, kernel))
    pal = cut(median_cut(small, "out_id", F.col("colors")).withColumn("sym", F.col("pos").cast("string")))
    q = quantize(small.withColumn("a", F.when(F.col("a") > 0, 255).otherwise(0)), pal, ["out_id"], "i243", cube=False)
    snapped = q.join(pal.select("out_id", "sym", F.col("r").alias("qr"), F.col("g").alias("qg"), F.col("b").alias("qb")), ["out_id", "sym"], "left")
    return snapped.select("image_id", "preset", "x", "y", F.coalesce("qr", F.lit(0)).alias("r"),
                          F.coalesce("qg", F.lit(0)).alias("g"), F.coalesce("qb", F.lit(0)).alias("b"), "a")


def slice_sheet(px: DataFrame, meta: DataFrame) -> DataFrame:
    """Cut ``count`` variants of ``clip_width x clip_height`` from each sheet's top row.

    ``meta(image_id, clip_width, clip_height, count)``; a variant that would
    run past the sheet is dropped.
    """
    widths = px.groupBy("image_id").agg((F.max("x") + 1).alias("sheet_w"))
    m = meta.join(widths, "image_id").withColumn("fit", F.least("count", F.expr("sheet_w div clip_width")))
    j = px.join(m, "image_id").withColumn("variant", F.expr("x div clip_width").cast("int"))
    j = j.where("variant < fit AND y < clip_height")
    return j.select("image_id", "variant", (F.col("x") - F.col("variant") * F.col("clip_width")).alias("x"), "y", *"rgba")


def slice_dedup(px: DataFrame, t: int, by: str = "image_id", value: list[str] = ["r", "g", "b"]) -> tuple[DataFrame, DataFrame]:
    """Cut images to ``t x t`` tiles, dictionary-encode equal content.

    Returns ``tilemap(by, row, col, name, digest)`` and ``unique(by, name, digest, row, col)``.
    Tiles shuffle once as digests; the remainder at the right and bottom is dropped.
    """
    dims = px.groupBy(by).agg(F.expr(f"(max(x) + 1) div {t}").alias("_cols"), F.expr(f"(max(y) + 1) div {t}").alias("_rows"))
    p = px.withColumns({"row": F.expr(f"y div {t}").cast("int"), "col": F.expr(f"x div {t}").cast("int")})
    cell = F.struct(F.col("y"), F.col("x"), F.concat_ws(",", *value).alias("v"))
    tiles = p.groupBy(by, "row", "col").agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(cell)), lambda c: c["v"]), ";"), 256).alias("digest"))
    tiles = tiles.join(dims, by).where("row < _rows AND col < _cols").drop("_rows", "_cols")
    first = tiles.groupBy(by, "digest").agg(F.min(F.struct("row", "col")).alias("_at"))
    rank = F.row_number().over(W.partitionBy(by).orderBy("_at")) - 1  # unique tiles of one image
    unique = first.select(by, "digest", F.format_string("bt_%03d", rank).alias("name"), "_at.row", "_at.col")
    return tiles.join(unique.select(by, "digest", "name"), [by, "digest"]), unique


def assign_symbols(colors: DataFrame, by: list[str]) -> DataFrame:
    """Frequency-ranked symbols: 16 single characters, then digit plus letter."""
    i = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "r", "g", "b")) - 1
    c = colors.withColumn("rank", i)
    rest = F.col("rank") - 16
    ext = F.concat((F.floor(rest / 26) + 2).cast("string"), F.char(F.lit(97) + rest % 26))
    return c.withColumn("sym", F.when(F.col("rank") < 16, F.substring(F.lit(IMPORT_SYMBOLS), F.col("rank") + 1, F.lit(1))).otherwise(ext))
