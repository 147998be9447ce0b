"""Training-set assembly: chat rows, splits, stratified caps, archives, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridweave.functions.grids import VOID
from gridweave.operators.ranking import draw, exact_rank, top_k

SYSTEM = "You draw symbol-grid tiles. Use only palette symbols, keep the given size, reply with the grid alone."
SPLITS = ("train", "valid", "test")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_chat(df: DataFrame, user: Column, assistant: Column, system: str = SYSTEM) -> DataFrame:
    return df.withColumn("messages", F.array(
        message("system", F.lit(system)), message("user", user), message("assistant", assistant)))


def to_completion(user: Column, grid: Column) -> Column:
    return F.concat(F.lit("Generate a tile grid:\n"), user, F.lit("\n\nGrid:\n"), grid)


def palette_prompt(palette: DataFrame, by: list[str], style: str = "inline") -> DataFrame:
    """One prompt text per palette; a palette is bounded by its symbol pool."""
    rgb = F.concat(F.lit("("), F.concat_ws(",", "r", "g", "b"), F.lit(")"))
    if style == "inline":
        p = palette.where(F.col("sym") != VOID)
        item, glue = F.concat(F.lit("'"), F.col("sym"), F.lit("'="), rgb), " "
    else:
        p = palette
        item = F.when(F.col("sym") == VOID, "  '.' = transparent").otherwise(
            F.concat(F.lit("  '"), F.col("sym"), F.lit("' = "), rgb))
        glue = "\n"
    return p.groupBy(*by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", item.alias("t")))), lambda c: c["t"]), glue).alias("palette_text"))


def corpus_pairs(corpus: DataFrame) -> DataFrame:
    """``corpus(w, h, affordance, tags ARRAY, grid)`` -> description and grid."""
    desc = F.concat(
        F.col("w").cast("string"), F.lit("x"), F.col("h").cast("string"), F.lit(" pixel art tile"),
        F.when(F.col("affordance").isNotNull(), F.concat(F.lit(" ("), F.col("affordance"), F.lit(" type)"))).otherwise(""),
        F.when(F.size("tags") > 0, F.concat(F.lit(" tagged: "), F.array_join("tags", ", "))).otherwise(""))
    return corpus.withColumn("description", F.concat(F.lit("a "), desc))


def split(df: DataFrame, id_cols: list[str], ratios=(0.9, 0.05), seed: int = 42, mode: str = "hash",
          group: list[str] | None = None) -> DataFrame:
    """Adds ``split``.

    ``hash`` places each row (or each ``group``, keeping its rows together) by
    a digest threshold and never shuffles.  ``exact`` ranks all digests, so
    the parts have exactly ``int(n * ratio)`` rows.
    """
    ids = [F.col(c) for c in (group or id_cols)]
    key = draw(seed, *ids)
    a, b = ratios[0], ratios[0] + ratios[1]
    if mode == "hash":
        u = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
        return df.withColumn("split", F.when(u < a, "train").when(u < b, "valid").otherwise("test"))
    r = exact_rank(df, key, id_cols, "_rank")
    cutoff = lambda x: F.floor(F.col("n") * F.lit(x))
    return r.withColumn("split", F.when(F.col("_rank") <= cutoff(a), "train").when(
        F.col("_rank") <= cutoff(b), "valid").otherwise("test")).drop("_rank", "n")


def feature_bins(df: DataFrame, bins: int = 5) -> DataFrame:
    b = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    return df.withColumns({"d_bin": b("density"), "e_bin": b("edge_complexity")})


def stratify(df: DataFrame, cap: int, id_cols: list[str], bins: int = 5, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per density x detail bin, drawn by digest order."""
    d = feature_bins(df, bins).withColumn("_draw", draw(seed, *[F.col(c) for c in id_cols]))
    return top_k(d, ["d_bin", "e_bin"], [F.col("_draw"), *[F.col(c) for c in id_cols]], cap, "bin_rank").drop("_draw")


def coverage(df: DataFrame, bins: int = 5) -> DataFrame:
    """All bins with their counts, and how many are filled."""
    spark = df.sparkSession
    frame = spark.range(bins).select(F.col("id").cast("int").alias("d_bin"), F.explode(
        F.sequence(F.lit(0), F.lit(bins - 1))).alias("e_bin"))
    counts = feature_bins(df, bins).groupBy("d_bin", "e_bin").agg(F.count("*").alias("n"))
    full = frame.join(counts, ["d_bin", "e_bin"], "left").na.fill(0, ["n"])
    filled = F.sum((F.col("n") > 0).cast("int")).over(W.partitionBy(F.lit(0)))  # bins**2 rows
    return full.withColumn("filled", filled)


def shuffle_order(df: DataFrame, id_cols: list[str], seed: int = 42) -> DataFrame:
    """Deterministic shuffle: a distributed range sort by digest."""
    return df.orderBy(draw(seed, *[F.col(c) for c in id_cols]), *id_cols)


def elite_bins(df: DataFrame) -> DataFrame:
    """Archive cell: 20 bins of wall ratio over .05-.95, 10 of rooms over .5-10.5."""
    def cell(value: Column, low: float, high: float, n: int) -> Column:
        raw = F.floor((value.cast("double") - low) / (high - low) * n)
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), raw)).cast("int")

    return df.withColumns({
        "wall_bin": cell(F.col("wall_ratio"), 0.05, 0.95, 20), "room_bin": cell(F.col("room_count"), 0.5, 10.5, 10)})


CELL = ["theme", "wall_bin", "room_bin"]


def elites(maps: DataFrame, id_col: str = "map_id") -> DataFrame:
    """Best-quality map per archive cell; the lowest id wins a tie.

    ``max_by`` combines map-side, so a hot theme costs one row per task.
    """
    m = elite_bins(maps)
    row = F.struct(*[F.col(c) for c in m.columns if c not in CELL])
    best = m.groupBy(*CELL).agg(F.max_by(row, F.struct(F.col("quality"), -F.col(id_col))).alias("_e"))
    return best.select(*CELL, "_e.*")


def merge_elites(old: DataFrame, new: DataFrame, id_col: str = "map_id") -> DataFrame:
    """A newcomer replaces a cell's elite only when strictly better."""
    both = old.withColumn("_old", F.lit(1)).unionByName(elites(new, id_col).withColumn("_old", F.lit(0)))
    row = F.struct(*[F.col(c) for c in both.columns if c not in (*CELL, "_old")])
    best = both.groupBy(*CELL).agg(F.max_by(row, F.struct(F.col("quality"), F.col("_old"), -F.col(id_col))).alias("_e"))
    return best.select(*CELL, "_e.*")


def archive_stats(elite: DataFrame, evaluated: DataFrame, cells: int = 200) -> DataFrame:
    """Per theme: filled cells, coverage and failed evaluations."""
    e = elite.groupBy("theme").agg(F.count("*").alias("elite_count"), F.max("quality").alias("best_quality"))
    f = evaluated.groupBy("theme").agg(F.count(F.when(F.col("quality") == 0, 1)).alias("failures"))
    return f.join(e, "theme", "left").select(
        "theme", F.coalesce("elite_count", F.lit(0)).alias("elite_count"),
        (F.coalesce("elite_count", F.lit(0)) / cells).alias("coverage"), "failures", "best_quality")


def map_text(cells: DataFrame, by: list[str] = ["map_id"]) -> DataFrame:
    """Tile names joined by spaces and newlines; rows are built before maps."""
    rows = cells.groupBy(*by, "y").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("x", "tile"))), lambda c: c["tile"]), " ").alias("_row"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("y", "_row"))), lambda c: c["_row"]), "\n").alias("grid_text"))


def dataset_stats(df: DataFrame, text: str = "grid") -> DataFrame:
    """Mean characters and tokens, and the rough token estimate of the whole set."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda t: t != ""))
    return df.agg(F.count("*").alias("n"), F.avg(F.length(text)).alias("avg_chars"),
                  F.avg(words).alias("avg_tokens")).withColumn(
        "token_estimate", F.floor(F.col("avg_chars") * F.col("n") / 4))


def parse_replies(replies: DataFrame, valid: DataFrame, w: int, h: int) -> DataFrame:
    """Reply text -> exactly ``w * h`` cells per reply; unknown or absent tokens are null.

    Lines beyond ``h`` and tokens beyond ``w`` are outside the requested grid.
    """
    lines = F.filter(F.transform(F.split(F.trim("text"), "\n"), lambda t: F.trim(t)), lambda t: t != "")
    frame = replies.select("reply_id", lines.alias("_lines"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y"))
    toks = F.split(F.get("_lines", F.col("y")), r"\s+")
    cells = frame.select("reply_id", "y", toks.alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"))
    cells = cells.select("reply_id", "x", "y", F.get("_t", F.col("x")).alias("token"))
    names = valid.select(F.explode(F.array(*[F.concat("tile", F.lit(s)) for s in ("", "_90", "_180", "_270")])).alias("token")).distinct()
    return cells.join(names.withColumn("_ok", F.lit(True)), "token", "left").select(
        "reply_id", "x", "y", F.when(F.col("_ok"), F.col("token")).alias("tile"))


def valid_ratio(cells: DataFrame) -> DataFrame:
    return cells.groupBy("reply_id").agg(F.avg(F.col("tile").isNotNull().cast("int")).alias("valid_ratio"))


def reply_pins(cells: DataFrame, half: bool = False) -> DataFrame:
    """Valid cells as pins; ``half`` keeps every other one in scan order."""
    pins = cells.where("tile IS NOT NULL")
    if not half:
        return pins
    # A reply holds at most the w*h cells that parse_replies emits.
    w = W.partitionBy("reply_id").orderBy("y", "x")
    return pins.withColumn("_i", F.row_number().over(w)).where("_i % 2 = 1").drop("_i")


def extract_grid(df: DataFrame, text: str, w: int, fence: str = "```") -> DataFrame:
    """Grid of a reply: the first fenced block, else the first run of lines of ``w`` symbols.

    The fallback marks every line as fitting (1) or not (0); the first run of
    ones in that mark string gives the position and length of the block.
    """
    body = F.regexp_extract(F.col(text), rf"(?s){fence}[^\n]*\n(.*?){fence}", 1)
    blank = F.lit(" \t\r\n")
    lines = F.transform(F.split(F.col(text), "\n"), lambda t: F.btrim(t, blank))
    d = df.withColumns({"_body": F.btrim(body, blank), "_lines": lines})
    marks = F.array_join(F.transform("_lines", lambda t: F.when(
        (F.length(t) == w) & ~t.rlike(r"\s"), "1").otherwise("0")), "")
    d = d.withColumn("_marks", marks).withColumn("_run", F.regexp_extract("_marks", "(1+)", 1))
    block = F.array_join(F.slice("_lines", F.instr("_marks", "1"), F.length("_run")), "\n")
    return d.withColumn("extracted", F.when(F.col("_body") != "", F.col("_body")).when(
        F.col("_run") != "", block)).drop("_body", "_lines", "_marks", "_run")
