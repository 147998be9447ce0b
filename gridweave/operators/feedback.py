"""Reviewer feedback: normalisation, statistics and generation constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators import dataset as ds
from gridweave.operators.ranking import top_k
from gridweave.operators.style import MEASURES, style_latent, style_score

ACTIONS = ("accept", "reject", "edit")
#: Reject reason -> instruction.
ADVICE = {
    "too_sparse": "Fill more of the tile.",
    "too_dense": "Leave more of the tile open or varied.",
    "wrong_style": "Stay close to the learned style.",
    "bad_edges": "Keep the border rows and columns solid.",
    "palette_violation": "Use declared palette symbols only.",
    "bad_composition": "Balance and place the elements better.",
}


def normalise(raw: DataFrame) -> DataFrame:
    """Keep known actions; free-text reasons become ``other(text)``."""
    reason = F.col("reason")
    return raw.where(F.col("action").isin(*ACTIONS)).withColumn(
        "reject_reason", F.when(reason.isNull() | reason.isin(*ADVICE), reason).otherwise(
            F.concat(F.lit("other("), reason, F.lit(")")))).drop("reason")


def void_symbol(palette: DataFrame) -> DataFrame:
    """The alpha-0 symbol of each palette, else ``.``."""
    return palette.groupBy("palette").agg(F.coalesce(F.min(F.when(F.col("a") == 0, F.col("sym"))), F.lit(".")).alias("void"))


def fb_record(raw: DataFrame, tiles: DataFrame, palette: DataFrame, ref_latent: DataFrame, ref_on: list[str],
              void: str = ".") -> DataFrame:
    """Normalised events with the tile's grid, latent and score against ``ref_latent``.

    Latents are computed once per distinct tile that events name, before the
    join, so a tile with very many events costs one fingerprint.
    """
    ev = normalise(raw).drop("style_score")
    used = tiles.join(ev.select("tile_id").distinct(), "tile_id", "left_semi")
    lat = style_latent(used, palette, list(dict.fromkeys(["tile_id", *ref_on])), void=void)
    scored = style_score(lat, ref_latent, ref_on).drop(*ref_on)
    keep = [c for c in ("grid", "tags", "target_layer") if c in tiles.columns]
    return ev.join(used.select("tile_id", *keep), "tile_id", "left").join(scored, "tile_id", "left")


def _mean(action: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col("action") == action, F.col("style_score"))), F.lit(0.0))


def stats_columns() -> list[Column]:
    n = lambda a: F.count(F.when(F.col("action") == a, 1))
    total = n("accept") + n("reject") + n("edit")
    return [n("accept").alias("accepts"), n("reject").alias("rejects"), n("edit").alias("edits"),
            F.when(total > 0, (n("accept") + n("edit")) / total).otherwise(0.0).alias("acceptance"),
            _mean("accept").alias("avg_accepted"), _mean("reject").alias("avg_rejected")]


def fb_stats(fb: DataFrame, by: list[str] | None = None) -> DataFrame:
    return fb.groupBy(*(by or [])).agg(*stats_columns())


def fb_top_reasons(fb: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Reject reasons by count; free-text reasons fold into ``other``."""
    key = F.when(F.startswith(F.col("reject_reason"), F.lit("other(")), "other").otherwise(F.col("reject_reason"))
    r = fb.where("action = 'reject' AND reject_reason IS NOT NULL")
    return r.groupBy(*(by or []), key.alias("reason")).agg(F.count("*").alias("n")).orderBy(*(by or []), F.desc("n"), "reason")


def fb_avoid(fb: DataFrame, min_count: int = 2, by: list[str] | None = None) -> DataFrame:
    pairs = [F.lit(x) for kv in ADVICE.items() for x in kv]
    text = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("reason")), F.concat(F.lit("Fix the repeated issue: "), "reason"))
    return fb_top_reasons(fb, by).where(F.col("n") >= min_count).withColumn("instruction", text)


def fb_examples(fb: DataFrame, n: int = 3, by: list[str] | None = None) -> DataFrame:
    """Newest accepted or edited events that have a grid, newest first.

    The ranking runs on narrow rows; join grids to its few results afterwards.
    """
    ok = fb.where("action IN ('accept', 'edit')")
    if "grid" in fb.columns:
        ok = ok.where("grid IS NOT NULL")
    return top_k(ok, by or [], [F.desc("ts"), F.desc("event_id")], n)


def fb_threshold(stats: DataFrame) -> DataFrame:
    """Adaptive pre-display threshold from at least three accepts."""
    return stats.withColumn("threshold", F.when(
        (F.col("accepts") >= 3) & (F.col("avg_accepted") > 0), F.greatest(F.col("avg_accepted") * 0.8, F.lit(0.3))).otherwise(0.0))


def fb_preferred_style(recorded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean latent of accepted and edited events; hue by circular mean."""
    ok = recorded.where("action IN ('accept', 'edit') AND sample_count IS NOT NULL")
    rad = F.radians("hue_bias")
    deg = F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad))))
    return ok.groupBy(*(by or [])).agg(
        *[F.avg(m).alias(m) for m in MEASURES if m != "hue_bias"],
        F.when(deg < 0, deg + 360.0).otherwise(deg).alias("hue_bias"), F.sum("sample_count").alias("sample_count")).where("sample_count IS NOT NULL")


def fb_filter(candidates: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Candidates that reach the threshold of their group (0 where there is none)."""
    t = thresholds.select(*by, F.col("threshold").alias("_t"))
    return candidates.join(t, by, "left").where(F.col("style_score") >= F.coalesce("_t", F.lit(0.0))).drop("_t")


def describe_tile(tags: Column, name: Column) -> Column:
    return F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise(F.replace(name, F.lit("_"), F.lit(" ")))


def fb_export(recorded: DataFrame, palette_text: DataFrame) -> DataFrame:
    """Accepted and edited events with a grid as chat rows.

    ``palette_text`` is one row (or one per ``palette``, when events carry it).
    """
    ok = recorded.where("action IN ('accept', 'edit') AND grid IS NOT NULL")
    on = [c for c in palette_text.columns if c in recorded.columns]
    ok = ok.join(palette_text, on) if on else ok.join(F.broadcast(palette_text))
    size = F.concat(F.length(F.split_part("grid", F.lit("\n"), F.lit(1))).cast("string"), F.lit("x"), F.size(F.split("grid", "\n")).cast("string"))
    user = F.concat("palette_text", F.lit("\n\nGenerate a "), size, F.lit(" pixel art tile: "), describe_tile(F.col("tags"), F.col("tile_name")))
    return ds.to_chat(ok, user, F.col("grid"))


def fb_training_stats(recorded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accepted and edited events are training pairs; where events carry a ``grid``, only those that have one."""
    ok = F.col("action").isin("accept", "edit")
    pair = ok & F.col("grid").isNotNull() if "grid" in recorded.columns else ok
    n = lambda a: F.count(F.when(F.col("action") == a, 1))
    return recorded.groupBy(*(by or [])).agg(
        F.count(F.when(pair, 1)).alias("training_pairs"), F.count("*").alias("total_feedback"),
        F.when(F.count("*") > 0, F.count(F.when(ok, 1)) / F.count("*")).otherwise(0.0).alias("acceptance"),
        n("accept").alias("accepts"), n("reject").alias("rejects"))


def fb_refinements(log: DataFrame) -> DataFrame:
    """Refinement passes per tile."""
    return log.groupBy("tile_id").agg(F.count("*").alias("refinements"))


def project_status(tiles: DataFrame, targets: DataFrame, palette: DataFrame) -> DataFrame:
    """Per project and world: tiles authored, target, latent; ``targets(project, world, target)``."""
    lat = style_latent(tiles, palette, ["project", "world"])
    return targets.join(lat, ["project", "world"], "left").withColumn("authored", F.coalesce("sample_count", F.lit(0)))
