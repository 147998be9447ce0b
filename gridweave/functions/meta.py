"""Labels and descriptions from tile metadata records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _positive(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) > 0


def _first_sentence() -> Column:
    return F.trim(F.split_part(F.trim(_text("description")), F.lit("."), F.lit(1)))


def _footprint() -> tuple[Column, Column]:
    return F.coalesce("req_w", F.lit(1)), F.coalesce("req_h", F.lit(1))


def meta_label() -> Column:
    """``category:…, title:…, footprint:WxH, tags:…, props:…, desc:…``; absent parts drop out."""
    w, h = _footprint()
    cat = F.replace(F.lower(_text("category")), F.lit(" "), F.lit("_"))
    title = F.lower(F.trim(_text("title")))
    tags = F.array_join(F.transform(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 5), F.lower), " ")
    props = F.concat_ws(
        " ", F.when(_positive("pollutionLevel"), "polluting"), F.when(_positive("happiness"), "happy"),
        F.when(_positive("inhabitants"), F.concat(F.lit("pop:"), F.col("inhabitants").cast("string"))),
        F.when(_positive("fireHazardLevel"), "fire_risk"), F.when(_positive("power"), "powered"),
        F.when(F.coalesce("placeOnWater", F.lit(False)), "aquatic"))
    s = _first_sentence()
    short = F.when(F.length(s) > 60, F.concat(F.substring(s, 1, 57), F.lit("..."))).otherwise(s)
    some = lambda key, v, has=None: F.when((v if has is None else has) != "", F.concat(F.lit(f"{key}:"), v))
    return F.concat_ws(
        ", ", some("category", cat), some("title", title), F.concat(F.lit("footprint:"), w.cast("string"), F.lit("x"), h.cast("string")),
        F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.concat(F.lit("tags:"), tags)),
        some("props", props), some("desc", F.lower(short), F.trim(_text("description"))))


def meta_description() -> Column:
    """Prose form: a sentence, the first sentence of the text if short, and a tag suffix."""
    w, h = _footprint()
    size = F.when((w > 1) | (h > 1), F.concat(w.cast("string"), F.lit("x"), h.cast("string"), F.lit(" "))).otherwise("")
    head = F.concat(F.lit("a "), size, F.lit("isometric "), F.lower(F.coalesce("category", F.lit("building"))), F.lit(" tile: "),
                    F.lower(F.coalesce("title", "id")))
    s = F.trim(F.split_part(_text("description"), F.lit("."), F.lit(1)))
    tags = F.concat_ws(
        ", ", F.when(_positive("pollutionLevel"), "polluting"), F.when(_positive("happiness"), "makes people happy"),
        F.when(_positive("fireHazardLevel"), "fire hazard"), F.when(F.coalesce("placeOnWater", F.lit(False)), "water building"),
        F.when(_positive("powerProduction"), "power plant"))
    return F.concat_ws(". ", head, F.when((s != "") & (F.length(s) < 150), s), F.when(tags != "", F.concat(F.lit("("), tags, F.lit(")"))))
