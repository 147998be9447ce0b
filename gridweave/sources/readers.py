"""File sources.  Every reader uses an explicit schema; missing fields become defaults."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = "array<struct<role:string,content:string>>"
ARCHIVE = ("label string, grid array<array<string>>, features struct<wall_ratio:double,walkable_ratio:double,room_count:int,"
           "largest_room:int,border_solidity:double,transition_count:int>, quality double, theme string, width int, height int, seed bigint")
META = ("id string, title string, category string, description string, tags array<string>, RequiredTiles struct<width:int,height:int>, "
        "tiles struct<fileName:string,clip_width:int,clip_height:int,count:int>, pollutionLevel double, happiness double, "
        "inhabitants double, fireHazardLevel double, power double, powerProduction double, placeOnWater boolean")
FEEDBACK = "event_id bigint, tile_name string, tile_id bigint, tileset_id bigint, action string, reject_reason string, style_score double, grid string, tags array<string>, target_layer string, timestamp bigint"
PASSAGE = "struct<content:string,summary:string,concepts:array<string>,keywords:array<string>,hypothetical_questions:array<string>>"
KB = (f"documents array<struct<title:string,chapters:array<struct<sections:array<struct<passages:array<{PASSAGE}>>>>>,"
      f"orphan_passages:array<{PASSAGE}>,knowledge_graph:struct<entities:map<string,struct<relations:array<struct<predicate:string,target:string>>>>>>>")


def read_pairs(spark: SparkSession, glob: str) -> DataFrame:
    """JSON files holding an array of ``[description, grid]``; blank grids drop out."""
    files = spark.read.text(glob, wholetext=True)
    pairs = files.select(F.explode(F.from_json("value", "array<array<string>>")).alias("_p"))
    return pairs.select(F.get("_p", F.lit(0)).alias("description"), F.get("_p", F.lit(1)).alias("grid")).where("trim(grid) <> ''")


def read_archive(spark: SparkSession, glob: str) -> DataFrame:
    """JSON lines of map archives; blank lines are skipped by the source."""
    return spark.read.schema(ARCHIVE).json(glob)


def read_tile_meta(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of tile records, flattened, with the sheet and footprint defaults."""
    m = spark.read.schema(META).option("multiLine", True).json(path)
    return m.select(
        *[c for c in m.columns if c not in ("RequiredTiles", "tiles")], F.col("RequiredTiles.width").alias("req_w"), F.col("RequiredTiles.height").alias("req_h"),
        F.coalesce("tiles.fileName", F.lit("")).alias("file_name"), F.coalesce("tiles.clip_width", F.lit(32)).alias("clip_width"),
        F.coalesce("tiles.clip_height", F.lit(32)).alias("clip_height"), F.coalesce("tiles.count", F.lit(1)).alias("count"))


def read_images(spark: SparkSession, root: str, glob: str = "*.png") -> DataFrame:
    """``image_pixel`` rows of a folder of images; undecodable files drop out.

    The tileset is the parent folder.  Decoded bytes are B, G, R(, A) per
    pixel; three-channel images are opaque.  Pixels explode in the map stage.
    """
    img = (spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", glob).load(root)).select("image.*")
    p = img.where("nChannels IN (1, 3, 4)").select(
        F.col("origin").alias("image_id"), F.element_at(F.split("origin", "/"), -2).alias("tileset_id"), "width", "nChannels", "data",
        F.explode(F.expr("sequence(0, width * height - 1)")).alias("_i"))
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), F.col("_i") * F.col("nChannels") + k + 1, F.lit(1))), 16, 10).cast("int")
    gray = F.col("nChannels") == 1
    return p.select("image_id", "tileset_id", F.expr("_i % width").alias("x"), F.expr("cast(_i div width as int)").alias("y"),
                    F.when(gray, byte(0)).otherwise(byte(2)).alias("r"), F.when(gray, byte(0)).otherwise(byte(1)).alias("g"), byte(0).alias("b"),
                    F.when(F.col("nChannels") == 4, byte(3)).otherwise(255).alias("a"))


SECTIONS = "struct<palette:map<string,map<string,string>>,theme:map<string,string>,tile:map<string,string>,stamp:map<string,string>>"


def _to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """TOML text -> JSON text with each theme, tile and stamp kept as its own JSON object."""
    def convert(text: str) -> str | None:
        try:
            doc = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return None
        nested = {k: {n: json.dumps(v, default=str) for n, v in doc.get(k, {}).items()} for k in ("theme", "tile", "stamp")}
        return json.dumps({"palette": doc.get("palette", {}), **nested}, default=str)

    for pdf in batches:
        yield pd.DataFrame({"tileset_id": pdf["tileset_id"], "doc": [convert(v) for v in pdf["value"]]})


TILE = ("palette string, size string, symmetry string, auto_rotate string, auto_rotate_weight string, template string, target_layer string, weight double, "
        "tags array<string>, edge_class struct<n:string,e:string,s:string,w:string>, corner_class struct<ne:string,se:string,sw:string,nw:string>, "
        "semantic struct<affordance:string,collision:string>, grid string, rle string, layout string")
THEME = ("palette string, extends string, scale int, canvas int, max_palette_size int, light_source string, roles map<string,string>, constraints map<string,string>")


def read_tilesets(spark: SparkSession, glob: str) -> dict[str, DataFrame]:
    """Tileset files -> domain tables; an unparsable file yields a row in ``rejected`` only."""
    files = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("tileset_id"), "value")
    docs = files.mapInPandas(_to_json, "tileset_id string, doc string")
    good = docs.where("doc IS NOT NULL").select("tileset_id", F.from_json("doc", SECTIONS).alias("d"))
    entry = lambda kind, schema: good.select("tileset_id", F.explode(f"d.{kind}").alias("name", "_v")).select(
        "tileset_id", "name", F.from_json("_v", schema).alias("_s")).select("tileset_id", "name", "_s.*")
    pal = good.select("tileset_id", F.explode("d.palette").alias("palette", "_m")).select("tileset_id", "palette", F.explode("_m").alias("sym", "hex"))
    return {"palette": pal, "tile": entry("tile", TILE), "theme": entry("theme", THEME),
            "stamp": entry("stamp", "palette string, size string, grid string"), "rejected": docs.where("doc IS NULL").select("tileset_id")}


def read_kb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Knowledge corpus -> (passages, entity relations); chapter passages and orphans together.

    Any level may be missing.  ``doc_id`` is a digest of the passage's place
    (file, document, chapter, section, index), so equal passages stay apart.
    """
    docs = spark.read.schema(KB).option("multiLine", True).json(path).select(
        F.input_file_name().alias("_file"), F.posexplode("documents").alias("_d", "d")).select("_file", "_d", "d.*")
    at = ["_file", "_d", "title"]
    sections = docs.select(*at, F.posexplode("chapters").alias("_c", "_v")).select(*at, "_c", F.posexplode("_v.sections").alias("_s", "_v"))
    inner = sections.select(*at, "_c", "_s", F.posexplode("_v.passages").alias("_i", "p"))
    orphans = docs.select(*at, F.lit(-1).alias("_c"), F.lit(-1).alias("_s"), F.posexplode("orphan_passages").alias("_i", "p"))
    empty = F.array().cast("array<string>")
    p = inner.unionByName(orphans).select(F.xxhash64("_file", "_d", "_c", "_s", "_i").alias("doc_id"), "title", F.col("p.content").alias("content"), F.coalesce("p.summary", F.lit("")).alias("summary"), F.coalesce("p.concepts", empty).alias("concepts"),
                                          F.coalesce("p.keywords", empty).alias("keywords"), F.coalesce("p.hypothetical_questions", empty).alias("questions"))
    rel = docs.select(F.explode("knowledge_graph.entities").alias("entity", "_e")).select("entity", F.explode("_e.relations").alias("_r")).select(
        "entity", F.col("_r.predicate").alias("predicate"), F.col("_r.target").alias("target"))
    return p, rel


def read_feedback(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Persisted stores ``{events: [...]}`` (batch), or appended event lines (stream)."""
    if streaming:
        ev = spark.readStream.schema(FEEDBACK).json(path)
    else:
        ev = spark.read.schema(f"events array<struct<{FEEDBACK.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path).select(
            F.explode("events").alias("_e")).select("_e.*")
    return ev.withColumn("ts", F.timestamp_seconds("timestamp")).drop("timestamp")
