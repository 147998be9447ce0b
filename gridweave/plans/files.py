"""Source and sink queries: write derived data to shared scratch space, read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import fixtures as fx
from gridweave.functions import labels
from gridweave.operators import dataset as ds
from gridweave.plans import assembly, reviews
from gridweave.plans.corpus import BIG, FEAT_SQL, PAL_INLINE, R6, ROWTEXT, SPLIT_SQL, features
from gridweave.plans.mapping import BINS, TEXT, measured
from gridweave.plans.registry import query
from gridweave.session import scratch_path
from gridweave.sources import readers as rd
from gridweave.sources import writers as wr

T = fx.TILE_SQL


@query("read_pairs", f"WITH {T} SELECT tileset_id || ' ' || tile_id AS description, md5({ROWTEXT}) AS digest FROM tile")
def read_pairs(spark, d):
    p = scratch_path(spark, "pairs")
    t = fx.tiles(spark, d).select(F.expr("doc_id div 50").alias("_f"), F.array(F.concat("tileset_id", F.lit(" "), F.col("tile_id").cast("string")), "grid").alias("_p"))
    blank = F.array(F.array(F.lit("blank"), F.lit("  ")))
    # One file per fifty documents, as the shipped pair files are small too.
    t.groupBy("_f").agg(F.to_json(F.concat(F.collect_list("_p"), blank)).alias("value")).write.partitionBy("_f").text(p)
    return rd.read_pairs(spark, p + "/*/*.txt").select("description", F.md5("grid").alias("digest"))


def chat_rows(spark, d):
    pal = ds.palette_prompt(fx.palette(spark), ["palette"])
    f = features(spark, d).withColumns({"palette": F.lit("base"), "label": labels.tile_label()}).join(F.broadcast(pal), "palette")
    c = ds.to_chat(f, F.concat(F.lit("Palette: "), "palette_text", F.lit("\n"), "label"), F.col("grid"))
    c = c.withColumn("text", ds.to_completion(F.col("label"), F.col("grid")))
    return ds.split(c, ["tile_id"])


@query("write_chat_splits", f"WITH {FEAT_SQL} SELECT split, md5('Palette: {PAL_INLINE.replace(chr(39), chr(39) * 2)}' || chr(10) || label) AS user_digest, count(*) AS n FROM (SELECT label, {SPLIT_SQL} AS split FROM lab) GROUP BY ALL")
def write_chat_splits(spark, d):
    p = scratch_path(spark, "chat")
    wr.write_splits(chat_rows(spark, d), p)
    back = wr.read_splits(spark, p).select("split", F.from_json("value", f"messages {rd.MESSAGES}")["messages"].alias("m"))
    return back.groupBy("split", F.md5(F.col("m")[1]["content"]).alias("user_digest")).agg(F.count("*").alias("n"))


@query("write_completion_splits", f"WITH {FEAT_SQL} SELECT split, md5(label) AS label_digest, count(*) AS n, sum(length(label) + 256 + 15 + 22 + 8)::bigint AS chars FROM (SELECT label, {SPLIT_SQL} AS split FROM lab) GROUP BY ALL")
def write_completion_splits(spark, d):
    p = scratch_path(spark, "completion")
    wr.write_splits(chat_rows(spark, d), p, "completion")
    back = wr.read_splits(spark, p).select("split", F.get_json_object("value", "$.text").alias("t"))
    label = F.regexp_extract("t", r"grid:\n(.*)\n\nGrid:\n", 1)
    return back.groupBy("split", F.md5(label).alias("label_digest")).agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))


#: Rows whose texts are packed into one piece.
PIECE_ROWS = 20_000


def order_digest(df, by, text):
    """``(*by, n, order_digest)``: rows, and the md5 of the texts in the order of the sorted ``df``, joined by commas; ``by`` are texts.

    It is only for the comparison with the oracle.  An md5 is computed from
    front to end, so a group's texts pass through one task; they come there in
    order, as packed pieces, and are never held together.
    """
    k, names = len(by), [*by, "_part", "_seq", "_n", "_body"]
    fields = ", ".join(f"{c} string" for c in by)

    def pack(parts):
        import itertools
        import zlib

        import pyarrow as pa

        types = pa.schema([(c, pa.string()) for c in by] + [(c, pa.int64()) for c in names[k:-1]] + [("_body", pa.binary())])
        seq = 0
        rows = (r for b in parts for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for key, mine in itertools.groupby(rows, lambda r: r[:k + 1]):
            while some := list(itertools.islice(mine, PIECE_ROWS)):
                held = [r[-1].encode() for r in some if r[-1] is not None]
                row = (*key, seq, len(some), zlib.compress(b",".join(held)) if held else None)
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=types)
                seq += 1

    def read(parts):
        import hashlib
        import itertools
        import zlib

        import pyarrow as pa

        rows = (tuple(v[0].as_py() for v in b.slice(i, 1).columns) for b in parts for i in range(b.num_rows))
        for key, mine in itertools.groupby(rows, lambda r: r[:k]):
            n, md5, some = 0, hashlib.md5(), False
            for r in mine:
                n += r[-2]
                if r[-1] is not None:
                    md5.update((b"," if some else b"") + zlib.decompress(r[-1]))
                    some = True
            types = pa.schema([(c, pa.string()) for c in by] + [("n", pa.int64()), ("order_digest", pa.string())])
            row = (*key, n, md5.hexdigest() if some else None)
            yield pa.RecordBatch.from_pylist([dict(zip(types.names, row, strict=True))], schema=types)

    pieces = df.select(*by, F.spark_partition_id().cast("bigint").alias("_part"), text).mapInArrow(pack, f"{fields}, _part bigint, _seq bigint, _n bigint, _body binary")
    return pieces.repartition(*by).sortWithinPartitions(*by, "_part", "_seq").mapInArrow(read, f"{fields}, n bigint, order_digest string")


@query("merge_splits", f"WITH {T}, a AS (SELECT tile_id, {SPLIT_SQL} AS split FROM tile), b AS (SELECT split, 'a' || tile_id AS value FROM a WHERE split <> 'test' UNION ALL SELECT split, 'b' || tile_id FROM a WHERE split <> 'test') SELECT split, count(*) AS n, md5(string_agg(value, ',' ORDER BY md5('42:' || value), value)) AS order_digest FROM b GROUP BY 1")
def merge_splits(spark, d):
    s = ds.split(fx.tiles(spark, d).select("tile_id"), ["tile_id"])
    base = s.where("split <> 'test'").select("split", F.concat(F.lit("a"), F.col("tile_id").cast("string")).alias("value"))
    new = s.select("split", F.concat(F.lit("b"), F.col("tile_id").cast("string")).alias("value"))
    m = wr.merge_splits(base, new)
    return order_digest(m, ["split"], "value")


def archive_rows(spark, d):
    e = ds.elites(measured(spark, d)).withColumn("label", labels.map_label())
    text = ds.map_text(fx.map_cells(spark, d))
    return e.join(text, "map_id").select(
        "label", F.transform(F.split("grid_text", "\n"), lambda r: F.split(r, " ")).alias("grid"),
        F.struct("wall_ratio", "walkable_ratio", F.col("room_count").cast("int").alias("room_count"), F.col("largest_room").cast("int").alias("largest_room"), "border_solidity",
                 F.col("transition_count").cast("int").alias("transition_count")).alias("features"),
        "quality", "theme", F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), F.col("map_id").alias("seed"))


def _archive(spark, d):
    p = scratch_path(spark, "archive")
    wr.write_archive(archive_rows(spark, d), p)
    return rd.read_archive(spark, p)


ARCH_SQL = BINS + f", {TEXT} "


@query("write_archive", ARCH_SQL + "SELECT theme, count(*) AS n, sum(room_count)::bigint AS rooms FROM el GROUP BY 1")
def write_archive(spark, d):
    return _archive(spark, d).groupBy("theme").agg(F.count("*").alias("n"), F.sum("features.room_count").alias("rooms"))


@query("read_archive", ARCH_SQL + "SELECT map_id AS seed, label, grid_text, round(wall_ratio, 6) AS wall_ratio, round(quality, 6) AS quality, w AS width, h AS height FROM el JOIN tx USING (map_id)")
def read_archive(spark, d):
    a = _archive(spark, d)
    return a.select("seed", "label", F.array_join(F.transform("grid", lambda r: F.array_join(r, " ")), "\n").alias("grid_text"),
                    F.round("features.wall_ratio", 6).alias("wall_ratio"), R6("quality"), BIG("width"), BIG("height"))


@query("read_tile_meta", "SELECT 'id' || p_partkey AS id, CASE WHEN p_partkey % 9 <> 4 THEN p_name END AS title, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 + 1 END AS req_w, CASE WHEN p_partkey % 6 = 0 THEN 32 ELSE 8 END AS clip_width, CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 3 END AS count, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'f.png' END AS file_name FROM part")
def read_tile_meta(spark, d):
    p = scratch_path(spark, "meta")
    k = F.expr("cast(substring(id, 3) as bigint)")
    m = assembly.tile_meta(spark, d)
    rec = m.select(F.struct("id", "title", "category", "description", "tags", F.when(F.col("req_w").isNotNull(), F.struct(F.col("req_w").alias("width"), F.col("req_h").alias("height"))).alias("RequiredTiles"),
                            F.when(k % 6 != 0, F.struct(F.lit("f.png").alias("fileName"), F.lit(8).alias("clip_width"), F.lit(3).alias("count"))).alias("tiles")).alias("r"),
                   F.expr("cast(substring(id, 3) as bigint) div 500").alias("_f"))
    # One array per file of five hundred records.
    rec.groupBy("_f").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("_f").text(p)
    return rd.read_tile_meta(spark, p + "/*/*.txt").select("id", "title", BIG("req_w"), "clip_width", "count", "file_name")


@query("read_tilesets", "SELECT 'p' || p_partkey AS name, 'c' || (p_size % 6) AS n, CASE WHEN p_partkey % 2 = 0 THEN 'obstacle' END AS affordance, '16x' || p_size AS size, '##' || chr(10) || '..' AS grid FROM part")
def read_tilesets(spark, d):
    p = scratch_path(spark, "tilesets")
    k = F.col("p_partkey").cast("string")
    block = F.concat(F.lit("[tile.p"), k, F.lit(']\npalette = "base"\nsize = "16x'), F.col("p_size").cast("string"), F.lit("\"\ngrid = '''\n##\n..'''\nedge_class = { n = \"c"),
                     (F.col("p_size") % 6).cast("string"), F.lit('", e = "a", s = "b", w = "c" }\n'), F.when(F.col("p_partkey") % 2 == 0, 'semantic = { affordance = "obstacle" }\n').otherwise(""))
    files = fx.table(spark, d, "part").groupBy(F.expr("p_partkey div 100").alias("_f")).agg(F.concat(F.lit('[palette.base]\n"." = "#00000000"\n'), F.array_join(F.collect_list(block), "\n")).alias("value"))
    # A file per tileset: its rows are bounded by the tileset definition itself.
    files.withColumn("set", F.col("_f")).select("value", "set").write.partitionBy("set").text(p)
    ts = rd.read_tilesets(spark, p + "/set=*/*.txt")
    return ts["tile"].select("name", F.col("edge_class.n").alias("n"), F.col("semantic.affordance").alias("affordance"), "size", "grid")


#: Documents of a file of the knowledge corpus.
KB_FILE = 500


@query("read_kb", "SELECT source AS title, count(*) AS passages, sum(length(text))::bigint AS chars, count(*) FILTER (doc_id % 3 = 0) AS with_summary FROM documents GROUP BY 1")
def read_kb(spark, d):
    p = scratch_path(spark, "kb")
    pas = F.struct(F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, "s").alias("summary"), F.array("lang").alias("concepts"))
    # One file per five hundred documents with a record per title, so there are far fewer files than documents; dealt by file, both groupings stay in place.
    dealt = fx.table(spark, d, "documents").withColumn("_f", F.expr(f"doc_id div {KB_FILE}")).repartition("_f")
    docs = dealt.groupBy(F.col("source").alias("title"), "_f").agg(
        F.collect_list(F.when(F.col("doc_id") % 2 == 0, pas)).alias("_in"), F.collect_list(F.when(F.col("doc_id") % 2 == 1, pas)).alias("orphan_passages"))
    doc = F.struct("title", F.array(F.struct(F.array(F.struct(F.col("_in").alias("passages"))).alias("sections"))).alias("chapters"), "orphan_passages")
    docs.groupBy("_f").agg(F.to_json(F.struct(F.collect_list(doc).alias("documents"))).alias("value")).select("value", "_f").write.partitionBy("_f").text(p)
    passages, _ = rd.read_kb(spark, p + "/*/*.txt")
    return passages.groupBy("title").agg(F.count("*").alias("passages"), F.sum(F.length("content")).alias("chars"), F.count(F.when(F.col("summary") != "", 1)).alias("with_summary"))


FB_OUT = "SELECT event_id, tileset_id, action, reject_reason, round(style_score, 6) AS style_score, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM fb"


@query("read_feedback", "WITH " + fx.RAW_FEEDBACK_SQL + FB_OUT)
def read_feedback(spark, d):
    p = scratch_path(spark, "feedback")
    ev = reviews.events(spark, d).withColumn("timestamp", F.unix_timestamp("ts")).drop("ts")
    # One store per tileset and thousand events, as the sidecar files are.
    stores = ev.withColumn("_f", F.expr("event_id div 1000")).groupBy("tileset_id", "_f").agg(F.to_json(F.struct(F.collect_list(F.struct(*ev.columns)).alias("events"))).alias("value"))
    stores.select("value", F.col("tileset_id").alias("set"), "_f").write.partitionBy("set", "_f").text(p)
    f = rd.read_feedback(spark, p + "/*/*/*.txt")
    return f.select("event_id", "tileset_id", "action", "reject_reason", R6("style_score"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("write_stamp_text", f"""WITH {T} SELECT count(*)::bigint AS blocks, sum(length('[stamp.t' || tile_id || ']'))::bigint AS head_chars FROM tile""")
def write_stamp_text(spark, d):
    p = scratch_path(spark, "stamps")
    t = reviews.tiles(spark, d).select(F.concat(F.lit("t"), F.col("tile_id").cast("string")).alias("name"), F.lit("base").alias("palette"), F.lit("16x16").alias("size"),
                                       F.lit(None).cast("string").alias("affordance"), "tags", F.lit(0.97).alias("accuracy"), "grid")
    wr.write_stamp_text(t, fx.palette(spark), p)
    back = spark.read.text(p).where("startswith(value, '[stamp.')")
    return back.agg(F.count("*").alias("blocks"), F.sum(F.length("value")).alias("head_chars"))
