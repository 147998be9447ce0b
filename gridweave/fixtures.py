"""Bindings: domain tables derived from the shared Parquet tables.

Every binding covers the whole source table and whole texts.  ``*_SQL`` holds
the same binding as a common table expression for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.lookup import lookup

# Fixed values of the bindings.
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = ".#+=~gorhw"
MAPPED = "".join(SYMBOLS[(i + 1) % 10] for i in range(26))
SIZE = 16
CHUNKS = 1 << 23  # tile_id = doc_id * CHUNKS + chunk number; a text of 2 GiB, the longest there can be, has as many
#: Our own ten colours, one per symbol.
PALETTE = [
    (".", 0, 0, 0, 0), ("#", 34, 32, 52, 255), ("+", 69, 40, 60, 255), ("=", 102, 57, 49, 255),
    ("~", 91, 110, 225, 255), ("g", 106, 190, 48, 255), ("o", 223, 113, 38, 255),
    ("r", 172, 50, 50, 255), ("h", 251, 242, 54, 255), ("w", 203, 219, 252, 255),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when the input has fewer splits than the session has cores.

    Large inputs have many splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def symbol_text(text: Column) -> Column:
    """Letters fold to the ten symbols, everything else is void."""
    letters = F.regexp_replace(text, "[^A-Za-z]", ".")
    return F.translate(letters, ALPHABET + ALPHABET.upper(), MAPPED * 2)


SYMBOL_TEXT_SQL = (
    "translate(regexp_replace({}, '[^A-Za-z]', '.', 'g'), "
    f"'{ALPHABET}{ALPHABET.upper()}', '{MAPPED * 2}')"
)


def tiles(spark: SparkSession, sf_dir: str, most: int = SIZE) -> DataFrame:
    """Documents cut into 16x16 tiles, the last one padded with void; the first ``most`` rows of each."""
    if most < SIZE:
        return _tile_tops(spark, sf_dir, most)
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id").select("doc_id", "source", "lang", symbol_text(F.col("text")).alias("s"))
    t = d.select("doc_id", "source", "lang", F.posexplode(
        F.regexp_extract_all("s", F.lit("(.{1,256})"), F.lit(1))).alias("k", "chunk"))
    rows = F.regexp_extract_all(F.rpad("chunk", SIZE * SIZE, "."), F.lit("(.{16})"), F.lit(1))
    return t.select(
        (F.col("doc_id") * CHUNKS + F.col("k")).alias("tile_id"),
        F.col("source").alias("tileset_id"), F.col("lang").alias("theme"),
        F.col("doc_id"), F.lit(SIZE).alias("w"), F.lit(SIZE).alias("h"),
        F.array_join(rows, "\n").alias("grid"),
    )


def _tile_tops(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """First rows of the tiles: a symbol stands for a character, so texts are cut first and only those rows are folded."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    t = d.select("doc_id", "source", "lang", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)(.{1,%d}).{0,%d}" % (most * SIZE, (SIZE - most) * SIZE)), F.lit(1))).alias("k", "chunk"))
    t = t.withColumn("s", F.rpad(symbol_text(F.col("chunk")), most * SIZE, "."))
    rows = [F.substring("s", 1 + i * SIZE, SIZE) for i in range(most)]
    return t.select(
        (F.col("doc_id") * CHUNKS + F.col("k")).alias("tile_id"), F.col("source").alias("tileset_id"), F.col("lang").alias("theme"),
        F.col("doc_id"), F.lit(SIZE).alias("w"), F.lit(SIZE).alias("h"), F.concat_ws("\n", *rows).alias("grid"))


TILE_SQL = f"""
doc AS (SELECT doc_id, source, lang, {SYMBOL_TEXT_SQL.format('text')} AS s FROM documents),
tile AS (SELECT doc_id * {CHUNKS} + k AS tile_id, source AS tileset_id, lang AS theme, doc_id,
                rpad(substr(s, (k * 256 + 1)::bigint, 256), 256, '.') AS flat
         FROM (SELECT *, unnest(range(0, ((length(s) + 255) // 256)::bigint)) AS k FROM doc)),
px AS (SELECT tile_id, tileset_id, theme, i % 16 AS x, i // 16 AS y, substr(flat, i + 1, 1) AS sym
       FROM (SELECT *, unnest(range(0, 256)) AS i FROM tile))
"""


def palette(spark: SparkSession, name: str = "base") -> DataFrame:
    rows = [(name, i, *p) for i, p in enumerate(PALETTE)]
    return spark.createDataFrame(rows, "palette string, pos int, sym string, r int, g int, b int, a int")


PALETTE_SQL = "palette(pos, sym, r, g, b, a) AS (VALUES " + ", ".join(
    f"({i}, '{s}', {r}, {g}, {b}, {a})" for i, (s, r, g, b, a) in enumerate(PALETTE)) + ")"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 RGBA images: ``image_pixel`` rows with their tileset."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("label").cast("string").alias("tileset_id"), "embedding")
    chan = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(
        F.lit(255), F.floor(v.cast("double") * 510 + 127.5))).cast("int"))
    p = e.select("image_id", "tileset_id", chan.alias("_c"), F.posexplode("embedding").alias("i", "_v"))
    at = lambda shift: F.expr(f"_c[(i + {shift}) % 64]")
    return p.select(
        "image_id", "tileset_id", (F.col("i") % 8).alias("x"), F.expr("i div 8").cast("int").alias("y"),
        at(0).alias("r"), at(21).alias("g"), at(42).alias("b"),
        F.when(F.col("_v") < F.lit(-0.2).cast("float"), 0).otherwise(255).alias("a"),
    )


IMAGE_SQL = """
img0 AS (SELECT vec_id AS image_id, label::varchar AS tileset_id, embedding AS e,
                unnest(range(0, 64)) AS i FROM embeddings),
img AS (SELECT image_id, tileset_id, i % 8 AS x, i // 8 AS y,
   greatest(0, least(255, floor(e[i + 1]::double * 510 + 127.5)))::int AS r,
   greatest(0, least(255, floor(e[(i + 21) % 64 + 1]::double * 510 + 127.5)))::int AS g,
   greatest(0, least(255, floor(e[(i + 42) % 64 + 1]::double * 510 + 127.5)))::int AS b,
   CASE WHEN e[i + 1] < (-0.2)::float THEN 0 ELSE 255 END AS a FROM img0)
"""

MAP_W, MAP_H = 12, 8


def map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid out as 12-wide maps; the last map may have fewer rows."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    p = F.substring("o_orderpriority", 1, 1)
    base = F.when(p.isin("1", "2"), "wall").when(p == "5", "water").otherwise("floor")
    sfx = F.when(F.col("o_orderstatus") == "O", "_90").when(F.col("o_orderstatus") == "P", "_180").otherwise("")
    return o.select(
        F.expr("o_orderkey div 96").alias("map_id"), (k % 12).cast("int").alias("x"),
        F.expr("(o_orderkey % 96) div 12").cast("int").alias("y"), F.concat(base, sfx).alias("tile"))


MAP_SQL = """
cell AS (SELECT o_orderkey // 96 AS map_id, o_orderkey % 12 AS x, (o_orderkey % 96) // 12 AS y,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'wall' WHEN left(o_orderpriority, 1) = '5' THEN 'water' ELSE 'floor' END AS base,
  CASE o_orderstatus WHEN 'O' THEN '_90' WHEN 'P' THEN '_180' ELSE '' END AS sfx FROM orders),
acell AS (SELECT *, base || sfx AS tile,
  CASE base WHEN 'wall' THEN 'obstacle' WHEN 'floor' THEN 'walkable' ELSE 'hazard' END AS aff FROM cell),
dims AS (SELECT map_id, max(x) + 1 AS w, max(y) + 1 AS h FROM cell GROUP BY map_id)
"""

AFFORDANCES = [("wall", "obstacle"), ("floor", "walkable"), ("water", "hazard")]


def affordances(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AFFORDANCES, "tile string, affordance string")


def tile_edges(spark: SparkSession, sf_dir: str, per_set: int = 100) -> DataFrame:
    """Parts as tiles with edge and (partly missing) corner classes."""
    cls = lambda k: F.concat(F.lit("c"), ((k) % 6).cast("string"))
    corner = lambda k: F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("k"), (k % 2).cast("string")))
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.expr(f"p_partkey div {per_set}").alias("tileset_id"), F.concat(F.lit("t"), key.cast("string")).alias("name"),
        cls(F.col("p_size")).alias("n"), cls(F.length("p_name")).alias("e"), cls(key).alias("s"),
        cls(F.length("p_type")).alias("w"),
        corner(F.col("p_size")).alias("ne"), corner(key).alias("se"),
        corner(F.length("p_name")).alias("sw"), corner(F.length("p_brand")).alias("nw"),
        F.when(key % 5 == 0, "4way").when(key % 5 == 1, "flip").when(key % 5 == 2, "8way").alias("auto_rotate"),
        F.when(key % 2 == 0, "equal").alias("auto_rotate_weight"),
        (F.col("p_size") / 10.0).alias("weight"), (key % 7 == 6).alias("is_template"),
        F.when(key % 4 == 0, "obstacle").when(key % 4 == 1, "walkable").when(key % 4 == 2, "hazard").alias("affordance"),
    )


def tile_edges_sql(per_set: int = 100, name: str = "te") -> str:
    return f"""
{name} AS (SELECT p_partkey // {per_set} AS tileset_id, 't' || p_partkey AS name,
  'c' || (p_size % 6) AS n, 'c' || (length(p_name) % 6) AS e, 'c' || (p_partkey % 6) AS s, 'c' || (length(p_type) % 6) AS w,
  CASE WHEN p_partkey % 3 <> 0 THEN 'k' || (p_size % 2) END AS ne,
  CASE WHEN p_partkey % 3 <> 0 THEN 'k' || (p_partkey % 2) END AS se,
  CASE WHEN p_partkey % 3 <> 0 THEN 'k' || (length(p_name) % 2) END AS sw,
  CASE WHEN p_partkey % 3 <> 0 THEN 'k' || (length(p_brand) % 2) END AS nw,
  CASE p_partkey % 5 WHEN 0 THEN '4way' WHEN 1 THEN 'flip' WHEN 2 THEN '8way' END AS auto_rotate,
  CASE WHEN p_partkey % 2 = 0 THEN 'equal' END AS auto_rotate_weight,
  p_size / 10.0::double AS weight, p_partkey % 7 = 6 AS is_template,
  CASE p_partkey % 4 WHEN 0 THEN 'obstacle' WHEN 1 THEN 'walkable' WHEN 2 THEN 'hazard' END AS affordance
  FROM part)"""


# The six named reject reasons; the seventh is free text.
REASONS = ["too_sparse", "too_dense", "wrong_style", "bad_edges", "palette_violation",
           "bad_composition", "muddy colours"]


def raw_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw reviewer events; each names some tile of some document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.expr("(n_chars + 255) div 256")).alias("_tiles"))
    n_docs = docs.count()  # answered from the Parquet footers
    e = lookup(table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % n_docs), docs, ["doc_id"])
    action = F.when(F.col("event_type") == "purchase", "accept").when(
        F.col("event_type") == "signup", "edit").when(F.col("event_type") == "error", "reject").otherwise(F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (k % 7) + 1)
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("tileset_id"),
        (F.col("doc_id") * CHUNKS + F.col("event_id") * 7919 % F.coalesce("_tiles", F.lit(1))).alias("tile_id"), action.alias("action"),
        F.when(F.col("event_type") == "error", reason).alias("reason"),
        (F.least("value", F.lit(100.0)) / 100.0).alias("style_score"),
    )


RAW_FEEDBACK_SQL = f"""
fbraw AS (SELECT event_id, ts, user_id % 10 AS tileset_id,
  (event_id % (SELECT count(*) FROM documents)) * {CHUNKS} + event_id * 7919 % coalesce(greatest(1, (n_chars + 255) // 256), 1) AS tile_id,
  CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'signup' THEN 'edit' WHEN 'error' THEN 'reject' ELSE event_type END AS action,
  CASE WHEN event_type = 'error' THEN [{', '.join(repr(r) for r in REASONS)}][(json_extract_string(props, '$.k')::int % 7) + 1] END AS reason,
  least(value, 100.0) / 100.0 AS style_score FROM events LEFT JOIN (SELECT doc_id, n_chars FROM documents) ON doc_id = event_id % (SELECT count(*) FROM documents)),
fb AS (SELECT event_id, ts, tileset_id, tile_id, action, style_score,
  CASE WHEN reason IS NULL OR reason IN ({', '.join(repr(r) for r in REASONS[:6])}) THEN reason ELSE 'other(' || reason || ')' END AS reject_reason
  FROM fbraw WHERE action IN ('accept', 'reject', 'edit'))
"""


#: Letters from which a word names a concept; words of one letter less are keywords.
NAME_LETTERS = 10


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages: all long words of the whole text are concepts, all pairs of neighbouring long words phrases."""
    def of(pattern: str) -> Column:
        return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))))

    n = NAME_LETTERS
    d = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("content"), F.col("lang").alias("summary"),
        of(rf"\p{{L}}{{{n - 1},}}").alias("_w"), of(rf"\p{{L}}{{{n},}} \p{{L}}{{{n},}}").alias("phrases"))
    return d.select(
        "doc_id", "title", "content", "summary", F.filter("_w", lambda w: F.length(w) >= n).alias("concepts"),
        F.filter("_w", lambda w: F.length(w) < n).alias("keywords"), F.array().cast("array<string>").alias("questions"), "phrases")


def entities(passages_df: DataFrame) -> DataFrame:
    """``(entity, target)``: every concept of a passage to the next one in order, every phrase to both its words."""
    c = F.col("concepts")
    near = F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.struct(a.alias("entity"), b.alias("target")))
    both = F.flatten(F.transform("phrases", lambda p: F.transform(F.split(p, " "), lambda w: F.struct(p.alias("entity"), w.alias("target")))))
    return passages_df.select(F.explode(F.concat(F.filter(near, lambda e: e["target"].isNotNull()), both)).alias("e")).select("e.*")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


KB_SQL = f"""
wrd AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{{NAME_LETTERS - 1},}}')) AS w FROM documents),
phr AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{{NAME_LETTERS},}} \\p{{L}}{{{NAME_LETTERS},}}')) AS p FROM documents),
pas AS (SELECT d.doc_id, d.source AS title, d.text AS content, d.lang AS summary, coalesce(list(w ORDER BY w) FILTER (length(w) >= {NAME_LETTERS}), []) AS concepts,
  coalesce(list(w ORDER BY w) FILTER (length(w) < {NAME_LETTERS}), []) AS keywords FROM documents d LEFT JOIN wrd USING (doc_id) GROUP BY ALL),
con AS (SELECT w AS concept, doc_id, source AS title FROM wrd JOIN documents USING (doc_id) WHERE length(w) >= {NAME_LETTERS}),
ent AS (SELECT entity, target FROM (SELECT concept AS entity, lead(concept) OVER (PARTITION BY doc_id ORDER BY concept) AS target FROM con) WHERE target IS NOT NULL
  UNION ALL SELECT p, unnest(string_split(p, ' ')) FROM phr),
rel AS (SELECT entity, target, count(*) AS n FROM ent GROUP BY ALL),
crel AS (SELECT entity AS key, target AS other FROM rel UNION SELECT target, entity FROM rel),
qry AS (SELECT item_id AS query_id, text FROM benchmark)
"""
