"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.fixtures import table
from gridweave.llm import ann, bpe, decontaminate, fill_middle, jaccard_join, licenses, quality, quotes, secret_scan, source_divergence, toxicity, unigram, zip_warc
from gridweave.plans.registry import Query, shipped
from gridweave.session import scratch_path

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Score from which a text counts as toxic.
TOXIC = 0.3
#: Score from which a text counts as good.
GOOD = 0.3


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = shipped(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every text, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their three-word shingles."""
    return jaccard_join.link_components(table(spark, sf_dir, "documents"), jaccard_join.Rule(3, 9, 10))


def _secret_sql() -> str:
    """Places from the lengths of the texts between matches, as in the operator but by window sums."""
    parts, counts = [], []
    for i, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, e - length(hit) AS s, e, length(val) >= {r.least} AS ok FROM (
  SELECT doc_id, hit, val, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
    SELECT doc_id, unnest(range(1, len(hits) + 1)) AS k, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {r.group}) AS vals, regexp_split_to_array(t, '{p}') AS gaps FROM d)))""")
        if r.kind in secret_scan.BASE:
            counts.append(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}")
    one = "string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' ORDER BY s, ord)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), hit AS ({' UNION ALL '.join(parts)}),
agg AS (SELECT doc_id, {', '.join(counts)}, {one} FILTER (ord < 3) AS base, {one} AS spans FROM hit WHERE ok GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)"""


@query("op2_secret_scan", _secret_sql())
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts and places."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"].isin(*secret_scan.BASE))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, secret_scan.BASE),
        F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("found")).alias("spans"))


#: The same windows, compared with every item of their length and without fingerprints.
DECONTAMINATE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS nw, unnest(range(0, len(w) - 4)) AS pos, w FROM dw WHERE len(w) >= 5),
dsh AS (SELECT doc_id, nw, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS sh FROM ds),
ish AS (SELECT item_id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS sh FROM (
  SELECT item_id, len(w) AS n, w, unnest(range(0, len(w) - 4)) AS p FROM iw WHERE len(w) >= 5)),
win AS (SELECT DISTINCT doc_id, n, greatest(0, least(pos - p, nw - n)) AS start FROM dsh JOIN ish USING (sh)),
wsh AS (SELECT doc_id, n, start, sh, count(*) AS c FROM win JOIN dsh USING (doc_id)
  WHERE pos >= start AND pos + 5 <= start + n GROUP BY ALL),
isc AS (SELECT item_id, n, sh, count(*) AS c FROM ish GROUP BY ALL),
wtot AS (SELECT doc_id, n, start, sum(c * (length(sh) - 4)) AS t FROM wsh GROUP BY ALL),
itot AS (SELECT item_id, n, sum(c * (length(sh) - 4)) AS t FROM isc GROUP BY ALL),
inter AS (SELECT doc_id, item_id, n, start, sum(least(wsh.c, isc.c) * (length(sh) - 4)) AS i FROM wsh JOIN isc USING (n, sh) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, n, start, i, wtot.t + itot.t - i AS u FROM inter JOIN wtot USING (doc_id, n, start) JOIN itot USING (item_id, n))
SELECT doc_id, item_id, start, n AS n_words, i / u AS similarity FROM sim WHERE i * 10 >= u * 8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY i / u DESC, start) = 1
"""


@query("op10_decontaminate", DECONTAMINATE_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with their place."""
    return decontaminate.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("distance")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """A model that never saw the labels of the held-out fold."""
    return toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text, from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def _license_sql() -> str:
    """Every unit against every template, without size bounds or an index."""
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(licenses.TEMPLATES))
    words = f"regexp_extract_all(lower(t), '{licenses.WORD}')"
    bag = "SELECT {k}, len(w) - 1 AS n, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT *, unnest(range(1, len(w))) AS i FROM {t} WHERE len(w) >= {m})"
    return f"""WITH tpl(template, licence, t) AS (VALUES {rows}), tw AS (SELECT template, licence, {words} AS w FROM tpl),
tb AS (SELECT template, licence, n AS size, pair, count(*) AS c FROM ({bag.format(k='template, licence', t='tw', m=2)}) GROUP BY ALL),
unit AS (SELECT doc_id, 0 AS line, text AS t FROM documents UNION ALL
  SELECT doc_id, unnest(range(1, len(ls) + 1)), unnest(ls) FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, chr(10)))),
uw AS (SELECT doc_id, line, {words} AS w FROM unit),
ub AS (SELECT doc_id, line, n, pair, count(*) AS c FROM ({bag.format(k='doc_id, line', t='uw', m=3)}) GROUP BY ALL),
sim AS (SELECT doc_id, line, licence, template, 2 * sum(least(ub.c, tb.c)) / (n + size) AS dice, 10 * sum(least(ub.c, tb.c)) >= 4 * (n + size) AS ok
  FROM ub JOIN tb USING (pair) GROUP BY doc_id, line, n, licence, template, size),
best AS (SELECT * FROM sim WHERE ok QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, licence) = 1)
SELECT doc_id, licence, line, coalesce(dice, 0.0) AS dice FROM documents LEFT JOIN best USING (doc_id)"""


@query("op3_license_scan", _license_sql())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence of every document, as a whole, by line or in a run of words."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.templates(spark)).drop("text")


@query("op4_zip_warc")
def op4_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC in ZIP archives and read back."""
    manifest = zip_warc.write(zip_warc.typed(table(spark, sf_dir, "pages")), scratch_path(spark, "warc"))
    return zip_warc.read(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_ann")
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under the unigram vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


#: The same by windows over lines and a recursive walk up the replies.
QUOTES_SQL = r"""
WITH RECURSIVE ln AS (SELECT conv_id, turn, i, ls[i] AS l FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
  SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations))),
lv AS (SELECT conv_id, turn, i, length(regexp_replace(q, '[ \t]', '', 'g')) AS level, trim(translate(substr(l, length(q) + 1), chr(9) || chr(13) || chr(12) || chr(11), '    ')) AS body
  FROM (SELECT *, regexp_extract(l, '^(?:[ \t]*>)+') AS q FROM ln)),
runs AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM (
  SELECT *, coalesce(lag(level) OVER w <> level OR lag(body) OVER w = '', true) AS fresh FROM lv WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)) WHERE body <> ''),
pas AS (SELECT conv_id, turn, g, any_value(level) AS level, md5(trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), ' +', ' ', 'g'))) AS h FROM runs GROUP BY conv_id, turn, g),
org AS (SELECT conv_id, h, min(turn) AS src FROM pas WHERE level = 0 GROUP BY ALL),
quo AS (SELECT p.conv_id, p.turn, p.g, p.level, CASE WHEN src < p.turn THEN src END AS src FROM pas p LEFT JOIN org USING (conv_id, h) WHERE level > 0),
lnk AS (SELECT conv_id, turn, count(*) AS n_quotes, count(src) AS n_linked, arg_min(src, level * 1000000 + g) FILTER (src IS NOT NULL) AS parent FROM quo GROUP BY ALL),
up AS (SELECT conv_id, turn, turn AS root FROM conversations UNION ALL SELECT up.conv_id, up.turn, lnk.parent FROM up JOIN lnk ON lnk.conv_id = up.conv_id AND lnk.turn = up.root WHERE lnk.parent IS NOT NULL),
top AS (SELECT conv_id, turn, min(root) AS thread FROM up GROUP BY ALL),
own AS (SELECT conv_id, turn, regexp_replace(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), '^\n+|\n+$', '', 'g') AS content FROM lv GROUP BY ALL)
SELECT c.conv_id, c.turn, role, coalesce(content, '') AS content, parent AS parent_turn, thread, row_number() OVER (PARTITION BY c.conv_id ORDER BY thread, c.turn) AS place,
  coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked
FROM conversations c JOIN own USING (conv_id, turn) JOIN top USING (conv_id, turn) LEFT JOIN lnk USING (conv_id, turn)
"""


@query("op8_quotes", QUOTES_SQL)
def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without quotes, in reply order."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def _fill_middle_sql() -> str:
    """Units as a list, parts as joined slices of it."""
    draw = ", ".join(f"('0x' || substr(sha256('1:' || doc_id), {8 * i + 1}, 8))::bigint AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(t, '{m}')" for m in fill_middle.MARKERS)
    p, s, m = fill_middle.MARKERS
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {draw} FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR {marked} OR h3 % 100 >= {fill_middle.CUT} THEN 'plain' WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
part AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256 FROM part"""


@query("op12_fill_middle", _fill_middle_sql())
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut and put in its drawn form, and the text rebuilt from that, as digests."""
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


#: The same, each text by itself and every term of every group spelt out.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT i) >= 30),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
tot AS (SELECT lang, source, sum(n) AS t FROM cell GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (t + 5 * v) AS p FROM cell JOIN tot USING (lang, source) JOIN vocab USING (lang)),
lt AS (SELECT lang, term, sum(n) AS n FROM cnt GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM lt JOIN vocab USING (lang)),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::bigint AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
tm AS (SELECT lang, source, 'term' AS part, term AS item, (p.p - q.q)::bigint AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
al AS (SELECT * FROM pr UNION ALL SELECT * FROM tm)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::int AS rank FROM al
QUALIFY part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between a language's sources, and the terms that each source has more of."""
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """A model that never saw the labels of the held-out fold."""
    return quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))


@query("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text, from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
