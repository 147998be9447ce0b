"""Steps whose work has to follow the input: files, shuffled rows and rounds are counted, results compared."""

import os

import pytest

import gridweave.plans.catalog  # noqa: F401
from gridweave.plans import check, files, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_read_kb_writes_few_files(spark, con, tmp_path, monkeypatch):
    """A file holds hundreds of documents of all titles; it was nearly one per document."""
    monkeypatch.setattr(files, "scratch_path", lambda s, name: str(tmp_path / name))
    ok, msg = check.compare(spark, con, SF, "read_kb", registry.QUERIES["read_kb"], registry.ORACLES["read_kb"])
    assert ok, msg
    written = [f for _, _, names in os.walk(tmp_path / "kb") for f in names if f.startswith("part-")]
    assert 1 <= len(written) <= -(-spark.read.parquet(f"{SF}/documents.parquet").count() // files.KB_FILE) + 1


def test_small_graphs_close_in_one_step(spark, monkeypatch):
    """Rounds of jobs for some edges overran the driver's memory; the components are those of the rounds."""
    import random

    from gridweave.operators import components

    rng = random.Random(5)
    rows = [(f"k{i % 3}", a, b) for i in range(400) for a, b in [(rng.randrange(300), rng.randrange(300))]] + [("k0", 1000 + i, 1001 + i) for i in range(200)]
    e = spark.createDataFrame(rows, "k string, src long, dst long")
    nodes = e.selectExpr("k", "src as node").unionByName(e.selectExpr("k", "dst as node"))
    cuts, real = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or real(df))
    one = {tuple(r) for r in components.connected_components(nodes, e, ["k"]).collect()}
    assert len(cuts) <= 3
    monkeypatch.setattr(components, "CLOSED", 0)
    assert one == {tuple(r) for r in components.connected_components(nodes, e, ["k"]).collect()}


def test_expansion_follows_an_edge_once_for_many_queries(spark):
    """Queries travel as bits: 200 that ask the same share rows; the terms are those of each query alone."""
    from pyspark.sql import functions as F

    from gridweave.operators import retrieval as rt

    rel = spark.createDataFrame([("castle", "moat", 1), ("moat", "water", 2), ("castle wall", "stone", 1), ("stone", "quarry", 1)], "entity string, target string, n long")
    con = spark.createDataFrame([(w, 1, "t") for w in ("castle", "moat", "water", "stone", "quarry", "castles")], "concept string, doc_id long, title string")
    q = spark.createDataFrame([(i, "Castle wall and gate" if i % 2 else "water") for i in range(200)], "query_id long, text string")
    numbered = rt._numbered(q, ["query_id"])
    assert rt._packed(rt.query_words(q, ["query_id"]), numbered, ["query_id"], "word").where("term = 'castle'").count() <= 200 // rt.BITS + 1
    got = {r.query_id: tuple(sorted(r.t)) for r in rt.expand(q, rel, con).groupBy("query_id").agg(F.collect_list("term").alias("t")).collect()}
    # 'castle' reaches itself again by the second hop but is the query's own word.
    assert got == {i: ("castles", "moat", "quarry", "stone", "water") if i % 2 else ("castle", "moat") for i in range(200)}


def test_terms_are_counted_where_they_lie(spark):
    """No shuffle to count a passage's terms, unless ids repeat; counts are those of the terms."""
    from collections import Counter

    from gridweave.operators import postings

    rows = [(i, [f"w{(i * j) % 7}" for j in range(i % 40)]) for i in range(1200)]
    toks = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    got = postings._counted(toks)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(i, len(t), w, n) for i, t in rows for w, n in Counter(t).items()}
    assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want
    twice = postings._counted(toks.unionByName(toks)).collect()
    assert {tuple(r) for r in twice} == {(i, d, w, 2 * n) for i, d, w, n in want} and len(twice) == len(want)


def test_boosted_scores_round_halves_up(spark):
    """Scores on an exact half followed the last bit of a sum; here every sum is compared with whole numbers."""
    from gridweave.operators import retrieval as rt

    best = [1_000_010 + 10 * i for i in range(300)]
    q = spark.createDataFrame([(i, "castle") for i in range(300)], "query_id long, text string")
    scores = spark.createDataFrame([(i, 1, b / 1e6) for i, b in enumerate(best)], "query_id long, doc_id long, score double")
    rel = spark.createDataFrame([("castle", "moat", 3)], "entity string, target string, n long")
    con = spark.createDataFrame([("moat", 1, "t"), ("moat", 2, "t")], "concept string, doc_id long, title string")
    got = {(r.query_id, r.doc_id): round(r.score * 1e6) for r in rt.kb_boost(q, scores, rel, con).collect()}
    assert got == {(i, d): (100 * b * (d == 1) + 45 * b + 50) // 100 for i, b in enumerate(best) for d in (1, 2)}


def test_pixels_travel_as_pieces_of_lines(spark):
    """Every pixel was shuffled, twice and more; now pieces are, once.  Results are those of sorted cells, whatever their order."""
    import random
    from itertools import groupby

    from gridweave.operators import grid as g

    rng = random.Random(4)
    some = ["a", "a", "a", "#", "é", "𝄞", "ab", "", None, "\n", "1"]
    rows = [(t or None, y, x - 2, rng.choice(some[:rng.choice([2, 5, 11])])) for t in range(12) for y in range(3) for x in range(rng.randrange(1, 20)) if rng.random() < 0.95]
    twice = [(1, 0, 4, "z"), (1, 0, 4, "b")]
    grids, coded = {}, {}
    for t, mine in groupby(sorted(rows, key=lambda r: (r[0] or 0, *r[1:3])), lambda r: r[0]):
        lines = [[r[3] for r in line] for _, line in groupby(mine, lambda r: r[1])]
        grids[t] = "\n".join("".join(s or "" for s in line) for line in lines)
        text = []
        for line in lines:
            runs = []
            for s in line:
                if runs and s is not None and runs[-1][0] == s:
                    runs[-1][1] += 1
                else:
                    runs.append([s, 1])
            text.append(" ".join(s if len(s) == 1 and n == 1 else f"{n}{s}" if len(s) == 1 else f"{n}:{s}" for s, n in runs if s is not None))
        coded[t] = "\n".join(text)
    px = spark.createDataFrame(rows, "tile_id long, y int, x int, sym string")
    for p in (px.coalesce(1), px.repartition(3, "x")):
        assert {r.tile_id: r.grid for r in g.to_grid(p).collect()} == grids
        assert {r.tile_id: r.rle for r in g.pixels_to_rle(p).collect()} == coded
    over = spark.createDataFrame([(1, 0, x, "a") for x in range(6)] + twice, "tile_id long, y int, x int, sym string")
    assert g.to_grid(over).first().grid == "aaaaabza"
    t = spark.createDataFrame([(i, "\n".join(["aab" * 6] * 9)) for i in range(40)], "tile_id long, grid string")
    for out in (g.to_grid(g.to_pixels(t)), g.pixels_to_rle(g.to_pixels(t))):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert g._lines(g.to_pixels(t), ("tile_id",)).selectExpr("sum(size(_s)) AS n").first().n == 40 * 9


def test_order_digest_gathers_packed_pieces(spark, monkeypatch):
    """A split's rows and sort keys met in one task; packed pieces do now, and the digest is that of the sorted texts."""
    import hashlib

    monkeypatch.setattr(files, "PIECE_ROWS", 7)
    rows = [("ab"[i % 2], f"{i * 7919 % 1000:04d}é") for i in range(400)] + [("a", None), ("b", ""), ("none", None)]
    df = spark.createDataFrame(rows, "split string, value string").repartition(5).orderBy("split", "value")
    got = {r.split: (r.n, r.order_digest) for r in files.order_digest(df, ["split"], "value").collect()}
    text = lambda k: ",".join(sorted(v for s, v in rows if s == k and v is not None))
    assert got == {k: (sum(s == k for s, _ in rows), hashlib.md5(text(k).encode()).hexdigest()) for k in "ab"} | {"none": (1, None)}
    assert "collect_list" not in registry.QUERIES["merge_splits"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_themes_are_dealt_by_rows(spark, monkeypatch):
    """A table of themes is one small file, and one task sorted all its chains; a task has a bounded number now."""
    from gridweave.operators import definitions as df_

    monkeypatch.setattr(df_, "THEME_ROWS", 10)
    rows = [(f"set{i // 4}", f"th{i % 4}", "base", f"th{i % 4 - 1}" if i % 4 else None, i if i % 4 == 1 else None, {"bg": str(i % 10)}) for i in range(300)]
    themes = spark.createDataFrame(rows, "tileset_id string, name string, palette string, extends string, scale int, roles map<string,string>").selectExpr(
        "*", "null AS canvas", "null AS max_palette_size", "null AS light_source").coalesce(1)
    got = df_.resolve_themes(themes)
    assert got.rdd.getNumPartitions() >= 300 // 10
    want = {(f"set{i // 4}", f"th{i % 4}"): (i - i % 4 + 1 if i % 4 else 1, str(i % 10), "ok") for i in range(300)}
    assert {(r.tileset_id, r.name): (r.scale, r.roles["bg"], r.status) for r in got.collect()} == want


def test_conversion_computes_pixels_once(spark):
    """The resampled pixels were computed for each of three readers, and every image's colours were cut in a call of its own."""
    from gridweave import fixtures as fx
    from gridweave.operators import image as im

    px = fx.images(spark, SF).where("image_id < 6")
    plan = im.convert(px, [("tiny", 4, 4), ("full", 8, 8)])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "InPandas" not in plan
    plan = im.median_cut(px, "image_id", 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
    got = {}
    for r in im.median_cut(px, "image_id", 4).collect():
        got.setdefault(r.image_id, {})[r.pos] = (r.r, r.g, r.b)
    for i, mine in px.where("a > 0").groupBy("image_id", "r", "g", "b").count().toPandas().groupby("image_id"):
        want = im._cut(mine[["r", "g", "b"]].to_numpy("int64"), mine["count"].to_numpy("int64"), 4)
        assert [got[i][k] for k in sorted(got[i])] == [tuple(c) for c in want.tolist()]


def test_rules_read_each_grid_once(spark):
    """Every rule folded and cut all texts again, for sizes too; one pass outlines the grids, and the outline is that of their cells."""
    from pyspark.sql import functions as F

    from gridweave.functions.grids import cells_of
    from gridweave.operators import audit
    from gridweave.plans import audits

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    ts = audits.tables(spark, SF)
    assert "translate" not in plan(audit.validate(ts))
    for rule in (audit.v_size, audit.v_rotate_square, audit.v_rle):
        assert "translate" not in plan(rule(ts))
    grids = ["##\n##", "#. \n+", "", "\n\n", "  ", "é𝄞\n𝄞𝄞é", "a\tb\n\t", " #\n#  \n\n.", None]
    t = spark.createDataFrame([(i, g, None, None) for i, g in enumerate(grids)], "name int, grid string, rle string, layout string")
    rows = F.filter(F.transform(F.split("grid", "\n"), lambda r: F.rtrim(r)), lambda r: r != "")
    want = t.select("name", F.size(rows).alias("rows"), F.array_sort(F.array_distinct(F.transform(rows, F.length))).alias("widths"),
                    F.array_sort(F.array_distinct(cells_of(F.array_join(rows, "")))).alias("syms"))
    got = {r.name: r for r in audit.outlined(t).collect()}
    for r in want.collect():
        mine = got[r.name]
        assert (mine.rows, mine.widths, mine.syms and set(mine.syms)) == ((r.rows, r.widths, set(r.syms)) if grids[r.name] is not None else (None, None, None))
    assert [r.name for r in audit.outlined(t).where(~audit.has_pixels(audit.outlined(t))).collect()] == [len(grids) - 1]


def test_few_queries_scan_the_terms(spark, monkeypatch):
    """Some dozen queries wrote a whole index; the scan finds what the index finds, whatever its limits."""
    import random

    from pyspark.sql import functions as F

    from gridweave.operators import postings, retrieval as rt, scan

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)] + ["é𝄞", "ß"]
    words = lambda n: [vocab[min(int(rng.paretovariate(0.6)) - 1, len(vocab) - 1)] for _ in range(n)]
    docs = spark.createDataFrame([(i, words(rng.randrange(0, 60))) for i in range(400)] + [(1000, []), (1001, None)], "doc_id long, terms array<string>")
    queries = spark.createDataFrame([(i, words(1 + i % 9) + ["absent"]) for i in range(2 * scan.BITS + 5)], "query_id long, terms array<string>")
    rows = lambda r: {(x.query_id, x.doc_id): (round(x.score, 4), x["rank"]) for x in r.collect()}
    q = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    index = postings.write(docs, F.col("terms"))
    want = rows(postings.search(q, index, 4, ["query_id"]))
    found = scan.texts(docs)
    # The number of passages counts those without terms, as in the index.
    assert found.n_docs == index.n_docs and len(want) > 400
    assert rows(rt.bm25(queries, found, 4)) == want
    for name in ("HOT", "FEW", "PATTERNS"):
        monkeypatch.setattr(scan, name, 0)
    assert rows(rt.bm25(queries, found, 4)) == want
    monkeypatch.setattr(scan, "MOST_BITS", scan.ROW_BITS)
    monkeypatch.setattr(scan, "HOT", 20)
    assert rows(rt.bm25(queries, found, 4)) == want
    assert scan.texts(docs.unionByName(docs)) is None


def test_transition_context_writes_no_index(spark, con, monkeypatch):
    """An index of all terms was written for twenty queries, and passages were digested for every tile."""
    from gridweave.operators import postings, prompts

    def never(*_):
        raise AssertionError("an index is written or whole prompts are made")

    monkeypatch.setattr(postings, "write", never)
    monkeypatch.setattr(prompts, "transition_context", never)
    ok, msg = check.compare(spark, con, SF, "transition_context", registry.QUERIES["transition_context"], registry.ORACLES["transition_context"])
    assert ok, msg


def test_prompts_are_digested_from_their_passages_on(spark, monkeypatch):
    """The digests are those of the whole prompts, with passages, without and with blank ones."""
    import hashlib

    from gridweave.operators import prompts as pr

    sets = {"A": "[t] é𝄞 notes", "B": None, "C": ""}
    grid = "\n".join("#+.g" * 4 for _ in range(16))
    tiles = spark.createDataFrame([(s, f"t{i}", None if i == 1 else f"n{i}", "e", "s", "w", "16x16", grid.replace("+", str(i))) for s in "ABCD" for i in range(3)],
                                  "tileset_id string, name string, n string, e string, s string, w string, size string, grid string")
    pairs = spark.createDataFrame([(i, s, f"t{i}", f"t{i + 1}") for s in "ABCD" for i in range(2)], "pair_id long, tileset_id string, a string, b string")
    notes = spark.createDataFrame([*sets.items()], "tileset_id string, knowledge_text string")
    whole = pr.transition_context(pairs, tiles, notes).collect()
    want = {(r.tileset_id, r.pair_id, r.a, r.b, r.n, r.e, r.s, r.w, hashlib.md5(r.user_prompt.encode()).hexdigest()) for r in whole}
    got = pr.transition_digests(pairs, tiles, notes)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and len(want) == 8
    assert {(r.tileset_id, r.pair_id, r.a, r.b, r.n, r.e, r.s, r.w, r.user_digest) for r in got.collect()} == want
    monkeypatch.setattr(pr, "HELD", 0)
    assert {(r.tileset_id, r.pair_id, r.a, r.b, r.n, r.e, r.s, r.w, r.user_digest) for r in pr.transition_digests(pairs, tiles, notes).collect()} == want


def test_first_rows_of_tiles(spark):
    """Only the rows asked for are folded; they are those of the whole tiles."""
    from gridweave import fixtures as fx
    from gridweave.operators import prompts as pr

    some = fx.tiles(spark, SF, 4).select("tile_id", "tileset_id", "theme", "doc_id", "grid").collect()
    assert sorted(some) == sorted(fx.tiles(spark, SF).select("tile_id", "tileset_id", "theme", "doc_id", pr.preview().alias("grid")).collect())


def _with(tmp_path, con, name, sql):
    """The small tables with one of them replaced, and a connection to them."""
    d = tmp_path / "tables"
    d.mkdir()
    for f in os.listdir(SF):
        if f != f"{name}.parquet":
            os.symlink(f"{SF}/{f}", d / f)
    con.execute(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return str(d), check.connect(str(d))


@pytest.mark.parametrize("docs", [
    "SELECT * REPLACE (doc_id + doc_id // 50 AS doc_id) FROM documents", "SELECT * REPLACE (doc_id // 2 AS doc_id) FROM documents",
    "SELECT * REPLACE (n_chars + 4000 AS n_chars) FROM documents"], ids=["gaps", "repeated ids", "shorter texts"])
def test_training_stats_count_events_of_missing_and_repeated_tiles(spark, con, tmp_path, docs):
    """Events were joined with the tiles: one without a tile was no pair, one of a repeated tile counted again."""
    d, own = _with(tmp_path, con, "documents", docs)
    ok, msg = check.compare(spark, own, d, "fb_training_stats", registry.QUERIES["fb_training_stats"], registry.ORACLES["fb_training_stats"])
    assert ok, msg


@pytest.mark.parametrize("name", ["kb_fuse", "kb_boost", "kb_search", "prompt_context"])
def test_expanded_searches_write_no_index(spark, con, monkeypatch, name):
    """Two hundred queries that grow to most of the vocabulary were looked up in an index written for them."""
    from gridweave.operators import postings

    def none(*_):
        raise AssertionError("an index was written")

    monkeypatch.setattr(postings, "write", none)
    ok, msg = check.compare(spark, con, SF, name, registry.QUERIES[name], registry.ORACLES[name])
    assert ok, msg


def test_first_rows_of_a_group_are_limited_before_they_move(spark):
    """Salted groups kept up to ``k`` rows of each salt and task; without salts a task sends ``k`` of each group."""
    from gridweave.operators.ranking import top_k
    from pyspark.sql import functions as F

    df = spark.range(8000, numPartitions=4).select((F.col("id") % 3).alias("q"), F.pmod(F.hash("id"), F.lit(500)).alias("s"), "id")
    order = [F.desc("s"), F.col("id")]
    one, salted = top_k(df, ["q"], order, 5, salts=1), top_k(df, ["q"], order, 5)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, salted.collect()))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") == 1 and "xxhash64" not in plan


def test_variants_are_counted_without_a_join_or_their_draws(spark, con):
    """The tiles were cut twice and shuffled to their variants, and each variant drew its digests though no grid was read."""
    q = registry.QUERIES["variants"](spark, SF)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and "md5" not in plan
    ok, msg = check.compare(spark, con, SF, "variants", lambda *_: q, registry.ORACLES["variants"])
    assert ok, msg
