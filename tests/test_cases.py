"""Small literal cases and properties."""

import math
import struct
import zlib
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.functions import labels
from gridweave.functions.grids import grid_text, rotate_rows, rows_of
from gridweave.operators import adjacency as adj
from gridweave.operators import audit, components, containment, dataset, definitions, feedback, image, maps, postings, ranking, retrieval, style, variants
from gridweave.operators import features as ft
from gridweave.operators import grid as g
from gridweave.operators.lookup import lookup


def tiles(spark, *grids):
    return spark.createDataFrame([(i, v) for i, v in enumerate(grids)], "tile_id bigint, grid string")


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_rotations_close(spark):
    t = tiles(spark, "ab.\n#cd").withColumn("r", rows_of(F.col("grid")))
    for _ in range(4):
        t = t.withColumn("r", rotate_rows(F.col("r"), 1))
    assert one(t.withColumn("g", grid_text(F.col("r"))), "g") == [("ab.\n#cd",)]
    assert one(t.select(grid_text(rotate_rows(F.col("r"), 1)).alias("g")), "g") == [("#a\ncb\nd.",)]


def test_long_and_compact_forms_agree(spark):
    t = tiles(spark, "aab\n..b\nccc", "#\n#")
    assert dict(one(g.to_grid(g.to_pixels(t)), "tile_id", "grid")) == {0: "aab\n..b\nccc", 1: "#\n#"}
    a = dict(one(g.rle_encode(t), "tile_id", "rle"))
    b = dict(one(g.pixels_to_rle(g.to_pixels(t)), "tile_id", "rle"))
    assert a == b and a[0] == "2a b\n2. b\n3c"
    back = g.to_grid(g.rle_decode(g.rle_encode(t)))
    assert dict(one(back, "tile_id", "grid")) == {0: "aab\n..b\nccc", 1: "#\n#"}


def test_extended_rle(spark):
    t = spark.createDataFrame([(1, "2:2a 1:b #")], "tile_id bigint, rle string")
    assert sorted(one(g.rle_decode(t), "x", "sym")) == [(0, "2a"), (1, "2a"), (2, "b"), (3, "#")]


def test_rejected_run_length_tokens(spark):
    t = spark.createDataFrame([(1, "2a 0b xx 3\n x9  1:q\n\n99999999999z é")], "tile_id bigint, rle string")
    assert sorted(one(g.rle_decode(t), "y", "x", "sym")) == [(0, 0, "a"), (0, 1, "a"), (1, 0, "q"), (3, 0, "é")]
    assert sorted(one(g.rle_rejected(t), "y", "i", "tok")) == [(0, 1, "0b"), (0, 2, "xx"), (0, 3, "3"), (1, 0, "x9"), (3, 0, "99999999999z")]


def test_features_of_odd_and_void_tiles(spark):
    f = {r["tile_id"]: r for r in ft.tile_features(tiles(spark, "aba\n...\naba", "..\n..", "ab")).collect()}
    assert f[0]["symmetry_h"] == 1.0 and f[0]["symmetry_v"] == 1.0 and f[0]["density"] == pytest.approx(6 / 9)
    assert f[0]["dominant_symbol"] == "a" and f[0]["unique_symbols"] == 2
    assert f[1]["dominant_symbol"] == "." and f[1]["dominant_ratio"] == 1.0 and f[1]["edge_complexity"] == 0
    assert f[2]["symmetry_h"] == 0.0 and f[2]["symmetry_v"] == 0.0 and f[2]["edge_complexity"] == 1.0


def test_edge_classes(spark):
    t = ft.classify_edges(ft.edges(tiles(spark, "####\n#..+\n#..+\n....")))
    r = t.collect()[0]
    assert (r["edge_n"], r["edge_e"], r["edge_s"], r["edge_w"]) == ("####", "#++.", "....", "###.")
    assert r["class_n"] == "solid_#" and r["class_s"] == "open" and r["class_w"] == "edge_#"
    assert r["class_e"].startswith("mixed_")


ROOM = ["wall wall wall wall", "wall floor floor wall", "wall floor floor_90 wall", "wall wall wall wall"]


def room_cells(spark, rows, map_id=1):
    c = [(map_id, x, y, t) for y, row in enumerate(rows) for x, t in enumerate(row.split())]
    aff = spark.createDataFrame([("wall", "obstacle"), ("floor", "walkable")], "tile string, affordance string")
    return maps.with_affordance(spark.createDataFrame(c, "map_id bigint, x bigint, y bigint, tile string"), aff)


def test_walled_room(spark):
    r = maps.map_quality(maps.map_features(room_cells(spark, ROOM))).collect()[0]
    assert (r["wall_ratio"], r["walkable_ratio"], r["room_count"], r["largest_room"]) == (0.75, 0.25, 1.0, 4)
    assert r["border_solidity"] == 1.0 and r["connectivity"] == 1.0 and r["quality"] == 1.5 and r["transition_count"] == 8


def test_one_row_map_counts_its_border_twice(spark):
    r = maps.map_features(room_cells(spark, ["wall floor wall"])).collect()[0]
    assert r["border_solidity"] == pytest.approx(4 / 6)


def brute_rooms(cells):
    todo, sizes = set(cells), []
    while todo:
        q, n = deque([todo.pop()]), 0
        while q:
            x, y = q.popleft()
            n += 1
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in todo:
                    todo.remove(p)
                    q.append(p)
        sizes.append(n)
    return sorted(sizes)


def test_rooms_across_blocks_match_brute_force(spark):
    rng = np.random.default_rng(3)
    cells = [(int(x), int(y)) for y, x in zip(*np.nonzero(rng.random((23, 31)) < 0.62))]
    df = spark.createDataFrame([(1, x, y) for x, y in cells], "map_id bigint, x bigint, y bigint")
    want = brute_rooms(cells)
    for lab in (maps.label_rooms(df, block=8), maps.label_rooms(df), maps.label_rooms_join(df)):
        got = Counter(r["room"] for r in lab.collect())
        assert sorted(got.values()) == want
    a = {(r["x"], r["y"]): r["room"] for r in maps.label_rooms(df, block=8).collect()}
    b = {(r["x"], r["y"]): r["room"] for r in maps.label_rooms_join(df).collect()}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(a) == groups(b)


def test_long_chain_component(spark):
    n = 200
    e = spark.createDataFrame([("g", i, i + 1) for i in range(n)] + [("h", 5, 6)], "k string, src bigint, dst bigint")
    nodes = e.select("k", F.explode(F.array("src", "dst")).alias("node"))
    got = {(r["k"], r["comp"]) for r in components.connected_components(nodes, e, ["k"]).collect()}
    assert got == {("g", 0), ("h", 5)}


EDGE = "tileset_id int, name string, n string, e string, s string, w string, ne string, se string, sw string, nw string"


def test_wall_floor_transition(spark):
    t = spark.createDataFrame([(0, "wall", *["solid"] * 4, *[None] * 4), (0, "floor", *["floor"] * 4, *[None] * 4),
                               (0, "step", "solid", "solid", "floor", "solid", *[None] * 4)], EDGE)
    got = {(r["a"], r["dir"], r["b"]) for r in adj.adjacency(t).collect()}
    assert ("step", "s", "floor") in got and ("step", "n", "wall") in got and ("floor", "n", "step") in got
    assert not any({a, b} == {"wall", "floor"} for a, _, b in got)
    deg = {(r["name"], r["dir"]): r["degree"] for r in adj.adjacency_degree(t).collect()}
    assert all(deg[k] == sum(1 for a, d, _ in got if (a, d) == k) for k in deg)


def test_corner_rule_tests_one_corner(spark):
    t = spark.createDataFrame([(0, "a", *["x"] * 4, "p", "q", "r", "s"), (0, "b", *["x"] * 4, "p", "q", "r", "s")], EDGE)
    got = {(r["a"], r["dir"], r["b"]) for r in adj.adjacency(t).collect()}
    assert got == set()  # counter-clockwise corner never equals the clockwise one here


def test_three_classes_one_isolated(spark):
    rows = [(0, "a", "wall", "wall", "floor", "wall"), (0, "b", "water", "water", "water", "water")]
    t = spark.createDataFrame([(*r, *[None] * 4) for r in rows], EDGE)
    c = adj.edge_components(t)
    r = adj.completeness(c).collect()[0]
    assert (r["n_classes"], r["connected"], r["disconnected"]) == (3, 1, 2)
    assert {r["name"] for r in adj.missing_tiles(c).collect()} == {"transition_floor_water", "transition_wall_water"}
    single = spark.createDataFrame([(1, "s", *["x"] * 4, *[None] * 4)], EDGE)
    assert adj.completeness(adj.edge_components(single)).collect()[0]["score"] == 0


def test_autotile_table(spark):
    m = spark.range(256).select(F.lit(1).alias("map_id"), maps.clean_mask(F.col("id").cast("int")).alias("mask"), "id")
    got = {r["id"]: r["tile_index"] for r in maps.autotile_index(m).collect()}
    assert len(set(got.values())) == 47 and got[0] == 0 and got[255] == 46


def test_feedback_rules(spark):
    ev = [(i, "k", "accept", None, 0.8) for i in range(5)] + [(9 + i, "k", "reject", "too_dense", 0.2) for i in range(3)] + [(20, "k", "reject", "other(x)", None)]
    fb = spark.createDataFrame(ev, "event_id bigint, tileset_id string, action string, reject_reason string, style_score double")
    s = feedback.fb_threshold(feedback.fb_stats(fb, ["tileset_id"])).collect()[0]
    assert s["threshold"] == pytest.approx(0.64) and s["acceptance"] == pytest.approx(5 / 9)
    assert [r["reason"] for r in feedback.fb_avoid(fb).collect()] == ["too_dense"]


def test_style_of_own_reference(spark):
    pal = spark.createDataFrame([(".", 0, 0, 0), ("#", 20, 20, 30), ("+", 200, 220, 240)], "sym string, r int, g int, b int")
    t = tiles(spark, "##+.\n##+.\n+++.\n....", "++++\n++++\n++++\n++++")
    lat = style.style_latent(t, pal, ["tile_id"])
    ref = lat.where("tile_id = 0").drop("tile_id")
    s = {r["tile_id"]: r["style_score"] for r in style.style_score(lat, ref).collect()}
    assert s[0] > 0.9 and s[1] < s[0]


def test_splits_and_caps(spark):
    df = spark.range(1000).withColumnRenamed("id", "tile_id")
    e = Counter(r["split"] for r in dataset.split(df, ["tile_id"], mode="exact").collect())
    assert e == {"train": 900, "valid": 50, "test": 50}
    f = df.select("tile_id", F.lit(0.99).alias("density"), (F.col("tile_id") % 2 * 0.5).alias("edge_complexity"))
    s = dataset.stratify(f, 7, ["tile_id"])
    assert Counter((r["d_bin"], r["e_bin"]) for r in s.collect()) == {(4, 0): 7, (4, 2): 7}
    hot = ranking.top_k(df.withColumn("k", F.lit(1)), ["k"], [F.desc("tile_id")], 3)
    assert sorted(r["tile_id"] for r in hot.collect()) == [997, 998, 999]


def test_elites_keep_old_on_ties(spark):
    cols = "map_id bigint, theme string, wall_ratio double, room_count int, quality double"
    old = dataset.elites(spark.createDataFrame([(5, "t", 0.5, 2, 1.2)], cols))
    tie = dataset.merge_elites(old, spark.createDataFrame([(1, "t", 0.5, 2, 1.2)], cols)).collect()
    better = dataset.merge_elites(old, spark.createDataFrame([(1, "t", 0.5, 2, 1.3)], cols)).collect()
    assert [r["map_id"] for r in tie] == [5] and [r["map_id"] for r in better] == [1]


def test_lanczos_matches_a_plain_sum(spark):
    vals = np.array([[10, 200, 30, 90, 120, 60], [5, 80, 250, 40, 70, 220]], dtype=float)
    px = spark.createDataFrame([(1, x, y, int(vals[y, x]), 0, 0, 255) for y in range(2) for x in range(6)], "image_id int, x int, y int, r int, g int, b int, a int")
    got = {(r["x"], r["y"]): r["r"] for r in image.resample(px, ["image_id"], F.lit(3), F.lit(2), "lanczos3").collect()}

    def weights(src, dst, i):
        ratio, scale = src / dst, max(src / dst, 1)
        c = (i + 0.5) * ratio
        t = (np.arange(src) + 0.5 - c) / scale
        w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0)
        return w / w.sum()

    for x in range(3):
        for y in range(2):
            want = weights(2, 2, y) @ vals @ weights(6, 3, x)
            assert got[x, y] == int(np.floor(min(max(round(want, 9), 0), 255) + 0.5))


def test_median_cut_splits_two_clusters():
    out = image._cut(np.array([[0, 0, 0], [10, 0, 0], [250, 0, 0], [240, 0, 0]]), np.array([1, 1, 1, 1]), 2)
    assert sorted(map(tuple, out.tolist())) == [(5, 0, 0), (245, 0, 0)]
    weighted = image._cut(np.array([[0, 0, 0], [100, 0, 0]]), np.array([3, 1]), 2)
    assert sorted(map(tuple, weighted.tolist())) == [(0, 0, 0), (50, 0, 0)]


def test_contains_join_matches_brute_force(spark):
    hay, needle = ["torchlight", "nes", "stone wall", "ab"], ["torch", "light", "nes", "wall", "e w", "ne"]
    h = spark.createDataFrame([(v,) for v in hay], "h string")
    n = spark.createDataFrame([(v,) for v in needle], "n string")
    got = {(r["h"], r["n"]) for r in containment.contains_pairs(h, n, "h", "n").collect()}
    assert got == {(a, b) for a in hay for b in needle if len(b) >= 3 and b in a}


def test_frames_build_on_earlier_frames_as_shown(spark):
    rows = [("a", 1, "grid", "#.\n..", None, None, "h", None), ("a", 2, "linked", None, None, None, None, None),
            ("a", 3, "delta", None, 2, None, "vh", [(0, 0, "+"), (9, 0, "+")]), ("a", 4, "delta", None, 9, None, None, [])]
    rows += [("a", i, "linked", None, None, i - 1, None, None) for i in range(5, 6)]
    rows += [("b", 1, "grid", "ab", None, None, None, None)] + [("b", i, "linked", None, None, i - 1, None, None) for i in range(2, 15)]
    f = spark.createDataFrame([("s", sp, i, i, *rest) for sp, i, *rest in rows], "spriteset string, sprite string, ord int, index int, encoding string, "
                              "grid string, base int, link_to int, mirror string, changes array<struct<x:int,y:int,sym:string>>").withColumn("duration_ms", F.lit(None).cast("int"))
    got = {(r.sprite, r["index"]): (r.grid, r.duration_ms) for r in definitions.resolve_grids(f).collect()}
    assert {i: g for (sp, i), (g, _) in got.items() if sp == "a"} == {1: ".#\n..", 2: ".#\n..", 3: "..\n#+"}
    assert [got["b", i] for i in range(1, 15)] == [("ab", 125)] * 14
    assert {(r.sprite, r["index"]) for r in definitions.frame_errors(f).collect()} == {("a", 4), ("a", 5)}
    assert definitions.resolve_frames(f).where("sprite = 'a'").count() == 12


def test_cycle_shift_modes(spark):
    def seq(direction, legacy=False):
        df = spark.range(7).select("id", definitions.cycle_shift(F.lit(3), F.lit(direction), F.col("id"), legacy).alias("s"))
        return [r["s"] for r in df.orderBy("id").collect()]

    assert seq("forward") == [0, 1, 2, 0, 1, 2, 0] and seq("backward") == [0, 2, 1, 0, 2, 1, 0]
    assert seq("ping-pong") == [0, 1, 2, 1, 0, 1, 2] and seq("ping-pong", True) == [0, 1, 2, 0, 1, 2, 0]


def test_tile_refs(spark):
    df = spark.createDataFrame([("wall!hd:hi",), ("wall:glow",), ("wall",)], "r string").select(definitions.parse_ref(F.col("r")).alias("p"))
    got = [tuple(r) for r in df.select("p.*").collect()]
    assert got == [("wall", True, False, True, "highlight"), ("wall:glow", False, False, False, None), ("wall", False, False, False, None)]


def test_rule_parsing(spark):
    r = spark.createDataFrame([("affordance:a forbids type:b adjacent",), ("affordance:a likes affordance:b",)], "rule string")
    assert one(maps.parse_rules(r), "kind", "source", "target") == [("forbids", "a", "b")]


def test_variants_repeat_and_keep_borders(spark):
    pal = spark.createDataFrame([("#", 1, 1, 1), ("+", 9, 9, 9)], "sym string, r int, g int, b int")
    t = tiles(spark, "\n".join(["#+#+#+#+"] * 8), "........\n" * 8)
    a, b = (sorted(one(variants.vary(t, 6, 1, pal), "name", "mutation", "grid")) for _ in range(2))
    assert a == b and len(a) == 6
    for _, kind, grid in a:
        rows = grid.split("\n")
        assert len(rows) == 8 and all(len(r) == 8 for r in rows) and rows[0] == "#+#+#+#+" and rows[7] == "#+#+#+#+", kind


def test_prompt_labels(spark):
    df = spark.createDataFrame([("A tight dungeon with many rooms",)], "t string").select(labels.prompt_label(F.col("t"), F.lit("x"), F.lit("8x8")).alias("l"))
    assert df.collect()[0]["l"] == "theme:x, size:8x8, layout:dense, rooms:many, border:enclosed"


def test_grid_extract_fallback(spark):
    df = spark.createDataFrame([("text here\n##..\n..##\nend\n####",), ("a\n```\nab\ncd\n```",), ("none",)], "t string")
    assert [r["extracted"] for r in dataset.extract_grid(df, "t", 4).collect()] == ["##..\n..##", "ab\ncd", "none"]


def png(path, w, h, rgba):
    raw = b"".join(b"\x00" + bytes(v for x in range(w) for v in rgba[y][x]) for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_images(spark, tmp_path):
    from gridweave.sources.readers import read_images

    (tmp_path / "set1").mkdir()
    png(tmp_path / "set1" / "a.png", 2, 1, [[(1, 2, 3, 255), (9, 8, 7, 0)]])
    (tmp_path / "set1" / "broken.png").write_bytes(b"not an image")
    got = sorted(one(read_images(spark, str(tmp_path)), "tileset_id", "x", "y", "r", "g", "b", "a"))
    assert [r[:3] for r in got] == [("set1", 0, 0), ("set1", 1, 0)] and got[0][3:] == (1, 2, 3, 255) and got[1][6] == 0


def test_validate_reports_everything(spark):
    from gridweave.plans import audits

    v = audit.validate(audits.tables(spark, "/root/testdata/sf0.001"))
    rules = {r["rule"] for r in v.select("rule").distinct().collect()}
    assert {"palette_ref", "size", "pixels", "rle", "template", "theme", "cycle"} <= rules


def test_rooms_meet_across_zero(spark):
    df = spark.createDataFrame([(1, x, 0) for x in (-1, 0, 1)] + [(1, 0, y) for y in (-9, -8, -7)], "map_id int, x int, y int")
    for lab in (maps.label_rooms(df), maps.label_rooms(df, block=8), maps.label_rooms_join(df)):
        assert sorted(r["n"] for r in lab.groupBy("room").agg(F.count("*").alias("n")).collect()) == [3, 3]


def test_names_stay_in_their_tileset(spark):
    rows = [("A", "dark", "pa", None, 2), ("B", "dark", "pb", None, 3), ("B", "leaf", "pb", "dark", None), ("A", "leaf2", "pa", "leaf", None)]
    theme = spark.createDataFrame(
        [(*r, None, None, None, {"bg": "#"}) for r in rows],
        "tileset_id string, name string, palette string, extends string, scale int, canvas int, max_palette_size int, light_source string, roles map<string,string>")
    got = {(r["tileset_id"], r["name"]): (r["palette"], r["scale"], r["status"]) for r in definitions.resolve_themes(theme).collect()}
    assert got == {("A", "dark"): ("pa", 2, "ok"), ("B", "dark"): ("pb", 3, "ok"), ("B", "leaf"): ("pb", 3, "ok"), ("A", "leaf2"): ("pa", 1, "missing")}

    palette = spark.createDataFrame([("B", "base", "#"), ("C", "base", "#"), ("C", "base", "+")], "tileset_id string, palette string, sym string")
    tile = spark.createDataFrame([(s, "t", "base", "2x1", "#+") for s in "ABC"], "tileset_id string, name string, palette string, size string, grid string")
    tile = tile.withColumns({c: F.lit(None).cast("string") for c in ("template", "rle", "layout", "symmetry")})
    ts = {"palette": palette, "tile": tile, "stamp": tile}
    assert {(r["tileset_id"], r["entity_type"]) for r in audit.v_palette_ref(ts).collect()} == {("A", "tile"), ("A", "stamp")}
    assert [(r["tileset_id"], r["detail"]) for r in audit.v_symbols(ts).collect()] == [("B", "+")]

    req = spark.createDataFrame([(1, "A", 3, 3), (2, "B", 3, 3)], "map_id int, tileset_id string, w int, h int")
    preds = req.select("map_id", F.lit(0).alias("ord"), F.lit("region:r:wall:1x1").alias("rule"))
    tiles = spark.createDataFrame([("A", "a", 2, "wall"), ("B", "b", 1, "wall"), ("C", "wall", 0, None)], "tileset_id string, name string, idx int, affordance string")
    assert {(r["map_id"], r["tile"]) for r in maps.expand_pins(req, preds, tiles).collect()} == {(1, "a"), (2, "b")}


def test_knowledge_reader_places(spark, tmp_path):
    import json

    from gridweave.sources import readers

    same = {"content": "same words"}
    doc = {"title": "T", "chapters": [{"sections": [{"passages": [same, same]}, {}]}, {}], "orphan_passages": [same]}
    (tmp_path / "kb.json").write_text(json.dumps({"documents": [doc, {"title": "empty"}]}))
    rows = readers.read_kb(spark, str(tmp_path / "kb.json"))[0].collect()
    assert [r["content"] for r in rows] == ["same words"] * 3 and len({r["doc_id"] for r in rows}) == 3


def test_palette_extension_by_tileset(spark):
    """Equal names of two tilesets stay apart; an unknown base and a bad colour are rows with an error."""
    pal = spark.createDataFrame([("a", "p", "#", 1, 1, 1, 255), ("a", "p", ".", 2, 2, 2, 255), ("b", "p", "#", 9, 9, 9, 255), ("b", "q", ".", 8, 8, 8, 255)],
                                "tileset_id string, palette string, sym string, r int, g int, b int, a int")
    ext = spark.createDataFrame([("a", "x", "p", "#", "#0a0b0c"), ("a", "x", "p", "base", "p"), ("b", "x", "p", "2c", "#zz0000"), ("a", "y", "q", "2a", "#000000"), ("b", "only", "q", "base", "q")],
                                "tileset_id string, palette string, base string, sym string, hex string")
    got = sorted((r.tileset_id, r.palette, r.sym or "", r.r, r.error) for r in definitions.merge_palette_ext(pal, ext).collect())
    assert got == [("a", "x", "#", 10, None), ("a", "x", ".", 2, None), ("a", "y", "", None, "base palette not found"),
                   ("b", "only", ".", 8, None), ("b", "x", "#", 9, None), ("b", "x", "2c", None, "bad colour")]


def test_names_inside_texts(spark):
    """One automaton, shards, cut shards and salted texts all give what a nested loop gives."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abé x"), rng.integers(1, 7)))
    texts = [None, "", "ab", *{"".join(word() for _ in range(rng.integers(1, 9))) for _ in range(120)}]
    names = [None, "", "ab", *{word() for _ in range(150)}]
    h, n = (spark.createDataFrame([(t,) for t in x + x[:40]], f"{c} string") for c, x in (("h", texts), ("n", names)))
    want = {(t, m) for t in texts for m in names if t and m and len(m) >= 3 and m in t}
    for most, group in ((200_000, 20_000), (20, 7), (1, 1)):
        got = [tuple(r) for r in containment.contains_pairs(h, n, "h", "n", most, group).collect()]
        assert len(got) == len(set(got)) and set(got) == want, most
    assert containment.contains_pairs(h, n.where("false"), "h", "n").count() == 0
    assert containment.contains_pairs(h.where("false"), n, "h", "n", 20, 7).count() == 0
    with pytest.raises(ValueError):
        containment.contains_pairs(h, h, "h", "h")


def full_scores(docs, query, k):
    """Every document's whole sum, without an index."""
    n = len(docs)
    df = Counter(t for terms in docs.values() for t in set(terms))
    out = []
    for d, terms in docs.items():
        tf = Counter(terms)
        s = sum(q * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(terms) / 200)) for t, q in Counter(query).items() if tf[t])
        if s:
            out.append((-round(s, 6), d))
    return [(d, -s) for s, d in sorted(out)[:k]]


@pytest.mark.parametrize(("block", "plain"), [(1024, 0), (4, 0), (4, 10**9)])
def test_pruned_search_is_exact(spark, block, plain):
    """Block skipping and optional terms against the full sum, with frequent and rare terms, ties and short queries."""
    rng = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(60)]
    docs = {i: list(rng.choice(vocabulary, rng.integers(0, 60), p=(w := 1 / np.arange(1, 61)) / w.sum())) for i in range(300)}
    docs[300], docs[301] = docs[7], []
    rows = spark.createDataFrame([(i, [str(t) for t in terms]) for i, terms in docs.items()], "doc_id long, t array<string>")
    index = postings.write(rows, F.col("t"), block)
    queries = {1: ["t0"], 2: ["t0", "t1", "t59"], 3: [str(t) for t in docs[7]] or ["t3"], 4: ["t5"] * 3 + ["t2"], 5: ["unknown"], 6: vocabulary, 7: ["t58", "unknown"]}
    q = spark.createDataFrame([(i, t, c) for i, terms in queries.items() for t, c in Counter(terms).items()], "query_id long, term string, qtf long")
    got = {}
    for r in postings.search(q, index, 5, ["query_id"], plain).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for i, terms in queries.items():
        want = full_scores(docs, terms, 5)
        assert [d for d, _ in got.get(i, [])] == [d for d, _ in want], i
        assert np.allclose([s for _, s in got.get(i, [])], [s for _, s in want])
    longest = index.blocks(spark).agg(F.max(F.size("postings"))).first()[0]
    assert longest <= (300 if block == 1024 else 40)
    plan = index.blocks(spark, [1, 2]).select("term")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("metric", ["w309", "bucket", "i243"])
def test_colour_cube_is_exact(spark, metric):
    """Every colour's nearest entry by a plain search, ties to the first entry, cells on their edges included."""
    rng = np.random.default_rng(11)
    weights = {"w309": (30, 59, 11), "bucket": (1, 1, 1), "i243": (2, 4, 3)}[metric]
    pals = {g: [(i, chr(97 + i), *map(int, rng.integers(0, 256, 3))) for i in range(n)] for g, n in (("a", 16), ("b", 2), ("c", 1))}
    pals["b"].append((2, "z", *pals["b"][0][2:]))  # the same colour again, later
    colours = [tuple(map(int, c)) for c in rng.integers(0, 256, (150, 3))] + [(15, 16, 31), (0, 0, 0), (255, 255, 255), *[p[2:] for p in pals["a"]]]
    px = [(g, i, *c, 255 if i % 5 else 100) for g in ("a", "b", "c", "none") for i, c in enumerate(colours * 2)]
    df = spark.createDataFrame(px, "tileset_id string, i int, r int, g int, b int, a int")
    pal = spark.createDataFrame([(g, *p) for g, ps in pals.items() for p in ps], "tileset_id string, pos int, sym string, r int, g int, b int")
    got = image.quantize(df, pal, ["tileset_id"], metric).collect()
    assert len(got) == len(px)
    for r in got:
        c = [(v // 16 * 16 if metric == "bucket" else v) for v in (r.r, r.g, r.b)]
        near = min(((sum(w * (x - y) ** 2 for w, x, y in zip(weights, c, p[2:], strict=True)), p[0], p[1]) for p in pals.get(r.tileset_id, [])), default=None)
        if r.a < 128 or near is None:
            assert (r.sym, r.dist) == (".", 0.0)
        else:
            assert r.sym == near[2] and r.dist == pytest.approx(math.sqrt(near[0] / (100 if metric == "w309" else 1)))
    plan = image.quantize(df, pal, ["tileset_id"], metric)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "_pal" not in plan  # no pixel meets a whole palette


def test_next_in_order_across_ranges(spark):
    rows = [("a", k) for k in (1, 2, 9, 10, 11, 55, 1000)] + [("b", 7), ("c", 3), ("c", 10_000)]
    df = spark.createDataFrame(rows, "g string, k long")
    want = {("a", 1): 2, ("a", 2): 9, ("a", 9): 10, ("a", 10): 11, ("a", 11): 55, ("a", 55): 1000, ("a", 1000): None, ("b", 7): None, ("c", 3): 10_000, ("c", 10_000): None}
    for width in (1, 10, 10**6):
        assert {(r.g, r.k): r.next for r in ranking.next_in_order(df, ["g"], "k", width).collect()} == want


def test_lookup_sends_or_salts(spark):
    """A small side is sent whole and moves no row of the other; a large one is met by key and salt, with the same rows."""
    df = spark.range(200).select((F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k long, v string")
    for how in ("left", "inner", "left_semi"):
        sent, salted = lookup(df, small, ["k"], how), lookup(df, small, ["k"], how, most=2)
        assert sorted(map(tuple, sent.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)
        assert sent.count() == (200 if how == "left" else sum(i % 7 < 5 for i in range(200)))
        plan = sent._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert "_salt" in salted._jdf.queryExecution().toString()


def test_cells_and_pixels_stay_where_they_are(spark):
    """No exploded row is shuffled on a tile name or a symbol."""
    cells = spark.createDataFrame([(1, x, 0, t) for x, t in enumerate(["wall_90", "floor", "ice", None])], "map_id long, x int, y int, tile string")
    kinds = spark.createDataFrame([("wall", "obstacle"), ("floor", "walkable"), ("wall_90", "portal")], "tile string, affordance string")
    got = maps.with_affordance(cells, kinds)
    assert [r.affordance for r in got.orderBy("x").collect()] == ["portal", "walkable", None, None]
    px = spark.createDataFrame([(1, s) for s in "#.x"], "tile_id long, sym string")
    pal = spark.createDataFrame([("#", 1, 2, 3, 255), (".", 4, 5, 6, 0)], "sym string, r int, g int, b int, a int")
    shown = definitions.colorize(px, pal, [], pal.where("sym = '.'").withColumn("r", F.lit(9)), [])
    assert sorted((r.sym, r.r, r.a) for r in shown.collect()) == [("#", 1, 255), (".", 9, 0), ("x", 255, 255)]
    for df in (got, shown):
        assert "hashpartitioning" not in df._jdf.queryExecution().toString()


def test_variants_write_only_the_cells_they_change(spark):
    """A mutation walked all cells of a tile: its plan now writes a list of cells into the text, also on small and ragged-sized grids."""
    pal = spark.createDataFrame([("#", 1, 1, 1), ("g", 9, 9, 9)], "sym string, r int, g int, b int")
    t = spark.createDataFrame([(1, "\n".join("#g+=#g+=" for _ in range(6))), (2, "#g\ng#"), (3, "#"), (4, "é+é\n+é+\né+é")], "tile_id bigint, grid string")
    v = variants.vary(t, 6, 1, pal)
    assert "transform(_cells" not in v._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["tile_id"], r["mutation"]): r["grid"] for r in v.collect()}
    assert len(got) == 24 and all(len(x) == len(dict(t.collect())[k]) for (k, _), x in got.items())
    assert all(set(got[4, m]) <= set("é+\n") for m in variants.MUTATIONS)
    swap = got[1, "swap"].split("\n")
    assert swap[0] == swap[5] == "#g+=#g+=" and swap[1] != "#g+=#g+=" and all(r[0] == "#" and r[7] == "=" for r in swap)
    assert got[3, "row"] == got[3, "col"] == got[3, "crack"] == got[3, "swap"] == "#"


def test_style_scores_walk_the_cells_once(spark):
    """Scores exploded and counted all cells twice, for the tiles and for their tilesets; runs went cell by cell."""
    from gridweave.functions.grids import run_count
    from gridweave.plans import corpus

    plan = corpus.scored(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # the sums were written
    rows = spark.createDataFrame([(1, ["aab", "b..", "é🙂🙂"]), (2, ["a"]), (3, []), (4, ["  x\r"])], "i int, rows array<string>")
    assert dict(rows.select("i", run_count(F.col("rows"))).collect()) == {1: 6, 2: 1, 3: 0, 4: 3}


def test_plain_tokens_are_decoded_without_patterns(spark):
    """Every token went through up to nine searches of a pattern; the tokens of all forms decode as before."""
    toks = ["3a", "a", "0a", "12", "3:", ":", "::", "3::", "3:ab", ":ab", "ab", "2é", "1🙂", "2:🙂x", "x2", "007b", "99999999999a", "2:a\u2028", "2:\u2028a", "2\u2028", "2:1", "1:a:b"]
    t = spark.createDataFrame([(i, k) for i, k in enumerate(toks)], "tile_id bigint, rle string")
    got: dict = {}
    for r in g.rle_decode(t).orderBy("tile_id", "y", "x").collect():
        got.setdefault(toks[r["tile_id"]], []).append(r["sym"])
    want = {"3a": ["a"] * 3, "a": ["a"], "3:": [":"] * 3, ":": [":"], "3::": [":"] * 3, "3:ab": ["ab"] * 3, "2é": ["é"] * 2, "1🙂": ["🙂"], "2:🙂x": ["🙂x"] * 2,
            "007b": ["b"] * 7, "2:a\u2028": ["a"] * 2, "2\u2028": ["\u2028"] * 2, "2:1": ["1"] * 2, "1:a:b": ["a:b"]}
    assert got == want
    # A token without a line separator reaches no pattern: it ends before the branch that holds them.
    plan = g.rle_decode(t)._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("0123456789") < plan.find("regexp_extract(")
