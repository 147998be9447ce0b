"""Edge cases and planted cases of the scans, the classifier, quotes and token counts."""

import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from gridweave.llm import decontaminate, licenses, queries, quotes, secret_scan, toxicity, unigram
from gridweave.plans import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_secret_scan", "op3_license_scan", "op8_quotes", "op10_decontaminate"])
def test_queries_match_sql(spark, name):
    con = check.connect(SF)
    ok, msg = check.compare(spark, con, SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, msg


def spans(text):
    """Base matches by Python's own engine."""
    out = []
    rules = [("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)]
    for i, (kind, p, least, group) in enumerate(rules):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "") if len(m[group]) >= least]
    return ",".join(s for _, _, s in sorted(out))


def test_secret_scan(spark):
    texts = [None, "", "é🙂 password = 'hunter22' and PassWord:abc", "token: token: abcdefgh", "API_KEY=\"a.b-c_d=\" apikey = AKIA" + "Q7" * 9, "AKIA" + "A" * 15,
             "AKIAAKIA" + "B" * 20, "f" * 24 + " " + "0" * 23, "secret=" + "0a" * 20, "ſecret=abcdefgh toKen=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "x" * 200_000 + " passwd:zzzzzz", "token=secret=abcdefgh"]
    rows = [(i, t, "f") for i, t in enumerate(texts)] + [(2, texts[2], "again"), (2, "other text, token=abcdef1", None), (None, texts[2], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = secret_scan.scan(docs)
    base = F.filter("found", lambda s: s["kind"].isin(*secret_scan.BASE))
    out = got.select("doc_id", "text", secret_scan.listed(base).alias("b"), "found", secret_scan.redacted(F.col("text"), F.col("found")).alias("r")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.b == spans(r.text), r.text
        assert all((r.text or "")[s.start:s.end] == s.text for s in r.found)
        if r.found:
            assert not any(s.text in r.r for s in r.found)
        else:
            assert r.r == r.text
    assert secret_scan.scan(docs.where("false")).count() == 0
    assert any(s.kind == "private_key" for r in out for s in r.found)


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == []
    assert secret_scan.trigram_query("(?:abcd|bcd)x?") == [frozenset({"bcd"})]
    assert secret_scan.trigram_query("ab[cd]e+") == [frozenset({"abc", "bce"}), frozenset({"abd", "bde"})]


def test_license_edges(spark):
    mit = "Released under the MIT License."
    rows = [(1, None, 5.0), (2, "", 0.0), (3, mit, 0.0), (4, "x\n" + mit.upper() + "\n" + mit, 0.0), (5, "word " * 50_000, 0.0), (6, "MIT License", 0.0), (3, mit, 1.0), (None, mit, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dice double")
    got = licenses.scan(docs, licenses.templates(spark)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.licence, r.line, r.dice) for r in got}
    assert by == {(1, None, None, 0.0), (2, None, None, 0.0), (3, "MIT", 0, 1.0), (4, "MIT", 2, 1.0), (5, None, None, 0.0), (6, None, None, 0.0), (None, "MIT", 0, 1.0)}
    assert licenses.scan(docs.where("false"), licenses.templates(spark)).count() == 0


def test_licenses_inside_texts(spark):
    """Wrapped grants, notices beside other text, several licences, against every window of words."""
    import textwrap
    full = [t for _, t in licenses.TEMPLATES]
    prose = "some plain words of the work that stand before it and are subject to the terms of nobody "
    wrapped = textwrap.fill(full[4], 70)
    dual = "/* " + textwrap.fill(full[6], 60) + "\n */\n" + prose + "\n" + textwrap.fill(full[11], 40) + " and so on"
    rows = [(1, f"# Title\n{prose * 3}\n\n{wrapped}\n\n{prose * 3}"), (2, prose + full[2] + " " + prose), (3, dual), (4, f"{full[2]}\n{full[7]}"),
            (5, "x\n" + textwrap.fill(full[12], 50) + "\n" + prose * 5), (6, "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n" + prose * 4),
            (7, prose * 40), (8, "a\n" + full[8] + "\nb " + prose * 4), (9, full[2] + "\n" + prose * 3), (9, prose * 3), (10, prose + full[4].replace("free of charge", "gratis").replace("sublicense", "lend") + prose)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.templates(spark)).collect()
    by = sorted((r.doc_id, r.licence, r.line) for r in got if r.licence)
    assert by == [(1, "MIT", 4), (2, "MIT", 1), (3, "GPL-3.0", 1), (3, "MPL-2.0", 8), (4, "CC-BY-NC-4.0", 2), (4, "MIT", 1), (5, "ISC", 2), (6, "BSD-3-Clause", 1),
                  (8, "CC-BY-4.0", 2), (9, "MIT", 1), (10, "MIT", 1)]
    assert len(got) == len(rows) + 2 and all(0.8 <= r.dice <= 1 for r in got if r.licence)
    best = {r.doc_id: r.dice for r in got}
    assert best[2] == best[5] == best[6] == 1

    def pairs(t):
        w = re.findall("[a-z0-9]+", t.lower())
        return [*zip(w, w[1:])]
    from collections import Counter
    whole = pairs(rows[-1][1])
    slow = max(2 * sum((Counter(whole[a:b]) & Counter(pairs(full[4]))).values()) / (b - a + len(pairs(full[4]))) for a in range(len(whole)) for b in range(a + 2, len(whole) + 1))
    assert abs(best[10] - slow) < 1e-12 and slow < 1


def test_decontamination_against_all_windows(spark):
    """Planted, edited and clean documents against a comparison of every anchored window."""
    import random
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 12, 20, 40, 40, 60])] + [(6, "too short"), (7, None), (8, ""), (3, "x y z v u w")]
    docs = []
    for i in range(60):
        w = items[i % 6][1].split()
        for _ in range(i // 15):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join([word() for _ in range(rng.randrange(40))] + w + [word() for _ in range(rng.randrange(40))]), "a"))
    docs += [(100, None, "a"), (101, "", "a"), (102, items[3][1] + " " + items[3][1].upper(), "a"), (103, " ".join(items[5][1].split()[:55]), "a"), (None, items[4][1], "a"), (5, docs[5][1], "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, start string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in decontaminate.passages(d, b).collect()}
    con = __import__("duckdb").connect()
    import pandas as pd
    con.register("documents", pd.DataFrame({"doc_id": pd.array([x[0] for x in docs], "Int64"), "text": [x[1] for x in docs]}).drop_duplicates())
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).query("item_id != 3 or text.str.len() > 20"))
    want = {(r[0], r[1]): (r[2], round(r[4], 9)) for r in con.execute(queries.DECONTAMINATE_SQL).fetchall()}
    named = {k: v for k, v in got.items() if k[0] is not None}
    assert named == {k: v for k, v in want.items() if k[0] is not None} and len(named) >= 15
    assert (None, 4) in got
    assert decontaminate.passages(d.where("false"), b).count() == 0 and decontaminate.passages(d, b.where("false")).count() == 0


def test_toxicity(spark):
    texts = [(i, f"you are a {'stupid idiot' if i % 3 == 0 else 'kind person'} said {w} number {i}", int(i % 3 == 0))
             for i, w in enumerate(["women", "men", "muslims", "jews", "plain", "none"] * 40)]
    # identity terms lean towards the toxic label; the charge on swaps keeps their weight down
    texts += [(1000 + i, "muslims idiot idiot here", 1) for i in range(40)]
    docs = spark.createDataFrame([t[:2] for t in texts] + [(5000, None), (5001, ""), (None, "no id idiot"), (3, "second text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(9999, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    probe = spark.createDataFrame([(1, "stupid idiot"), (2, "you are a kind person said muslims"), (3, "you are a kind person said christians"), (4, None), (5, "word " * 60_000)], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert s[1] > 0.3 > s[2] and abs(s[2] - s[3]) < 0.02 and 0 <= s[4] <= 1 and 0 <= s[5] <= 1
    empty = toxicity.train(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(probe, empty).collect()} == {0.0}
    assert toxicity.score(probe.where("false"), model).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.QUERIES["op7_toxicity"](spark, sf)
    rows = got.join(lab, "doc_id").where("held_out").select("predicted", "toxic", "score").toPandas()
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert hit / (rows.toxic == 1).sum() > 0.8 and hit / (rows.predicted == 1).sum() > 0.9
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.select("doc_id", "held_out").limit(200).collect())


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello  there.\n\nSecond part\nof it."), (1, 1, "bot", "> hello there.\n\nAnswer one."), (1, 2, "user", "Unrelated."),
            (1, 3, "bot", ">> Hello there.\n> Answer one.\n\nDeep."), (1, 4, "user", "> second part of\n> IT.\nmine"), (1, 5, "bot", "> nobody said this"),
            (1, 6, "user", "> > \n>"), (2, 0, "user", None), (2, 1, "bot", "> hello there."), (2, 1, "bot", "> hello there."), (None, 3, "x", "> a"), (3, None, "x", "hm")]
    m = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn int, role string, text string, level string")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(m).collect()}
    assert quotes.conversations(m).count() == len(rows)
    parents = {k: r.parent_turn for k, r in got.items() if r.parent_turn is not None}
    assert parents == {(1, 1): 0, (1, 3): 1, (1, 4): 0}
    assert [k[1] for k, r in sorted(got.items(), key=lambda x: x[1].place or 0) if k[0] == 1] == [0, 1, 3, 4, 2, 5, 6]
    assert got[1, 4].content == "mine" and got[1, 5].content == "" and got[2, 0].content == "" and got[1, 3].content == "Deep."
    assert (got[1, 3].n_quotes, got[1, 3].n_linked, got[1, 3].thread) == (2, 2, 0)
    assert quotes.conversations(m.where("false")).count() == 0


def test_quotes_of_parts(spark, monkeypatch):
    """Answers between the lines and trimmed quotes, whole passages first; places over several ranges."""
    monkeypatch.setattr(quotes, "TURNS", 2)
    rows = [(1, 0, "first\nsecond\nthird"), (1, 1, "> first\nyes\n> Second\nno"), (1, 2, "first\nother"), (1, 3, "> third\n> first\nok"), (1, 4, "> first\n>  other\nboth"),
            (1, 5, "> first\n> unknown\nhm"), (1, 6, "> later line\nx"), (1, 7, "later line\ny"), (1, 8, "> other\n> third"), (1, 9, ">> second\n> no\nz"), (2, 0, "> first"),
            (1, 10, "second"), (1, 11, "> second"), (1, 12, "plain")]
    m = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(m).collect()}
    assert len(got) == len(rows)
    assert {k[1]: r.parent_turn for k, r in got.items() if r.parent_turn is not None} == {1: 0, 3: 0, 4: 2, 9: 1, 11: 10}
    assert [(got[1, t].n_quotes, got[1, t].n_linked) for t in (1, 5, 6, 8, 9)] == [(2, 2), (1, 0), (1, 0), (1, 0), (2, 2)]
    assert (got[1, 9].thread, got[2, 0].parent_turn) == (0, None)
    order = sorted((k[1] for k in got if k[0] == 1), key=lambda t: (got[1, t].thread, t))
    assert [got[1, t].place for t in order] == list(range(1, len(order) + 1)) and order[:4] == [0, 1, 3, 9]


def test_token_counts_against_plain_search(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    score, longest = unigram.scores(path)

    def slow(word):
        data = word.encode()
        best = [(0.0, 0)] + [None] * len(data)
        for i in range(1, len(data) + 1):
            best[i] = max(((best[i - n][0] + score[data[i - n:i]], best[i - n][1] - 1) for n in range(1, min(i, longest) + 1) if data[i - n:i] in score))
        return -best[-1][1]

    texts = [None, "", " ", "Hello world, hello worlds", "naïve 日本 🙂 <|endoftext|>", "a" * 3000, "don't stop  \n\n now"] + [
        r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()[:20]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, n_tokens string")
    for r in unigram.token_counts(docs, path, pattern).collect():
        words = regex.findall(pattern, r.text or "")
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(map(slow, words)))
    assert unigram.token_counts(docs.where("false"), path, pattern).count() == 0
