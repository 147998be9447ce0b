"""Quality classifier: features, fit and scores against plain versions, held-out rows, odd rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import quality, queries

SF = "/root/testdata/sf0.01"


def grams(text):
    """The n-grams of a text, spelt out."""
    tokens = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode())

    def shape(t):
        if not re.match(rb"[A-Za-z0-9\x80-\xff]", t):
            return t
        up, low = len(re.findall(b"[A-Z]", t)), len(re.findall(b"[a-z\x80-\xff]", t))
        if up == 0:
            return "digits" if low == 0 else "lower"
        if low == 0:
            return "upper" if up > 1 else "single"
        return "title" if up == 1 and 65 <= t[0] <= 90 else "mixed"

    shapes = [shape(t) for t in tokens]
    echo = [i > 0 and tokens[i] == tokens[i - 1] for i in range(len(tokens))]
    some = [("t", 1, tokens), ("t", 2, tokens), *(("s", k, shapes) for k in (1, 2, 3)), *(("e", k, echo) for k in (2, 3, 4))]
    return {(kind, k, *x[i:i + k]) for kind, k, x in some for i in range(len(x) - k + 1)}


def test_features_are_the_grams():
    texts = ["", None, "One two, two -- THREE three3 É 12 x", "a a a a b", "tab\tnew\nline...", "same words same words", "$$$ x$$$ %%%", "z " * 200_000 + "Ende", " \n ", "DEL\x7fETE é ü"]
    got = quality.features(texts)
    names: dict[int, set] = {}
    for t, f in zip(texts, got, strict=True):
        want = grams(t)
        assert len(f) == len(want) and f.dtype == np.int32 and (np.diff(f) > 0).all(), t
        assert np.array_equal(quality.features([t])[0], f)  # the same alone
        for g in want:
            names.setdefault(quality_key(g), set()).add(g)
    assert {h for f in got for h in f.tolist()} == set(names)


def quality_key(gram):
    """Feature of one n-gram, hashed step by step."""
    kind, _, *x = gram
    if kind == "t":
        return _gram([_token(t) for t in x], quality._STEP[3])
    if kind == "e":
        return _gram([_u(int(quality._STEP[5]) if v else 0) for v in x], quality._STEP[5])
    look = {"digits": 1, "lower": 2, "upper": 3, "single": 4, "title": 5, "mixed": 6}
    return _gram([_token(s) if isinstance(s, bytes) else quality.mix(_u(look[s]) * quality._STEP[1]) for s in x], quality._STEP[4])


def _u(v):
    return np.array([v], np.uint64)


def _token(t):
    base, total, power = quality._BASE, 0, 1
    for b in t:
        power = power * base % 2**64
        total += int(quality._BYTE[b]) * power
    back = pow(base, -1, 2**64)
    return quality.mix(_u((total * back + len(t) * int(quality._STEP[0])) % 2**64))


def _gram(x, salt):
    h = np.full(1, salt, np.uint64)
    for v in x:
        h = quality.mix(h * quality._STEP[2] + v)
    return int(h[0] >> np.uint64(64 - quality.BITS))


def test_descent_reaches_the_least_hinge_loss():
    """Against the dual solved densely by projected gradient."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * draw.normal(size=60) > 0.2, 1.0, -1.0)
    w, b = quality.descend([(np.arange(8), r) for r in x], y, 8, rounds=3000)
    top = len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    z = np.hstack([x, np.ones((60, 1))]) * y[:, None]
    q, a = z @ z.T, np.zeros(60)
    for _ in range(20_000):
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, top)

    def loss(v):
        return v @ v / 2 + (top * np.maximum(0, 1 - z @ v)).sum()

    assert abs(loss(np.append(w, b)) - loss(z.T @ a)) < 1e-2 * loss(z.T @ a)


def test_counts_and_scores_against_plain(spark):
    """Ratios from the labelled rows outside the fold, scores as the model's formula gives them."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = queries.quality_model(docs, labels)
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.collect()}
    n1, n0 = np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS)
    for i, q in known.items():
        (n1 if q else n0)[quality.features([texts[i]])[0]] += 1
    index = np.flatnonzero(n1 + n0 >= quality.LEAST)
    assert np.array_equal(model.index, index)
    p, q = n1[index] + 1, n0[index] + 1
    assert np.allclose(model.ratio, np.log(p / p.sum()) - np.log(q / q.sum()))
    got = {r.doc_id: r for r in queries.QUERIES["op13_quality"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    weight, ratio = dict(zip(index.tolist(), model.weight, strict=True)), dict(zip(index.tolist(), model.ratio, strict=True))
    for i, t in texts.items():
        some = [f for f in quality.features([t])[0].tolist() if f in weight]
        size = np.sqrt(sum(ratio[f] ** 2 for f in some)) or 1.0
        margin = sum(weight[f] * ratio[f] / size for f in some) + model.bias
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))))
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == (got[i].score >= 0.3)


def test_held_out_rows(spark):
    """Rows that the model never saw: nearly all junk is told from good text."""
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op13_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    junk, good = [r for r in got if r.quality == 0], [r for r in got if r.quality == 1]
    assert len(junk) > 50 and sum(r.predicted == 0 for r in junk) >= 0.95 * len(junk)
    assert sum(r.predicted == 1 for r in good) >= 0.99 * len(good)


def test_odd_rows(spark):
    good = [(i, f"Plain words number {i} follow, as they should.") for i in range(40)]
    bad = [(i, f"x{i} | y{i} | z{i} | BUY NOW!!") for i in range(40, 80)]
    odd = [(None, "no id here"), (1, good[1][1]), (1, "another text"), (200, None), (201, ""), (202, "word " * 100_000), (None, None)]
    docs = spark.createDataFrame([(*r, 9.0) for r in good + bad + odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(1, 0), (None, 1), (3, None), (200, 1), (999, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == docs.columns and got.count() == len(good + bad + odd)
    by = {r.text: r.score for r in got.collect()}
    assert all(0 <= s <= 1 for s in by.values()) and by[None] == by[""]
    assert min(by[t] for _, t in good) > 0.5 > max(by[t] for _, t in bad)
    small = quality.train(docs, labels, sample=20)  # fewer rows than are labelled
    assert quality.score(docs, small).where("score between 0 and 1").count() == len(good + bad + odd)
    only = quality.score(docs, quality.train(docs, labels.where("quality = 1"))).select("score").distinct().collect()
    assert [r.score for r in only] == [1.0]
    none = quality.train(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.0}
    assert quality.score(docs.where("false"), model).count() == 0
    assert quality.held_out(F.lit(1)) is not None
