"""Toxicity classifier with counterfactual regularisation.

Features of a text are its distinct words and the distinct beginnings of its
words (``STEMS`` letters), hashed to ``BITS`` bits.  The model is a sparse
logistic regression; besides the log loss it is charged for every change of
score when the identity terms of a labelled text are swapped for other terms
of their group, so a neutral mention of a group moves no score.  The L1 charge
keeps the weights of features that tell nothing at zero.

Labels are learned from a bounded sample (``SAMPLE`` rows, the least digests of
their ids); only hashed features of that sample reach the driver.  Scoring is a
map over all texts.

Defined results: null and empty texts have no feature and score the bias;
texts of any length are read whole; rows without a label, without an id or
repeated are scored like others, labels without a text teach nothing; without
usable labels every score is 0; columns of the output's names are replaced.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most.
SAMPLE = 8_000
BITS = 20
STEMS = (4, 5, 6)
#: Charges: weights' size, and change of score under a swap.
L1, SWAP = 5e-5, 2.0
ROUNDS = 200
#: Standard errors by which a feature's share differs between the labels before it is fitted.
SIGNAL = 5.0
#: Distinct words whose features a worker remembers; only a cache.
CACHE = 50_000

#: Identity terms by group; a swap replaces a term by another of its group.
GROUPS = [
    "women men girls boys woman man girl boy female male transgender nonbinary".split(),
    "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists catholic protestant".split(),
    "black white asian latino african american european arab indian chinese mexican native".split(),
    "gay lesbian straight bisexual queer heterosexual homosexual".split(),
    "immigrant immigrants refugee refugees foreigner foreigners migrant migrants".split(),
    "young old elderly teenage disabled blind deaf autistic".split(),
    "frauen männer frau mann muslime christen juden ausländer flüchtlinge schwule lesben".split(),
    "femmes hommes femme homme musulmans chrétiens juifs étrangers réfugiés gays lesbiennes".split(),
    "mujeres hombres mujer hombre musulmanes cristianos judíos extranjeros refugiados homosexuales lesbianas".split(),
]
TERM_GROUP = {t: g for g in GROUPS for t in g}
_word = re.compile(r"\w+").findall


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) & ((1 << BITS) - 1)


def word_features(word: str) -> list[int]:
    return [_hash(word), *(_hash(f"{word[:k]}*") for k in STEMS if len(word) > k)]


def swapped(words: list[str]) -> list[str]:
    """Each identity term replaced by the next of its group; the words themselves if there is none."""
    return [g[(g.index(w) + 1) % len(g)] if (g := TERM_GROUP.get(w)) else w for w in words]


def features(text: str | None, swap: bool = False) -> np.ndarray:
    words = set(_word((text or "").lower()))
    return np.unique(np.array([f for w in (swapped(list(words)) if swap else words) for f in word_features(w)], np.int32))


class Model(NamedTuple):
    """Hashed features with a weight, their weights, and the bias; no bias means nothing was learned."""

    index: np.ndarray
    weight: np.ndarray
    bias: float | None

    def score(self, logit: float) -> float:
        return 0.0 if self.bias is None else float(1 / (1 + np.exp(-logit)))


def sampled(docs: DataFrame, labels: DataFrame, sample: int, doc_id: str, text: str, label: str) -> DataFrame:
    """``(h, label, plain, swap)``: hashed features of a bounded sample of the labelled rows.

    The sample is the ids of the least digests; an id labelled twice has the
    higher label, an id with several texts the least of them.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(label).cast("int").alias("_label"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(picked, F.col("_doc") == F.col("_id")).groupBy("_id", "_label").agg(
        F.min("_text").alias("_text")).where("_text is not null").repartition(24, "_id")

    def run(parts):
        import pandas as pd

        for p in parts:
            yield pd.DataFrame({"h": p["h"], "label": p["_label"], "plain": [features(t).tobytes() for t in p["_text"]],
                                "swap": [features(t, True).tobytes() if TERM_GROUP.keys() & set(_word(t.lower())) else b"" for t in p["_text"]]})

    return texts.select(F.xxhash64("_id").alias("h"), "_label", "_text").mapInPandas(run, "h bigint, label int, plain binary, swap binary")


def fit(rows: list, l1: float = L1, swap: float = SWAP, rounds: int = ROUNDS) -> Model:
    """Accelerated proximal gradient on ``(label, plain, swap)`` rows."""
    if not rows:
        return Model(np.zeros(0, np.int32), np.zeros(0), None)
    y = np.array([r["label"] for r in rows], float)
    sets = [np.frombuffer(r["plain"], np.int32) for r in rows]
    pairs = [(i, np.frombuffer(r["swap"], np.int32)) for i, r in enumerate(rows) if r["swap"]]
    # Features that tell the labels apart by more than chance, and those that a swap changes.
    used, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    share = seen / len(y)
    bad = np.bincount(at, np.repeat(y, [len(s) for s in sets]), len(used))
    gap = bad / max(1, y.sum()) - (seen - bad) / max(1, (1 - y).sum())
    noise = np.sqrt(share * (1 - share) * (1 / max(1, y.sum()) + 1 / max(1, (1 - y).sum()))) + 1e-12
    used = used[(seen >= 3) & (np.abs(gap) / noise >= SIGNAL)]
    moved = [np.setxor1d(s, sets[i]) for i, s in pairs]
    used = np.union1d(used, np.concatenate(moved)) if pairs else used

    def matrix(some):
        place = [np.searchsorted(used, s[np.isin(s, used)]) for s in some]
        return np.repeat(np.arange(len(place)), [len(p) for p in place]), np.concatenate([np.zeros(0, np.int64), *place])

    xr, xc = matrix(sets)
    n, d = len(y), len(used)
    # A swap's change: features that come, less those that go.
    pr, pc = matrix([s for _, s in pairs])
    qr, qc = matrix([sets[i] for i, _ in pairs])
    m = max(1, len(pairs))
    scale = 1 / np.sqrt(np.bincount(xc, minlength=d).clip(1))
    w, bias = np.zeros(d), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, vb, t = w.copy(), bias, 1.0
    step = float(n)  # features are scaled by their frequency, so curvature is near 1 / n; halved where it isn't
    last = np.inf
    for _ in range(rounds):
        def loss(w, bias):
            z = np.bincount(xr, (w * scale)[xc], n) + bias
            change = np.bincount(pr, (w * scale)[pc], m) - np.bincount(qr, (w * scale)[qc], m)
            return z, change, float(np.mean(np.logaddexp(0, z) - y * z) + swap * np.mean(change**2))

        z, change, now = loss(v, vb)
        err = (1 / (1 + np.exp(-z)) - y) / n
        grad = scale * np.bincount(xc, err[xr], d)
        grad += scale * (2 * swap / m) * (np.bincount(pc, change[pr], d) - np.bincount(qc, change[qr], d))
        while True:  # halve the step until the quadratic bound holds
            new = v - step * grad
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1 * scale, 0)
            nb = vb - min(step, 4.0) * err.sum()
            gap = new - v
            if loss(new, nb)[2] <= now + grad @ gap + (gap @ gap) / (2 * step) + err.sum() * (nb - vb) + (nb - vb) ** 2 / (2 * min(step, 4.0)) + 1e-12:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if now > last:  # restart the momentum
            t2 = 1.0
        last = now
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = new, nb, t2
    keep = np.flatnonzero(w)
    return Model(used[keep], (w * scale)[keep], float(bias))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled texts; at most ``sample`` rows of hashed features reach the driver."""
    rows = sampled(docs, labels, sample, doc_id, text, label).collect()
    return fit(sorted(rows, key=lambda r: (r["h"], r["label"], r["plain"])))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's score of the text, between 0 and 1."""
    weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        known: dict[str, list[int]] = run_cache
        out = []
        for t in texts:
            words = set(_word(t.lower())) if t else ()
            hit: set[int] = set()
            for w in words:
                f = known.get(w)
                if f is None:
                    if len(known) > CACHE:
                        known.clear()
                    f = known[w] = tuple(x for x in word_features(w) if x in weight)
                if f:
                    hit.update(f)
            out.append(model.score((model.bias or 0.0) + sum(weight[x] for x in sorted(hit))))
        return pd.Series(out, dtype=float)

    run_cache: dict[str, tuple[int, ...]] = {}
    return docs.withColumn(name, run(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
