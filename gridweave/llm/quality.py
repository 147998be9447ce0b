"""Quality classifier: a support-vector machine on n-grams scaled by class log-count ratios (naive Bayes SVM).

1. *N-grams.*  A text's tokens are runs of letters and digits, and runs of other
   visible characters.  Its features are the distinct tokens and token pairs,
   and the distinct single, paired and threefold *shapes* of tokens (lower case,
   capitalised, upper case, digits, or the marks themselves), and which of two
   to four neighbours repeat the token before them, hashed to ``BITS`` bits.  They are read from the bytes of many texts at once.
2. *Ratios.*  The model is fitted on a bounded sample of the labelled rows
   (``SAMPLE`` rows, the least digests of their ids).  A feature's ratio is the
   log of the shares of texts of either label that hold it, smoothed; its
   indicator is scaled by that.
3. *Hinge loss.*  A linear model is fitted by dual coordinate descent.  Rows are
   scaled to unit length, so long texts are not surer.
4. *Score.*  A logistic curve over the margin, fitted on the share of the sample
   that the model was not fitted on; then the model is fitted on all of it.

Scoring is a map over all texts, whole.

Defined results: null and empty texts have no feature and score what the bias
says; rows without a label, without an id or repeated are scored like others;
labels without a text or an id teach nothing; an id labelled twice has the
higher label, an id with several texts the least of them; if only one label
(or none) is known every score is that label (or 0); an empty table gives an
empty result; a column of the output's name is replaced.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shingles import mix

#: Labelled rows that a model is fitted on at most.
SAMPLE = 8_000
BITS = 20
#: Labelled texts that a feature is in at least, and what is added to its counts.
LEAST, ADDED = 3, 1.0
#: Weight of a hinge loss against the norm; passes over the rows; change at which they end.
COST, ROUNDS, ENOUGH = 1.0, 60, 1e-2
#: One sampled row in so many is left to the logistic curve.
CURVE = 4
#: Bytes of text read at once; a longer text is alone.
CHUNK = 1 << 18

_U = np.uint64
_LOWER, _UPPER, _DIGIT, _MARK, _SPACE = range(5)


def _kinds() -> np.ndarray:
    kind = np.full(256, _MARK, np.uint8)
    kind[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = _LOWER
    kind[0x41:0x5B], kind[0x30:0x3A] = _UPPER, _DIGIT
    kind[[0x20, 0x7F, *range(0x20)]] = _SPACE
    return kind


KIND = _kinds()
_BYTE = np.array([int.from_bytes(hashlib.blake2b(b"q%d" % b, digest_size=8).digest(), "little") for b in range(256)], _U)
_BASE = 0xD6E8FEB86659FD93
_STEP = [_U(int.from_bytes(hashlib.blake2b(b"gram%d" % i, digest_size=8).digest(), "little") | 1) for i in range(6)]
_power = np.cumprod(np.full(CHUNK + 1, _BASE, _U))
_back = np.cumprod(np.full(CHUNK + 1, pow(_BASE, -1, 2**64), _U))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_power):
        return _power[:n], _back[:n]
    return np.cumprod(np.full(n, _BASE, _U)), np.cumprod(np.full(n, pow(_BASE, -1, 2**64), _U))


def _read(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct features of some texts, read at once."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = KIND[data]
    group = np.where(kind <= _DIGIT, np.uint8(1), np.where(kind == _MARK, np.uint8(2), np.uint8(0)))
    turn = np.flatnonzero(np.diff(group, prepend=np.uint8(0)))
    start = turn[group[turn] > 0]
    ends = np.append(turn[1:], len(data))[group[turn] > 0]
    power, back = _powers(len(data))
    run = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * power)])
    token = mix((run[ends] - run[start]) * back[start] + (ends - start).astype(_U) * _STEP[0])
    # Shapes: what a word's letters look like; marks are their own shape.
    upper = np.concatenate([[0], np.cumsum(kind == _UPPER)])
    lower = np.concatenate([[0], np.cumsum(kind == _LOWER)])
    n_up, n_low = upper[ends] - upper[start], lower[ends] - lower[start]
    look = np.where(n_up == 0, np.where(n_low == 0, 1, 2), np.where(n_low == 0, np.where(n_up > 1, 3, 4), np.where((n_up == 1) & (kind[start] == _UPPER), 5, 6)))
    shape = np.where(group[start] == 1, mix(look.astype(_U) * _STEP[1]), token)

    # Repeats: whether a token is the one before it.
    again = np.concatenate([[False], token[1:] == token[:-1]])[:len(token)]
    echo = np.where(again, _STEP[5], _U(0))

    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cut = np.searchsorted(start, bounds)
    at = np.arange(len(texts)).repeat(np.diff(cut))

    def gram(x, n, salt):
        """Hashes of n neighbours of one text, and whose they are."""
        if len(x) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.full(len(x) - n + 1, salt, _U)
        for i in range(n):
            h = mix(h * _STEP[2] + x[i:len(x) - n + 1 + i])
        same = at[:len(h)] == at[n - 1:]
        return at[:len(h)][same], (h[same] >> _U(64 - BITS)).astype(np.int64)

    grams = [gram(token, 1, _STEP[3]), gram(token, 2, _STEP[3]), gram(shape, 1, _STEP[4]), gram(shape, 2, _STEP[4]), gram(shape, 3, _STEP[4]), *(gram(echo, k, _STEP[5]) for k in (2, 3, 4))]
    key = np.unique(np.concatenate([a << BITS | h for a, h in grams]))
    cuts = np.searchsorted(key, np.arange(len(texts) + 1) << BITS)
    key = (key & ((1 << BITS) - 1)).astype(np.int32)
    return [key[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct features of each text."""
    raw = [(t or "").encode() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        end, total = at, 0
        while end < len(raw) and (end == at or total + len(raw[end]) < CHUNK):
            total += len(raw[end]) + 1
            end += 1
        out += _read(raw[at:end])
        at = end
    return out


def ratios(n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """Log ratio of the features' smoothed shares under label 1 and label 0."""
    p, q = n1 + ADDED, n0 + ADDED
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss by dual coordinate descent.

    ``rows`` hold places and values of unit length, ``y`` is 1 or -1.  A row's dual
    variable stays in 0 to ``cost``; each step takes one row to its optimum.  The
    loss of either label weighs as much in all.
    """
    w, bias = np.zeros(n), 0.0
    alpha = np.zeros(len(rows))
    top = cost * len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))
    draw = np.random.default_rng(7)
    norm = np.array([v @ v + 1 for _, v in rows])
    for _ in range(rounds):
        worst = 0.0
        for i in draw.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + bias) - 1
            if alpha[i] <= 0:
                g = min(g, 0.0)
            elif alpha[i] >= top[i]:
                g = max(g, 0.0)
            if g == 0:
                continue
            worst = max(worst, abs(g))
            new = min(max(alpha[i] - g / norm[i], 0.0), top[i])
            move = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[at] += move * v
            bias += move
        if worst < ENOUGH:
            break
    return w, bias


def curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the margins; targets are smoothed by the labels' counts, both labels weigh alike."""
    n1, n0 = label.sum(), (1 - label).sum()
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    much = len(label) / 2 / np.where(label == 1, max(n1, 1), max(n0, 1))
    x = np.array([1.0, 0.0])
    z = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ x, -30, 30)))
        h = (z * (much * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (much * (p - t)))
        x -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(x[0], 1e-3)), float(x[1])


class Model(NamedTuple):
    """Features with a weight (sorted), their ratios, weights, bias, and the logistic curve; without features, the score of all."""

    index: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def row(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a text's features, of unit length."""
        at = np.searchsorted(self.index, found)
        at = at[self.index[np.minimum(at, len(self.index) - 1)] == found] if len(self.index) else at[:0]
        v = self.ratio[at]
        return at, v / (np.sqrt(v @ v) or 1.0)

    def margin(self, found: np.ndarray) -> float:
        at, v = self.row(found)
        return float(self.weight[at] @ v + self.bias)

    def score(self, found: np.ndarray) -> float:
        if not len(self.index):
            return self.offset
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -500, 500))))


def fit(sets: list[np.ndarray], label: np.ndarray) -> Model:
    """A model from the features of the sampled rows."""
    n1, n0 = (np.bincount(np.concatenate([np.zeros(0, np.int32), *(s for s, x in zip(sets, label, strict=True) if x == v)]), minlength=1 << BITS) for v in (1, 0))
    index = np.flatnonzero(n1 + n0 >= LEAST).astype(np.int32)
    if not len(index) or label.min() == label.max():
        return Model(index[:0], np.zeros(0), np.zeros(0), 0.0, 0.0, float(label.max()) if len(label) else 0.0)
    model = Model(index, ratios(n1[index], n0[index]), np.zeros(len(index)), 0.0, 1.0, 0.0)
    rows, y = [model.row(s) for s in sets], np.where(label > 0, 1.0, -1.0)
    aside = np.arange(len(rows)) % CURVE == 0
    w, b = descend([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], len(index))
    m = np.array([w[at] @ v + b for (at, v), a in zip(rows, aside, strict=True) if a])
    slope, offset = curve(m, label[aside].astype(float))
    w, b = descend(rows, y, len(index))
    return model._replace(weight=w, bias=b, slope=slope, offset=offset)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from the labelled texts; the hashed features of at most ``sample`` rows reach the driver."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("label"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where("_text is not null").join(
        F.broadcast(picked), F.col("_doc") == F.col("_id")).groupBy("_id", "label").agg(F.min("_text").alias("text"))

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            got = features(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([s.tobytes() for s in got], pa.binary())], names=["h", "label", "set"])

    rows = texts.select(F.xxhash64("_id").alias("h"), "label", "text").mapInArrow(run, "h bigint, label int, set binary").toArrow().sort_by(
        [("h", "ascending"), ("label", "ascending"), ("set", "ascending")])
    found = [np.frombuffer(s.as_buffer(), np.int32) for s in rows["set"]]
    return fit(found, np.asarray(rows["label"]).clip(0, 1))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's score of the text, between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS features

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        known = shared.value
        return pd.Series([known.score(f) for f in features(texts.tolist())], dtype=float)

    return docs.withColumn(name, run(F.col(text)))
