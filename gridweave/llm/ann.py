"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph (largest inner products) is cut into
``PARTITIONS`` balanced parts: each cut orders a part's vectors by the second
eigenvector of its graph, found by power iteration, and halves them.  A small
softmax classifier learns, for each sampled vector, how its neighbours spread
over the parts.  It then places every vector in its most probable part and
routes every query to several of them: as many as the sample needs for
``RECALL`` of its own neighbours, and to further ones until those hold enough
vectors for ``k`` rows.  Within a part all vectors are reranked by
exact inner products in double precision, block by block.

Parts grow with the table; their blocks do not, and a part's copies of one
vector are spread over its blocks.

Defined results: null, zero or non-finite vectors, and those of another length
than the commonest (the smaller of equally common ones), take no part; ties go to the smaller id; a query has fewer
rows where there are fewer candidates; rows that share an id are never each
other's neighbours and a repeated query row is one query; rows without an id
take no part; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridweave.session import cut

#: Rows that the partitions are learned from at most, and the number of partitions (a power of two).
SAMPLE, PARTITIONS = 6_000, 32
#: Recall that routing has to reach on the sample.
RECALL = 0.96
#: Neighbours in the graph; vectors and queries of one block.
DEGREE, BLOCK, QUERIES = 12, 4096, 1024


class Model(NamedTuple):
    weight: np.ndarray
    bias: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` others of largest inner product of each row."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1000):
        s = x[a:a + 1000] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 1000] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Halve the graph again and again along its second eigenvector; parts differ by one vector per level."""
    n = len(near)
    src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    for _ in range(parts.bit_length() - 1):
        inside = part[src] == part[dst]
        a, b = src[inside], dst[inside]
        root = np.sqrt(np.maximum(np.bincount(a, minlength=n), 1))
        v = rng.standard_normal(n)
        for _ in range(60):
            v = v - root * (np.bincount(part, v * root) / np.bincount(part, root**2))[part]
            v = v / np.sqrt(np.bincount(part, v * v) + 1e-30)[part]
            v = (v + np.bincount(a, v[b] / (root[a] * root[b]), n)) / 2
        order = np.lexsort((v / root, part))
        size = np.bincount(part)
        place = np.arange(n) - np.concatenate([[0], np.cumsum(size)[:-1]])[part[order]]
        half = np.empty(n, np.int64)
        half[order] = place >= (size[part[order]] + 1) // 2
        part = part * 2 + half
    return part


def fit(x: np.ndarray, parts: int = PARTITIONS, degree: int = DEGREE, recall: float = RECALL, k: int = 20) -> Model:
    """Partition the sample's graph, learn to route, and choose the number of probes."""
    x = np.unique(x, axis=0)
    dim, n = x.shape[1], len(x)
    if n <= 4 * parts:  # too few to learn from: one part
        return Model(np.zeros((dim, 1)), np.zeros(1), 1)
    near = neighbours(x, min(degree, n - 1))
    part = balanced_parts(near, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1.0)
    target[np.arange(n), part] += degree / 2
    target /= target.sum(1, keepdims=True)
    scale = 1 / np.sqrt((x * x).mean() + 1e-30)
    w, b = np.zeros((dim, parts)), np.zeros(parts)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, 201):  # Adam on the whole sample
        z = x @ w * scale + b
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - target) / n
        gw, gb = scale * (x.T @ p) + 1e-5 * w, p.sum(0)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, b = w - rate * mw / (np.sqrt(vw) + 1e-9), b - rate * mb / (np.sqrt(vb) + 1e-9)
    model = Model(w * scale, b, parts)
    z = model.logits(x)
    home = z.argmax(1)
    rank = np.empty((n, parts), np.int64)
    np.put_along_axis(rank, np.argsort(-z, axis=1), np.broadcast_to(np.arange(parts), z.shape), axis=1)
    needs = np.sort(rank[np.arange(n)[:, None], home[neighbours(x, min(k, n - 1))]].ravel())
    return model._replace(probes=int(needs[min(len(needs) - 1, int(recall * len(needs)))]) + 1)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(fine & F.exists("v", lambda x: x != 0))


def placed(vectors: DataFrame, model: Model) -> DataFrame:
    """``(vec_id, v, parts)``: the parts of each vector, most probable first."""
    def run(batches):
        for p in batches:
            z = model.logits(np.stack(p["v"].to_list()))
            p["parts"] = list(np.argsort(-z, axis=1, kind="stable").astype(np.int32))
            yield p

    return vectors.mapInPandas(run, "vec_id bigint, v array<double>, parts array<int>")


def reranked(queries, block, k: int):
    """The ``k`` nearest vectors of one block to each query, by exact scores."""
    import pandas as pd

    if queries.empty or block.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": float})
    ids, x = block["vec_id"].to_numpy(), np.stack(block["v"].to_list())
    out = []
    for q, v in zip(queries["query_id"].to_numpy(), queries["qv"], strict=True):
        v = np.asarray(v)
        s = x @ v
        s[ids == q] = -np.inf
        if len(s) > k:
            bound = -np.partition(-s, k - 1)[k - 1]
            keep = np.flatnonzero(s >= bound - 1e-9 * max(1.0, abs(bound)))
        else:
            keep = np.arange(len(s))
        keep = keep[ids[keep] != q]
        exact = (x[keep] * v).sum(1)
        best = np.lexsort((ids[keep], -exact))[:k]
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[keep][best], "score": exact[best]}))
    return pd.concat(out)


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
           sample: int = SAMPLE, parts: int = PARTITIONS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for every row for which ``is_query(vec_id)`` holds."""
    good = usable(vectors, vec_id, vector)
    common = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if common is None:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    good = good.where(F.size("v") == common["dim"])
    rows = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    model = fit(np.array([r["v"] for r in rows]), parts, k=k)
    spread = cut(placed(good, model))
    base = spread.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), F.col("parts")[0].alias("part"))
    # Ids of each part, an id of several parts in one of them, so that their sums are ids at hand; one number per partition.
    held = dict(base.groupBy("vec_id").agg(F.min("part").alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect())
    ids = F.array(*[F.lit(held.get(i, 0)).cast("bigint") for i in range(len(model.bias))])
    # Further parts until those before hold k others; the query itself may be one of their ids.
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("probes"))
    enough = F.aggregate("parts", none, lambda acc, p: F.when(
        (acc["probes"] >= model.probes) & (acc["n"] > k), acc).otherwise(F.struct((acc["n"] + F.get(ids, p)).alias("n"), (acc["probes"] + 1).alias("probes"))))["probes"]
    asked = spread.where(is_query(F.col("vec_id"))).select("vec_id", "v", F.explode(F.slice("parts", F.lit(1), enough)).alias("part"))

    counts = base.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("asks"))
    plan = F.broadcast(cut(counts.join(wanted, "part")))  # one row per partition, their number is a parameter

    def dealt(n: str):
        return F.pmod(F.xxhash64(F.lit(n), "vec_id"), F.col(n)).cast("int")

    b = base.join(plan, "part").select("vec_id", "v", "part", dealt("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"))
    q = asked.join(plan, "part").dropDuplicates(["vec_id", "part"]).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("part").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), dealt("asks").alias("ask"))
    key = ["part", "block", "ask"]
    near = q.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(
        lambda x, y: reranked(x, y, k), "query_id bigint, vec_id bigint, score double")
    # Repeated candidate rows are one candidate.
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
