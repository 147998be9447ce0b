import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import ann, queries


def exact(rows, k=20):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.all(np.isfinite(v)) and np.any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            s = sorted(((-float((good[i] * good[q]).sum()), i) for i in good if i != q))[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


def compared(got, want):
    found = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert by.keys() <= want.keys()
    for q, best in want.items():
        mine = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(best)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        least = best[-1][1]
        found += sum(r.score >= least - 1e-12 for r in mine)
        total += len(best)
    return found / total


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert compared(queries.QUERIES["op5_ann"](spark, d).collect(), exact(rows)) >= 0.9


def test_odd_vectors_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(1)
    hot = rng.standard_normal(8).tolist()
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)] + [(i, hot) for i in range(400, 700)]
    rows += [(700, None), (720, [0.0] * 8), (740, [float("nan")] + [1.0] * 7), (760, [None] + [1.0] * 7), (780, [float("inf")] + [1.0] * 7), (None, hot)]
    rows += [rows[20], rows[500]]  # repeated rows
    v = spark.createDataFrame([(i, x, "x") for i, x in rows], "vec_id long, embedding array<double>, v string")
    got = ann.search(v, lambda i: i % 20 == 0, parts=8).collect()
    want = exact(rows)
    assert compared(got, want) >= 0.9
    same = [r.vec_id for r in sorted((r for r in got if r.query_id == 500), key=lambda r: r.rank)]
    assert same[:20] == [i for i, _ in want[500]]  # all ties, smallest ids first


def test_odd_length_first_and_small_parts(spark, monkeypatch):
    """The commonest length counts, and parts of few vectors are not all that a query sees."""
    rng = np.random.default_rng(4)
    ids = [r.vec_id for r in spark.range(120).withColumnRenamed("id", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").collect()]
    odd = next(i for i in ids if i % 20)  # a query would have no rows
    ids = [i for i in ids if i == odd or ids.index(i) > ids.index(odd)]  # the odd one has the least hash
    rows = [(i, [1.0, 2.0, 3.0] if i == odd else [float(5 + i % 3) if i % 40 == 0 else 0.1, float(rng.standard_normal()) + 4]) for i in ids]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "fit", lambda x, *a, **b: ann.Model(np.array([[1.0, 0.0, -1.0], [0.0, 0.5, 0.0]]), np.zeros(3), 1))
    got = ann.search(v, lambda i: i % 20 == 0).collect()
    queried = [i for i in ids if i % 20 == 0]
    assert len(queried) > 1 and {i for i in queried if i % 40 == 0}
    assert {q: sum(r.query_id == q for r in got) for q in queried} == dict.fromkeys(queried, 20)
    assert odd not in {r.vec_id for r in got}


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(few, lambda i: i % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1, 4.0), (0, 2, 2, 0.5)]
    assert ann.search(few.limit(0), lambda i: i % 20 == 0).collect() == []


def test_parts_are_balanced():
    x = np.random.default_rng(2).standard_normal((1000, 16))
    part = ann.balanced_parts(ann.neighbours(x, 10), 8)
    assert np.bincount(part).tolist() == [125] * 8
