import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Every stage on what the one before kept, over the whole of a small table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in cp.drop_toxic(spark, docs, sf).collect()}
    assert kept <= rows.keys() and len(kept) > 0.8 * len(rows)
    left = [(i, rows[i].text) for i in sorted(kept)]
    one = {d for d, _, c in brute(left, cp.NEAR) if d == c}
    now = docs.where(docs.doc_id.isin(*kept))
    near = cp.drop_near_copies(spark, now, sf)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == one
    clean = cp.drop_benchmark_passages(spark, docs.where(docs.doc_id.isin(*one)), sf)
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leak = {i for i in one if any(f" {x} " in f" {norm(rows[i].text)} " for x in items)}
    ids = {r.doc_id for r in clean.collect()}
    assert ids == one - leak
    safe = {r.doc_id: r for r in cp.redact_secrets(spark, docs.where(docs.doc_id.isin(*ids)), sf).collect()}
    assert safe.keys() == ids and all(r.n_chars == len(r.text) for r in safe.values())
    assert not any(re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text) for r in safe.values())
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    assert out.keys() == ids
    for i, r in out.items():
        assert r.ids == tok.encode(safe[i].text, add_special_tokens=False).ids and r.round_trip


def test_odd_rows(spark):
    """Nulls, repeats, an extra column and no rows pass all stages."""
    rows = [(1, "same words here again and again", "en", "s", 31, 7), (1, "same words here again and again", "en", "s", 31, 7), (2, None, None, None, None, None),
            (3, "", "en", "s", 0, 1), (None, "text without an id", "en", "s", 18, 1), (4, "password = hunter2222", "en", "s", 21, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score long"
    sf = "/root/testdata/sf0.001"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in cp.STAGES[1:]:
            docs = stage(spark, docs, sf)
        got = docs.collect()
        assert len(got) == (5 if some else 0)
    toxic = cp.drop_toxic(spark, spark.createDataFrame(rows, schema).drop("_score"), sf)
    assert toxic.count() == len(rows)


def test_near_copies_by_row(spark):
    """Repeated and missing ids decide by row: one row of every component stays, rows with an id first."""
    def text(k, n=40):
        return " ".join(f"w{k}x{i}" for i in range(n))

    near = text(1) + " tail"
    rows = [(1, text(1)), (2, near), (2, text(2)), (None, near), (None, text(3)), (None, text(3)), (4, text(4)), (4, text(4)), (5, ""), (5, ""), (None, None), (7, near)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row long")
    got = cp.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    kept = sorted(r._row for r in got.collect())
    assert kept[:2] == [0, 2] and len(kept) == 7  # the near copies under ids 2, 7 and null go
    assert len({4, 5} & set(kept)) == 1 and len({6, 7} & set(kept)) == 1 and {8, 9, 10} <= set(kept)
    assert cp.drop_near_copies(spark, docs.where("false"), SF).count() == 0
