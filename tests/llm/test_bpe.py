import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridweave.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "a" * 3000, "ab" * 700 + " x", "<|endoftext|>", "x<|endoftext|>  <|endoftext|>\n", " \n\n  x \t ", "don't 'S I'll",
       "日本語 テスト 🙂🙂", "\x00\x1c\x85 a b", "1234567 ٣٤", "Hello world, hello world. " * 4000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_odd_texts_and_clashing_columns(spark, tokenizer):
    rows = [(i, t, "was here", None) for i, t in enumerate(ODD)] + [(3, ODD[3], "again", 1), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, extra int")
    got = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "extra", "ids", "decoded"}
    for r in got:
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_ties_take_the_leftmost_pair():
    """Against the textbook loop, over every short string of a few letters."""
    voc = bpe.vocabulary(PATH)

    def slow(word):
        ids = [int(voc.byte_id[b]) for b in word]
        while len(ids) > 1:
            import numpy as np
            ranks = voc.rank(np.array(ids[:-1]), np.array(ids[1:]))
            if ranks.min() == bpe.EMPTY:
                break
            i = int(ranks.argmin())
            ids[i:i + 2] = [int(voc.merged[ranks[i]])]
        return ids

    import itertools

    import numpy as np
    words = [bytes(w) for n in range(1, 6) for w in itertools.product(b"aehtn", repeat=n)] + [b"the" * 40, b"a" * 129]
    for w, got in zip(words, bpe.encode_words(voc, words), strict=True):
        assert np.frombuffer(got, np.int32).tolist() == slow(w)


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op6_bpe"](spark, sf).collect()}
    import hashlib
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = tokenizer.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_a_batch_holds_few_pre_tokens_at_once():
    """The pre-tokens of 500 long texts took 100 MB of a worker, which it kept for the steps after."""
    import tracemalloc

    texts = [" ".join(f"w{(i * 7 + k) % 500}" for k in range(800)) for i in range(500)]
    coder = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    tracemalloc.start()
    for a, b in bpe.batches(texts):
        coder.encode(texts[a:b])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
