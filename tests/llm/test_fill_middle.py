"""Fill-in-middle: SQL, a unit-by-unit version, odd rows and the way back."""

import hashlib

from pyspark.sql import functions as F

from gridweave.llm import fill_middle, queries
from gridweave.plans import check

SF = "/root/testdata/sf0.001"


def slow(doc_id, text):
    """Units one by one."""
    text = text or ""
    units, word = [], ""
    for c in text:
        if c.isascii() and c.isalpha():
            word += c
        else:
            units += [word, c] if word else [c]
            word = ""
    units += [word] if word else []
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fill_middle.MARKERS) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_query_matches_sql(spark):
    con = check.connect(SF)
    ok, msg = check.compare(spark, con, SF, "op12_fill_middle", queries.QUERIES["op12_fill_middle"], queries.ORACLES["op12_fill_middle"])
    assert ok, msg


def test_odd_rows_and_round_trip(spark):
    texts = [None, "", "one", " ", "a<P>b", "x <S", "<", "é🙂ß ab\n\r\t12", "A" * 3_000, "ab, " * 60_000, " line\x00nul", "<<M", "word " * 40, "P>S>M>", "no <M> here"]
    rows = [(i, t, "kept", "f") for i, t in enumerate(texts * 4)] + [(7, texts[7], None, None), (7, "other", None, None), (None, "no id here", None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string")
    made = fill_middle.transform(docs)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    want = sorted(((i, *slow(i, t), t or "") for i, t, _, _ in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    empty = fill_middle.transform(docs.where("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_pieces_of_long_texts():
    """A text longer than one match may be is matched in pieces, with the same ends."""
    text = "Some words, and 12 more\n" * 300 + "z" * 900 + " end" + "q" * 400
    whole = fill_middle.unit_ends(text).tolist()
    for most in (1, 7, 64, 1000):
        assert fill_middle.unit_ends(text, most).tolist() == whole
    assert whole[-1] == len(text) and fill_middle.unit_ends("").tolist() == []
    assert len(fill_middle.unit_ends("ab " * 2_500_000)) == 5_000_000
