"""Source divergence: SQL, and a dense version of odd rows."""

import re
from collections import Counter

import pytest

from gridweave.llm import queries, source_divergence
from gridweave.plans import check

SF = "/root/testdata/sf0.001"


def dense(rows, least, top=50):
    groups, docs, counts = set(), Counter(), {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        docs.update((lang, t) for t in set(terms))
        counts.setdefault((lang, source), Counter()).update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        some = sorted(s for x, s in groups if x == lang)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in some}
        q = shares(sum((counts[lang, s] for s in some), Counter()))
        for s in some:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in some if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def test_query_matches_sql(spark):
    con = check.connect(SF)
    ok, msg = check.compare(spark, con, SF, "op11_source_divergence", queries.QUERIES["op11_source_divergence"], queries.ORACLES["op11_source_divergence"])
    assert ok, msg


@pytest.mark.parametrize("held", [200_000, 3])
def test_odd_rows_against_dense(spark, monkeypatch, held):
    monkeypatch.setattr(source_divergence, "HELD", held)
    rows = [("The cat, the CAT and the dog's tail ÄÖ ä", "en", f"s{i % 3}") for i in range(40)]  # one text in three sources
    rows += [(f"a dog number{i % 7} sat\x00on the{i}mat ÉTÉ été \x85 k x", "en", "s1" if i % 4 else None) for i in range(60)]
    rows += [("x " * 30_000 + "é" * 9, "en", "long"), ("", "en", "void"), (None, "en", "void"), (None, None, None), ("tie aa bb", None, "s1"), ("tie aa bb", "", "s2")]
    rows += [("une seule source ici", "fr", "s1")] * 12 + [("[]{}@ 123 _^`", "num", "s1"), ("7", "num", "s2")]
    schema = "text string, lang string, source string, term string, n long"
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], schema)
    for least in (2, 10):
        got = sorted(tuple(r) for r in source_divergence.audit(docs, least=least).collect())
        assert got == dense(rows, least)
    assert {g[2] for g in got} == {"pair", "term"}
    assert [tuple(r) for r in source_divergence.audit(docs.where("false")).collect()] == []
    one = source_divergence.audit(docs, top=1, least=2).where("part = 'term'")
    assert one.groupBy("lang", "source").count().where("count > 1").count() == 0


def test_shares_of_large_counts(spark):
    """Counts beyond what a product of longs holds stay exact."""
    big = 7 * 10**15 + 3
    df = spark.createDataFrame([(big, 3 * big + 1, 10**6)], "n long, total long, terms long")
    assert source_divergence.with_share(df, "p", "n").first().p == 1 + 10**9 * (big + 5) // (3 * big + 1 + 5 * 10**6)
