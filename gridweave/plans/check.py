"""Run registered queries beside their SQL oracle and compare the results."""

from __future__ import annotations

import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(0.0 if v == 0 else round(v, 6))
        return f"{type(v).__name__}:{v}"

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(cols)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    """(ok, message) for one query."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, gc = normal([tuple(r) for r in df.collect()], df.columns)
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no oracle)"
    res = con.execute(sql)
    want, wc = normal(res.fetchall(), [d[0] for d in res.description])
    t2 = time.time()
    msg = f"rows={len(got)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if gc != wc:
        return False, f"{msg} columns {gc} != {wc}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"{msg} want={len(want)} only-spark={list(a - b)[:3]} only-duck={list(b - a)[:3]}"
    if not got:
        return False, msg + " EMPTY"
    return True, msg


def main(argv: list[str]) -> int:
    from gridweave.plans import registry
    from gridweave.session import local_session
    import gridweave.plans.catalog  # noqa: F401

    sf_dir, names = argv[0], argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            ok, msg = compare(spark, con, sf_dir, name, fn, registry.ORACLES.get(name))
        except Exception as exc:  # report and go on
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + " " + msg, flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
