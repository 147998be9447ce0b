"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.session import cut

#: Edges, counted both ways, of a contracted graph up to which one task closes it: some ten MB, less than a round of jobs costs.
CLOSED = 400_000


def _close(edges: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, src, to)`` of a graph of ``CLOSED`` edges at most: every node's representative."""
    def run(parts):
        import pyarrow as pa

        boss: dict = {}

        def find(x):
            while boss[x] != x:
                boss[x] = x = boss[boss[x]]
            return x

        for batch in parts:
            for *key, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = (*key, a), (*key, b)
                x, y = find(a) if a in boss else boss.setdefault(a, a), find(b) if b in boss else boss.setdefault(b, b)
                if x != y:
                    boss[x] = y
        nodes = list(boss)
        for k in range(0, len(nodes), 10_000):
            rows = [(*n, find(n)[-1]) for n in nodes[k:k + 10_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*by, "src", "to"])

    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(edges.schema)]
    # Every edge is there both ways; one way is enough.
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip([*by, "src", "to"], edges.schema, strict=True))
    return edges.where("src < dst").coalesce(1).mapInArrow(run, schema)


def connected_components(nodes: DataFrame, edges: DataFrame, by: list[str], node: str = "node") -> DataFrame:
    """``(*by, node, comp)``: the smallest node id of each component.

    ``edges(*by, src, dst)`` is undirected.  In each round every node hooks to
    the member of its closed neighbourhood with the least digest (a fresh one
    per round), and the graph is contracted along the hooks.  About half the
    nodes go per round whatever the shape, so long chains and hubs both close
    in a logarithmic number of rounds; a graph that has come down to ``CLOSED``
    edges is closed in one step instead.  Rounds are written tables, so a lost
    executor costs one round at most.
    """
    e = edges.where("src <> dst").select(*by, "src", "dst")
    e = cut(e.unionByName(e.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    hooks: list[DataFrame] = []
    while left := e.count():
        if left <= CLOSED:
            hooks.append(cut(_close(e, by)))
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(hooks)), F.col(c)).alias("h"), F.col(c).alias("to"))
        near = e.groupBy(*by, "src").agg(F.min(rank("dst")).alias("_m"))
        step = cut(near.select(*by, "src", F.least("_m", rank("src"))["to"].alias("to")))
        a = step.select(*by, "src", F.col("to").alias("_a"))
        b = step.select(*by, F.col("src").alias("dst"), F.col("to").alias("_b"))
        e = cut(e.join(a, [*by, "src"]).join(b, [*by, "dst"]).where("_a <> _b").select(
            *by, F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct())
        hooks.append(step)
    every = nodes.select(*by, node).distinct()
    if not hooks:
        return every.withColumn("comp", F.col(node))
    # Compose from the smallest, last round back to the first.
    root = hooks[-1]
    for step in reversed(hooks[:-1]):
        later = root.select(*by, F.col("src").alias("to"), F.col("to").alias("_root"))
        root = step.join(later, [*by, "to"], "left").select(*by, "src", F.coalesce("_root", "to").alias("to"))
    rooted = cut(every.join(root.withColumnRenamed("src", node), [*by, node], "left").select(
        *by, node, F.coalesce("to", node).alias("_root")))
    least = rooted.groupBy(*by, "_root").agg(F.min(node).alias("comp"))
    return rooted.join(least, [*by, "_root"]).select(*by, node, "comp")
