"""Which names occur inside which texts: many patterns in one pass with an Aho-Corasick automaton.

Up to ``NAMES`` names make one automaton, which every task builds from a
broadcast list; the texts stay where they are and each is read once, whatever
the number of names.  More names are sharded by their first characters: a text
goes to the shards of its own character windows only, a shard that many names
begin alike in is cut further, and the texts of a shard are salted, so no group
grows with the data.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.session import cut

#: Names of one automaton (some hundred bytes each), and texts of one group of a shard.
NAMES, TEXTS = 200_000, 20_000
#: Characters that a name has at least; they choose its shard.
LEAST = 3


@lru_cache(maxsize=2)
def _automaton(names: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, name)
    made.make_automaton()
    return made


def _found(texts: list[str], names: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Pairs of a text and a name inside it."""
    hay: list[str] = []
    needle: list[str] = []
    if names:
        machine = _automaton(names)
        for t in texts:
            got = {name for _, name in machine.iter(t)}
            hay += [t] * len(got)
            needle += got
    return hay, needle


def _shard(window: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(window), F.lit(shards)).cast("int")


def contains_pairs(hay: DataFrame, needle: DataFrame, h: str, n: str, most: int = NAMES, group: int = TEXTS) -> DataFrame:
    """All ``(h, n)`` with ``n`` inside ``h``, for needles of ``LEAST`` characters or more; distinct, nulls meet nothing."""
    if h == n:
        raise ValueError("name the two columns differently")
    texts = hay.select(h).distinct().where(F.length(h) >= LEAST)
    names = cut(needle.select(n).distinct().where(F.length(n) >= LEAST))
    schema = f"`{h}` string, `{n}` string"
    count = names.count()
    if count <= most:
        return _whole(texts, names, h, n, schema)
    return _sharded(texts, names, h, n, schema, -(-count // most), most, group)


def _whole(texts: DataFrame, names: DataFrame, h: str, n: str, schema: str) -> DataFrame:
    """One automaton for all names, of which there are ``NAMES`` at most."""
    listed = names.sparkSession.sparkContext.broadcast(tuple(sorted(r[0] for r in names.collect())))

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            hay, needle = _found(batch.column(0).to_pylist(), listed.value)
            yield pa.RecordBatch.from_arrays([pa.array(hay, pa.string()), pa.array(needle, pa.string())], names=[h, n])

    return texts.mapInArrow(run, schema)


def _sharded(texts: DataFrame, names: DataFrame, h: str, n: str, schema: str, shards: int, most: int, group: int) -> DataFrame:
    """An automaton per shard of names, met by the texts that have one of the shard's windows."""
    named = names.select(n, _shard(F.substring(n, 1, LEAST), shards).alias("_s"))
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(h) - LEAST + 1), lambda i: _shard(F.substring(F.col(h), i, F.lit(LEAST)), shards)))
    placed = cut(texts.select(h, F.explode(windows).alias("_s")))
    # A row per shard: how often its names and its texts are cut.
    parts = named.groupBy("_s").agg(F.ceil(F.count("*") / most).cast("int").alias("_cuts")).join(
        placed.groupBy("_s").agg(F.ceil(F.count("*") / group).cast("int").alias("_salts")), "_s")
    parts = cut(parts)
    key = ["_s", "_cut", "_salt"]

    def dealt(df: DataFrame, c: str, own: str, many: str, other: str, times: str) -> DataFrame:
        """Rows in their own part ``own`` of ``many``, and in all ``times`` parts of the other side."""
        return df.join(parts, "_s").select(c, "_s", F.pmod(F.xxhash64(c), F.col(many)).cast("int").alias(own),
                                           F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias(other))

    left, right = dealt(named, n, "_cut", "_cuts", "_salt", "_salts"), dealt(placed, h, "_salt", "_salts", "_cut", "_cuts")

    def run(a, b):
        import pandas as pd

        hay, needle = _found(b[h].tolist(), tuple(sorted(a[n])))
        return pd.DataFrame({h: hay, n: needle}, dtype=object)

    # A name has one shard, so no pair comes twice.
    return left.select(n, *key).groupBy(*key).cogroup(right.select(h, *key).groupBy(*key)).applyInPandas(run, schema)
