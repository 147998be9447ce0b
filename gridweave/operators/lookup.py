"""Joins with a side whose size is measured before the plan is chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.session import BROADCAST_ROWS

#: Parts that a hot key of the large side is split into where the small side can't be sent whole.
SALTS = 8


def lookup(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` joined with ``small`` (written, or cheap to count).

    Up to ``most`` rows of ``small`` are sent to every executor, so the rows of
    ``df`` stay where they are.  Beyond that both are shuffled: ``df`` by key and
    one of ``SALTS`` salts, ``small`` once per salt, so a hot key is many tasks'
    work.
    """
    if small.limit(most + 1).count() <= most:
        return df.join(F.broadcast(small), on, how)
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
