"""Versioned tables: a commit log over Parquet folders, for results that micro-batches rewrite.

A version is a folder ``v=N``.  It counts once the file ``_commits/N`` stands,
which is created in one atomic step after the folder is written.  A crash before
that leaves the version before it as the newest; the replay overwrites the
half-written folder.  A replay after it finds its number committed and changes
nothing.  The newest ``keep`` versions stay, for readers that still hold one;
older ones go, commit first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Versions that stay.
KEEP = 3


class Versions:
    """The versions of the table below ``path``."""

    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(1, keep)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def numbers(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(n) for n in self._names("_commits") if n.isdigit())

    def newest(self, below: int | None = None) -> int | None:
        some = [n for n in self.numbers() if below is None or n < below]
        return some[-1] if some else None

    def read(self, number: int | None = None) -> DataFrame:
        """A version, the newest unless told otherwise."""
        number = self.newest() if number is None else number
        if number is None:
            raise FileNotFoundError(f"no committed version below {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={number}")

    def write(self, df: DataFrame, number: int) -> None:
        """Write and commit a version; nothing happens if it is committed already."""
        if number in self.numbers():
            return
        df.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        self.commit(number)
        self.clean()

    def commit(self, number: int) -> None:
        self._fs.create(self._place(f"_commits/{number}"), False).close()

    def clean(self) -> None:
        """Remove all but the newest versions, and what crashes have left below them."""
        stay = self.numbers()[-self.keep:]
        for n in self._names("_commits"):
            if n.isdigit() and int(n) < stay[0]:
                self._fs.delete(self._place(f"_commits/{n}"), False)
        for n in self._names(""):
            if n.startswith("v=") and int(n[2:]) < stay[-1] and int(n[2:]) not in stay:
                self._fs.delete(self._place(n), True)
