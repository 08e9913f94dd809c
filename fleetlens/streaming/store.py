"""Tables that streams add to batch by batch: parts, versions of the list of parts, and merges of parts.

A batch writes its rows as a new part and then a new version: the list of all parts that count, and of the last batch of every
run. A reader takes the newest complete version and the parts it names, so it never sees half a batch or half a merge. A batch
that a run has written before is left out, whichever checkpoint the run goes on from. ``FAN`` parts of one level and day merge
into one of the next level, so their number grows with the logarithm of the number of batches; parts and versions that no
reader can still be at are deleted. One stream writes to a store at a time; a second one fails at its first version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN = 8
"""Parts of a level and day that merge into one."""

KEPT_VERSIONS = 3
"""Versions whose parts stay for readers that have begun."""

FILTER_BITS = 32768
"""Bits of one piece of a filter, as Spark's bitmap functions have them."""

ENTRY = "kind string, run string, batch bigint, folder string, day string, level int"


@dataclass(frozen=True)
class Part:
    folder: str
    day: str | None
    level: int


@dataclass
class Version:
    number: int = 0
    runs: dict[str, int] = field(default_factory=dict)
    parts: list[Part] = field(default_factory=list)


def current_run(spark: SparkSession) -> str:
    """The stream's own id, which goes with its checkpoint; outside of a stream a constant."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "manual"


class Store:
    """The parts below ``path``. With ``days``, rows are kept apart by the column ``day``, a text, which is not among the columns of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, merge: Callable[[DataFrame], DataFrame] | None = None,
                 days: bool = False, keys: Sequence[str] = (), pieces: int = 256):
        self.spark, self.path, self.schema, self.days = spark, path, schema, days
        self.merge, self.keys, self.pieces = merge or (lambda rows: rows), list(keys), pieces

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        """Complete versions in ascending order."""
        files, at = self._files()
        folder = at(f"{self.path}/versions")
        if not files.exists(folder):
            return []
        names = [one.getPath().getName() for one in files.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit() and files.exists(at(f"{self.path}/versions/{n}/_SUCCESS")))

    def _entries(self, number: int) -> list:
        return self.spark.read.schema(ENTRY).json(f"{self.path}/versions/{number:012d}").collect()

    def current(self) -> Version:
        """The newest complete version; its size is the number of parts, not of rows."""
        numbers = self._versions()
        if not numbers:
            return Version()
        entries = self._entries(numbers[-1])
        return Version(numbers[-1], {e.run: e.batch for e in entries if e.kind == "run"},
                       [Part(e.folder, e.day, e.level) for e in entries if e.kind == "part"])

    def rows(self, parts: Sequence[Part], columns: Sequence[str] | None = None) -> DataFrame:
        """The rows of some parts; with days, also their ``day``."""
        wanted = self.schema if columns is None else StructType([f for f in self.schema.fields if f.name in columns])
        if not parts:
            empty = self.spark.createDataFrame([], wanted)
            return empty.withColumn("day", F.lit(None).cast("string")) if self.days else empty
        found = self.spark.read.schema(wanted).parquet(*[f"{self.path}/{p.folder}" for p in parts])
        # The folder says the day; rows of a part are of one day.
        return found if not self.days else found.withColumn("day", F.regexp_extract("_metadata.file_path", r"/day=([^/]*)/", 1))

    def read(self, days: Sequence[str] | None = None) -> DataFrame:
        """All rows, or those of some days; merged, so that a key of a running result comes once."""
        parts = self.current().parts
        return self.merge(self.rows([p for p in parts if days is None or p.day in days]))

    def _write(self, rows: DataFrame, folder: str) -> list[str | None]:
        """Write a folder of parts, and the filters of its keys; its days."""
        if not self.days:
            rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
            return [None]
        # A file for each small day, several for one that holds most rows.
        rows.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/{folder}")
        if self.keys:
            bits = rows.select("day", *self.place()).groupBy("day", "piece").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
            bits.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/filters/{folder}")
        files, at = self._files()
        names = [one.getPath().getName() for one in files.listStatus(at(f"{self.path}/{folder}"))]
        return [n.removeprefix("day=") for n in names if n.startswith("day=")]

    def place(self) -> list[Column]:
        """A key's ``piece`` and ``bit`` in its day's filter."""
        slot = F.pmod(F.xxhash64(*self.keys), F.lit(self.pieces * FILTER_BITS))
        return [F.floor(slot / FILTER_BITS).cast("int").alias("piece"), (slot % FILTER_BITS).alias("bit")]

    def perhaps_stored(self, rows: DataFrame, days: Sequence[str], version: Version) -> DataFrame:
        """The rows whose keys the filters of these days let through: all that are stored, and few others."""
        folders = [f"{self.path}/filters/{p.folder}" for p in version.parts if p.day in days]
        bits = self.spark.read.schema("piece int, bits binary").parquet(*folders).withColumn(
            "day", F.regexp_extract("_metadata.file_path", r"/day=([^/]*)/", 1))
        joined = bits.groupBy("day", "piece").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
        return rows.select("*", *self.place()).join(joined, ["day", "piece"]).filter(
            byte.bitwiseAND(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")) != 0).drop("piece", "bit", "bits")

    def written(self, run: str, batch: int, version: Version) -> bool:
        """Whether the run has committed this batch before."""
        return version.runs.get(run, -1) >= batch

    def append(self, rows: DataFrame, run: str, batch: int, version: Version) -> None:
        """Add a batch's rows after ``version``: write its part, merge what is due, commit, and drop what no reader needs."""
        number = version.number + 1
        folder = f"parts/{number:012d}"
        parts = [*version.parts, *(Part(f"{folder}/day={d}" if d is not None else folder, d, 0) for d in self._write(rows, folder))]
        parts = self._merged(parts, number)
        self._commit(Version(number, {**version.runs, run: batch}, parts))
        self._clean(number)

    def _merged(self, parts: list[Part], number: int) -> list[Part]:
        level = 0
        while any(p.level >= level for p in parts):
            held: dict[str | None, list[Part]] = {}
            for part in parts:
                if part.level == level:
                    held.setdefault(part.day, []).append(part)
            due = {day: found for day, found in held.items() if len(found) >= FAN}
            if due:
                gone = {p for found in due.values() for p in found}
                folder = f"parts/{number:012d}-{level + 1}"
                days = self._write(self.merge(self.rows([p for p in parts if p in gone])), folder)
                parts = [p for p in parts if p not in gone] + [
                    Part(f"{folder}/day={d}" if d is not None else folder, d, level + 1) for d in days]
            level += 1
        return parts

    def _commit(self, version: Version) -> None:
        entries = [("run", run, batch, None, None, None) for run, batch in version.runs.items()]
        entries += [("part", None, None, p.folder, p.day, p.level) for p in version.parts]
        # Fails if another stream has written this version.
        self.spark.createDataFrame(entries, ENTRY).coalesce(1).write.json(f"{self.path}/versions/{version.number:012d}")

    def _clean(self, newest: int) -> None:
        """Delete what only versions before the kept ones name."""
        old = [n for n in self._versions() if n <= newest - KEPT_VERSIONS]
        if not old:
            return
        folders = lambda numbers: {e.folder for n in numbers for e in self._entries(n) if e.kind == "part"}
        gone = folders(old) - folders(n for n in self._versions() if n not in old)
        files, at = self._files()
        for folder in sorted(gone):
            files.delete(at(f"{self.path}/{folder}"), True)
            files.delete(at(f"{self.path}/filters/{folder}"), True)
            self._drop_if_empty(folder.split("/day=")[0])
        for number in old:
            files.delete(at(f"{self.path}/versions/{number:012d}"), True)

    def _drop_if_empty(self, folder: str) -> None:
        files, at = self._files()
        for path in (f"{self.path}/{folder}", f"{self.path}/filters/{folder}"):
            if files.exists(at(path)) and not any(one.isDirectory() or one.getPath().getName().endswith(".parquet") for one in files.listStatus(at(path))):
                files.delete(at(path), True)
