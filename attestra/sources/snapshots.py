"""Tables of Parquet that change by commits: a reader sees one version as a whole, during a write too.

A table is a folder with ``data`` (files, never changed) and ``commits``
(000000.json, 000001.json, ..: which files each version is made of).  Rows are
dealt to buckets by a hash of their keys; a change writes the buckets that it
touches anew, and a commit lists, for every bucket, the folder that holds it.

A commit is one rename to the next number, which fails if that is taken; so two
writers can't both succeed from the same version.  That asks for a file system
whose rename is atomic and doesn't replace (HDFS, a local disk), which object
stores without such a rename aren't.  A change may carry a token: a change whose
token is in the log already (a replayed batch) does nothing.

Scale: a change reads and writes the buckets that it touches; what the driver
sees is bucket numbers and commit files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed since the version that a change was made from."""


class Table:
    """A table of committed snapshots at ``path``, its rows told apart by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # the log

    def version(self) -> int | None:
        """The number of the newest commit."""
        numbers = self._numbers()
        return numbers[-1] if numbers else None

    def _numbers(self) -> list[int]:
        folder = self._at("commits")
        if not self._files.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._files.listStatus(folder))
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def _commit(self, number: int) -> dict:
        stream = self._files.open(self._at("commits", f"{number:06d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, number: int, entry: dict) -> None:
        made = self._at("commits", f".{uuid.uuid4().hex}")
        stream = self._files.create(made)
        stream.write(json.dumps(entry).encode())
        stream.close()
        target = self._at("commits", f"{number:06d}.json")
        if self._files.exists(target) or not self._files.rename(made, target):
            self._files.delete(made, False)
            raise Conflict(f"version {number} of {self.path} is there already")

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless given; files that later commits replace stay until they expire."""
        number = self.version() if version is None else version
        if number is None:
            raise ValueError(f"{self.path} has no version yet")
        entry = self._commit(number)
        return self._rows(entry, entry["parts"])

    def _rows(self, entry: dict, buckets) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.path}/data/{entry['parts'][b]}/_bucket={b}" for b in buckets if b in entry["parts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # writing

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> tuple[str, set[str]]:
        """A new folder with ``rows``, and its buckets."""
        folder = uuid.uuid4().hex
        self._dealt(rows).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        return folder, {f.getPath().getName().split("=")[1] for f in self._files.listStatus(self._at("data", folder)) if "=" in f.getPath().getName()}

    def replace(self, rows: DataFrame, token: str | None = None) -> int:
        """The whole table anew."""
        return self._change(rows, lambda old, new: new, token, whole=True)

    def upsert(self, rows: DataFrame, token: str | None = None) -> int:
        """Rows with new keys come in, rows with known keys are replaced; ``rows`` has a key once."""
        return self._change(rows, lambda old, new: old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new), token)

    def delete(self, keys: DataFrame, token: str | None = None) -> int:
        """Rows whose keys are among ``keys`` go."""
        return self._change(keys.select(*self.keys).distinct(), lambda old, new: old.join(new, self.keys, "left_anti"), token)

    def change(self, how: Callable[[DataFrame], DataFrame], token: str | None = None) -> int:
        """The whole table as ``how`` makes it from the newest version."""
        return self._change(None, lambda old, _: how(old), token, whole=True)

    def _change(self, rows: DataFrame | None, how: Callable[[DataFrame, DataFrame], DataFrame], token: str | None, whole: bool = False) -> int:
        number = self.version()
        entry = self._commit(number) if number is not None else None
        if token is not None and any(token in self._commit(n)["tokens"] for n in self._numbers()[-1:]):
            return number
        touched = staged = None
        if not whole:
            if entry is None:
                entry = {"parts": {}, "schema": rows.schema.jsonValue(), "tokens": []}
            # computed once: which buckets a change touches is seen from what it wrote
            staged, touched = self._write(rows)
            rows = self._rows({"parts": dict.fromkeys(touched, staged), "schema": rows.schema.jsonValue()}, touched)
        old = self._rows(entry, entry["parts"] if touched is None else touched) if entry else None
        made = how(old, rows)
        if entry and not whole:
            made = made.select(*StructType.fromJson(entry["schema"]).fieldNames())
        try:
            folder, written = self._write(made)
        finally:
            if staged is not None:
                self._files.delete(self._at("data", staged), True)
        kept = {} if touched is None else {b: f for b, f in entry["parts"].items() if b not in touched}
        # a log without end of tokens would grow with the table's age: the newest thousand are remembered
        tokens = ([*entry["tokens"], token] if entry else [token]) if token is not None else (entry["tokens"] if entry else [])
        self._publish(0 if number is None else number + 1, {"parts": kept | {b: folder for b in sorted(written)}, "schema": made.schema.jsonValue(), "tokens": tokens[-1000:]})
        return 0 if number is None else number + 1

    def expire(self, keep: int = 1) -> int:
        """Drop all versions but the ``keep`` newest, and the files that only they had; how many folders went.

        A reader of an old version must be done before.
        """
        numbers = self._numbers()
        gone, stay = numbers[:-keep], numbers[-keep:]
        needed = {f for n in stay for f in self._commit(n)["parts"].values()}
        old = {f for n in gone for f in self._commit(n)["parts"].values()} - needed
        for n in gone:
            self._files.delete(self._at("commits", f"{n:06d}.json"), False)
        for folder in old:
            self._files.delete(self._at("data", folder), True)
        return len(old)
