"""Tables that several writers change: files that stay as they are, and numbered versions that list them."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.sources.sinks import replaced, unseen

RETRIES = 20


class Conflict(Exception):
    """Another writer made the version first."""


class Versions:
    """A table at ``path``: Parquet files under ``data``, and ``versions/<number>.json`` with the files of each version.

    A writer writes its files, then creates the next version; creating is exclusive, so of two writers one is
    told of the other, looks at the table again and retries. A reader takes the files of the newest version: it sees the table before a change or
    after it, and never none. Files that no version lists are only waste, left by writers that failed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("versions").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def number(self) -> int:
        """The newest version; -1 if there is none."""
        if not self.fs.exists(self.at("versions")):
            return -1
        return max((int(f.getPath().getName()[:-5]) for f in self.fs.listStatus(self.at("versions")) if f.getPath().getName().endswith(".json")), default=-1)

    def entry(self, number: int) -> dict:
        if number < 0:
            return {"files": [], "schema": None, "batches": {}}
        stream = self.fs.open(self.at(f"versions/{number:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame | None:
        """A version, the newest by default; null if there is none."""
        entry = self.entry(self.number() if number is None else number)
        if entry["schema"] is None:
            return None
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in entry["files"])) if entry["files"] else self.spark.createDataFrame([], schema)

    def add(self, rows: DataFrame) -> list[str]:
        """Write rows as new files."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return [f"{folder}/{f.getPath().getName()}" for f in self.fs.listStatus(self.at(folder)) if f.getPath().getName().endswith(".parquet")]

    def commit(self, number: int, entry: dict) -> None:
        """Create version ``number`` whole, unless it is there: then Conflict.

        The entry is written beside and published by a move that refuses to replace; on a machine's own files that is a hard link, as their move replaces.
        """
        goal, beside = self.at(f"versions/{number:012d}.json"), self.at(f"versions/.{uuid.uuid4().hex}.new")
        out = self.fs.create(beside, True)
        out.write(json.dumps(entry).encode())
        out.close()
        try:
            if self.fs.getScheme() == "file":
                local = lambda p: self.fs.makeQualified(p).toUri().getPath()
                os.link(local(beside), local(goal))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), self.conf)
                none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(self.fs.makeQualified(beside), self.fs.makeQualified(goal), none)
        except FileExistsError:
            raise Conflict(number) from None
        except Py4JJavaError as e:
            if self.fs.exists(goal):
                raise Conflict(number) from None
            raise e
        finally:
            self.fs.delete(beside, False)

    def change(self, make: Callable[[DataFrame | None, dict], dict | None]) -> int:
        """Make a new version from the newest by ``make(rows, entry)``, again if another writer was first; the version's number. None: nothing to do."""
        for attempt in range(RETRIES):
            number = self.number()
            entry = self.entry(number)
            new = make(self.read(number), entry)
            if new is None:
                return number
            try:
                self.commit(number + 1, new)
                return number + 1
            except Conflict:
                time.sleep(min(2.0, 0.05 * 2**attempt))
        raise Conflict(f"{self.path}: {RETRIES} other writers were first")

    def append_new(self, rows: DataFrame, key: str, batch: tuple[str, int] | None = None) -> int:
        """IO7: add the rows whose key the table doesn't have, of rows with one key the first that Spark meets; null keys are one key.

        ``batch`` (a stream's name, the batch's number): a batch that is already in is not added again.
        """

        def make(there: DataFrame | None, entry: dict) -> dict | None:
            if batch and entry["batches"].get(batch[0], -1) >= batch[1]:
                return None
            new = rows.dropDuplicates([key]) if there is None else unseen(rows, there, key)
            return {"files": entry["files"] + self.add(new), "schema": entry["schema"] or rows.schema.json(), "batches": entry["batches"] | ({batch[0]: batch[1]} if batch else {})}

        return self.change(make)

    def replace_rows(self, new: DataFrame, key: str) -> int:
        """IO8: ``replaced``; only files that hold one of the keys are written anew, the others are listed as they are."""

        def make(there: DataFrame | None, entry: dict) -> dict | None:
            if there is None:
                return None
            keys = new.select(key).distinct()
            hit = there.select(key, F.col("_metadata.file_path").alias("_file")).join(keys, key, "left_semi").select("_file").distinct()
            names = {r["_file"].split("/data/")[-1] for r in hit.collect()}  # a name a file that changes
            old = [f for f in entry["files"] if f.removeprefix("data/") in names]
            if not old:
                return None
            rows = self.spark.read.schema(there.schema).parquet(*(f"{self.path}/{f}" for f in old))
            return entry | {"files": [f for f in entry["files"] if f not in old] + self.add(replaced(rows, new, key))}

        return self.change(make)
