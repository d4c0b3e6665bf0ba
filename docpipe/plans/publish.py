"""Publishing runs: the tables of a run become visible together, once, and a repeat of the run replaces them.

A run writes its tables to a folder of its own attempt. When all are written and the numbers of rows agree, one small
file, the run's pointer, is moved into place by an atomic rename. Readers see the attempts that pointers name and
nothing else: a run that broke off anywhere is invisible, and one that is run again takes the place of its earlier self.
Runs do not wait for each other, as each has its own pointer.

    <base>/runs/<run>.json                                  pointer: attempt, numbers of rows, schemas
    <base>/data/<table>/run=<run>/attempt=<attempt>/...     rows
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "run string, attempt string, counts map<string,bigint>, schemas map<string,string>"


class Files:
    """The few file operations that publishing needs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.system(name).exists(self.path(name))

    def children(self, name: str) -> list:
        return list(self.system(name).listStatus(self.path(name))) if self.exists(name) else []

    def remove(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)

    def replace(self, name: str, text: str) -> None:
        """Write a file so that readers see the old one or the new one, never a part."""
        folder, file = name.rsplit("/", 1)
        draft = f"{folder}/_{uuid.uuid4().hex}-{file}"
        stream = self.system(draft).create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        source, target = (self.system(folder).makeQualified(self.path(n)) for n in (draft, name))
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.conf).rename(source, target, options)


def run_name(name: str) -> str:
    """A name that is safe in paths: itself, or a hash of it."""
    return name if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]{0,120}", name) else hashlib.sha256(name.encode()).hexdigest()


@dataclass
class Run:
    """What is being written; see `publishing`."""

    store: Store
    name: str
    attempt: str
    counts: dict[str, int] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)

    def write(self, table: str, rows: DataFrame, by: str | None = None) -> int:
        """Write one table of the run; its rows are counted in the same pass."""
        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write
        writer = writer.partitionBy(by) if by else writer
        writer.parquet(self.store.folder(table, self.name, self.attempt))
        self.counts[table] = int(seen.get["n"])
        self.schemas[table] = rows.schema.json()
        return self.counts[table]


@dataclass(frozen=True)
class Store:
    """Published tables below a folder that all executors share."""

    spark: SparkSession
    base: str

    def folder(self, table: str, run: str, attempt: str) -> str:
        return f"{self.base.rstrip('/')}/data/{table}/run={run}/attempt={attempt}"

    def runs(self) -> DataFrame:
        """A row per published run: run, attempt, counts, schemas."""
        folder = f"{self.base.rstrip('/')}/runs"
        if not Files(self.spark).exists(folder):
            return self.spark.createDataFrame([], POINTER)
        return self.spark.read.schema(POINTER).json(folder)

    def has(self, table: str) -> bool:
        return not self.runs().filter(F.col("schemas")[table].isNotNull()).isEmpty()

    def read(self, table: str, extra: Sequence[str] = (), run: str | None = None) -> DataFrame:
        """The rows of all published runs, or of one. Files of other attempts are not even listed.

        ``extra`` may name `run`, and `file_time`, when the file of the row was written.
        """
        pointers = self.runs().filter(F.lit(run is None) | (F.col("run") == run))
        pointers = [r for r in pointers.select("run", "attempt", F.col("schemas")[table].alias("schema")).collect() if r["schema"]]
        if not pointers:
            raise ValueError(f"no run with a table {table} is published in {self.base}")
        schema = T.StructType.fromJson(json.loads(max(pointers, key=lambda r: r["run"])["schema"]))
        paths = [self.folder(table, r["run"], r["attempt"]) for r in pointers]
        partitions = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType())])
        rows = self.spark.read.schema(partitions).option("basePath", f"{self.base.rstrip('/')}/data/{table}").parquet(*paths)
        known = {"run": F.col("run"), "file_time": F.col("_metadata.file_modification_time").alias("file_time")}
        return rows.select(*schema.names, *[known[e] for e in extra])

    def withdraw(self, run: str) -> None:
        """Take a run back: its pointer goes, and with it all its rows."""
        Files(self.spark).remove(f"{self.base.rstrip('/')}/runs/{run_name(run)}.json")

    @contextmanager
    def publishing(self, name: str) -> Iterator[Run]:
        """A new attempt of the run `name`; it is published if the block ends without an error."""
        run = Run(self, run_name(name), uuid.uuid4().hex)
        yield run
        pointer = {"run": run.name, "attempt": run.attempt, "counts": run.counts, "schemas": run.schemas}
        Files(self.spark).replace(f"{self.base.rstrip('/')}/runs/{run.name}.json", json.dumps(pointer))

    def remove_unpublished(self, hours: float = 24) -> int:
        """Delete the attempts that no pointer names and that are older than `hours`; returns their number.

        Choose more hours than any run, or reader of a replaced run, takes.
        """
        files = Files(self.spark)
        named = {(r["run"], r["attempt"]) for r in self.runs().select("run", "attempt").collect()}
        before = (time.time() - hours * 3600) * 1000
        removed = 0
        for table in files.children(f"{self.base.rstrip('/')}/data"):
            for run in files.children(table.getPath().toString()):
                for attempt in files.children(run.getPath().toString()):
                    key = tuple(p.getPath().getName().split("=", 1)[1] for p in (run, attempt))
                    if key not in named and attempt.getModificationTime() <= before:
                        files.remove(attempt.getPath().toString())
                        removed += 1
        return removed
