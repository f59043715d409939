"""Run folders with a list of commits: rerunnable writes over plain Parquet folders.

A run writes its rows into new folders (``data/<part>/run=<name>``) and commits
last, with one small JSON row in ``commits``. Readers take only committed
folders, so a run that was lost halfway, or a rerun while a reader is at work,
changes nothing that is read. All parts of a run (rows, quarantine, state)
become visible together, because one row names them all.

Runs are told apart by their name: of two commits of one name the newer counts.
Runs that cover a time range ``[low, high)`` replace each other by range: every
instant is read from the newest run that covers it.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.functions.scalar import ts_lit

COMMIT = "seq long, run string, low string, high string, folders map<string,string>"
MAX_RECORDS_PER_FILE = 5_000_000


class Conflict(Exception):
    """Another run committed first; read its result and try again."""


class Ledger:
    """Committed runs of the store at ``root``; ``low``/``high`` are ISO seconds, which order as text."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def records(self) -> list:
        """All commits, oldest first (one small row per run)."""
        try:
            rows = self.spark.read.schema(COMMIT).json(os.path.join(self.root, "commits")).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r for r in rows if r.run is not None), key=lambda r: r.seq)

    def newest(self):
        return next(reversed(self.records()), None)

    def has(self, run: str) -> bool:
        return any(r.run == run for r in self.records())

    def write(self, part: str, df: DataFrame, partitions: list[str] | tuple = ()) -> str:
        """Write one part of a run into a folder of its own; returns the folder's name (not yet visible)."""
        name = "r" + uuid.uuid4().hex
        # by folder, so that a run leaves few files; adaptive execution splits a hot folder over many tasks
        dealt = df.hint("rebalance", *(F.col(p) for p in partitions)) if partitions else df
        w = dealt.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        if partitions:
            w = w.partitionBy(*partitions)
        w.parquet(self.folder(part, name))
        return name

    def commit(self, run: str, folders: dict[str, str], low: str | None = None, high: str | None = None,
               after: int | None = None) -> None:
        """Make the run's folders visible.

        Commits are files named by their number, made only if there is none of that name, so two writers never share
        a number. A run that builds on what it has read passes the number of the newest commit it saw as ``after``
        (-1: none) and gets a ``Conflict`` if another one came between.
        """
        last = self.newest()
        seq = last.seq + 1 if last and after is None else (after if after is not None else -1) + 1
        while not self._create(seq, {"seq": seq, "run": run, "low": low, "high": high, "folders": folders}):
            if after is not None:
                raise Conflict(f"commit {seq} exists")
            seq += 1

    def _create(self, seq: int, record: dict) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, "commits", f"{seq:012d}.json"))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            return False
        out.write((json.dumps(record) + "\n").encode())
        out.close()
        return True

    def folder(self, part: str, name: str) -> str:
        return os.path.join(self.root, "data", part, f"run={name}")

    def live(self, part: str) -> list[tuple[str, list[tuple[str, str]] | None]]:
        """(folder, ranges) that readers of a part take, ranges None for a whole folder."""
        out, seen, covered = [], set(), []
        for r in reversed(self.records()):
            if r.run in seen or part not in r.folders:
                continue
            seen.add(r.run)
            if r.low is None:
                out.append((r.folders[part], None))
                continue
            left = [(r.low, r.high)]
            for a, b in covered:
                left = [p for lo, hi in left for p in ((lo, min(hi, a)), (max(lo, b), hi)) if p[0] < p[1]]
            covered.append((r.low, r.high))
            if left:
                out.append((r.folders[part], None if left == [(r.low, r.high)] else left))
        return out[::-1]

    def read(self, part: str, schema: T.StructType, time: str | None = None) -> DataFrame:
        """The rows of a part, in one scan of its live folders; ``time`` is the column that ranges hold."""
        return self._scan(part, schema, self.live(part), time)

    def read_one(self, part: str, record, schema: T.StructType) -> DataFrame:
        """The rows that one committed run wrote."""
        return self._scan(part, schema, [(record.folders[part], None)], None)

    def _scan(self, part, schema, live, time) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], schema)
        named = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        base = os.path.join(self.root, "data", part)
        df = self.spark.read.schema(named).option("basePath", base).parquet(*(self.folder(part, f) for f, _ in live))
        cut = [(f, ranges) for f, ranges in live if ranges is not None]
        if cut:
            t, keep = F.col(time), ~F.col("run").isin(*(f for f, _ in cut))
            for f, ranges in cut:
                for lo, hi in ranges:
                    keep |= (F.col("run") == f) & (t >= ts_lit(lo)) & (t < ts_lit(hi))
            df = df.filter(keep)
        return df.select(*schema.names)

    def remove_dead(self, newest_only: tuple[str, ...] = ()) -> int:
        """Delete folders that no reader takes any more (replaced or never committed; of the ``newest_only`` parts, all
        but the last commit's); for a quiet moment, since a running reader or writer may still be in them. Returns
        their number."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        data = jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, "data"))
        fs = data.getFileSystem(conf)
        records, gone = self.records(), 0
        for part in fs.listStatus(data) if fs.exists(data) else ():
            name = part.getPath().getName()
            keep = {r.folders[name] for r in records[-1:] if name in r.folders}
            if name not in newest_only:
                keep |= {f for f, _ in self.live(name)}
            for folder in fs.listStatus(part.getPath()):
                if folder.getPath().getName().removeprefix("run=") not in keep:
                    fs.delete(folder.getPath(), True)
                    gone += 1
        return gone
