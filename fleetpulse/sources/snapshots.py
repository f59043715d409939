"""Compaction and retention over a list of files.

A table is read through a snapshot: the list of its live files, with sizes.
Maintenance writes new files beside the table, makes a new list from metadata
and publishes it last; files that stay are neither read nor written, and
readers of the old list are not disturbed. Replaced files are deleted later
(``remove_unlisted``).

The lists hold one row per file, as Spark's own file index does.
"""

from __future__ import annotations

import bisect
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import schemas as S
from fleetpulse.sources.ledger import Ledger

TARGET_FILE_BYTES = 128 * 1024 * 1024
#: base: the folder that partition folders are under; folder: ``year=2024/month=1/..`` below it.
FILES = T.StructType([
    T.StructField("base", S.STR), T.StructField("folder", S.STR), T.StructField("path", S.STR), T.StructField("length", S.BIGINT),
])
_FOLDER = r"((?:/[^/=]+=[^/]*)*)/[^/]+$"


def _relative(path):
    """Partition folders and file name of a path."""
    return F.regexp_extract(path, r"((?:/[^/=]+=[^/]*)*/[^/]+)$", 1)


def snapshot(spark: SparkSession, base: str) -> DataFrame:
    """All Parquet files under ``base``: a listing, no file is opened."""
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
        .load(base).select("path", "length")
    )
    return listed.select(F.lit(base).alias("base"), F.regexp_extract("path", _FOLDER, 1).alias("folder"), "path", "length")


def read_snapshot(spark: SparkSession, files: DataFrame, schema: T.StructType, columns: list | None = None) -> DataFrame:
    """The rows of the listed files."""
    by = defaultdict(list)
    for r in files.select("base", "path").collect():
        by[r.base].append(r.path)
    out = None
    for base, paths in sorted(by.items()):
        df = spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names, *(columns or ()))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema)


def bins(sizes: list[tuple[str, int]], target: int) -> list[list[str]]:
    """Files in bins of at most ``target`` bytes: largest first, each into the open bin it fills best."""
    out: list[list[str]] = []
    free: list[tuple[int, int]] = []  # (free bytes, bin)
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            left, number = free.pop(at)
        else:
            left, number = target, len(out)
            out.append([])
        out[number].append(name)
        bisect.insort(free, (left - size, number))
    return out


def compact(spark: SparkSession, files: DataFrame, schema: T.StructType, partitions: list[str], out_base: str,
            target: int = TARGET_FILE_BYTES) -> DataFrame:
    """The new list after small files were merged; row set unchanged.

    Files of at least half the target stay as they are. Small files are packed per folder into bins of about the target
    from their sizes alone; a bin of one file stays too. Each other bin is read and written by one task as one file,
    sorted by instance and time (tight min/max statistics), so a hot folder is spread over its bins.
    """
    small = defaultdict(list)
    for r in files.filter(F.col("length") < target // 2).collect():
        small[r.folder].append((r.path, r.length))
    merged = [b for folder in sorted(small) for b in bins(small[folder], target) if len(b) > 1]
    if not merged:
        return files
    number = spark.createDataFrame([(p, i) for i, b in enumerate(merged) for p in b], "path string, bin int")
    chosen = files.join(number, "path", "left_semi")
    named = number.select(_relative(F.col("path")).alias("_file"), "bin")
    rows = read_snapshot(spark, chosen, schema, [_relative(F.col("_metadata.file_path")).alias("_file")])
    order = [c for c in ("instance_id", "collected_at") if c in schema.names and c not in partitions]
    dealt = rows.join(named, "_file").repartitionById(len(merged), F.col("bin"))
    (
        dealt.sortWithinPartitions(*partitions, *order).select(*schema.names)
        .write.mode("errorifexists").option("compression", "zstd").partitionBy(*partitions).parquet(out_base)
    )
    return files.join(number, "path", "left_anti").select(*FILES.names).unionByName(snapshot(spark, out_base))


def retain(spark: SparkSession, files: DataFrame, schema: T.StructType, partitions: list[str], cutoff, out_base: str) -> DataFrame:
    """The new list without rows before ``cutoff``.

    Folders of earlier days leave the list, later ones stay, both by their names alone; only the day that the cutoff
    falls into is read, and its remaining rows are written under ``out_base``.
    """
    from fleetpulse.plans.scoring import as_of_col

    t = as_of_col(cutoff)
    part = lambda name: F.regexp_extract("folder", rf"/{name}=(\d+)", 1).cast("int")
    day = F.make_date(part("year"), part("month"), part("day"))
    whole = F.date_trunc("day", t) == t
    kept = files.filter((day > F.to_date(t)) | ((day == F.to_date(t)) & whole))
    edge = files.filter((day == F.to_date(t)) & ~whole)
    if edge.isEmpty():
        return kept
    read_snapshot(spark, edge, schema).filter(F.col("collected_at") >= t).write.mode("errorifexists") \
        .option("compression", "zstd").partitionBy(*partitions).parquet(out_base)
    return kept.unionByName(snapshot(spark, out_base))


class SnapshotTable:
    """A table whose current list of files is the newest commit of a ledger at ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, partitions: list[str]):
        self.spark, self.schema, self.partitions = spark, schema, partitions
        self.ledger = Ledger(spark, root)

    def adopt(self, base: str) -> None:
        """Publish the files that plain appends left under ``base``."""
        self._publish(snapshot(self.spark, base), -1)

    def files(self, record=None) -> DataFrame:
        record = record or self.ledger.newest()
        return self.ledger.read_one("files", record, FILES)

    def read(self) -> DataFrame:
        return read_snapshot(self.spark, self.files(), self.schema)

    def _publish(self, files: DataFrame, after: int) -> None:
        name = self.ledger.write("files", files.select(*FILES.names).coalesce(1))
        self.ledger.commit(name, {"files": name}, after=after)

    def _new_base(self) -> str:
        return f"{self.ledger.root}/written/{uuid.uuid4().hex}"

    def compact(self, target: int = TARGET_FILE_BYTES) -> None:
        now = self.ledger.newest()
        self._publish(compact(self.spark, self.files(now), self.schema, self.partitions, self._new_base(), target), now.seq)

    def retain(self, cutoff) -> None:
        now = self.ledger.newest()
        self._publish(retain(self.spark, self.files(now), self.schema, self.partitions, cutoff, self._new_base()), now.seq)

    def remove_unlisted(self) -> int:
        """Delete the files that earlier lists name and the current one does not; for a time when no reader holds an
        earlier list. Returns their number."""
        records = self.ledger.records()
        old = None
        for r in records[:-1]:
            old = self.files(r) if old is None else old.union(self.files(r))
        if old is None:
            return 0
        gone = [r.path for r in old.select("path").distinct().join(self.files(records[-1]), "path", "left_anti").collect()]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in gone:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, False)
        return len(gone)
