"""Join-shaped operators.

Join strategy is left to Catalyst/AQE: a side is broadcast only when its
measured size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``;
otherwise both sides shuffle on the join key (sort-merge), and AQE splits
skewed partitions. No operator here emits all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def semi(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with a match in ``keys_df`` (``EXISTS``)."""
    return df.join(keys_df.select(*keys), list(keys), "left_semi")


def anti(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` without a match in ``keys_df`` (``NOT EXISTS``)."""
    return df.join(keys_df.select(*keys), list(keys), "left_anti")


def after_event(df: DataFrame, events: DataFrame, key: str, t: str, event_t: str) -> DataFrame:
    """Rows of ``df`` later than the key's event time (hash join + residual filter)."""
    return df.join(events, key).filter(F.col(t) > F.col(event_t))


def flag_left_join(keys: DataFrame, populations: dict[str, DataFrame], key: str) -> DataFrame:
    """J6 + P13: left-join optional populations onto a key set and flag membership.

    Each population must be unique by ``key``; its other columns are carried over.
    """
    out = keys
    for flag, pop in populations.items():
        marker = f"_m_{flag}"
        out = out.join(pop.withColumn(marker, F.lit(1)), key, "left")
        out = out.withColumn(flag, F.col(marker).isNotNull()).drop(marker)
    return out


#: Bits of the key filter of J8: a table of at most BITS / 64 rows of 16 bytes (16 MB), so it may be broadcast.
KEY_FILTER_BITS = 1 << 26


def in_folders(target: DataFrame, batch: DataFrame, folders: Sequence[str]) -> DataFrame:
    """Rows of ``target`` in the folders that ``batch`` touches.

    The batch's distinct folder values (as many as it has folders) are one scalar subquery over partition columns, which
    Spark evaluates before it lists the scan's files.
    """
    folders = list(folders)
    touched = batch.select(F.collect_set(F.struct(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in folders]))).scalar()
    return target.filter(F.array_contains(touched, F.struct(*folders)))


def may_contain(target: DataFrame, batch: DataFrame, keys: Sequence[str], bits: int = KEY_FILTER_BITS) -> DataFrame:
    """Rows of ``target`` whose key may be in ``batch``: a one-hash Bloom filter, as a table of 64-bit words.

    Every key of the batch sets one of ``bits`` bits. The words that have a bit set are at most ``bits / 64`` rows,
    whatever the batch's size, so the target meets them in a broadcast join at its scan and most of its rows go no
    further. No match is lost; a foreign row passes with probability (keys / bits).
    """
    def slot(df: DataFrame):
        return F.pmod(F.xxhash64(*[F.col(k).cast(target.schema[k].dataType) for k in keys]), F.lit(bits))

    set_bits = batch.select(slot(batch).alias("_s"))
    words = set_bits.groupBy(F.shiftright("_s", 6).alias("_w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_s") % 64).cast("int"))).alias("_m"))
    marked = target.withColumns({"_s": slot(target), "_w": F.shiftright(slot(target), 6)})
    hit = F.call_function("shiftrightunsigned", F.col("_m"), (F.col("_s") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return marked.join(F.broadcast(words), "_w").filter(hit).select(*target.columns)


def insert_if_absent(batch: DataFrame, target: DataFrame, keys: Sequence[str],
                     partition_cols: Sequence[str] = (), bits: int = KEY_FILTER_BITS) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``target`` (the rows an append adds).

    The batch is de-duplicated on the key first (stricter than MERGE, which does
    not de-duplicate its source). ``partition_cols`` are the target's folder
    columns, which must be determined by the key (the stamp derived from
    ``collected_at``): only the folders the batch touches are listed and read.
    Of these, only rows that pass a filter of the batch's keys go into the exact
    anti-join, so what is shuffled follows the batch, not the target.
    """
    keys = list(keys)
    extra = [c for c in partition_cols if c in batch.columns and c in target.columns and c not in keys]
    near = in_folders(target, batch, extra) if extra else target
    return anti(batch.dropDuplicates(keys), may_contain(near, batch, keys, bits), keys)


def upsert(target: DataFrame, source: DataFrame, key: str, insert: dict, update: dict) -> DataFrame:
    """Column-wise upsert on one key, in one full join: ``insert`` maps columns to the values of new rows, ``update`` to
    the new values of rows that exist (other columns keep theirs). Expressions name the source's columns as ``s.<name>``
    and the target's as ``t.<name>``; the source holds each key once."""
    t, s = target.alias("t"), source.alias("s")
    both = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    new, seen = F.col(f"t.{key}").isNull(), F.col(f"s.{key}").isNotNull()
    out = []
    for f in target.schema.fields:
        old = F.col(f"t.{f.name}")
        value = F.when(new, insert.get(f.name, F.lit(None)))
        value = value.when(seen, update[f.name]) if f.name in update else value
        out.append(value.otherwise(old).cast(f.dataType).alias(f.name))
    return both.select(*out)


def replace_by_key(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key is absent from source, plus all source rows.

    Columns the source lacks become NULL; the result has the target's columns.
    """
    keys = list(keys)
    kept = anti(target, source, keys)
    aligned = source.select(*[
        (F.col(f.name) if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.schema.fields
    ])
    return kept.unionByName(aligned)


def count_per_key(left: DataFrame, detail: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Correlated ``COUNT(*)`` per left row, 0 when none (pre-aggregate + left join)."""
    keys = list(keys)
    n = detail.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return left.join(n, keys, "left").withColumn(out, F.coalesce(F.col("_n"), F.lit(0))).drop("_n")
