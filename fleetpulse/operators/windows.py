"""Window-shaped operators: latest-per-key, lag deltas, top-n per group.

Every window here is partitioned by a key; none runs over an unpartitioned
window (that would put all rows in one task).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    tiebreak: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The newest row per key (``QUALIFY row_number() .. ORDER BY t DESC = 1``).

    Expressed as ``max_by(struct(row), struct(order, tiebreak))`` so Spark
    combines partially on the map side: the shuffle carries one row per key per
    task rather than every row, which also defuses a hot key.
    """
    keys = list(keys)
    rest = [c for c in (columns or df.columns) if c not in keys]
    ordering = F.struct(*_cols(list(order) + list(tiebreak)))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*_cols(rest)), ordering).alias("_latest"))
    return picked.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in rest])


def latest_per_key_rownum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1
) -> DataFrame:
    """W1/W6 literal form: ``row_number() over (partition by keys order by ..) <= n``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def topn_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_col: str | None = None
) -> DataFrame:
    """``TOP (n) .. ORDER BY ..`` per group, with caller-supplied tiebreaks.

    Spark plans ``row_number() <= n`` as a per-partition group limit before the
    window sort, so each task keeps at most n rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")


def lag_with_default(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], default=0, prefix: str = "lag_"
) -> DataFrame:
    """``LAG(c, 1, default) OVER (PARTITION BY keys ORDER BY order)`` for several columns."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", *[F.lag(c, 1, default).over(w).alias(f"{prefix}{c}") for c in columns])


def reset_guarded_delta(cur: str | Column, prev: str | Column) -> Column:
    """``CASE WHEN prev <= cur THEN cur - prev ELSE 0 END``."""
    c = F.col(cur) if isinstance(cur, str) else cur
    p = F.col(prev) if isinstance(prev, str) else prev
    return F.when(p <= c, c - p).otherwise(F.lit(0))


def all_nonzero(columns: Sequence[str]) -> Column:
    """Every column ``<> 0`` (NULL drops the row)."""
    cond = None
    for c in columns:
        term = F.col(c) != 0
        cond = term if cond is None else cond & term
    return cond


# --------------------------------------------------------------------------
# Ordinals: positions in a global or per-key order without one task that sees all.
#
# The order's leading column is cut into cells at bounds that are taken once (a
# quantile sketch, one number per cell) and are constants of the plan from then
# on. Every pass, and every task that is run again, puts a row into the same
# cell, so no copy of the input has to hold the passes together.


def _position(df: DataFrame, name: str) -> Column:
    """A double that never falls when the column rises (nulls lowest); rows that it does not tell apart share a cell."""
    kind, c = df.schema[name].dataType.typeName(), F.col(name)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        c = F.unix_micros(c.cast("timestamp"))
    elif kind == "string":
        # the six bytes behind what all values share
        ends = df.select(F.min(name), F.max(name)).first()
        low, high = ((x or "").encode() for x in ends)
        shared = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        padded = F.rpad(F.hex(F.substring(c.cast("binary"), shared + 1, 6)), 12, "0")
        c = F.conv(padded, 16, 10)
    elif kind == "boolean":
        c = c.cast("int")
    return F.coalesce(c.cast("double"), F.lit(float("-inf")))


def _bounds(values: DataFrame, n: int) -> tuple[list[float], list[float]]:
    """(inner bounds of about ``n`` cells of equal size, values that fill a cell or more) of the column ``x``."""
    marks = [i / n for i in range(1, n)]
    found = values.approxQuantile("x", marks, 1 / (4 * n)) if marks else []
    heavy = sorted({a for a, b in zip(found, found[1:]) if a == b})
    alone = [e for v in heavy for e in (v, math.nextafter(v, math.inf))]
    return sorted({v for v in (*found, *alone) if -math.inf < v < math.inf}), heavy


def _cell(df: DataFrame, position: Column, bounds: list[float], out: str) -> DataFrame:
    """``df`` with the number of the cell that ``position`` falls into."""
    if not bounds:
        return df.withColumn(out, F.lit(0.0))
    from pyspark.ml.feature import Bucketizer

    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=f"{out}_x", outputCol=out, handleInvalid="keep")
    return cut.transform(df.withColumn(f"{out}_x", position)).drop(f"{out}_x")


def _cells_wanted(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_cells(df: DataFrame, order: Sequence[str], out: str = "_cell", cells: int | None = None) -> DataFrame:
    """``df`` with a cell number that rises with ``order``. A leading value that would fill cells by itself (one collection
    cycle, say) is cut by the second column."""
    n = cells or _cells_wanted(df)
    first = _position(df, order[0])
    bounds, heavy = _bounds(df.select(first.alias("x")), n)
    cut = _cell(df, first, bounds, out)
    if not heavy or len(order) == 1:
        return cut.withColumn(out, F.col(out).cast("long"))
    second = _position(df, order[1])
    parts = -(-n // len(heavy))
    inner, _ = _bounds(df.filter(first.isin(*heavy)).select(second.alias("x")), parts)
    both = _cell(cut, second, inner, f"{out}_2")
    fine = F.when(first.isin(*heavy), F.col(f"{out}_2")).otherwise(F.lit(0.0))
    return both.withColumn(out, (F.col(out) * (len(inner) + 2) + fine).cast("long")).drop(f"{out}_2")


def chunk_ids(df: DataFrame, order: Sequence[str], size: int, out: str = "chunk_id") -> DataFrame:
    """Split rows ordered by ``order`` into chunks of ``size`` (last may be short)."""
    ranked = dense_rank_global(df, order, "_pos")
    return ranked.withColumn(out, F.floor((F.col("_pos") - 1) / F.lit(size)).cast("long")).drop("_pos")


def dense_rank_global(df: DataFrame, order: Sequence[str], out: str = "rank", cells: int | None = None) -> DataFrame:
    """1-based global row position by ``order``: rows counted per cell, counts summed over the cells before (one row
    per cell), rows numbered inside their cell.

    ``order`` must be a total order (append a unique tiebreak if needed).
    """
    order = list(order)
    cut = with_cells(df, order, cells=cells)
    counts = cut.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # over at most three rows per wanted cell
    offsets = counts.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_cell").orderBy(*order))
    return (
        cut.withColumn("_local", local).join(F.broadcast(offsets), "_cell")
        .withColumn(out, (F.col("_off") + F.col("_local")).cast("long")).drop("_cell", "_local", "_off")
    )


# --------------------------------------------------------------------------
# Windows whose groups stay bounded when one key holds a large share of rows.
#
# A plain ``Window.partitionBy(key)`` puts every row of a key into one task.
# Here each key's rows get an ordinal (counted per key and cell of the order),
# are cut into blocks of ``block`` rows, and each block also receives
# the few rows of the previous block its frame needs (a halo). Windows then run
# per (key, block): no task holds more than ``block + halo`` rows of a key.

DEFAULT_BLOCK = 1 << 16


def key_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "_ord", cells: int | None = None) -> DataFrame:
    """1-based position of each row within its key by ``order`` (must be a total order).

    The cells are those of the whole table's order, where a key that holds much of the table is spread over many of them.
    """
    keys, order = list(keys), list(order)
    n = cells or _cells_wanted(df)
    first = _position(df, order[0])
    cut = _cell(df, first, _bounds(df.select(first.alias("x")), n)[0], "_cell")
    spans = cut.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = cut.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order)))
    return (
        null_safe_join(local, spans, [*keys, "_cell"])
        .withColumn(out, (F.col("_off") + F.col("_pos")).cast("long")).drop("_cell", "_pos", "_off")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL equals NULL, as in a window's groups; the left side's keys are kept."""
    own = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    met = left.join(own, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how)
    return met.drop(*(f"_r_{k}" for k in keys))


def with_blocks(df: DataFrame, halo: int, block: int, ord_col: str = "_ord") -> DataFrame:
    """Assign ``_blk`` and add the last ``halo`` rows of each block to the next one (``_halo`` true)."""
    if halo >= block:
        raise ValueError("halo must be smaller than block")
    blk = F.floor((F.col(ord_col) - 1) / F.lit(block)).cast("long")
    own = df.select("*", blk.alias("_blk"), F.lit(False).alias("_halo"))
    if halo == 0:
        return own
    tail = df.filter(((F.col(ord_col) - 1) % F.lit(block)) >= F.lit(block - halo))
    return own.unionByName(tail.select("*", (blk + 1).alias("_blk"), F.lit(True).alias("_halo")))


def lag_bounded(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                prefix: str = "prev_", block: int = DEFAULT_BLOCK) -> DataFrame:
    """``LAG(c, 1) OVER (PARTITION BY keys ORDER BY order)`` for several columns, with
    groups of at most ``block + 1`` rows per task."""
    keys = list(keys)
    b = with_blocks(key_ordinal(df, keys, order), 1, block)
    w = Window.partitionBy(*keys, "_blk").orderBy("_ord")
    out = b.select("*", *[F.lag(c, 1).over(w).alias(f"{prefix}{c}") for c in columns])
    return out.filter(~F.col("_halo")).drop("_halo", "_blk")


def trailing_avg_bounded(df: DataFrame, keys: Sequence[str], n: int, value: str, out: str,
                         block: int = DEFAULT_BLOCK, ord_col: str = "_ord") -> DataFrame:
    """Average of ``value`` over the current and ``n-1`` preceding rows per key
    (``df`` carries a key ordinal ``ord_col``)."""
    b = with_blocks(df, n - 1, block, ord_col)
    w = Window.partitionBy(*keys, "_blk").orderBy(ord_col).rowsBetween(-(n - 1), 0)
    return b.select("*", F.avg(value).over(w).alias(out)).filter(~F.col("_halo")).drop("_halo", "_blk")


def run_length_since(df: DataFrame, keys: Sequence[str], reset: str, out: str,
                     block: int = DEFAULT_BLOCK, ord_col: str = "_ord") -> DataFrame:
    """Rows since the last row where ``reset`` is true (0 on such a row), per key.

    Gaps-and-islands with bounded groups: the last reset ordinal is a running
    max inside each block, carried across blocks from a one-row-per-block table.
    """
    keys = list(keys)
    b = with_blocks(df, 0, block, ord_col)
    hit = F.when(F.col(reset), F.col(ord_col))
    inside = Window.partitionBy(*keys, "_blk").orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_last_in", F.max(hit).over(inside))
    per_block = b.groupBy(*keys, "_blk").agg(F.max(hit).alias("_blk_last"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(*keys, "_blk", F.max("_blk_last").over(earlier).alias("_carry"))
    last = F.coalesce(F.col("_last_in"), F.col("_carry"), F.lit(0))
    return (
        null_safe_join(b, carry, [*keys, "_blk"], "left")
        .withColumn(out, (F.col(ord_col) - last).cast("long"))
        .drop("_blk", "_halo", "_last_in", "_carry")
    )
