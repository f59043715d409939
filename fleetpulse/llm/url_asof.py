"""URL filters by a temporal list join (operator 9).

Dated list entries (pattern, action, listed_at) become validity intervals: an entry holds from its date until the
pattern's next entry. A pattern is a domain (which covers its subdomains) or ``host/segment`` (which covers that part of
a site). Every capture asks for the patterns that could cover its URL, and an as-of join on (pattern, time bucket) with
the interval as condition finds the entries active at its fetch time; the longest pattern decides.

A bucket holds the entries that begin in it and, where a capture asks for it, the entry that the pattern's last earlier
bucket left: it is carried forward over the buckets that exist, so neither a long silence nor an outlying time adds rows.
Only distinct (url, fetch time) pairs and patterns are joined; rows of a hot URL or pattern meet their one interval by an
equality join whose hot side Spark can split, and windows run over the entries of one bucket or over a pattern's buckets. No
list is broadcast beyond Spark's own size check.

Defined cases: a null or unparsable URL, a null fetch time and an uncovered URL have no decision (null, not blocked);
entries with a null pattern or date are ignored, other actions than ``allow`` block; of entries of one pattern and date a
block wins; hosts are compared in lower case and without trailing dots, segments (as paths are) in their own case; white space
before a URL is ignored; other columns are kept; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 30 * 86_400

WHITE = " \t\n\x0b\x0c\r"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host(url: Column) -> Column:
    """Lower-case host name without trailing dots; empty if the URL has none."""
    return F.lower(F.rtrim(F.regexp_extract(F.ltrim(url, F.lit(WHITE)), HOST, 1), F.lit(".")))


def patterns(url: Column) -> Column:
    """Patterns that could cover a URL: its host, the host's parent domains of two labels or more, host/segment."""
    name, segment = host(url), F.regexp_extract(F.ltrim(url, F.lit(WHITE)), SEGMENT, 1)
    labels = F.split(name, r"\.")
    last = F.greatest(F.size(labels) - F.lit(1), F.lit(1))
    domains = F.transform(
        F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    site = F.when(segment != "", F.array(F.concat_ws("/", name, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(name != "", F.array_distinct(F.concat(domains, site))).otherwise(F.array().cast("array<string>"))


def _folded(pattern: Column) -> Column:
    """A list pattern with its host in lower case; a segment keeps its own, as in ``patterns``."""
    name = F.regexp_extract(pattern, "^[^/]*", 0)
    return F.concat(F.lower(F.rtrim(name, F.lit("."))), F.substring(pattern, F.length(name) + 1, F.length(pattern)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, bucket, valid_from, valid_to, blocked): at most one interval of a pattern holds at a time; ``bucket`` is that
    of its beginning."""
    dated = entries.select("pattern", "action", "listed_at").where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull())
    begin = F.col("listed_at").cast("timestamp")
    single = dated.groupBy(_folded(F.col("pattern")).alias("pattern"), _bucket(begin).alias("bucket"), begin.alias("valid_from")).agg(
        F.max(F.coalesce(F.col("action") != "allow", F.lit(True))).alias("blocked")
    )
    # the next entry of the bucket, or the first of the pattern's next bucket
    firsts = single.groupBy("pattern", "bucket").agg(F.min("valid_from").alias("first"))
    following = F.lead("first").over(Window.partitionBy("pattern").orderBy("bucket"))
    nxt = F.lead("valid_from").over(Window.partitionBy("pattern", "bucket").orderBy("valid_from"))
    met = single.withColumn("nxt", nxt).join(firsts.select("pattern", "bucket", following.alias("following")), ["pattern", "bucket"])
    return met.select("pattern", "bucket", "valid_from", F.coalesce("nxt", "following").alias("valid_to"), "blocked")


def _bucket(t: Column) -> Column:
    return F.floor(F.unix_seconds(t) / F.lit(BUCKET_SECONDS))


def decide(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """Captures with ``pattern``, ``valid_from``, ``valid_to`` of the deciding entry and ``blocked``."""
    rest = [c for c in captures.columns if c not in ("pattern", "valid_from", "valid_to", "blocked")]
    rows = captures.select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(rest))).alias("row"), F.col(url).alias("u"),
                           F.col(fetched_at).cast("timestamp").alias("t"))
    asked = rows.where(F.col("u").isNotNull() & F.col("t").isNotNull()).select("u", "t").distinct()
    distinct = asked.select("u", "t", _bucket(F.col("t")).alias("bucket"), F.explode(patterns(F.col("u"))).alias("pattern"))
    held = intervals(entries)
    interval = F.struct("valid_from", "valid_to", "blocked")
    # per pattern and bucket the last interval that begins in it; null in buckets that are only asked for
    marks = held.groupBy("pattern", "bucket").agg(F.max(interval).alias("e"), F.lit(0).alias("asked"))
    none = F.lit(None).cast(marks.schema["e"].dataType)
    wanted = distinct.select("pattern", "bucket").distinct().select("pattern", "bucket", none.alias("e"), F.lit(1).alias("asked"))
    merged = marks.union(wanted).groupBy("pattern", "bucket").agg(F.max("e").alias("e"), F.max("asked").alias("asked"))
    earlier = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = merged.select("pattern", "bucket", "asked", F.last("e", ignorenulls=True).over(earlier).alias("e"))
    carried = carried.where((F.col("asked") == 1) & F.col("e").isNotNull()).select("pattern", "bucket", "e.*")
    spread = held.select("pattern", "bucket", "valid_from", "valid_to", "blocked").union(carried)
    active = distinct.join(spread, ["pattern", "bucket"]).where(
        (F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to")))
    )
    best = F.max(F.struct(F.length("pattern").alias("long"), "pattern", "valid_from", "valid_to", "blocked"))
    decided = active.groupBy("u", "t").agg(best.alias("e"))
    both = rows.join(decided, ["u", "t"], "left")
    own = (F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest))
    return both.select(*own, "e.pattern", "e.valid_from", "e.valid_to", F.coalesce("e.blocked", F.lit(False)).alias("blocked"))


def kept(captures: DataFrame, entries: DataFrame, **names) -> DataFrame:
    """The captures that no entry active at their fetch time blocks."""
    return decide(captures, entries, **names).where(~F.col("blocked")).select(*captures.columns)
