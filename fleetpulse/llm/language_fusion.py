"""Language ID by Bayesian evidence fusion (operator 10).

Four kinds of evidence are multiplied: the text's likelihood under a byte-trigram model of every language, the language
that the markup declares, the language that the address suffix suggests, and the prior of the host. The trigram models
are fitted on a bounded sample of declared rows; the other three come from grouped counts over all rows: how often each
declared value and suffix goes with each language (by text alone), and how often each language occurs on a host, smoothed
towards its domain and that towards the whole corpus. ``und`` (no language) competes with a uniform text model.

Counts are combined before they are shuffled, so a hot host costs as much as another. The evidence tables have one row
per declared value, suffix or host; they are broadcast only when their counted rows are few, and joined by their key
otherwise.

Defined cases: null or empty text, or text without letters, gives ``und`` and is not kept; a null declaration, suffix or
host says nothing; other columns are kept; rows that repeat are judged alike; an empty table gives an empty one, and
without declared rows every text is ``und``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.common import row_blocks, utf8

UND = "und"
BUCKETS = 1 << 15
FIT_ROWS = 6_000
MOST_CLASSES = 256
#: Neighbouring trigrams repeat each other's evidence; long texts say no more than this many letters.
OVERLAP, MOST_LETTERS = 3.0, 600
PRIOR_UND = 0.02
SHRINK = 20.0
SMOOTH = 0.5
BROADCAST_ROWS = 10_000

_LETTER = np.full(256, 32, np.uint8)
for _b in (*range(97, 123), *range(128, 256)):
    _LETTER[_b] = _b
for _b in range(65, 91):
    _LETTER[_b] = _b + 32


class Model(NamedTuple):
    """Languages and their trigram log probabilities (languages x BUCKETS); the last class is ``und``."""

    languages: tuple[str, ...]
    table: np.ndarray

    @property
    def classes(self) -> tuple[str, ...]:
        return (*self.languages, UND)


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram around every letter, each row's first letter index: n + 1)."""
    n = len(off) - 1
    line = np.full(len(data) + n + 1, 32, np.uint32)
    line[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(off))] = _LETTER[data]
    at = np.flatnonzero(line != 32)
    code = (line[at - 1] * np.uint32(0x9E3779B1) ^ line[at] * np.uint32(0x85EBCA77)) + line[at + 1] * np.uint32(0xC2B2AE3D)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(17)).astype(np.int64), np.searchsorted(at, off + np.arange(n + 1))


def fit(rows: DataFrame, *, key: str, text: str, declared: str, fit_rows: int = FIT_ROWS) -> Model:
    """Trigram models from at most ``fit_rows`` declared rows, those whose key hashes lowest; rows of one key, declaration
    and text count once.

    Declared values of less than a ``MOST_CLASSES``-th of the sample are no classes of their own, so there are at most
    ``MOST_CLASSES`` languages, whatever rows declare.
    """
    some = rows.select(F.col(key).alias("k"), F.col(declared).alias("l"), F.col(text).alias("t")).where("l IS NOT NULL AND t IS NOT NULL")
    some = some.withColumn("h", F.xxhash64("k", "l", "t"))
    picked = some.select("k", "h").orderBy(F.xxhash64("k"), "k", "h").limit(fit_rows).distinct()
    picked = picked.select(F.col("k").alias("pk"), F.col("h").alias("ph"))
    met = some.join(F.broadcast(picked), F.col("k").eqNullSafe(F.col("pk")) & (F.col("h") == F.col("ph")))
    sample = met.dropDuplicates(["k", "h"]).select("l", "t").persist()  # at most fit_rows texts, read three times
    common = sample.groupBy("l").agg(F.count("*").alias("n"))
    common = common.where(F.col("n") * MOST_CLASSES >= sample.select(F.count("*")).scalar()).select("l")
    chosen = sample.join(common, "l", "left_semi")

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            names = np.array(batch.column(0).to_pylist(), object)
            for i, j in row_blocks(off):
                code, first = trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for name in np.unique(names[i:j]):
                    own = np.repeat(names[i:j] == name, np.diff(first))
                    n = np.bincount(code[own], minlength=BUCKETS)
                    hit = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(hit)), pa.array(hit), pa.array(n[hit])], names=["l", "bucket", "n"]
                    )

    counts = chosen.mapInArrow(run, "l string, bucket long, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    sample.unpersist()
    languages = tuple(sorted(counts["l"].unique()))
    table = np.full((len(languages), BUCKETS), SMOOTH)
    for i, name in enumerate(languages):
        own = counts[counts["l"] == name]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def text_evidence(model: Model, text: Column) -> Column:
    """Log likelihood of a text under every class (empty array: no letters)."""
    classes = len(model.classes)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(column: pa.Array) -> pa.Array:
        data, off = utf8(column)
        values, sizes = [np.empty((0, classes))], []
        for i, j in row_blocks(off):
            code, first = trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
            letters = np.diff(first)
            sums = np.zeros((j - i, classes))
            for c, own in enumerate(model.table):
                total = np.concatenate(([0.0], np.cumsum(own[code], dtype=np.float64)))
                sums[:, c] = total[first[1:]] - total[first[:-1]]
            sums[:, -1] = letters * -np.log(BUCKETS)
            sums *= (np.minimum(1, MOST_LETTERS / np.maximum(1, letters)) / OVERLAP)[:, None]
            values.append(sums[letters > 0])
            sizes.append(np.where(letters > 0, classes, 0))
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes) if sizes else []))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).ravel()))

    return score(text)


class Priors(NamedTuple):
    """Evidence tables: log arrays per declared value, suffix and host, and the corpus' own log prior."""

    declared: DataFrame
    suffix: DataFrame
    host: DataFrame
    corpus: list[float]


def learn_priors(scored: DataFrame, model: Model) -> Priors:
    """Evidence tables from rows with ``ll``, ``declared``, ``suffix``, ``domain`` and ``host``, by grouped counts."""
    n = len(model.classes)
    cells = [f"n{c}" for c in range(n)]
    best = F.coalesce(F.array_position("ll", F.array_max("ll")), F.lit(n)) - 1
    keys = ["declared", "suffix", "domain", "host"]
    grouped = scored.select(*keys, best.alias("best")).groupBy(*keys).agg(
        *(F.sum(F.when(F.col("best") == c, 1.0).otherwise(0.0)).alias(cells[c]) for c in range(n))
    ).checkpoint()
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cells]
    whole = grouped.agg(*sums).first()
    every = sum(whole)
    share = [(whole[c] + 1.0) / (every + n) for c in range(n)]
    corpus = [float(np.log((1 - PRIOR_UND) * s if c < n - 1 else PRIOR_UND)) for c, s in enumerate(share)]
    per_class = [F.lit(float(whole[c])) for c in range(n)]

    def likelihood(key: str) -> DataFrame:
        """P(value | class), smoothed by one unseen value."""
        own = grouped.where(F.col(key).isNotNull()).groupBy(key).agg(*sums)
        logs = F.array(*(F.log((F.col(c) + F.lit(1.0)) / (t + F.lit(2.0))) for c, t in zip(cells, per_class)))
        return _small(own.select(F.col(key).alias(f"{key}_key"), logs.alias(f"{key}_log")))

    total = sum((F.col(c) for c in cells[1:]), F.col(cells[0]))
    domain = grouped.groupBy("domain").agg(*sums)
    mixed = [(F.col(c) + F.lit(SHRINK * share[i])) / (total + F.lit(SHRINK)) for i, c in enumerate(cells)]
    domain = domain.select("domain", *(m.alias(f"p{i}") for i, m in enumerate(mixed)))
    host = grouped.where(F.col("host").isNotNull()).groupBy("domain", "host").agg(*sums)
    host = host.join(domain.withColumnRenamed("domain", "of"), F.col("domain").eqNullSafe(F.col("of")))
    logs = F.array(*(F.log((F.col(c) + SHRINK * F.col(f"p{i}")) / (total + F.lit(SHRINK))) for i, c in enumerate(cells)))
    host = host.select(F.coalesce("domain", F.lit("")).alias("domain_key"), F.col("host").alias("host_key"), logs.alias("host_log"))
    return Priors(likelihood("declared"), likelihood("suffix"), _small(host), corpus)


def _small(table: DataFrame) -> DataFrame:
    """The table cut off from its lineage, and broadcast if its counted rows are few."""
    table = table.checkpoint()
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def identify(
    rows: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    training: str = "lang",
    least: float = 0.5,
    model: Model | None = None,
) -> DataFrame:
    """Rows with ``language``, ``probability`` and ``language_kept`` (a language, at least ``least`` probable)."""
    nothing = F.lit(None).cast("string")
    model = model or fit(rows, key=key, text=text, declared=training)
    own = {"declared": declared, "suffix": suffix, "domain": domain, "host": host}
    added = ("language", "probability", "language_kept")
    rest = [c for c in rows.columns if c not in added]
    # the row's own columns travel as one struct, so that no name of theirs meets one of these
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)))
    marks = (F.coalesce(nothing if v is None else v.cast("string"), nothing).alias(k) for k, v in own.items())
    scored = rows.select(row.alias("row"), text_evidence(model, F.col(text)).alias("ll"), *marks)
    priors = learn_priors(scored, model)
    met = (
        scored.join(priors.declared, F.col("declared") == F.col("declared_key"), "left")
        .join(priors.suffix, F.col("suffix") == F.col("suffix_key"), "left")
        .join(priors.host, (F.col("host") == F.col("host_key")) & (F.coalesce("domain", F.lit("")) == F.col("domain_key")), "left")
    )
    n = len(model.classes)
    zero = F.array(*[F.lit(0.0)] * n)
    prior = F.coalesce("host_log", F.array(*(F.lit(x) for x in priors.corpus)))
    logs = F.col("ll")
    for more in (prior, F.coalesce("declared_log", zero), F.coalesce("suffix_log", zero)):
        logs = F.zip_with(logs, more, lambda a, b: a + b)
    met = met.withColumn("log", logs).withColumn("top", F.array_max("log"))
    mass = F.aggregate("log", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    names = F.array(*(F.lit(c) for c in model.classes))
    at = F.array_position("log", F.col("top"))
    language = F.coalesce(F.when(F.size("ll") > 0, F.get(names, (at - 1).cast("int"))), F.lit(UND))
    probability = F.when(F.size("ll") > 0, F.lit(1.0) / mass).otherwise(F.lit(1.0))
    kept = (F.col("language") != UND) & (F.col("probability") >= least)
    out = met.select("row", language.alias("language"), probability.alias("probability")).withColumn("language_kept", kept)
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)), *added)
