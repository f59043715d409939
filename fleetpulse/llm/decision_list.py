"""Quality rules as learned decision lists (operator 8), in DataFrame functions only.

Every text gets a row of statistics without leaving its row: word and window arrays live inside the expression, so
nothing is exploded or shuffled. A decision list is learned from labelled statistics by sequential covering: a rule is
grown by adding the threshold that gains most (FOIL gain) on the growing rows, pruned from its end on the held-out rows,
and kept while it is precise enough; the rows it covers are taken out and the next rule is grown. The labelled rows are
bounded, and only their counts per combination of bins reach the driver. The rules become one ordered conditional
expression (``F.when(...).when(...)``) on the statistics.

Words are runs outside space, tab, LF, VT, FF and CR. A text fails the base rules with fewer than ``LEAST_WORDS`` words or
with more than half its words in repeated windows of three.

Defined cases: null and empty texts have zero statistics and fail the base rules; rows of equal text get equal verdicts;
without labels of both kinds the list is empty and the base rules decide; null labels are ignored; other columns are kept;
an empty table gives an empty one.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 50
WINDOW = 3
#: Bound of the labelled rows that rules are learned from (those whose id hashes lowest).
FIT_ROWS = 8_000
BINS = 64
MAX_RULES, MAX_CONDITIONS = 8, 3
LEAST_PRECISION, LEAST_COVER = 0.95, 4

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios over which rules are learned; thresholds lie midway between neighbouring quantiles of labelled rows.
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")

_WHITE = r"[\x20\x09-\x0D]+"
#: Words in windows of three that occur twice or more, from the word array ``w``. A window's hash gives up as many low
#: bits as its place needs, so one sort of longs brings equal windows together; the places of those with an equal
#: neighbour, sorted again, tell how many words they cover. Should two neighbours of equal hash differ in their words, the
#: windows are sorted by their words instead.
_COVERED = "aggregate(transform({p}, (x, i) -> least(3L, coalesce(get({p}, i + 1) - x, 3L))), 0L, (a, x) -> a + x)"
_BY_WORDS = f"""
get(transform(array(sort_array(transform(sequence(0, size(w) - 3), i ->
      struct(get(w, i) as a, get(w, i + 1) as b, get(w, i + 2) as c, cast(i as bigint) as i)))), s ->
  get(transform(array(sort_array(transform(
        filter(s, (x, i) -> (x.a <=> get(s, i - 1).a and x.b <=> get(s, i - 1).b and x.c <=> get(s, i - 1).c)
                         or (x.a <=> get(s, i + 1).a and x.b <=> get(s, i + 1).b and x.c <=> get(s, i + 1).c)), x -> x.i))), p ->
    {_COVERED.format(p="p")}), 0)), 0)
"""
_REPEAT_WORDS = f"""
if(size(w) < 3, 0L,
  get(transform(array(length(bin(size(w)))), b ->
    get(transform(array(sort_array(transform(sequence(0, size(w) - 3), i ->
          shiftleft(shiftright(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), b), b) | cast(i as bigint)))), s ->
      if(size(filter(s, (x, i) -> if(shiftright(x, b) <=> shiftright(get(s, i - 1), b),
            get(transform(array(struct(cast(x & (shiftleft(1L, b) - 1L) as int) as p, cast(get(s, i - 1) & (shiftleft(1L, b) - 1L) as int) as q)), k ->
              get(w, k.p) != get(w, k.q) or get(w, k.p + 1) != get(w, k.q + 1) or get(w, k.p + 2) != get(w, k.q + 2)), 0), false))) > 0,
        {_BY_WORDS},
        get(transform(array(sort_array(transform(
            filter(s, (x, i) -> shiftright(x, b) <=> shiftright(get(s, i - 1), b) or shiftright(x, b) <=> shiftright(get(s, i + 1), b)),
            x -> x & (shiftleft(1L, b) - 1L)))), p -> {_COVERED.format(p="p")}), 0))), 0)), 0))
"""


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Rows with the columns of BASE and FEATURES (long and double); the text, and columns of these names, are dropped."""
    rest = [c for c in docs.columns if c not in (text, *BASE, *FEATURES)]
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split("t", _WHITE), "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = F.struct(
        F.size("w").cast("long").alias("n_words"),
        _without(F.col("t"), " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.col("chars") - _without(F.col("t"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEAT_WORDS).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        (F.col("chars") - _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("upper"),
        (F.col("chars") - _without(F.col("t"), ".,;:!?")).alias("marks"),
    )
    # the row's own columns travel as one struct, so that no name of theirs meets one of these
    row = F.struct(F.lit(0).alias("row"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)))
    split = docs.select(row.alias("row"), t.alias("t")).withColumns({"w": words, "lines": lines, "chars": F.length("t")})
    # A generator keeps later filters from being pushed below, where they would compute the statistics once more.
    counted = split.select("row", F.inline(F.array(counts)))

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    shares = {
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("upper", "word_chars"),
        "mark_share": share("marks", "word_chars"),
    }
    own = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)]
    return counted.select(*own, *BASE, *(v.alias(k) for k, v in shares.items()))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


class Condition(NamedTuple):
    """``feature > threshold`` or, with ``above`` false, ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


class DecisionList(NamedTuple):
    """Ordered rules, each a conjunction that rejects; what no rule covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejecting_rule(self) -> Column:
        """Number (from 1) of the first rule that covers a row, else 0."""
        out = None
        for i, rule in enumerate(self.rules):
            met = rule[0].column()
            for c in rule[1:]:
                met = met & c.column()
            out = F.when(met, F.lit(i + 1)) if out is None else out.when(met, F.lit(i + 1))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "; ".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


class _Cell(NamedTuple):
    """Labelled rows that share their bins: a bin per feature, whether they grow or prune, good and bad counts."""

    bins: tuple[int, ...]
    grows: bool
    good: int
    bad: int


def _count(cells: list[_Cell]) -> tuple[int, int]:
    return sum(c.bad for c in cells), sum(c.good for c in cells)


def _covers(rule: list[tuple[int, bool, int]], cell: _Cell) -> bool:
    return all((cell.bins[f] > k) == above for f, above, k in rule)


def _grow(cells: list[_Cell], edges: list[list[float]]) -> list[tuple[int, bool, int]]:
    """Add the threshold of largest FOIL gain until only bad rows are covered."""
    rule: list[tuple[int, bool, int]] = []
    live = cells
    while len(rule) < MAX_CONDITIONS:
        bad, good = _count(live)
        if not bad or not good:
            break
        best, gain = None, 1e-9
        for f, marks in enumerate(edges):
            tally = [[0, 0] for _ in range(len(marks) + 1)]
            for c in live:
                tally[c.bins[f]][0] += c.bad
                tally[c.bins[f]][1] += c.good
            low = [0, 0]
            for k in range(len(marks)):
                low = [low[0] + tally[k][0], low[1] + tally[k][1]]
                for above, (p, n) in ((False, low), (True, [bad - low[0], good - low[1]])):
                    if p >= LEAST_COVER:
                        won = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                        if won > gain:
                            best, gain = (f, above, k), won
        if best is None:
            break
        rule.append(best)
        live = [c for c in live if _covers(rule, c)]
    return rule


def _prune(rule: list, cells: list[_Cell]) -> list:
    """The beginning of the rule that does best on rows it was not grown on; of equals the shorter."""

    def worth(part: list) -> float:
        bad, good = _count([c for c in cells if _covers(part, c)])
        return (bad - good) / (bad + good) if bad + good else -1.0

    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda part: (worth(part), -len(part)), default=[])


def cover(cells: list[_Cell], edges: list[list[float]]) -> DecisionList:
    """Sequential covering over binned labelled statistics."""
    rules, left = [], cells
    while len(rules) < MAX_RULES:
        held = [c for c in left if not c.grows]
        rule = _prune(_grow([c for c in left if c.grows], edges), held)
        if not rule:
            break
        bad, good = _count([c for c in left if _covers(rule, c)])
        held_bad, held_good = _count([c for c in held if _covers(rule, c)])
        if bad < LEAST_COVER or bad < LEAST_PRECISION * (bad + good) or held_bad < LEAST_PRECISION * (held_bad + held_good):
            break
        rules.append(tuple(Condition(FEATURES[f], above, edges[f][k]) for f, above, k in rule))
        left = [c for c in left if not _covers(rule, c)]
    return DecisionList(tuple(rules))


def learn(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS
) -> DecisionList:
    """Decision list from at most ``fit_rows`` labelled rows (label 0: reject, else keep)."""
    judged = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_label"))
    some = judged.orderBy(F.xxhash64(key), key).limit(fit_rows)
    rows = statistics(docs.select(key, text).join(F.broadcast(some), key), text=text).where(~base_failed()).checkpoint()
    marks = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*(F.percentile_approx(f, marks).alias(f) for f in FEATURES)).first()
    values = [sorted({float(x) for x in found[f] or []}) for f in FEATURES]
    edges = [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in values]

    def bin_of(f: str, marks: list[float]) -> Column:
        return sum((F.when(F.col(f) > F.lit(m), 1).otherwise(0) for m in marks), F.lit(0))

    grows = F.pmod(F.xxhash64(F.lit("fold"), F.col(key)), F.lit(3)) != 0
    binned = rows.select(
        F.array(*(bin_of(f, m) for f, m in zip(FEATURES, edges))).alias("bins"), grows.alias("grows"), (F.col("_label") == 0).alias("bad")
    )
    counted = binned.groupBy("bins", "grows").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    return cover([_Cell(tuple(r["bins"]), r["grows"], r["good"], r["bad"]) for r in counted.collect()], edges)


def judge(docs: DataFrame, rules: DecisionList, *, text: str = "text") -> DataFrame:
    """Rows (without text) with statistics, ``base_failed``, ``rule`` (that rejects, else 0) and ``kept``."""
    added = {"base_failed": base_failed(), "rule": rules.rejecting_rule()}
    out = statistics(docs.drop(*added, "kept"), text=text).withColumns(added)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, rules: DecisionList, *, text: str = "text") -> DataFrame:
    """The rows that the base rules and the list keep, with their own columns."""
    row = F.struct(*docs.columns)
    judged = judge(docs.select(row.alias("_row"), F.col(text)), rules, text=text)
    return judged.where("kept").select("_row.*")
