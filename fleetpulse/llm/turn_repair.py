"""Conversation structure repair by Hirschberg's divide and conquer (operator 12).

A repaired conversation's role initials read ``(s?(ua)+)?``. Read from the left there are four states: nothing yet, after
s, after u, after a. Every row is kept, given another role, or deleted, and empty turns may be inserted anywhere; the
edits' initials in order are the audit, and among the cheapest edits the audit of least ASCII order is wanted.

A row, and any stretch of rows, is a table of 4 x 4 entries (state before, state after) -> least cost and place of its
least audit among the sixteen. Audits of a stretch are cut behind the letter of its last row, so none is the beginning of
another, and joining two stretches compares the first audit, then the second. Hirschberg's step takes a stretch with known
end states, runs a forward vector of four costs from its start and a backward vector from its end to the middle, crosses
where their sum is least (the audit-least if there is more than one) and goes on in both halves, in linear space.

A conversation of any length is spread over tasks: rows are range-sorted by conversation and turn and cut into segments of
at most ``SEGMENT`` rows; the tables of a conversation's segments are joined in a tree of ``FAN`` children a node, the same
step then walks down the tree to the states at every segment's ends, and segments are walked row by row.

Defined cases: null texts and roles are one space, and so is a null id or turn in the damage key; rows of one turn come in
the order of role, then of a digest of conversation, role and text; conversations whose id is null are one conversation; a row whose role
starts with none of s, u, a (or is empty) can only be given another role or deleted; gaps beyond a long count as the
largest long; a conversation without rows after damage has zeros, an empty audit and the empty string's digest; repeated
rows are rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.vector_blocks import TOP

SEGMENT = 4096
FAN = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, S, U, A = range(4)
ROLES = {"u": "user", "a": "assistant"}
#: What a role's initial leads to from each state.
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
#: Initials s, u, a and any other, times no fault, truncated, duplicate, blank: a row's kind is one letter.
INITIALS, FAULTS = "sua?", ("", "truncated", "duplicate", "blank")
KINDS = "abcdefghijklmnop"
FAR = 1 << 40

Table = tuple[tuple[int, ...], tuple[int, ...]]  # costs and places of 16 entries, 4 * before + after


def _placed(entries: list[tuple[int, object]]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Costs less the least one, and dense places of the orders of what can be reached."""
    least = min((c for c, _ in entries), default=0)
    place = {o: i for i, o in enumerate(sorted({o for c, o in entries if c < FAR}))}
    return tuple(c - least if c < FAR else FAR for c, _ in entries), tuple(place[o] if c < FAR else 0 for c, o in entries)


def _inserts(state: int) -> list[tuple[int, str, int]]:
    """(cost, letters, state) of the inserts that may precede a row."""
    out, at, letters = [(0, "", state)], state, ""
    for _ in range(2):
        at, letters = NEXT.get((at, "u"), NEXT.get((at, "a"))), letters + "I"
        out.append((INSERT * len(letters), letters, at))
    return out


#: Cost and letters of the inserts that end a conversation in each state.
CLOSE = {s: next((c, x) for c, x, t in _inserts(s) if t in (START, A)) for s in range(4)}


@lru_cache(maxsize=None)
def moves(kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> least cost and its least letters, for one row."""
    initial, fault = INITIALS[KINDS.index(kind) // 4], FAULTS[KINDS.index(kind) % 4]
    more = TRUNCATED if fault == "truncated" else 0
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        for cost, letters, at in _inserts(before):
            ways = [(DELETE, "D", at)]
            if fault in ("", "truncated"):
                ways += [(REROLE + more, "R", NEXT[at, i]) for i in "ua" if (at, i) in NEXT]
                if (at, initial) in NEXT:
                    ways.append((KEEP + more, "K", NEXT[at, initial]))
            for c, x, after in ways:
                out[before, after] = min(out.get((before, after), (FAR, "")), (cost + c, letters + x))
    return out


@lru_cache(maxsize=None)
def row_table(kind: str) -> Table:
    way = moves(kind)
    return _placed([way.get((s, t), (FAR, "")) for s in range(4) for t in range(4)])


@lru_cache(maxsize=1 << 16)
def joined(first: Table, second: Table) -> Table:
    """The table of two stretches, one behind the other."""
    out = []
    for s in range(4):
        for t in range(4):
            out.append(
                min(
                    (min(FAR, first[0][4 * s + m] + second[0][4 * m + t]), (first[1][4 * s + m], second[1][4 * m + t]))
                    for m in range(4)
                )
            )
    return _placed(out)


Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs and places of four states


@lru_cache(maxsize=1 << 16)
def forward(vector: Vector, table: Table) -> Vector:
    return _placed(
        [min((min(FAR, vector[0][s] + table[0][4 * s + t]), (vector[1][s], table[1][4 * s + t])) for s in range(4)) for t in range(4)]
    )


@lru_cache(maxsize=1 << 16)
def backward(vector: Vector, table: Table) -> Vector:
    return _placed(
        [min((min(FAR, table[0][4 * s + t] + vector[0][t]), (table[1][4 * s + t], vector[1][t])) for t in range(4)) for s in range(4)]
    )


def _only(state: int) -> Vector:
    return tuple(0 if s == state else FAR for s in range(4)), (0,) * 4


_END: Vector = _placed([CLOSE[s] for s in range(4)])


def _cross(ahead: Vector, behind: Vector) -> int:
    return min(range(4), key=lambda s: (ahead[0][s] + behind[0][s], ahead[1][s], behind[1][s]))


def crossings(tables: list[Table], start: int, end: int | None) -> list[int]:
    """States at the ends of all stretches, the first one's start included; end None: where the conversation may end."""
    states = [start] * (len(tables) + 1)
    if end is None:
        ahead = _only(start)
        for t in tables:
            ahead = forward(ahead, t)
        end = _cross(ahead, _END)
    states[-1] = end
    open_ = [(0, len(tables))]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        mid = (low + high) // 2
        ahead, behind = _only(states[low]), _only(states[high])
        for t in tables[low:mid]:
            ahead = forward(ahead, t)
        for t in reversed(tables[mid:high]):
            behind = backward(behind, t)
        states[mid] = _cross(ahead, behind)
        open_ += [(low, mid), (mid, high)]
    return states


def whole_table(tables: list[Table]) -> Table:
    out = tables[0]
    for t in tables[1:]:
        out = joined(out, t)
    return out


def letters(kinds: str, start: int, end: int | None) -> tuple[list[str], list[int]]:
    """Letters of every row (its inserts first) and the states at the rows' ends."""
    states = crossings([row_table(k) for k in kinds], start, end)
    return [moves(k)[s, t][1] for k, s, t in zip(kinds, states, states[1:])], states


# --- the damage of the contract's query ---------------------------------------------------------------------------------


def keyed(conv: Column) -> Column:
    """A conversation's key: never null."""
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit(""))


def damaged(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, role, text) after the damage that the rows' keys tell; conv is the key of the conversation."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    told = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    named = rows.select(
        keyed(F.col(conv)).alias("conv"), F.col(turn).alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), told.alias("damage")
    )
    damage = F.col("damage")
    text = F.when(damage == 1, F.lit("")).when(damage == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(damage == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(damage == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return named.where(damage != 0).select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


# --- faults, segments, tree ---------------------------------------------------------------------------------------------

_BLANKS = " \t\n\x0b\x0c\r"


def said(conv: Column, role: Column, text: Column) -> Column:
    """Digest that stands for a conversation, role and text."""
    measured = lambda c: (F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.unhex(F.sha2(F.concat(*measured(conv), *measured(role), text).cast("binary"), 256))


def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, node, kinds, saids, roles): at most ``segment`` rows (conv, turn, role, text) of a conversation, in their order,
    with a letter (blank, truncated or no fault), a digest and a role for each; ``node`` numbers the segments.

    Checkpointed, since places in the range-sorted rows must not change between passes.
    """
    trimmed = F.rtrim("text", F.lit(_BLANKS))
    fault = F.when(trimmed == "", 3).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    found = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1))
    initial = F.when((found == 0) | (F.col("role") == ""), 3).otherwise(found - 1)
    slim = rows.select(
        "conv", "turn", "role", said(F.col("conv"), F.col("role"), F.col("text")).alias("said"),
        F.substring(F.lit(KINDS), (initial * 4 + fault + 1).cast("int"), F.lit(1)).alias("kind"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("said"), F.asc("tie")]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ordered.select("conv", "kind", "said", "role", F.monotonically_increasing_id().alias("place"))
    # the place's upper bits are the partition, the lower ones the row in it
    node = F.col("place") - F.pmod(F.col("place").bitwiseAND((1 << 33) - 1), F.lit(segment))
    listed = F.sort_array(F.collect_list(F.struct("place", "kind", "said", "role"))).alias("l")
    held = placed.groupBy("conv", node.alias("first")).agg(listed).select(
        "conv", "first", F.array_join("l.kind", "").alias("kinds"), F.col("l.said").alias("saids"), F.col("l.role").alias("roles")
    ).checkpoint()
    # segments of a partition are counted on from those of the partitions before
    low = (1 << 33) - 1
    each = (held.agg(F.max(F.col("first").bitwiseAND(low))).first()[0] or 0) // segment + 1
    number = F.shiftright("first", 33) * each + F.floor(F.col("first").bitwiseAND(low) / segment)
    return held.select("conv", number.alias("node"), "kinds", "saids", "roles")


def _marked(kinds: str, saids: list[bytes], known) -> str:
    """The letters with rows marked as duplicates whose digest came earlier (``known``: in earlier segments)."""
    seen, out = set(known if known is not None else ()), []
    for kind, digest in zip(kinds, saids):
        k = KINDS.index(kind)
        out.append(KINDS[k - k % 4 + 2] if digest in seen and k % 4 != 3 else kind)
        seen.add(digest)
    return "".join(out)


def illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _initials(kinds: str) -> str:
    return "".join(INITIALS[KINDS.index(k) // 4] for k in kinds)


_NODE = "conv string, node long, costs array<long>, places array<int>"


def _leaves(parts: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tables = [whole_table([row_table(k) for k in _marked(*row)]) for row in zip(f["kinds"], f["saids"], f["known"])]
            yield pd.DataFrame({"conv": f["conv"], "node": f["node"], "costs": [list(t[0]) for t in tables], "places": [list(t[1]) for t in tables]})

    return parts.select("conv", "node", "kinds", "saids", "known").mapInPandas(run, _NODE)


def _tables(f: pd.DataFrame) -> list[Table]:
    return [(tuple(map(int, c)), tuple(map(int, p))) for c, p in zip(f["costs"], f["places"])]


def _parent(f: pd.DataFrame, fan: int) -> pd.DataFrame:
    """Children of one node, joined."""
    f = f.sort_values("node")
    cost, place = whole_table(_tables(f))
    return pd.DataFrame({"conv": [f["conv"].iloc[0]], "node": [int(f["node"].iloc[0]) // fan], "costs": [list(cost)], "places": [list(place)]})


def _children(f: pd.DataFrame) -> pd.DataFrame:
    """States at the ends of the children of one node whose own are known (end -1: open)."""
    f = f.sort_values("node")
    end = int(f["end"].iloc[0])
    states = crossings(_tables(f), int(f["start"].iloc[0]), None if end < 0 else end)
    ends = states[1:] if end >= 0 else [*states[1:-1], -1]  # the last child of an open node chooses for itself
    return pd.DataFrame({"conv": f["conv"], "node": f["node"], "start": states[:-1], "end": ends})


def solve(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """Segments with ``start`` and ``end`` states (end -1: where the conversation may end) and ``known``, the digests of
    theirs that earlier segments of the conversation hold. Conversations of one segment are solved as they are."""
    several = parts.groupBy("conv").agg(F.count("*").alias("n"), F.max("node").alias("last")).where("n > 1").checkpoint()
    alone = parts.join(several, "conv", "left_anti").withColumns(
        {"known": F.lit(None).cast("array<binary>"), "start": F.lit(START), "end": F.lit(-1)}
    )
    last = several.agg(F.max("last")).first()[0]
    if last is None:
        return alone
    long = parts.join(several.select("conv"), "conv", "left_semi")
    each = long.select("conv", "node", F.explode("saids").alias("said")).distinct()
    first = each.groupBy("conv", "said").agg(F.min("node").alias("first"))
    again = each.join(first, ["conv", "said"]).where("node > first").groupBy("conv", "node").agg(F.collect_set("said").alias("known"))
    long = long.join(again, ["conv", "node"], "left").checkpoint()
    levels = [_leaves(long).checkpoint()]
    while last:
        groups = levels[-1].groupBy("conv", F.floor(F.col("node") / fan))
        levels.append(groups.applyInPandas(lambda f: _parent(f, fan), _NODE).checkpoint())
        last //= fan
    known = levels[-1].select("conv", "node", F.lit(START).alias("start"), F.lit(-1).alias("end"))
    for level in reversed(levels[:-1]):
        above = known.withColumnRenamed("node", "parent")
        met = level.withColumn("parent", F.floor(F.col("node") / fan)).join(above, ["conv", "parent"])
        known = met.groupBy("conv", "parent").applyInPandas(_children, "conv string, node long, start int, end int").checkpoint()
    return alone.unionByName(long.join(known, ["conv", "node"]))


def audits(solved: DataFrame) -> DataFrame:
    """(conv, node, audit, cost, blank, duplicate, truncated, illegal, ends, edits, edit_saids, edit_roles) of every segment:
    edits are its letters but D, with their rows' digests and roles (null for inserts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for conv, node, kinds, saids, roles, known, start, end in zip(*(f[c] for c in columns)):
                kinds = _marked(kinds, saids, known)
                own, states = letters(kinds, int(start), None if end < 0 else int(end))
                more, close = CLOSE[states[-1]] if end < 0 else (0, "")
                cost = sum(moves(k)[s, t][0] for k, s, t in zip(kinds, states, states[1:])) + more
                edits = [(x, *((d, r) if x in "KR" else (None, None))) for xs, d, r in zip(own, saids, roles) for x in xs if x != "D"]
                edits += [("I", None, None)] * len(close)
                faults = [FAULTS[KINDS.index(k) % 4] for k in kinds]
                initials = _initials(kinds)
                rows.append((conv, node, "".join(own) + close, cost, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                             illegal(initials), initials[0] + initials[-1], *([e[i] for e in edits] for i in range(3))))
            yield pd.DataFrame(rows, columns=names)

    columns = ["conv", "node", "kinds", "saids", "roles", "known", "start", "end"]
    schema = (
        "conv string, node long, audit string, cost long, blank long, duplicate long, truncated long, illegal long, ends string, "
        "edits array<string>, edit_saids array<binary>, edit_roles array<string>"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    return solved.select(*columns).mapInPandas(run, schema)


def repair(rows: DataFrame, *, segment: int = SEGMENT, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired rows) of the rows (conv, turn, role, text).

    Conversations: conv, blank, duplicate, truncated, illegal, cost, audit. Repaired rows: conv, number (from 0), role,
    text.
    """
    # per segment: the pair it forms with the one before, and the turns before it and in all of its conversation
    of, size = Window.partitionBy("conv"), F.size("edits")
    pair = F.concat(F.substring(F.lag("ends").over(of.orderBy("node")), 2, 1), F.substring("ends", 1, 1))
    done = audits(solve(segments(rows, segment), fan)).checkpoint().select(
        "*", (F.col("illegal") + F.coalesce((~pair.isin("su", "ua", "au")).cast("long"), F.lit(0))).alias("pairs"),
        F.sum(size).over(of).alias("turns"), (F.sum(size).over(of.orderBy("node")) - size).alias("before"),
    )
    pieces = F.sort_array(F.collect_list(F.struct("node", "audit")))
    whole = done.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum("pairs").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"),
    )
    return whole, _written(done, rows)


def _written(done: DataFrame, rows: DataFrame) -> DataFrame:
    # an odd number of turns starts with a (kept) system turn
    step = done.select("conv", "turns", "before", F.posexplode(F.arrays_zip("edits", "edit_saids", "edit_roles")).alias("at", "e"))
    number = F.col("before") + F.col("at")
    given = F.when(number % 2 == F.col("turns") % 2, F.lit(ROLES["u"])).otherwise(F.lit(ROLES["a"]))
    role = F.when(F.col("e.edits") == "K", F.col("e.edit_roles")).otherwise(given)
    steps = step.select("conv", number.alias("number"), role.alias("role"), F.col("e.edit_saids").alias("said"))
    inserts = steps.where("said IS NULL").select("conv", "number", "role", F.lit("").alias("text"))
    texts = rows.groupBy(said(F.col("conv"), F.col("role"), F.col("text")).alias("said")).agg(F.min("text").alias("text"))
    kept = steps.where("said IS NOT NULL").join(texts, "said")
    return inserts.union(kept.select("conv", "number", "role", "text"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the conversations that keep a turn; the texts of a conversation stream through a task in
    order, since the digest of the whole has no parts."""
    dealt = repaired.repartition("conv").sortWithinPartitions("conv", "number").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        convs: list[str] = []
        sums: list[str] = []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now:
                    if now is not None:
                        convs.append(now)
                        sums.append(digest.hexdigest())
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(sums, pa.string())], names=["conv", "repaired_sha256"])
            convs, sums = [], []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

    return dealt.mapInArrow(run, "conv string, repaired_sha256 string")


def report(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """The contract's row per conversation of the original rows, after the damage."""
    hit = damaged(rows, conv=conv, turn=turn)
    conversations, repaired = repair(hit, segment=segment, fan=fan)
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn"))
    gapped = hit.groupBy("conv").agg(F.least(F.coalesce(gaps, wide(F.lit(0))), wide(F.lit(TOP))).cast("long").alias("gaps"))
    out = rows.select(F.col(conv).alias("conv_id")).distinct().withColumn("conv", keyed(F.col("conv_id")))
    for part in (gapped, conversations, digests(repaired)):
        out = out.join(part, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
