"""Chat formatting by schema fingerprint (operator 5).

A record arrives as JSON text of any known layout. The paths of its nested fields that a layout could use are hashed to a
fingerprint; the fingerprint selects a declarative mapping, and the mapping turns the record into canonical turns
(role, text). A fingerprint that no mapping has (fields of two layouts side by side) takes the mapping most of whose required
paths it holds, all of them; the choice is kept per fingerprint. ``layout_counts`` tells what stayed unknown. The template then marks every turn and escapes control strings reversibly, and notes the character spans
of assistant texts (the loss mask). ``read_back`` parses the formatted text again.

Defined cases: a record that is null, no JSON object, or that holds no mapping's required paths gives no turns and layout
null (an empty list of messages holds none); a text that is a list of parts is its parts' texts one after
the other; null
texts count as empty; null roles are empty; fields that no mapping names are ignored, also when their names clash with
template words; turns keep the record's order (rows: by turn, role, text, null turns first).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that steer a model in common chat templates (fixed values).
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
ESCAPE = "\\"

_TO_ESCAPE = re.compile("|".join(re.escape(c) for c in (ESCAPE, *CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN_OPEN) + r"(.*?)\n(.*?)" + re.escape(TURN_CLOSE), re.S)


class Mapping(NamedTuple):
    """How a layout becomes turns: ``turns`` names (role, path) pairs of single fields, or ``items`` a list of messages
    with its role and text fields; ``optional`` paths may be absent."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = ()

    def paths(self) -> frozenset[str]:
        listed = {f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"} if self.items else set()
        return frozenset(listed | {p for _, p in self.turns})


LAYOUTS = (
    Mapping("messages", items="messages", role="role", text="content"),
    Mapping("conversations", items="conversations", role="from", text="value"),
    Mapping("rows", items="rows", role="role", text="text"),
    Mapping("dialogue", items="dialogue", role="speaker", text="utterance"),
    Mapping("system_messages", turns=(("system", "system"),), items="messages", role="role", text="content"),
    Mapping(
        "instruction",
        turns=(("system", "system"), ("user", "instruction"), ("user+", "input"), ("assistant", "output")),
        optional=("system", "input"),
    ),
    Mapping("instruction_response", turns=(("user", "instruction"), ("user+", "context"), ("assistant", "response")), optional=("context",)),
    Mapping("prompt", turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_chosen", turns=(("user", "prompt"), ("assistant", "chosen"))),
    Mapping("question", turns=(("system", "system_prompt"), ("user", "question"), ("assistant", "answer")), optional=("system_prompt",)),
    Mapping("question_response", turns=(("system", "system_prompt"), ("user", "question"), ("assistant", "response")), optional=("system_prompt",)),
)
#: Canonical names of roles (others stay as they are).
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _registry(layouts) -> tuple[dict[str, Mapping], frozenset[str], tuple[Mapping, ...]]:
    by, known = {}, set()
    for m in layouts:
        must = m.paths() - set(m.optional)
        known |= m.paths()
        for bits in range(1 << len(m.optional)):
            some = {p for k, p in enumerate(m.optional) if bits >> k & 1}
            by.setdefault(fingerprint(must | some), m)
    return by, frozenset(known), tuple(layouts)


def _best(paths: frozenset[str], layouts) -> Mapping | None:
    """The mapping with the most required paths of those whose required paths all occur, then with the most optional ones;
    the first of equals."""
    fits = [m for m in layouts if m.paths() - set(m.optional) <= paths]
    return max(fits, key=lambda m: (len(m.paths() - set(m.optional)), len(m.paths() & paths)), default=None)


def field_paths(value, at: str = "", deep: int = 3) -> set[str]:
    """Nested field paths of a JSON value; ``[]`` stands for a list's items."""
    if deep and isinstance(value, dict):
        return set().union(*({f"{at}{k}"} | field_paths(v, f"{at}{k}.", deep - 1) for k, v in value.items()), set())
    if deep and isinstance(value, list):
        return set().union(*(field_paths(v, f"{at[:-1]}[].", deep) for v in value), set())
    return set()


def _text(value) -> str:
    if isinstance(value, list) and all(isinstance(p, str) or (isinstance(p, dict) and isinstance(p.get("text"), str)) for p in value):
        return "".join(p if isinstance(p, str) else p["text"] for p in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record: str | None, registry=None) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout, turns) of one JSON record."""
    by, known, layouts = registry or REGISTRY
    try:
        value = json.loads(record or "null")
    except ValueError:
        return None, []
    if not isinstance(value, dict):
        return None, []
    found = frozenset(field_paths(value)) & known
    mark = fingerprint(found)
    if mark not in by:
        by[mark] = _best(found, layouts)
    mapping = by[mark]
    if mapping is None:
        return None, []
    turns: list[tuple[str, str]] = []
    for role, path in mapping.turns:
        if path not in value:
            continue
        text = _text(value[path])
        if role.endswith("+") and turns:
            turns[-1] = (turns[-1][0], f"{turns[-1][1]}\n\n{text}" if text else turns[-1][1])
        else:
            turns.append((role.rstrip("+"), text))
    for item in value[mapping.items] if mapping.items else ():
        if isinstance(item, dict):
            role = _text(item.get(mapping.role))
            turns.append((ROLE_NAMES.get(role, role), _text(item.get(mapping.text))))
    return mapping.name, turns


REGISTRY = _registry(LAYOUTS)


def escape(text: str) -> str:
    """Backslashes doubled, and one put behind the first character of every control string."""
    return _TO_ESCAPE.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", ESCAPE + "n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, character spans of assistant texts in it)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN_OPEN}{_escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, TURN_CLOSE)
        at += len(head) + len(body) + len(TURN_CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_records(records: DataFrame, *, record: str = "record") -> DataFrame:
    """Rows with ``layout``, ``formatted`` and ``loss_spans`` (array of start, end) of their JSON record."""
    span = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType(), False) for x in ("start", "end")]), False)
    added = {"layout": T.StringType(), "formatted": T.StringType(), "loss_spans": span}
    rest = [c for c in records.columns if c not in (*added, record)]
    schema = T.StructType([*(records.schema[c] for c in rest), *(T.StructField(k, v) for k, v in added.items())])
    kind = pa.list_(pa.field("element", pa.struct([pa.field(x, pa.int32(), False) for x in ("start", "end")]), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, spans = [], [], []
            for r in batch.column(len(rest)):
                layout, turns = canonical(r.as_py())
                text, own = render(turns)
                names.append(layout)
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in own])
            new = [pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], names=schema.names)

    return records.select(*rest, record).mapInArrow(run, schema)


def layout_counts(formatted: DataFrame) -> DataFrame:
    """(layout, n): how many records each layout took; null: those that none did."""
    return formatted.groupBy("layout").agg(F.count("*").alias("n"))


def rows_to_records(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One JSON record of layout ``rows`` per conversation from a table with a row per turn."""
    item = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    packed = rows.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    return packed.select(key, F.to_json(F.struct("rows"), {"ignoreNullFields": "false"}).alias("record"))


def digests(formatted: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """Per formatted text what a reader of it gets: turns and their digest, the loss text and its digest."""
    schema = T.StructType(
        [
            T.StructField(key, formatted.schema[key].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

    return formatted.select(key, "formatted", "loss_spans").mapInArrow(run, schema)
