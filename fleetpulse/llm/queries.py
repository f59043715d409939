"""Registered queries of the training-data operators, each over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import (
    bond_topk,
    bpe,
    chat_layouts,
    circulant_minhash,
    collision_knn,
    decision_list,
    hilbert_pack,
    language_fusion,
    line_blocks,
    strassen_negatives,
    turn_repair,
    url_asof,
    wordpiece_counts,
)
from fleetpulse.llm.common import prepare, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with a multilingual byte-level BPE."""
    spec = bpe.from_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(read(spark, sf_dir, "documents"), spec)


@query("op2_line_blocks")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return line_blocks.main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op3_hilbert_pack")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens along a Hilbert curve."""
    model = hilbert_pack.read_model(public_tokenizers.path("byte_bpe_50k.json"))
    return hilbert_pack.pack(read(spark, sf_dir, "documents"), model, public_tokenizers.PATTERN, added=True)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' #' || len(w)::VARCHAR] ELSE [] END) AS s FROM w),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT reach.d, edge.b FROM reach JOIN edge ON edge.a = reach.r),
comp AS (SELECT d, min(r) AS r FROM reach GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, comp.r AS component_id, n.doc_id = comp.r AS kept FROM n JOIN comp ON comp.d = n.doc_id
"""


@query("op4_circulant_minhash", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return circulant_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def _sql_length(text: str) -> str:
    """Code points of an escaped text: control strings cannot overlap, each adds one, and so does every backslash."""
    more = [f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in (*chat_layouts.CONTROL, chat_layouts.ESCAPE)]
    return f"length({text}) + " + " + ".join(more)


OP5_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
per AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum({len(chat_layouts.TURN_OPEN) + 1 + len(chat_layouts.TURN_CLOSE)} + length(role) + {_sql_length("text")}) AS formatted
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted::BIGINT AS formatted_chars FROM per
"""


@query("op5_chat_layouts", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said_twice = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said_twice), (-1, 1, "assistant", said_twice)], said.schema)
    records = chat_layouts.rows_to_records(said.unionByName(probe))
    return chat_layouts.digests(chat_layouts.format_records(records))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op6_bond_topk", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best candidates of every row whose id is divisible by 100."""
    return bond_topk.top_k(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


@query("op7_wordpiece_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of every document."""
    vocabulary = wordpiece_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return wordpiece_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


@query("op8_decision_list")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the rules learned from the labelled ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.learn(docs, read(spark, sf_dir, "labels"))
    return decision_list.judge(docs, rules).select("doc_id", *decision_list.BASE, "base_failed", "kept")


#: Fetch times of pages, and a list made of what they say: a tracking mark in a URL blocks its host from the next day on,
#: a fragment its domain, and a page number allows host/segment; other pages allow their host.
_YEAR = 31_536_000
_START = 1_704_067_200


def page_captures(pages: DataFrame) -> DataFrame:
    second = F.pmod(F.pmod("page_id", F.lit(_YEAR)) * 7919, F.lit(_YEAR)) + _START
    return pages.select("page_id", "url", F.timestamp_seconds(second).alias("fetched_at"))


def page_entries(captures: DataFrame) -> DataFrame:
    u, name = F.col("url"), url_asof.host(F.col("url"))
    site = F.concat_ws("/", name, F.regexp_extract(u, url_asof.SEGMENT, 1))
    parent = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    marked = F.when(u.contains("utm_"), F.struct(name.alias("pattern"), F.lit("block").alias("action")))
    marked = marked.when(u.contains("#"), F.struct(parent.alias("pattern"), F.lit("block").alias("action")))
    marked = marked.when(u.contains("page="), F.struct(site.alias("pattern"), F.lit("allow").alias("action")))
    entry = marked.otherwise(F.struct(name.alias("pattern"), F.lit("allow").alias("action")))
    day = F.date_trunc("day", "fetched_at") + F.expr("interval 1 day")
    return captures.where(u.isNotNull()).select(entry.alias("e"), day.alias("listed_at")).select("e.*", "listed_at").distinct()


OP9_SQL = rf"""
WITH c AS (
  SELECT page_id, url, ((((page_id % {_YEAR} + {_YEAR}) % {_YEAR}) * 7919) % {_YEAR} + {_START}) AS s,
         lower(rtrim(regexp_extract(ltrim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.')) AS host,
         regexp_extract(ltrim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS segment FROM pages),
t AS (SELECT *, make_timestamp(s * 1000000) AS fetched_at, string_split(host, '.') AS l FROM c),
e AS (
  SELECT CASE WHEN contains(url, 'utm_') THEN host WHEN contains(url, '#') THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1)
              WHEN contains(url, 'page=') THEN host || '/' || segment ELSE host END AS pattern,
         CASE WHEN contains(url, 'utm_') OR contains(url, '#') THEN true ELSE false END AS blocked,
         date_trunc('day', fetched_at) + INTERVAL 1 DAY AS valid_from FROM t WHERE url IS NOT NULL),
d AS (SELECT pattern, valid_from, bool_or(blocked) AS blocked FROM e GROUP BY 1, 2),
k AS (
  SELECT page_id, url, fetched_at, unnest(list_distinct(list_concat(
           list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i:], '.')),
           CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END))) AS pattern
  FROM t WHERE host <> ''),
m AS (
  SELECT k.page_id, k.url, k.fetched_at, k.pattern, d.valid_from, d.blocked
  FROM k ASOF JOIN d ON k.pattern = d.pattern AND k.fetched_at >= d.valid_from),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC) AS r FROM m)
SELECT t.page_id, t.url, t.fetched_at, b.pattern, b.valid_from, coalesce(b.blocked, false) AS blocked
FROM t LEFT JOIN b ON b.page_id = t.page_id AND b.r = 1
"""


@query("op9_url_asof", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture judged by the list entry active at its fetch time."""
    captures = page_captures(read(spark, sf_dir, "pages"))
    judged = url_asof.decide(captures, page_entries(captures))
    return judged.select("page_id", "url", "fetched_at", "pattern", "valid_from", "blocked")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents name their declared language and their source, which stands for the host."""
    return language_fusion.identify(docs, declared=F.col("lang"), host=F.col("source"))


@query("op10_language_fusion")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, and whether it is kept."""
    found = identify_documents(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "lang", "language", "probability", F.col("language_kept").alias("kept"))


@query("page_languages")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its text, html lang attribute, address path or suffix, and host."""
    pages = read(spark, sf_dir, "pages")
    marked = line_blocks.main_text(
        pages.withColumn("declared", F.nullif(F.lower(F.regexp_extract("html", r"<html[^>]*\blang=[\"']?([A-Za-z]+)", 1)), F.lit("")))
    )
    name = url_asof.host(F.col("url"))
    suffix = F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-z]{2})/", 1), F.lit(""))
    found = language_fusion.identify(
        marked,
        key="page_id",
        declared=F.col("declared"),
        suffix=suffix,
        host=name,
        domain=F.nullif(F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1), F.lit("")),
        training="declared",
    )
    return found.select("page_id", "url", "declared", "language", "probability", F.col("language_kept").alias("kept"))


@query("op11_collision_knn")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows found of every row whose id is divisible by 100."""
    return collision_knn.nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def _repair_sql() -> str:
    """Least suffixes (nine digits of cost, then the audit) of every row and state, from the last row to the first."""
    way = lambda k, cost, letter: f"printf('%09d', substr({k}, 1, 9)::BIGINT + {cost}) || '{letter}' || substr({k}, 10)"
    open_ = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    none = "'999999999'"

    def row(s: int) -> str:
        initial, after = open_[s]
        kept = [f"CASE WHEN NOT must AND i = '{initial}' THEN {way(f'r.v{after}', 'late', 'K')} ELSE {none} END"]
        if s == 0:
            kept.append(f"CASE WHEN NOT must AND i = 's' THEN {way('r.v1', 'late', 'K')} ELSE {none} END")
        given = f"CASE WHEN NOT must THEN {way(f'r.v{after}', '3 + late', 'R')} ELSE {none} END"
        return f"least({way(f'r.v{s}', 4, 'D')}, {given}, {', '.join(kept)})"

    def closed(names: list[str]) -> list[str]:
        return [f"least({names[s]}, {way(names[open_[s][1]], 3, 'I')})" for s in range(4)]

    first = ", ".join(f"{row(s)} AS b{s}" for s in range(4))
    second = ", ".join(f"{x} AS c{s}" for s, x in enumerate(closed([f"b{s}" for s in range(4)])))
    third = ", ".join(f"{x} AS v{s}" for s, x in enumerate(closed([f"c{s}" for s in range(4)])))
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_reduce(list_concat([4294967295], list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
             lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc FROM conversations),
d AS (SELECT *, xor(crc, 4294967295) % 20 AS damage FROM named),
hit AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE damage <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM hit),
f AS (
  SELECT *, CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN t[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, role[1] AS i,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] NOT IN ('su', 'ua', 'au') AS bad FROM n),
g AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM f),
r AS (
  SELECT conv_id, max(n) + 1 AS k, '000000000' AS v0, '000000006II' AS v1, '000000003I' AS v2, '000000000' AS v3 FROM g GROUP BY conv_id
  UNION ALL
  SELECT conv_id, k, {third} FROM (SELECT conv_id, k, b0, b1, b2, b3, {second} FROM (
    SELECT g.conv_id, g.k, {first} FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.k = r.k - 1))),
best AS (SELECT conv_id, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM r WHERE k = 1),
steps AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
edits AS (
  SELECT conv_id, p, audit[p] AS edit, p - (length(a) - length(replace(a, 'D', ''))) AS e, p - (length(a) - length(replace(a, 'I', ''))) AS k,
         length(audit) - (length(audit) - length(replace(audit, 'D', ''))) AS turns FROM (SELECT *, audit[1:p] AS a FROM steps)),
out AS (
  SELECT edits.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN g.role WHEN e % 2 <> turns % 2 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN edit = 'I' THEN '' ELSE g.text END, chr(10) ORDER BY p)) AS h
  FROM edits LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM edits.conv_id AND g.k = edits.k WHERE edit <> 'D' GROUP BY 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal
  FROM g GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN out ON out.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP12_SQL = _repair_sql()


@query("op12_turn_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and cheapest repair of every conversation."""
    return turn_repair.report(read(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op13_strassen_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100; where the id is divisible by 7 the label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return strassen_negatives.mine(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, label=label)
