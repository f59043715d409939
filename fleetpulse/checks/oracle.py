"""DuckDB SQL for the correctness oracle.

The oracle sees only the input tables, so each query is prefixed with the
derivations of the lake tables it references (same integer-only definitions as
``fleetpulse.sources.derived``), emitted as CTEs in dependency order.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

_STAMP = """instance_id, 'sqlserver' AS platform, ts AS collected_at,
    CAST(year(ts) AS SMALLINT) AS year, CAST(month(ts) AS TINYINT) AS month,
    CAST(day(ts) AS TINYINT) AS day"""

# name -> body. Order matters only for readability; dependencies are resolved.
DERIVED: dict[str, str] = {}

DERIVED["ev"] = """
SELECT event_id, ts, user_id, event_type, value,
       CAST(1000 + floor(user_id * 2 / 3) AS INTEGER) AS instance_id,
       CAST(4 + event_id % 15 AS INTEGER) AS database_id,
       CAST(floor((day(ts) - 1) / 10) AS INTEGER) AS ep
FROM events"""

DERIVED["pings"] = f"""
SELECT {_STAMP},
       CAST(CASE WHEN event_type = 'error' THEN 5000 ELSE CAST(floor(value) AS INTEGER) END AS INTEGER)
           AS response_time_ms,
       NOT (event_type = 'error' OR (instance_id % 50 IN (3, 7) AND ts >= TIMESTAMP '2024-01-28 00:00:00'))
           AS is_success
FROM ev"""

DERIVED["metric_cpu"] = f"""
SELECT {_STAMP},
       CAST(CASE WHEN event_id % 53 = 0 THEN NULL ELSE (event_id * 37) % 90 END AS SMALLINT) AS engine_cpu_percent,
       CAST((event_id * 17) % 11 AS SMALLINT) AS other_cpu_percent,
       CAST(100 - CASE WHEN event_id % 53 = 0 THEN NULL ELSE (event_id * 37) % 90 END
                - (event_id * 17) % 11 AS SMALLINT) AS system_idle_percent
FROM ev WHERE event_type IN ('view', 'click')"""

DERIVED["metric_memory"] = f"""
SELECT {_STAMP},
       CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id * 7919) % 8000 END AS BIGINT) AS page_residency_seconds,
       CAST(NULL AS DECIMAL(5,2)) AS buffer_hit_ratio,
       CAST(NULL AS INTEGER) AS grants_pending, CAST(NULL AS INTEGER) AS grants_outstanding
FROM ev WHERE event_type = 'signup'"""

DERIVED["metric_sessions"] = f"""
SELECT {_STAMP}, CAST(event_id % 50 AS INTEGER) AS active_sessions
FROM ev WHERE event_type = 'purchase'"""

DERIVED["metric_database_io"] = """
SELECT instance_id, database_id, 'sqlserver' AS platform, ts AS collected_at,
       CAST(year(ts) AS SMALLINT) AS year, CAST(month(ts) AS TINYINT) AS month,
       CAST(day(ts) AS TINYINT) AS day,
       CASE WHEN event_id % 29 = 0 THEN NULL
            WHEN ep = 0 THEN TIMESTAMP '2024-01-01 00:00:00'
            WHEN ep = 1 THEN TIMESTAMP '2024-01-11 00:00:00'
            ELSE TIMESTAMP '2024-01-21 00:00:00' END AS last_restart_at,
       CAST(r AS BIGINT) AS num_of_reads, CAST(r * 8192 AS BIGINT) AS num_of_bytes_read,
       CAST(sr AS BIGINT) AS io_stall_read_ms, CAST(w AS BIGINT) AS num_of_writes,
       CAST(w * 8192 AS BIGINT) AS num_of_bytes_written, CAST(sw AS BIGINT) AS io_stall_write_ms,
       CAST(sr + sw AS BIGINT) AS io_stall, CAST(NULL AS BIGINT) AS size_on_disk_bytes
FROM (
    SELECT *,
        SUM(1 + event_id % 97)   OVER win AS r,
        SUM(1 + event_id % 9973) OVER win AS sr,
        SUM(1 + event_id % 89)   OVER win AS w,
        SUM(1 + event_id % 4999) OVER win AS sw
    FROM ev WHERE event_type IN ('view', 'click')
    WINDOW win AS (PARTITION BY instance_id, database_id, ep ORDER BY ts, event_id)
) x"""

DERIVED["metric_blocking"] = """
SELECT instance_id, database_id, 'sqlserver' AS platform, ts AS collected_at,
       CAST(year(ts) AS SMALLINT) AS year, CAST(month(ts) AS TINYINT) AS month,
       CAST(day(ts) AS TINYINT) AS day, CAST(event_id % 8 AS INTEGER) AS blocked_session_count
FROM ev WHERE event_type = 'error'"""

DERIVED["instances"] = """
SELECT CAST(1000 + s_suppkey AS INTEGER) AS instance_id, lower(s_name) AS instance_fqn,
       lower(s_name) AS instance_name, 'sqlserver' AS platform,
       CASE WHEN s_suppkey % 10 = 8 THEN 'Q' ELSE 'P' END AS environment,
       CASE WHEN s_suppkey % 10 = 9 THEN 'x' WHEN s_suppkey % 10 = 4 THEN 'b' ELSE 'a' END AS status,
       'standard' AS category, '16.0' AS engine_version, (s_suppkey % 3 = 0) AS is_clustered,
       FALSE AS dmz, 'corp' AS domain, 'integrated' AS auth_mode,
       TIMESTAMP '2023-12-01 00:00:00' AS registered_at, CAST(NULL AS TIMESTAMP) AS updated_at
FROM supplier"""

DERIVED["databases"] = """
SELECT k.instance_id, k.database_id, 'sqlserver' AS platform,
       (CASE WHEN k.database_id = 4 THEN 'msdb'
             WHEN k.database_id = 6 AND k.instance_id % 2 = 0 THEN 'uhtdba'
             WHEN k.database_id = 7 AND k.instance_id % 10 = 5 THEN 'model'
             ELSE 'db_' || CAST(k.database_id AS VARCHAR) END)
         || CASE WHEN s.snap = 2 AND k.database_id >= 10 THEN '_v2' ELSE '' END AS database_name,
       TIMESTAMP '2023-06-01 00:00:00' AS create_date, CAST(160 AS SMALLINT) AS compatibility_level,
       'SQL_Latin1_General_CP1_CI_AS' AS collation_name,
       CASE WHEN k.database_id % 2 = 0 THEN 'FULL' ELSE 'SIMPLE' END AS recovery_model,
       'ONLINE' AS state, 'MULTI_USER' AS user_access, FALSE AS is_read_only, FALSE AS is_mirrored,
       FALSE AS is_alwayson, 'sa' AS owner_name,
       CAST(k.database_id * 100 AS INTEGER) AS data_file_size_mb,
       CAST(k.database_id * 10 AS INTEGER) AS log_file_size_mb, s.collected_at
FROM (SELECT DISTINCT instance_id, database_id FROM ev) k,
     (VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (2, TIMESTAMP '2024-01-15 00:00:00')) s(snap, collected_at)"""

DERIVED["score_thresholds"] = """
SELECT * FROM (VALUES
    ('cpu', 'higher_worse', 75.0::DOUBLE, 90.0::DOUBLE),
    ('memory', 'lower_worse', 3600.0::DOUBLE, 300.0::DOUBLE),
    ('read_latency', 'higher_worse', 25.0::DOUBLE, 125.0::DOUBLE),
    ('write_latency', 'higher_worse', 25.0::DOUBLE, 125.0::DOUBLE),
    ('blocker', 'higher_worse', 0.05::DOUBLE, 0.15::DOUBLE)
) t(index_name, direction, warn_threshold, crit_threshold)"""


def register(name: str, body: str) -> None:
    DERIVED[name] = body


def _refs(sql: str, names) -> set[str]:
    return {n for n in names if re.search(rf"\b{re.escape(n)}\b", sql)}


def with_derived(final_sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``final_sql`` with every derived CTE it (transitively) needs.

    ``extra`` adds query-local CTEs (name -> body) that may reference derived ones.
    """
    defs = dict(DERIVED)
    if extra:
        defs.update(extra)
    order: list[str] = []
    seen: set[str] = set()

    def visit(n: str) -> None:
        if n in seen:
            return
        seen.add(n)
        for d in sorted(_refs(defs[n], set(defs) - {n})):
            visit(d)
        order.append(n)

    for n in sorted(_refs(final_sql, set(defs))):
        visit(n)
    if not order:
        return final_sql
    ctes = ",\n".join(f"{n} AS ({defs[n]}\n)" for n in order)
    body = final_sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{final_sql}"
