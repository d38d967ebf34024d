"""SQL text fragments for oracle queries (DuckDB dialect).

They state the same rules as ``batchtrail.functions`` in plain SQL so each
registered query has an independent answer to be compared with.
"""

from __future__ import annotations

from batchtrail.functions.text import WHITESPACE_CODES

NUM = r"-?\d+(?:\.\d+)?"
_WS = " || ".join(f"chr({c})" for c in WHITESPACE_CODES)


def clean(x: str) -> str:
    return f"coalesce(trim(CAST({x} AS VARCHAR), {_WS}), '')"


def nonblank(x: str) -> str:
    return f"nullif({clean(x)}, '')"


def parse_num(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(replace({clean(x)}, ',', ''), '{NUM}', 0), '') AS DOUBLE)"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "
            "lambda w: upper(w[1]) || lower(w[2:])), '')")


def eff_date(d: str = "entry_date", c: str = "created_at") -> str:
    return f"coalesce({d}, substr({c}, 1, 10))"


def point_time(d: str, t: str, c: str) -> str:
    dt = f"coalesce({nonblank(d)}, substr({clean(c)}, 1, 10))"
    tt = f"(CASE WHEN length({clean(t)}) = 5 THEN {clean(t)} || ':00' ELSE {clean(t)} END)"
    return (f"(CASE WHEN {dt} <> '' AND {tt} <> '' THEN {dt} || 'T' || {tt} "
            f"ELSE coalesce(nullif({clean(c)}, ''), {dt}) END)")


def payload_map(x: str = "payload_json") -> str:
    return f"coalesce(TRY_CAST(TRY_CAST({x} AS JSON) AS MAP(VARCHAR, VARCHAR)), MAP {{}})"


def run_label(rn: str = "run_number", bn: str = "batch_number", rid: str = "id") -> str:
    return (f"coalesce({nonblank(rn)}, {nonblank(bn)}, "
            f"CASE WHEN {rid} IS NOT NULL AND {rid} <> 0 THEN CAST({rid} AS VARCHAR) END, '')")


def date_between(start: str, end: str, d: str = "entry_date", c: str = "created_at") -> str:
    parts = []
    if start:
        parts.append(f"{eff_date(d, c)} >= '{start}'")
    if end:
        parts.append(f"{eff_date(d, c)} <= '{end}'")
    return " AND ".join(parts) if parts else "TRUE"


def unpivot(src: str, keep: str, fields: list[str]) -> str:
    """UNION ALL of one row per field (``field``, ``text``)."""
    return "\nUNION ALL\n".join(f"SELECT {keep}, '{f}' AS field, {f} AS text FROM {src}" for f in fields)
