"""Pieces of the SQL twins that several queries share."""

from __future__ import annotations

SEV = "CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END"


def counter(table: str, key: str, where: str = "TRUE", weight: str | None = None) -> str:
    """``(key, n)`` counter."""
    n = "count(*)" if weight is None else f"CAST(sum({weight}) AS BIGINT)"
    cond = where if weight is None else f"({where}) AND {weight} > 0"
    return f"SELECT CAST({key} AS VARCHAR) AS key, {n} AS n FROM {table} WHERE ({cond}) AND ({key}) IS NOT NULL GROUP BY 1"


def counters(table: str, dims: dict[str, tuple]) -> str:
    """``(dim, key, n)`` of several counters."""
    parts = []
    for name, spec in dims.items():
        source = spec[3] if len(spec) > 3 else table
        parts.append(f"SELECT '{name}' AS dim, key, n FROM ({counter(source, *spec[:3])})")
    return " UNION ALL ".join(parts)


def top(counts: str, n: int) -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, key) AS rank FROM ({counts})) "
        f"WHERE rank <= {n}"
    )


def tables(counts: str, layout, unit: str, byte_dims: set[str], n: int, tone: str) -> str:
    """Ranked table set in report order."""
    number = "CASE dim " + " ".join(f"WHEN '{name}' THEN {i}" for i, (name, _) in enumerate(layout, 1)) + " END"
    title = "CASE dim " + " ".join(f"WHEN '{name}' THEN '{text}'" for name, text in layout) + " END"
    names = ",".join(f"'{name}'" for name, _ in layout)
    bytes_in = ",".join(f"'{b}'" for b in byte_dims) or "''"
    return (
        f"SELECT CAST({number} AS BIGINT) AS table_no, {title} AS title, key, n, "
        f"CASE WHEN dim IN ({bytes_in}) THEN 'bytes' ELSE '{unit}' END AS unit, rank, "
        f"CAST(CASE WHEN n > 0 THEN greatest(1, floor(n * 100 / max(n) OVER (PARTITION BY dim))) ELSE 0 END AS BIGINT) AS pct_of_max, "
        f"{tone} AS tone FROM ({top(counts, n)}) WHERE dim IN ({names})"
    )


VALUE_TONE = (
    "CASE WHEN regexp_matches(key, '^[1-5][0-9][0-9]$') THEN CASE substr(key,1,1) WHEN '5' THEN 'crit' WHEN '4' THEN 'warn' WHEN '2' THEN 'ok' ELSE 'info' END "
    "WHEN key IN ('SSLv3','TLSv1','TLSv1.1') OR key LIKE '% SSLv3' OR key LIKE '% TLSv1' OR key LIKE '% TLSv1.1' THEN 'crit' "
    "WHEN key = '443 no TLS' THEN 'crit' WHEN key = 'unknown' OR key LIKE '% unknown' THEN 'warn' WHEN key = 'TLSv1.3' OR key LIKE '% TLSv1.3' THEN 'ok' "
    "WHEN key LIKE 'Failed%' THEN 'crit' WHEN key IN ('Success','ALLOW','ACCEPT') THEN 'ok' WHEN key IN ('BLOCK','REJECT') THEN 'crit' "
    "WHEN key IN ('CAPTCHA','CHALLENGE','SigV2') THEN 'warn' WHEN key = 'COUNT' THEN 'info' END"
)
ACTION_TONE = "CASE key WHEN 'ACCEPT' THEN 'ok' WHEN 'REJECT' THEN 'crit' END"


def normalized(path: str) -> str:
    """Numeric path segments as ``{n}``, without look-ahead."""
    return "array_to_string([regexp_replace(s, '^[0-9]+(\\.|$)', '{n}\\1') for s in string_split(" + path + ", '/')], '/')"


def finding(rule: str, severity: str, title: str, actor: str, detail: str, time: str, n: str, rest: str) -> str:
    rank = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}[severity]
    null = "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT '{rule}' AS rule, '{severity}' AS severity, CAST({rank} AS BIGINT) AS severity_rank, '{title}' AS title, "
        f"{actor} AS actor, {null} AS account, {null} AS region, {null} AS event_id, {detail} AS detail, {time} AS time, "
        f"CAST({n} AS BIGINT) AS n {rest}"
    )


FINDING_ORDER = "severity_rank DESC, n DESC, actor, rule, time, detail"


def capped(union: str, cap: int) -> str:
    return (
        f"SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (ORDER BY {FINDING_ORDER}) AS place FROM ({union})) "
        f"WHERE place <= {cap} OR severity = 'CRITICAL'"
    )


def size(n: str) -> str:
    """Binary size text."""
    return (
        f"CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B' WHEN {n} < 1048576 THEN printf('%.1f KiB', {n} / 1024.0) "
        f"WHEN {n} < 1073741824 THEN printf('%.1f MiB', {n} / 1048576.0) WHEN {n} < 1099511627776 THEN printf('%.1f GiB', {n} / 1073741824.0) "
        f"ELSE printf('%.1f TiB', {n} / 1099511627776.0) END"
    )


def severity_counts(union: str) -> str:
    return (
        "SELECT s.severity, CAST(s.severity_rank AS BIGINT) AS severity_rank, count(f.rule) AS n FROM "
        "(VALUES ('LOW',0),('MEDIUM',1),('HIGH',2),('CRITICAL',3)) s(severity, severity_rank) "
        f"LEFT JOIN ({union}) f ON f.severity = s.severity GROUP BY ALL"
    )
