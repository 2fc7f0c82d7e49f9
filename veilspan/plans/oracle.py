"""Pieces of DuckDB SQL shared by the catalogue's queries."""

from __future__ import annotations

from collections.abc import Sequence

from veilspan.operators.tokens import TOKEN


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def matches(pattern: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """key, k, span_start, span_end, surface of all matches, in order."""
    p = quoted(pattern)
    size = "lambda z: length(z)"
    return (
        f"SELECT {key}, k, span_start, span_start + length(surface) AS span_end, surface FROM (SELECT {key}, k, m[k] AS surface, "
        f"CAST(coalesce(list_sum(list_transform(g[1:k], {size})), 0) + coalesce(list_sum(list_transform(m[1:k-1], {size})), 0) AS BIGINT) AS span_start "
        f"FROM (SELECT {key}, string_split_regex({text}, {p}) AS g, regexp_extract_all({text}, {p}) AS m FROM {table} WHERE regexp_matches({text}, {p})) q, "
        f"unnest(range(1, len(q.m) + 1)) AS u(k))"
    )


def spans(rules: Sequence[tuple[str, str]], table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """key, label, place, span_start, span_end, surface; ``place`` is the input order."""
    return " UNION ALL ".join(
        f"SELECT {key}, {quoted(label)} AS label, {n} * 1000000 + k AS place, span_start, span_end, surface FROM ({matches(p, table, key, text)})" for n, (label, p) in enumerate(rules)
    )


def greedy(source: str, key: str = "doc_id", ties: str = "label", within: str = "", name: str = "kept") -> str:
    """CTEs up to ``name``: the left-to-right choice of the rows of ``source``."""
    part = f"{key}{within}"
    same = " AND ".join(f"o.{c.strip()} = w.{c.strip()}" for c in part.split(","))
    return (
        f"{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY span_start, span_start - span_end, {ties}) AS rn FROM {source}), "
        f"{name}_w AS (SELECT {part}, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS at, false AS kept FROM (SELECT DISTINCT {part} FROM {name}_o) "
        f"UNION ALL SELECT {', '.join('o.' + c.strip() for c in part.split(','))}, o.rn, CASE WHEN o.span_start >= w.at AND o.span_end > o.span_start THEN o.span_end ELSE w.at END, "
        f"o.span_start >= w.at AND o.span_end > o.span_start FROM {name}_w w JOIN {name}_o o ON {same} AND o.rn = w.rn + 1), "
        f"{name} AS (SELECT o.* FROM {name}_o o JOIN {name}_w w ON {same} AND o.rn = w.rn WHERE w.kept)"
    )


def redaction(placeholder: str, table: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """key columns, redacted_text, span_count from CTE ``kept``."""
    join = " AND ".join(f"d.{c.strip()} = k.{c.strip()}" for c in keys.split(","))
    cols = ", ".join("d." + c.strip() for c in keys.split(","))
    return (
        f"SELECT {cols}, CASE WHEN n IS NULL THEN d.{text} ELSE head || substring(d.{text}, last + 1) END AS redacted_text, coalesce(n, 0) AS span_count FROM {table} d LEFT JOIN ("
        f"SELECT {keys}, string_agg(substring({text}, before + 1, span_start - before) || {placeholder}, '' ORDER BY span_start) AS head, max(span_end) AS last, count(*) AS n FROM ("
        f"SELECT k.*, d.{text}, coalesce(lag(span_end) OVER (PARTITION BY {cols} ORDER BY span_start), 0) AS before FROM kept k JOIN {table} d ON {join}) GROUP BY {keys}) k ON {join}"
    )


MARK = "'<' || trim(regexp_replace(upper(label), '[^A-Za-z0-9]+', '_', 'g'), '_') || '>'"

TOKENS = (
    f"tok AS MATERIALIZED (SELECT doc_id, CAST(k - 1 AS BIGINT) AS token_idx, token, CAST(stop - length(token) AS BIGINT) AS char_start, CAST(stop AS BIGINT) AS char_end FROM ("
    f"SELECT doc_id, k, token, sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM ("
    f"SELECT doc_id, k, g[k] AS gap, m[k] AS token FROM (SELECT doc_id, string_split_regex(text, {quoted(TOKEN)}) AS g, regexp_extract_all(text, {quoted(TOKEN)}) AS m FROM documents) q, "
    f"unnest(range(1, len(q.m) + 1)) AS u(k))))"
)


def labelled(name: str, source: str) -> str:
    """CTE ``name``: doc_id, token_idx, boundary, label of the tokens that a span of ``source`` wins."""
    return (
        f"{name}_s AS (SELECT doc_id, label, span_start, span_end, row_number() OVER (PARTITION BY doc_id ORDER BY span_start, span_start - span_end, label) AS sp FROM {source}), "
        f"{name}_b AS (SELECT doc_id, token_idx, sp, label FROM (SELECT t.doc_id, t.token_idx, s.sp, s.label, row_number() OVER (PARTITION BY t.doc_id, t.token_idx "
        f"ORDER BY least(char_end, span_end) - greatest(char_start, span_start) DESC, s.sp) AS r FROM tok t JOIN {name}_s s ON t.doc_id = s.doc_id AND char_start < span_end AND span_start < char_end) WHERE r = 1), "
        f"{name} AS (SELECT doc_id, token_idx, label, CASE WHEN n = 1 THEN 'S' WHEN r = 1 THEN 'B' WHEN r = n THEN 'E' ELSE 'I' END AS boundary FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY doc_id, sp ORDER BY token_idx) AS r, count(*) OVER (PARTITION BY doc_id, sp) AS n FROM {name}_b))"
    )
