"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from veilspan.llm.quality_rules import BOILERPLATE
from veilspan.llm.queries import URL_RULES

#: Chat digests follow from the table alone; formatted_chars adds the template's marks and entities.
_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;') AS body,
    CASE role WHEN 'system' THEN 10 + 1 WHEN 'user' THEN 12 + 1 WHEN 'assistant' THEN 10 + 1
      ELSE 5 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) + 2 + 7 END AS marks
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + marks) + 7 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Exact all-pairs similarity by an inverted list of windows, and classes by a recursive walk.
_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS gram FROM w),
n AS (SELECT w.doc_id, count(g.gram) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (
  SELECT c.x, c.y FROM c JOIN n a ON a.doc_id = c.x JOIN n b ON b.doc_id = c.y WHERE common >= 0.8 * (a.n + b.n - common) - 1e-9
  UNION ALL SELECT a.doc_id, b.doc_id FROM n a JOIN n b ON a.n = 0 AND b.n = 0 AND a.doc_id <> b.doc_id),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y)
SELECT n.doc_id, min(r.y) AS class_id, (SELECT count(*) FROM p WHERE p.x = n.doc_id) AS n_links
FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id
"""


_HTML_LINK = r"""<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def _url_filters(damping: float = 0.85, steps: int = 8) -> str:
    """Rules by text, then the steps of both propagations written out."""

    def host(url: str) -> str:
        return f"translate(regexp_extract(substring({url}, instr({url}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    cases = []
    for _, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{rule}'")
    kinds = " ".join(f"WHEN '{rule}' THEN '{kind}'" for kind, rule in URL_RULES)
    link = _HTML_LINK.replace("'", "''")
    parts = [
        f"p AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN {host('url')} ELSE '' END AS host, "
        "CASE WHEN contains(url, '://') THEN regexp_extract(substring(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages)",
        f"b AS (SELECT *, CASE rule {kinds} END AS ruled FROM (SELECT *, CASE {' '.join(cases)} END AS rule FROM p))",
        "h AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS k FROM b WHERE host <> '' GROUP BY host)",
        f"l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1, 'i')) AS u FROM b WHERE host <> '')",
        f"e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT src, CASE WHEN contains(u, '://') THEN {host('u')} WHEN starts_with(u, '//') THEN {host("('x:' || u)")} ELSE src END AS dst FROM l) WHERE dst <> '' GROUP BY 1, 2)",
    ]
    for name, seed, src, dst in (("t", "a", "src", "dst"), ("d", "k", "dst", "src")):
        parts.append(f"{name}e AS (SELECT {src} AS x, {dst} AS y, w / sum(w) OVER (PARTITION BY {src}) AS s FROM e)")
        parts.append(f"{name}s AS (SELECT host, m / sum(m) OVER () AS m FROM (SELECT host, {seed} / n AS m FROM h WHERE {seed} > 0))")
        parts.append(f"{name}0 AS (SELECT host, m AS r FROM {name}s)")
        for k in range(steps):
            parts.append(
                f"{name}{k + 1} AS (SELECT host, sum(r) AS r FROM (SELECT y AS host, r * s * {damping} AS r FROM {name}e JOIN {name}{k} ON x = host "
                f"UNION ALL SELECT host, m * {1 - damping!r} FROM {name}s) GROUP BY host)"
            )
    return (
        "WITH " + ", ".join(parts) + " SELECT page_id, b.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.r, 0) > coalesce(t.r, 0) THEN 'block' ELSE 'allow' END) AS verdict "
        f"FROM b LEFT JOIN t{steps} t ON t.host = b.host LEFT JOIN d{steps} d ON d.host = b.host"
    )


def _quality(window: int = 5) -> str:
    """Counts and verdicts of the line rules and base rules."""
    space, solid = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    n = lambda p: f"len(regexp_extract_all(x, '{p}'))"
    fails = (
        f"{n(solid + '+')} > 0 AND (({n('[|»›]')} >= 2 AND {n('[|»›]')} * 4 >= {n(solid + '+')}) OR {n('[#*$%&<>]')} * 10 > length(regexp_replace(x, '{space}+', '', 'g')) "
        f"OR {n('[!?]{2,}')} * 3 > {n(solid + '+')} OR ({n(solid + '+')} >= 8 AND NOT regexp_matches(x, '[.!?…。:;](?:[\"''”»)\\]]*)(?:{space}|$)')) "
        f"OR ({n(solid + '+')} <= 12 AND regexp_matches(x, '{BOILERPLATE}')))"
    )
    return (
        f"WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents), "
        f"l AS (SELECT *, regexp_extract_all(text, '{solid}+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{solid}')) AS lines, "
        f"list_filter(string_split(text, chr(10)), lambda x: NOT ({fails})) AS good FROM t), "
        f"g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, list_value({', '.join(f'words[i + {k}]' for k in range(window))})) AS c FROM l, unnest(range(1, len(words) - {window - 2})) AS u(i)), "
        f"r AS (SELECT rid, sum(least({window}, coalesce(nx - i, {window}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM g WHERE c > 1) GROUP BY rid), "
        f"c AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{space}+', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, "
        "len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, "
        f"len(lines) - len(list_filter(good, lambda x: regexp_matches(x, '{solid}'))) AS n_failed_lines, length(regexp_replace(array_to_string(good, chr(10)), '{space}+', '', 'g')) AS kept_chars FROM l LEFT JOIN r ON r.rid = l.rid) "
        "SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars * 100 >= word_chars * 50 AS kept FROM c"
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _CHAT, "op3_url_filters": _url_filters(), "op6_ngram_jaccard_join": _NEAR, "op9_quality_rules": _quality()}
