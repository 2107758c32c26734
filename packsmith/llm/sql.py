"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM item_words WHERE len(w) > 0)),
doc_windows AS (
  SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM doc_words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT r, d.p, d.k, item FROM doc_windows d JOIN windows i ON d.k = i.k AND d.g = i.g),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS q FROM found) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""

OP8 = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS p FROM docs),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
marked AS (SELECT r, doc_id, line, p, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN often USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

def _secrets() -> str:
    from packsmith.llm.secrets import BASE, RULES

    quoted = [(k, r, r.pattern.replace("'", "''")) for k, r in enumerate(RULES)]
    rules = " UNION ALL ".join(f"SELECT r, {k} AS k, '{r.kind}' AS kind, regexp_extract_all(t, '{p}', 0) AS m, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}', {r.group}) AS g, {r.least} AS least FROM docs WHERE regexp_matches(t, '{p}')" for k, r, p in quoted)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({rules}),
each AS (SELECT r, k, kind, m, b, g, least, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (SELECT r, k, kind, length(g[i]) AS own, least, length(m[i]) AS n,
  CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM each),
spans AS (SELECT r, k, s, concat(kind, ':', s, ':', s + n) AS span FROM placed WHERE own >= least),
digest AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN digest USING (r)
"""


ORACLES = {
    "op1_decontamination": OP1,
    "op5_secrets": _secrets(),
    "op8_line_dedup": OP8,
}
