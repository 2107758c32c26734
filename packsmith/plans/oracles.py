"""DuckDB SQL for the queries of the byte-content operators."""

from __future__ import annotations

from packsmith.functions.chunking import GEAR, WINDOW
from packsmith.functions.scalars import EXTENSIONS, STEPS
from packsmith.plans.constants import CHUNKS, SHELF

_DOC = "SELECT doc_id AS item_id, coalesce(text, '') AS t FROM documents"
_BYTES = f"""docs AS ({_DOC}), hexed AS (SELECT item_id, hex(encode(t)) AS h FROM docs),
bytes AS (SELECT item_id, p, ('0x' || substr(h, 2 * p - 1, 2))::INT AS v FROM (SELECT item_id, h, unnest(range(1, length(h) // 2 + 1)) AS p FROM hexed WHERE h <> ''))"""
_VERDICT = "CASE WHEN h <= 6.5 THEN 'compressible' WHEN h >= 7.6 THEN 'incompressible' ELSE 'marginal' END"
_ENTROPY = f"""{_BYTES}, freq AS (SELECT item_id, v, count(*) AS c FROM bytes GROUP BY ALL),
ent AS (SELECT item_id, -sum(c / n * log2(c / n)) AS h FROM (SELECT item_id, c::DOUBLE AS c, sum(c) OVER (PARTITION BY item_id)::DOUBLE AS n FROM freq) GROUP BY item_id)"""
PROFILE = f"""WITH {_ENTROPY}
SELECT d.item_id AS doc_id, octet_length(encode(t))::BIGINT AS size, sha256(t) AS sha256, round(coalesce(h, 0.0), 3) AS entropy, {_VERDICT.replace('h ', 'coalesce(h, 0.0) ')} AS verdict
FROM docs d LEFT JOIN ent USING (item_id)"""
ENTROPY_BY_SOURCE = f"""WITH {_ENTROPY}, per AS (SELECT source, lang, round(coalesce(h, 0.0), 3) AS e FROM documents LEFT JOIN ent ON doc_id = item_id)
SELECT source, lang, count(*) AS n, floor(sum(round(e * 1000)::BIGINT)::DOUBLE * 10 / count(*) + 0.5) / 10000 AS avg_entropy, min(e) AS min_entropy, max(e) AS max_entropy FROM per GROUP BY source, lang"""
HISTOGRAM = f"WITH {_BYTES} SELECT v AS byte, count(*) AS n FROM bytes GROUP BY v"


def _kind(path: str, text: str) -> str:
    ext = f"lower(regexp_extract({path}, '\\.[^./]*$'))"
    cases = " ".join(f"WHEN {ext} IN ({', '.join(repr(e) for e in known)}) THEN '{kind}'" for kind, known in EXTENSIONS.items())
    head = f"hex(encode({text}))"
    magic = " ".join(f"WHEN {head} LIKE '{m}%' AND length({head}) >= {2 * least} THEN '{kind}'" for m, least, kind in [("52494646", 12, "audio_wav"), ("25504446", 4, "pdf"), ("504B0304", 4, "office"), ("425A68", 3, "archive"), ("47494638", 4, "image")])
    return f"CASE {cases} {magic} WHEN substr({head}, 1, 8) = '66747970' OR substr({head}, 9, 8) = '66747970' THEN 'video' ELSE 'text' END"


_STEPS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in STEPS.items()) + " END"
KINDS = f"SELECT page_id, kind, {_STEPS} AS steps FROM (SELECT page_id, {_kind('url', 'html')} AS kind FROM pages)"
_SIZE_H = "CASE WHEN s < 1024 THEN concat(s, ' B') WHEN s < 1048576 THEN printf('%.2f KB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.2f MB', s / 1048576.0) ELSE printf('%.2f GB', s / 1073741824.0) END"
SIZES = f"SELECT doc_id, {_SIZE_H} AS size_h, greatest(1, trunc(s * 0.2875::DOUBLE))::BIGINT AS target_balanced, greatest(1, trunc(s * 0.05::DOUBLE))::BIGINT AS target_ultra FROM (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS s FROM documents)"
TARGETS = "SELECT o_orderpriority AS mode, count(*) AS n, sum(greatest(1, trunc(floor(o_totalprice) * r)))::BIGINT AS target FROM orders JOIN (VALUES ('1-URGENT', 0.6::DOUBLE), ('2-HIGH', 0.2875::DOUBLE), ('3-MEDIUM', 0.15::DOUBLE), ('4-NOT SPECIFIED', 0.05::DOUBLE), ('5-LOW', 0.05::DOUBLE)) m(p, r) ON o_orderpriority = p GROUP BY 1"
PARSE = "SELECT part.p_partkey, (CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576 WHEN 3 THEN p_size * 1073741824::BIGINT ELSE p_size * 1536::BIGINT END)::BIGINT AS bytes FROM part"
_BASE = "regexp_replace(regexp_replace(regexp_extract(trim(coalesce(url, '')), '([^/]*)$', 1), '[\r\n\"'']', '', 'g'), '^[ .]+|[ .]+$', '', 'g')"
_SAFE = f"regexp_replace(regexp_replace(regexp_replace({_BASE}, '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')"
FILENAMES = f"""WITH s AS (SELECT page_id, {_BASE} AS base, {_SAFE} AS safe FROM pages)
SELECT page_id, CASE WHEN base = '' OR safe = '' THEN 'file.bin' WHEN length(safe) <= 100 THEN safe
  WHEN contains(safe, '.') AND length(regexp_extract(safe, '\\.([^.]*)$', 1)) <= 10 THEN substr(regexp_extract(safe, '^(.*)\\.[^.]*$', 1), 1, 99 - length(regexp_extract(safe, '\\.([^.]*)$', 1))) || '.' || regexp_extract(safe, '\\.([^.]*)$', 1)
  ELSE substr(safe, 1, 100) END AS safe_name FROM s"""
EXACT = "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n_copies, min(doc_id) AS first_id FROM documents GROUP BY 1"
LINES = """WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents),
u AS (SELECT x, count(*) AS n, octet_length(encode(x))::BIGINT AS len FROM l GROUP BY x)
SELECT sum(n)::BIGINT AS chunks, count(*) AS unique_chunks, sum(n * len)::BIGINT AS total_bytes, sum(len)::BIGINT AS unique_bytes, CASE WHEN sum(n * len) > 0 THEN round(sum(len) / sum(n * len), 4) ELSE 1.0 END AS dedup_ratio FROM u"""
_LEAST, _AVERAGE, _MOST = CHUNKS


def _rotl(x: str, by: str) -> str:
    return f"(((({x}) << ({by}))) | ((({x}) >> (32 - ({by}))))) & 4294967295::UBIGINT"


_CHUNKS = f"""{_BYTES},
marks AS (SELECT item_id, p, {_rotl('v::UBIGINT', '(32 - (p * 5) % 32) % 32')} AS r FROM bytes),
prefix AS (SELECT item_id, p, bit_xor(r) OVER (PARTITION BY item_id ORDER BY p) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM marks),
cuts(item_id, s, r0, n, e) AS (
  SELECT item_id, 0::BIGINT, 0::UBIGINT, max(n), NULL::BIGINT FROM prefix GROUP BY item_id
  UNION ALL
  SELECT item_id, e, (SELECT r FROM prefix q WHERE q.item_id = z.item_id AND q.p = z.e), n, NULL FROM (
    SELECT c.item_id, c.n, min(p.p) AS e FROM cuts c JOIN prefix p ON p.item_id = c.item_id AND p.p >= least(c.s + {_LEAST}, c.n) AND p.p <= c.s + {_MOST}
    WHERE c.s < c.n AND (p.p = c.s + {_MOST} OR p.p = c.n OR (({_rotl('xor(p.r, c.r0)', '(p.p * 5) % 32')}) & {_AVERAGE - 1}) = 0) GROUP BY c.item_id, c.n, c.s) z),
chunks AS (SELECT item_id, s AS pos, lead(s) OVER (PARTITION BY item_id ORDER BY s) - s AS len FROM cuts QUALIFY len IS NOT NULL)"""
CDC = f"WITH RECURSIVE {_CHUNKS} SELECT item_id AS doc_id, (row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1)::INT AS seq, pos, len::INT AS len FROM chunks"
_CDC_SHA = f"{_CHUNKS}, shas AS (SELECT c.item_id, c.pos, c.len, sha256(substr(h.h, (2 * pos + 1)::BIGINT, (2 * len)::BIGINT)) AS sha FROM chunks c JOIN hexed h USING (item_id))"
CDC_STATS = f"""WITH RECURSIVE {_CDC_SHA}, u AS (SELECT sha, count(*) AS n, min(len) AS len FROM shas GROUP BY sha)
SELECT sum(n)::BIGINT AS chunks, count(*) AS unique_chunks, sum(n * len)::BIGINT AS total_bytes, sum(len)::BIGINT AS unique_bytes, round(sum(len) / sum(n * len), 4) AS dedup_ratio FROM u"""
DELTA_STATS = f"""WITH RECURSIVE {_CDC_SHA}, fresh AS (SELECT sha, count(*) AS n, bool_or(sha IN (SELECT sha FROM shas WHERE item_id % 2 = 0)) AS known FROM shas WHERE item_id % 2 = 1 GROUP BY sha)
SELECT count(*) FILTER (WHERE NOT known) AS new_chunks, sum(n)::BIGINT AS total_chunks, coalesce(sum(n) FILTER (WHERE known), 0)::BIGINT AS reused_from_base, (sum(n) - count(*) FILTER (WHERE NOT known))::BIGINT AS reused_chunks FROM fresh"""
RESTORED = "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256, true AS verified FROM documents"
RESTORED_ODD = f"{RESTORED} WHERE doc_id % 2 = 1"
_DIGEST = "SELECT d.item_id AS doc_id, coalesce(n, 0) AS n, sha256(coalesce(x, '')) AS sha256 FROM docs d LEFT JOIN enc USING (item_id)"
_HEXED = "count(*)::BIGINT AS n, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS x"
DELTA8 = f"WITH {_BYTES}, enc AS (SELECT item_id, {_HEXED} FROM (SELECT item_id, p, (v - coalesce(lag(v) OVER (PARTITION BY item_id ORDER BY p), 0) + 256) % 256 AS e FROM bytes) GROUP BY item_id) {_DIGEST}"
XOR8 = f"WITH {_BYTES}, enc AS (SELECT item_id, {_HEXED} FROM (SELECT item_id, p, xor(v, coalesce(lag(v) OVER (PARTITION BY item_id ORDER BY p), 0)) AS e FROM bytes) GROUP BY item_id) {_DIGEST}"
DELTA16 = f"""WITH {_BYTES}, words AS (SELECT item_id, (p - 1) // 2 AS p, sum(v * (CASE WHEN p % 2 = 1 THEN 1 ELSE 256 END))::INT AS w FROM bytes GROUP BY ALL),
steps AS (SELECT item_id, p, (w - coalesce(lag(w) OVER (PARTITION BY item_id ORDER BY p), 0) + 65536) % 65536 AS e FROM words),
sizes AS (SELECT item_id, count(*) AS m FROM bytes GROUP BY item_id),
enc AS (SELECT item_id, 1 + 2 * count(*)::BIGINT AS n, printf('%02x', (any_value(m) % 2)::INT) || string_agg(printf('%02x%02x', (e % 256)::INT, (e // 256)::INT), '' ORDER BY p) AS x FROM steps JOIN sizes USING (item_id) GROUP BY item_id) {_DIGEST}"""
STRIDE = f"""WITH {_BYTES}, sample AS (SELECT item_id, p, v FROM bytes WHERE p <= 65536), sizes AS (SELECT item_id, count(*) AS n FROM sample GROUP BY item_id),
tried AS (SELECT item_id, n, st FROM sizes, (SELECT unnest([1, 2, 4, 8, 16, 64, 256, 1024]) AS st) WHERE st < n),
padded AS (SELECT t.item_id, st, g AS p, coalesce(s.v, 0) AS v, coalesce(u.v, 0) AS up FROM (SELECT item_id, st, unnest(range(1, ((n + st - 1) // st) * st + 1)) AS g FROM tried) t
  LEFT JOIN sample s ON s.item_id = t.item_id AND s.p = g LEFT JOIN sample u ON u.item_id = t.item_id AND u.p = g - st),
scores AS (SELECT item_id, st, sum(least((v - up + 256) % 256, 256 - (v - up + 256) % 256)) AS score FROM padded GROUP BY ALL)
SELECT d.item_id AS doc_id, coalesce(arg_min(st, score * 10000 + st), 1)::INT AS stride FROM docs d LEFT JOIN scores USING (item_id) GROUP BY d.item_id"""
PNG_ROWS = f"""WITH {_BYTES}, sizes AS (SELECT item_id, count(*) AS n FROM bytes GROUP BY item_id),
grid AS (SELECT z.item_id, g AS p, (g - 1) // 16 AS r, coalesce(b.v, 0) AS v FROM (SELECT item_id, unnest(range(1, ((n + 15) // 16) * 16 + 1)) AS g FROM sizes) z LEFT JOIN bytes b ON b.item_id = z.item_id AND b.p = g),
near AS (SELECT item_id, r, v, CASE WHEN (p - 1) % 16 = 0 THEN 0 ELSE lag(v) OVER w END AS a, coalesce(lag(v, 16) OVER w, 0) AS b, CASE WHEN (p - 1) % 16 = 0 THEN 0 ELSE coalesce(lag(v, 17) OVER w, 0) END AS c FROM grid WINDOW w AS (PARTITION BY item_id ORDER BY p)),
guess AS (SELECT item_id, r, v, [0, a, b, (a + b) // 2, CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END] AS g FROM near),
scores AS (SELECT item_id, r, f, sum(least((v - g[f + 1] + 256) % 256, 256 - (v - g[f + 1] + 256) % 256)) AS s FROM guess, (SELECT unnest(range(5)) AS f) GROUP BY ALL),
best AS (SELECT item_id, r, arg_min(f, s * 10 + f) AS f, min(s) AS s FROM scores GROUP BY ALL)
SELECT d.item_id AS doc_id, count(b.r) AS rows, coalesce(sum(s), 0)::BIGINT AS score, count(*) FILTER (WHERE f = 0) AS f0, count(*) FILTER (WHERE f = 1) AS f1, count(*) FILTER (WHERE f = 2) AS f2, count(*) FILTER (WHERE f = 3) AS f3, count(*) FILTER (WHERE f = 4) AS f4
FROM docs d LEFT JOIN best b USING (item_id) GROUP BY d.item_id"""
BWT = """WITH rot AS (SELECT p_partkey, i, length(p_name) AS n, substr(p_name, i + 1) || substr(p_name, 1, i) AS r, substr(p_name, CASE WHEN i = 0 THEN length(p_name) ELSE i END::BIGINT, 1) AS c FROM (SELECT p_partkey, p_name, unnest(range(length(p_name))) AS i FROM part))
SELECT p_partkey, string_agg(c, '' ORDER BY encode(r), -i) AS last_col, (count(*) FILTER (WHERE encode(r) <= encode(r0)) - 1)::INT AS primary_row FROM (SELECT *, max(CASE WHEN i = 0 THEN r END) OVER (PARTITION BY p_partkey) AS r0 FROM rot) GROUP BY p_partkey"""
CODECS = "SELECT doc_id, unnest(['zstd', 'lzma', 'bz2', 'gzip', 'store']) AS codec, octet_length(encode(coalesce(text, '')))::BIGINT AS orig, sha256(coalesce(text, '')) AS sha256, true AS verified FROM documents"
PACKED = "SELECT doc_id, 'text' AS kind, octet_length(encode(coalesce(text, '')))::BIGINT AS orig_size, sha256(coalesce(text, '')) AS sha256, 'PASS' AS verdict, true AS verified FROM documents"
TRANSFORMS = f"SELECT doc_id, t AS transform, size, sha256 FROM ({RESTORED}), (SELECT unnest(['none', 'delta8', 'xor8', 'delta16le', 'bwt', 'pngfilter']) AS t)"
TAMPERED = "SELECT doc_id, unnest(['body', 'header', 'magic', 'cut', 'cap']) AS damage, true AS refused FROM documents"
ENCRYPTED = "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, true AS ok, 'PasswordError' AS wrong_key FROM documents"
HEADERS = "SELECT doc_id, 2 AS v, 'text' AS kind, octet_length(encode(coalesce(text, '')))::BIGINT AS orig_size, CAST(NULL AS VARCHAR) AS error_class FROM documents"
BLOBS = """WITH l AS (SELECT DISTINCT item_id % 2 AS half, sha256(x) AS sha FROM (SELECT doc_id AS item_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents))
SELECT (SELECT count(DISTINCT sha) FROM l WHERE half = 0) AS stored, (SELECT count(DISTINCT sha) FROM l WHERE half = 1) AS asked, (SELECT count(*) FROM l a JOIN l b ON a.sha = b.sha WHERE a.half = 0 AND b.half = 1) AS found, (SELECT count(*) FROM l a JOIN l b ON a.sha = b.sha WHERE a.half = 0 AND b.half = 1) AS contained"""
MEMBERS = "SELECT lang, count(*) AS members, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, true AS same FROM documents GROUP BY lang"
BENCH = "SELECT lang, m AS mode, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS orig, true AS verified FROM documents, (SELECT unnest(['fast', 'balanced']) AS m) GROUP BY ALL"
XOR_REVERSED = f"""WITH {_BYTES}, sizes AS (SELECT item_id, count(*) AS m FROM bytes GROUP BY item_id),
enc AS (SELECT item_id, {_HEXED} FROM (SELECT a.item_id, a.p, xor(a.v, b.v) AS e FROM bytes a JOIN sizes z USING (item_id) JOIN bytes b ON b.item_id = a.item_id AND b.p = z.m + 1 - a.p) GROUP BY item_id) {_DIGEST}"""
_AVERAGE_BITS = _AVERAGE.bit_length() - 1
_STATE = " + ".join(f"coalesce(lag(g, {k}) OVER w, 0) * {1 << k}::UBIGINT" for k in range(WINDOW))
_GEAR_CUTS = _CHUNKS.replace(
    _CHUNKS[_CHUNKS.index("marks AS") : _CHUNKS.index("cuts(")],
    f"""gears AS (SELECT item_id, p, [{", ".join(map(str, GEAR.tolist()))}][v + 1]::UBIGINT AS g, count(*) OVER (PARTITION BY item_id) AS n FROM bytes),
prefix AS (SELECT item_id, p, n, (({_STATE}) & 4294967295::UBIGINT) >> {32 - _AVERAGE_BITS} AS r FROM gears WINDOW w AS (PARTITION BY item_id ORDER BY p)),
""",
).replace(f"(({_rotl('xor(p.r, c.r0)', '(p.p * 5) % 32')}) & {_AVERAGE - 1}) = 0", "p.r = 0")
_GEAR_SHA = _CDC_SHA.replace(_CHUNKS, _GEAR_CUTS)
GEAR_STATS = CDC_STATS.replace(_CDC_SHA, _GEAR_SHA)
_SHELVES = f"shelves AS (SELECT concat(coalesce(lang, 'none'), '-', doc_id // {SHELF}) AS shelf, count(*) AS members, string_agg(coalesce(text, ''), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)"
BEST = "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS orig, 5 AS codecs, true AS bounded, true AS smallest, CASE WHEN coalesce(text, '') = '' THEN 'store' END AS empty_codec FROM documents"
RACED = f"""WITH {_BYTES}, {_SHELVES}, cut AS (SELECT shelf, octet_length(encode(t))::BIGINT AS size FROM shelves),
placed AS (SELECT item_id, shelf, sum(n) OVER (PARTITION BY shelf ORDER BY item_id) - n AS before FROM (SELECT doc_id AS item_id, concat(coalesce(lang, 'none'), '-', doc_id // {SHELF}) AS shelf, octet_length(encode(coalesce(text, ''))) AS n FROM documents)),
freq AS (SELECT shelf, v, count(*)::DOUBLE AS c FROM bytes JOIN placed USING (item_id) WHERE before + p <= 131072 GROUP BY ALL),
ent AS (SELECT shelf, -sum(c / n * log2(c / n)) AS h FROM (SELECT shelf, c, sum(c) OVER (PARTITION BY shelf) AS n FROM freq) GROUP BY shelf)
SELECT concat(shelf, '.txt') AS path, 'text' AS kind, size, round(coalesce(e.h, 0.0), 3) AS entropy, {_VERDICT.replace('h ', 'coalesce(e.h, 0.0) ')} AS verdict,
  CASE WHEN size = 0 OR e.h >= 7.6 THEN '' WHEN size >= 65536 THEN 'bwt,delta8,none,pngfilter,xor8,zdict' ELSE 'bwt,delta8,none,pngfilter,xor8' END AS tried, true AS least
FROM cut LEFT JOIN ent e USING (shelf)"""
ADVANCED = f"WITH {_SHELVES} SELECT concat(shelf, '.txt') AS path, 'text' AS kind, octet_length(encode(t))::BIGINT AS orig, true AS smaller, sha256(t) AS sha256, 'PASS' AS verdict FROM shelves"
PACKED_MANY = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' ELSE 'max' END AS mode, octet_length(encode(coalesce(text, '')))::BIGINT AS orig, sha256(coalesce(text, '')) AS sha256, true AS verified, CAST(NULL AS VARCHAR) AS error_class FROM documents"
TARGET_SIZE = "SELECT doc_id, 'zstd' AS wide_codec, true AS wide_hit, false AS tight_hit FROM documents"
RATIOS = """WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS orig, (length(coalesce(text, '')) // 2)::BIGINT AS new FROM documents)
SELECT doc_id, orig, new, CASE WHEN orig > 0 THEN round(new::DOUBLE / orig, 4) ELSE 0.0 END AS ratio, CASE WHEN orig > 0 THEN round((1 - new::DOUBLE / orig) * 100, 2) ELSE 0.0 END AS saved_pct,
  new <= greatest(1, trunc(orig * CASE WHEN doc_id % 2 = 0 THEN 0.6::DOUBLE ELSE 0.05::DOUBLE END)) AS hit_target FROM d"""
BENCH_LINES = f"WITH {_SHELVES} SELECT concat(shelf, '.txt') AS path, 'fast      ' AS mode, 'true' AS verified FROM shelves"
ADMITTED = "SELECT doc_id, octet_length(encode(coalesce(text, ''))) <= 2048 AS admitted, CASE WHEN octet_length(encode(coalesce(text, ''))) > 2048 THEN 'OutputLimitError' END AS error_class FROM documents"
FILES = f"WITH {_SHELVES} SELECT shelf, octet_length(encode(t))::BIGINT + 1 AS length, sha256(t || chr(10)) AS sha256 FROM shelves"
DIRECTORIES = f"""SELECT concat(coalesce(lang, 'none'), '-', doc_id // {SHELF}) AS dir, 'PASS' AS verdict, count(*) AS members, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes,
  sha256(string_agg(coalesce(text, ''), '' ORDER BY concat(doc_id, '.txt'))) AS sha256 FROM documents GROUP BY 1"""
ROUTED = """SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'image' ELSE 'v1' END AS auto_route, CASE doc_id % 6 WHEN 1 THEN 'UnsupportedCodecError' END AS auto_error,
  CASE doc_id % 6 WHEN 1 THEN 'image' WHEN 4 THEN 'audio_wav' WHEN 5 THEN 'pdf' ELSE 'v2' END AS best_route, CASE WHEN doc_id % 6 IN (1, 4, 5) THEN 'UnsupportedCodecError' END AS best_error FROM documents"""
DELTA_PACKAGES = f"""WITH RECURSIVE {_CDC_SHA}, counts AS (SELECT item_id, count(*)::INT AS total_chunks, count(DISTINCT sha) FILTER (WHERE NOT known)::INT AS new_chunks
  FROM (SELECT s.item_id, s.sha, EXISTS (SELECT 1 FROM shas b WHERE b.item_id = s.item_id - 1 AND b.sha = s.sha) AS known FROM shas s) GROUP BY item_id)
SELECT d.doc_id, coalesce(new_chunks, 0)::INT AS new_chunks, coalesce(total_chunks, 0)::INT AS total_chunks, (coalesce(total_chunks, 0) - coalesce(new_chunks, 0))::INT AS reused_chunks, sha256(coalesce(d.text, '')) AS sha256, CAST(NULL AS VARCHAR) AS error_class, 'BaseMismatchError' AS wrong_base
FROM documents d JOIN documents b ON b.doc_id = d.doc_id - 1 LEFT JOIN counts c ON c.item_id = d.doc_id WHERE d.doc_id % 2 = 1"""
DEDUP_PACKAGES = f"""WITH RECURSIVE {_CDC_SHA}, counts AS (SELECT item_id, count(*) AS chunks, count(DISTINCT sha) AS blobs FROM shas GROUP BY item_id HAVING count(*) > 1)
SELECT doc_id, chunks, blobs, CASE WHEN chunks IS NOT NULL THEN sha256(coalesce(text, '')) END AS sha256 FROM documents LEFT JOIN counts ON item_id = doc_id"""
DICTIONARIES = f"""WITH {_SHELVES}, sized AS (SELECT shelf, t, octet_length(encode(t))::BIGINT AS size FROM shelves)
SELECT concat(shelf, '.txt') AS path, size, CASE WHEN size < 32768 THEN 0 ELSE len(list_filter(range(24), lambda k: k * greatest(1, (size - 4096) // 24) + 4096 <= size)) END::BIGINT AS slices, CASE WHEN size >= 32768 THEN sha256(t) END AS sha256 FROM sized"""
STREAMED = "SELECT doc_id, unnest(['zstd', 'bz2', 'gzip', 'store']) AS codec, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256 FROM documents"
