"""Plain SQL for the operators that SQL can express, over the whole tables."""

from tidewater.llm.quality_rules import MARKS, STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_NEAR = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b AS a, a AS b FROM l),
r AS (SELECT doc_id, doc_id AS comp FROM documents UNION SELECT e.b AS doc_id, r.comp FROM r JOIN e ON e.a = r.doc_id WHERE r.comp < e.b)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(comp) AS component_id, r.doc_id = min(comp) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

_MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 3 AS ceiling, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM p),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
s AS (SELECT source, source_size, CASE WHEN ceiling > level * weight THEN max(CASE WHEN ceiling > level * weight THEN level END) OVER () * weight ELSE CAST(ceiling AS DOUBLE) END AS target FROM f),
k AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target,
  CASE WHEN s.source_size > 0 THEN least(3.0, s.target / s.source_size) ELSE 0.0 END AS rate,
  (('0x' || substr(md5('7:' || coalesce(d.source, chr(0) || 'null')), 1, 8))::UBIGINT % 1024) / 1024.0 AS u,
  length(bin(size)) * 32 + CASE WHEN length(bin(size)) >= 6 THEN (size >> (length(bin(size)) - 6)) & 31 ELSE (size << (6 - length(bin(size)))) & 31 END AS class,
  ('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8))::UBIGINT % 512 AS slot
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slot, size, doc_id) - 1 AS i FROM k)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(least(3, floor(CAST(rate AS DOUBLE) * (i + 1) + CAST(u AS DOUBLE)) - floor(CAST(rate AS DOUBLE) * i + CAST(u AS DOUBLE))) * size AS BIGINT) AS taken FROM r
"""

_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
_MARKS = MARKS.replace("'", "''")
_QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c FROM i),
o AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS own FROM g WHERE c > 1),
v AS (SELECT doc_id, CAST(sum(own) AS BIGINT) AS covered FROM o GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(w, lambda x: lower(trim(x, '{_MARKS}')) IN ({_STOP}))) AS n_stop,
  length(t) - length(translate(t, '!', '')) AS n_bangs FROM t LEFT JOIN v ON v.doc_id = t.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars / n < 1.5 OR word_chars / n > 20.0 OR n_symbols / n > 0.2 OR n_stop / n < 0.05 OR n_bangs / n > 0.3 OR n_dup_lines / greatest(n_lines, 1) > 0.5) AS kept FROM b
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, h, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(s, CAST(k // 4 * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM x
"""

ORACLES: dict[str, str] = {"op4_bbit_minhash": _NEAR, "op5_warc_members": _WARC, "op9_source_mixing": _MIX, "op10_quality_rules": _QUALITY}
