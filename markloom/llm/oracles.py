"""DuckDB SQL for the queries that SQL can express whole, over whole tables."""

from __future__ import annotations

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _windows(source: str, key: str, length: str) -> str:
    """Windows of ``length`` words of a table (key, ws), with their 1-based starts."""
    return f"""SELECT {key}, k, w.p AS p, w.win AS win FROM (SELECT {key}, {length} AS k,
      unnest(list_transform(range(1, len(ws) - {length} + 2), lambda p: {{'p': p, 'win': array_to_string(ws[p:p + {length} - 1], ' ')}})) AS w FROM {source})"""


ANCHOR_DEDUP = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
  g AS ({_windows("d", "doc_id", "13")}),
  f AS (SELECT win, min(doc_id) AS first_id FROM g GROUP BY win),
  h AS (SELECT g.doc_id, g.p FROM g JOIN f USING (win) WHERE f.first_id < g.doc_id),
  w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
  c AS (SELECT doc_id, p, word, max(CASE WHEN h.p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM w LEFT JOIN h USING (doc_id, p)),
  k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

WINNOW_DECONTAM = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), {_LETTERS}) AS ws FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), {_LETTERS}) AS ws FROM benchmark),
  i AS (SELECT DISTINCT item_id, k, win FROM ({_windows("(SELECT * FROM b WHERE len(ws) >= 13)", "item_id", "13")}
    UNION ALL SELECT item_id, len(ws), 1, array_to_string(ws, ' ') FROM b WHERE len(ws) BETWEEN 1 AND 12)),
  n AS (SELECT DISTINCT k AS size FROM i),
  g AS ({_windows("(SELECT * FROM d, n WHERE len(d.ws) >= n.size)", "doc_id", "size")}),
  h AS (SELECT g.doc_id, g.p, g.k, i.item_id FROM g JOIN i USING (k, win)),
  s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM h GROUP BY doc_id),
  w AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS word FROM h) GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(s.items, '')) AS items_sha256, coalesce(w.n_hit > 0 AND 20 * w.n_hit >= len(d.ws), false) AS contaminated
  FROM d LEFT JOIN w USING (doc_id) LEFT JOIN s USING (doc_id)"""

WARC_SOURCE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS kept FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(kept, page_id) AS refers_to FROM q"""

COLUMNWISE_SUFFIX = """WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
  c AS (SELECT r, 1000 * k AS base, substr(h, 2000 * k + 1, 2398) AS piece FROM (SELECT r, h, unnest(range((len(h) // 2 - 200) // 1000 + 1)) AS k FROM d WHERE len(h) >= 400)),
  g AS (SELECT r, base + q AS p, substr(piece, 2 * q + 1, 400) AS win FROM (SELECT *, unnest(range(least(1000, len(piece) // 2 - 199))) AS q FROM c)),
  f AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
  x AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM g SEMI JOIN f USING (win)),
  y AS (SELECT r, p, sum(CASE WHEN before IS NULL OR p - before > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS island FROM x),
  i AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM y GROUP BY r, island),
  k AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS last FROM i),
  t AS (SELECT k.r, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(substr(h, 2 * last + 1, 2 * (s - last)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM k JOIN d ON d.r = k.r GROUP BY k.r)
  SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t ON t.r = d.r"""

SPELLING_VARIANTS = f"""WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
  r AS (SELECT doc_id, translate(run, {_UPPER}) AS run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE len(run) >= 7 GROUP BY ALL),
  x AS (SELECT run, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r),
  y AS (SELECT run, c, list_transform(range(1, len(x), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(x, i, 1)) - 1) + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1 AS BIGINT)) AS bytes FROM x),
  z AS (SELECT run, c, xor(list_reduce(list_concat([4294967295], bytes), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM y, t),
  v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM z) WHERE len(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
  d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)),
  p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b USING (i, k) WHERE a.word <> b.word UNION SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON d.k = v.word UNION SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON d.k = v.word),
  b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
  f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
  w AS (SELECT word, word AS upto, 0 AS far FROM f UNION ALL SELECT w.word, f.form, far + 1 FROM w JOIN f ON w.upto = f.word WHERE f.form IS NOT NULL)
  SELECT f.word, n, n_near, form, form_n, root FROM f JOIN (SELECT word, arg_max(upto, far) AS root FROM w GROUP BY word) USING (word)"""

_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

RANKED_SEARCH = f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_UPPER}), {_TERMS})) AS term FROM documents),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_UPPER}), {_TERMS})) AS term FROM benchmark),
  d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
  a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
  f AS (SELECT doc_id, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY doc_id, term),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term, docs),
  s AS (SELECT f.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS s FROM f JOIN d USING (doc_id) JOIN w USING (term), a),
  r AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN s USING (term) GROUP BY item_id, doc_id HAVING sum(s) > 0)
  SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 50"""

ORACLE_SQL = {"op11_spelling_variants": SPELLING_VARIANTS, "op13_ranked_search": RANKED_SEARCH, "op8_columnwise_suffix": COLUMNWISE_SUFFIX, "op3_anchor_dedup": ANCHOR_DEDUP, "op4_winnow_decontam": WINNOW_DECONTAM, "op7_warc_source": WARC_SOURCE}
