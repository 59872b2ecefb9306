"""SQL equivalents of those queries that SQL can express over whole tables."""

_SPACE = r"[^\x20\x09-\x0D]+"

# Windows of five words are numbered by their place; a word counts if one that holds it recurs.
_QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT r, regexp_extract_all(text, '{_SPACE}') AS ws FROM docs),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM listed),
runs AS (
  SELECT r, pos, w, CASE WHEN lead(w, 4) OVER o IS NOT NULL
    THEN [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] END AS run
  FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
twice AS (SELECT r, run FROM runs WHERE run IS NOT NULL GROUP BY r, run HAVING count(*) > 1),
marked AS (
  SELECT a.r, a.pos, a.w, max(CASE WHEN t.run IS NOT NULL THEN 1 ELSE 0 END) OVER (
    PARTITION BY a.r ORDER BY a.pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit
  FROM runs a LEFT JOIN twice t ON a.r = t.r AND a.run = t.run),
counts AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(hit) AS n_repeat_words,
    count(DISTINCT w) AS n_distinct_words,
    count(*) FILTER (regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')) AS n_lettered,
    count(*) FILTER (regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS n_capitals
  FROM marked GROUP BY r),
lines AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS ls FROM docs),
measured AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
    coalesce(n_distinct_words, 0) AS n_distinct_words, coalesce(n_lettered, 0) AS n_lettered,
    coalesce(n_capitals, 0) AS n_capitals,
    length(regexp_replace(d.text, '[^!?]', '', 'g')) AS n_marks
  FROM docs d JOIN lines USING (r) LEFT JOIN counts USING (r)),
bits AS (
  SELECT *,
    (n_words < 10)::INT AS f0, (100 * n_repeat_words > 20 * n_words)::INT AS f1,
    (10 * n_symbols > n_words)::INT AS f2, (10 * n_capitals > 3 * n_words)::INT AS f3,
    (2 * n_marks > n_words)::INT AS f4, (10 * n_lettered < 7 * n_words)::INT AS f5,
    (100 * n_dup_lines > 40 * n_lines)::INT AS f6,
    (n_words >= 50 AND 10 * n_distinct_words < 3 * n_words)::INT AS f7
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 + f1 > 0 AS base_failed,
  f0 + f1 + f2 + f3 + f4 + f5 + f6 + f7 = 0 AS kept,
  CAST(f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 + 32 * f5 + 64 * f6 + 128 * f7 AS BIGINT) AS failed
FROM bits
"""

_TOP_K = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (
  SELECT row_number() OVER () AS r, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
m AS (SELECT r, doc_id, 75 + (25 * len(ts) * n_docs) // n_terms AS m FROM d, corpus WHERE len(ts) > 0),
scored AS (
  SELECT i.r, item_id, doc_id, m.r AS d,
    CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
      * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM i JOIN tf USING (t) JOIN df USING (t) JOIN m ON m.r = tf.r, corpus GROUP BY ALL),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

# The checksum of an id goes through its digits bit by bit; a tampered leaf is folded level by level.
_MERKLE = """
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, [coalesce(strlen(v) || ':' || v, '-') FOR v IN
      [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text]] AS f,
    coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') AS more,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295::BIGINT) % 7 = 0,
      false) AS bad
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(array_to_string(f, '')) AS leaf,
    CASE WHEN bad THEN sha256(f[1] || f[2] || f[3] || more || f[5]) ELSE sha256(array_to_string(f, '')) END AS claim
  FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
low AS (
  SELECT tree, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2
  FROM low WHERE n > 1 GROUP BY tree, level, idx // 2),
subroots AS (
  SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS top FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, top AS idx, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2
  FROM high WHERE n > 1 GROUP BY level, idx // 2),
roots AS (SELECT level AS top_height, h AS root FROM high WHERE n = 1),
steps AS (
  SELECT p.tree, p.idx, l.level, l.h, (p.idx >> l.level) % 2 AS odd
  FROM placed p JOIN subroots s USING (tree) CROSS JOIN (SELECT unnest(range(64))::INTEGER AS level) v
  LEFT JOIN low l ON l.tree = p.tree AND l.level = v.level AND l.idx = xor(p.idx >> v.level, 1)
  WHERE v.level < s.height AND l.h IS NOT NULL
  UNION ALL
  SELECT p.tree, p.idx, s.height + l.level, l.h, (s.top >> l.level) % 2
  FROM placed p JOIN subroots s USING (tree) JOIN high l ON l.idx = xor(s.top >> l.level, 1)),
proof AS (
  SELECT tree, idx, sha256(string_agg(h, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY tree, idx),
fold AS (
  SELECT p.tree, p.idx, 0 AS level, claim AS h, height + top_height AS height FROM placed p JOIN subroots USING (tree), roots
  UNION ALL
  SELECT f.tree, f.idx, f.level + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN odd = 1 THEN s.h || f.h ELSE f.h || s.h END), height
  FROM fold f LEFT JOIN steps s ON s.tree = f.tree AND s.idx = f.idx AND s.level = f.level WHERE f.level < height)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed p JOIN subroots USING (tree) JOIN fold f ON f.tree = p.tree AND f.idx = p.idx AND f.level = f.height
LEFT JOIN proof x ON x.tree = p.tree AND x.idx = p.idx, roots
"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": _QUALITY,
    "op8_top_k": _TOP_K,
    "op11_reversed_search": _SEARCH,
    "op12_merkle": _MERKLE,
}
