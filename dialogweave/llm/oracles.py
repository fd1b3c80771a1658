"""The queries that SQL can express, as SQL."""

OP2 = """
WITH items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') AS w FROM benchmark
), docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') AS w FROM documents
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM items, unnest(range(1, len(w) - 3)) AS t(i)
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM docs, unnest(range(1, len(w) - 3)) AS t(i)
), sizes AS (
  SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id
)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 80
"""

OP9 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: The table of CRC-32, and the CRC of a list of bytes.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_concat([v], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS t
  FROM range(256) AS r(v)
)"""
_CRC = """xor(list_reduce(list_concat([4294967295], {codes}),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""


def _field(name: str, value: str | None = None) -> str:
    text = f"CAST({value or name} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

OP11 = f"""
WITH RECURSIVE {_CRC_TABLE}, marked AS (
  SELECT doc_id, source, sha256({_LEAF} || {_field("text")}) AS leaf,
    sha256({_LEAF} || {_field("text", "replace(text, chr(10), '')")}) AS cut,
    {_CRC.format(codes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))")} AS crc
  FROM documents, crc_table
), placed AS (
  SELECT doc_id, leaf, CASE WHEN crc % 2 = 0 THEN cut ELSE leaf END AS presented,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS id
  FROM marked
), nodes AS (
  SELECT 0 AS lvl, tree, idx, n, leaf AS d FROM placed
  UNION ALL
  SELECT lvl + 1, tree, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY lvl, tree, idx // 3, n
), tops AS (
  SELECT 0 AS lvl, tree AS idx, (SELECT max(tree) + 1 FROM placed) AS n, d FROM nodes WHERE n = 1
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx))
  FROM tops WHERE n > 1 GROUP BY lvl, idx // 3, n
), lower_steps AS (
  SELECT a.lvl, a.tree, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.lvl = b.lvl AND a.tree = b.tree AND a.idx // 3 = b.idx // 3
  WHERE a.n > 1 GROUP BY a.lvl, a.tree, a.idx
), upper_steps AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3
  WHERE a.n > 1 GROUP BY a.lvl, a.idx
), steps AS (
  SELECT id, l, r, row_number() OVER (PARTITION BY id ORDER BY part, lvl) AS k FROM (
    SELECT id, 0 AS part, lvl, l, r FROM placed p JOIN lower_steps s
      ON p.tree = s.tree AND p.idx // CAST(pow(3, s.lvl) AS BIGINT) = s.idx
    UNION ALL
    SELECT id, 1, lvl, l, r FROM placed p JOIN upper_steps s ON p.tree // CAST(pow(3, s.lvl) AS BIGINT) = s.idx)
), folds AS (
  SELECT id, CAST(0 AS BIGINT) AS k, presented AS d FROM placed
  UNION ALL
  SELECT f.id, s.k, sha256(s.l || f.d || s.r) FROM folds f JOIN steps s ON f.id = s.id AND s.k = f.k + 1
), ends AS (
  SELECT id, arg_max(d, k) AS folded_root FROM folds GROUP BY id
), proofs AS (
  SELECT p.id, sha256(coalesce(string_agg(s.l || s.r, '' ORDER BY s.k), '')) AS proof_sha256
  FROM placed p LEFT JOIN steps s ON p.id = s.id GROUP BY p.id
)
SELECT doc_id, leaf, sub.d AS subroot, root.d AS root, proof_sha256, folded_root, folded_root = root.d AS verified
FROM placed p JOIN ends USING (id) JOIN proofs USING (id)
JOIN nodes sub ON sub.tree = p.tree AND sub.n = 1, (SELECT d FROM tops WHERE n = 1) root
"""

OP12 = r"""
WITH RECURSIVE rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
    ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'),
    ('block', 'net/fr/', 'net', '/fr/')
), cut AS (
  SELECT row_number() OVER () AS id, page_id, html,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT id, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), best AS (
  SELECT id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY id
), judged AS (
  SELECT page_id, host, path, rule, verdict FROM parts LEFT JOIN best USING (id)
), seeds AS (
  SELECT host, count(*) FILTER (verdict = 'allow') > 0.5 * count(*) AS good,
    count(*) FILTER (verdict = 'block') > 0.5 * count(*) AS bad
  FROM judged WHERE host <> '' GROUP BY host
), edges AS (
  SELECT src, dst, count(*) AS links FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html,
      '(?i)\b(?:href|src|action|cite|data)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM parts WHERE host <> '')
  WHERE src <> dst GROUP BY src, dst
), ahead AS (
  SELECT src, dst, 0.85 * links / sum(links) OVER (PARTITION BY src) AS share FROM edges
), back AS (
  SELECT dst AS src, src AS dst, 0.85 * links / sum(links) OVER (PARTITION BY dst) AS share FROM edges
), trusted AS (
  SELECT 0 AS i, host, CAST(0.15 AS DOUBLE) AS m FROM seeds WHERE good
  UNION ALL
  SELECT i + 1, dst, sum(m * share) FROM trusted JOIN ahead ON host = src WHERE i < 20 GROUP BY i, dst
), distrusted AS (
  SELECT 0 AS i, host, CAST(0.15 AS DOUBLE) AS m FROM seeds WHERE bad
  UNION ALL
  SELECT i + 1, dst, sum(m * share) FROM distrusted JOIN back ON host = src WHERE i < 20 GROUP BY i, dst
), blocked AS (
  SELECT host FROM (SELECT host, sum(m) AS d FROM distrusted GROUP BY host)
  LEFT JOIN (SELECT host, sum(m) AS t FROM trusted GROUP BY host) USING (host)
  WHERE d > coalesce(t, 0) * (1 + 1e-9)
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN host IN (FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""

_LETTER_BYTES = """flatten(list_transform(string_split({text}, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))"""

OP13 = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, {_CRC.format(codes=_LETTER_BYTES.format(text="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h
  FROM runs, crc_table
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
    FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT DISTINCT word, length(word) AS size, i, substr(word, 1, i) || substr(word, i + 2) AS short
  FROM words, unnest(range(length(word))) AS r(i)
), pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.short = b.short AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION
  SELECT l.word, w.word FROM less l JOIN words w ON l.short = w.word
  UNION
  SELECT w.word, l.word FROM less l JOIN words w ON l.short = w.word
), best AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS top, max(n) AS top_n
  FROM pairs JOIN words ON word = b GROUP BY a
), forms AS (
  SELECT w.word, CASE WHEN top_n >= 10 * w.n THEN top END AS form, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN top_n >= 10 * w.n THEN top_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walks AS (
  SELECT word, 0 AS i, coalesce(form, word) AS here FROM forms
  UNION ALL
  SELECT w.word, i + 1, f.form FROM walks w JOIN forms f ON w.here = f.word WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT word, arg_max(here, i) AS root FROM walks GROUP BY word) USING (word)
"""

ORACLES = {
    "op2_decontamination": OP2,
    "op9_topk_search": OP9,
    "op11_merkle_manifest": OP11,
    "op12_url_filter": OP12,
    "op13_spelling_variants": OP13,
}
