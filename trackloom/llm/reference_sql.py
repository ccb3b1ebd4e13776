"""DuckDB SQL for the results of the ``opN_*`` queries."""

from trackloom.llm.license_scan import TEMPLATES, key_place, slack

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOWER_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM words WHERE len(w) >= 13
), hashed AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM windows
), late AS (
  SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first_id FROM hashed) WHERE doc_id > first_id
), gone AS (
  SELECT DISTINCT doc_id, p + unnest(range(0, 13)) AS p FROM late
), removed AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""

OP2 = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), words AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + 12], ' ') AS h, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM item_windows
), places AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS h
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, sizes WHERE len(w) >= n)
), hits AS (
  SELECT places.doc_id, p, places.n, item_id FROM places JOIN item_windows ON places.h = item_windows.h AND places.n = item_windows.n
), hit_words AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT doc_id, p, n, unnest(range(0, n)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, (length(text) + 3) // 4 + 4 AS tokens FROM turns
), marked AS (
  SELECT *, n = 1 AND role = 'system' AS is_system,
    length(regexp_replace(regexp_replace(role, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g'))
    + length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) + 19 AS chars FROM numbered
), halves AS (
  SELECT *, greatest(1024 - 256 - max(CASE WHEN is_system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id), 256) // 2 AS half FROM marked
), bigs AS (
  SELECT *, NOT is_system AND tokens > half AS big FROM halves
), runs AS (
  SELECT *, 2 * sum(CAST(big AS INT)) OVER (PARTITION BY conv_id ORDER BY n) - CAST(big AS INT) AS run FROM bigs
), slots AS (
  SELECT *, CASE WHEN big THEN 0 ELSE floor((sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id, run ORDER BY n) - 1) / half) END AS slot FROM runs
), firsts AS (
  SELECT *, NOT is_system AND NOT coalesce(lag(run) OVER o = run AND lag(slot) OVER o = slot AND NOT lag(is_system) OVER o, false) AS new FROM slots WINDOW o AS (PARTITION BY conv_id ORDER BY n)
), windowed AS (
  SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY conv_id ORDER BY n) AS win FROM firsts
), copies AS (
  SELECT *, greatest(max(win) OVER (PARTITION BY conv_id), 1) AS last_win, row_number() OVER e AS from_end, sum(tokens) OVER e AS tail FROM windowed WINDOW e AS (PARTITION BY conv_id, win ORDER BY n DESC)
), counted AS (
  SELECT *, CASE WHEN is_system THEN last_win WHEN from_end <= 2 AND tail <= 256 AND win < last_win THEN 2 ELSE 1 END AS times FROM copies
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars * times) + 3 * max(last_win) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""

OP5 = r"""
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), parts AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), best AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)
"""

OP6 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {LOWER_WORDS} AS w FROM documents
), k AS (
  SELECT doc_id, array_to_string(w, ' ') AS key, w FROM w WHERE len(w) > 0
), c AS (
  SELECT key, min(doc_id) AS copy_id, any_value(w) AS w FROM k GROUP BY key
), s AS (
  SELECT DISTINCT copy_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT copy_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM c)
), z AS (
  SELECT copy_id, count(*) AS n FROM s GROUP BY copy_id
), met AS (
  SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.copy_id <> b.copy_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM met JOIN z x ON x.copy_id = a JOIN z y ON y.copy_id = b WHERE 5 * met.n >= 4 * (x.n + y.n - met.n)
), r AS (
  SELECT copy_id AS node, copy_id AS low FROM c UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node
), named AS (
  SELECT key, copy_id, (SELECT min(low) FROM r WHERE node = copy_id) AS class_id, (SELECT count(*) FROM l WHERE a = copy_id) AS n_links FROM c
)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(copy_id, w.doc_id) AS copy_id, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN named USING (key)
"""

PLACES = ", ".join(f"('{w}', {k}, '{label}', {len(line.split())}, {i}, {i - key_place(phrase, line)}, {slack(i, phrase, line)})" for k, (label, phrase, line) in enumerate(TEMPLATES) for i, w in enumerate(line.split()))
PARTS = ", ".join(f"('{w}', {k}, {j}, {len(phrase.split())})" for k, (_, phrase, _) in enumerate(TEMPLATES) for j, w in enumerate(phrase.split()))
OP7 = f"""
WITH places_of(word, template, label, size, place, delta, slack) AS (
  VALUES {PLACES}
), parts(word, template, j, n) AS (
  VALUES {PARTS}
), d AS (
  SELECT doc_id, {LOWER_WORDS} AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d
), base AS (
  SELECT a.doc_id, a.i, CASE a.word WHEN 'mit' THEN 'mit' WHEN 'apache' THEN 'apache' ELSE 'gpl' END AS label
  FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.i = a.i + 1 LEFT JOIN p c ON c.doc_id = a.doc_id AND c.i = a.i + 2
  WHERE (a.word IN ('mit', 'apache') AND b.word = 'license') OR (a.word = 'general' AND b.word = 'public' AND c.word = 'license')
), places AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY doc_id
), starts AS (
  SELECT doc_id, template, i - j AS p FROM p JOIN parts USING (word) GROUP BY doc_id, template, i - j, n HAVING count(*) = n
), met AS (
  SELECT s.doc_id, t.label, s.p, t.template, count(DISTINCT t.place) / max(t.size) AS share
  FROM starts s JOIN places_of t ON t.template = s.template JOIN p ON p.doc_id = s.doc_id AND p.word = t.word AND abs(p.i - s.p - t.delta) <= t.slack GROUP BY ALL
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS score FROM met WHERE share >= 0.7 GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(places.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(places.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS score
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP13 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP12 = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""

SQL = {"op12_hard_negatives": OP12, "op13_exact_dedup": OP13, "op6_ngram_join": OP6, "op7_license_scan": OP7, "op3_chat": OP3, "op5_url_filter": OP5, "op2_decontamination": OP2, "op10_substring_dedup": OP10}
