"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op9_url_filter"] = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, max_by(h || q, length(h || q)) AS rule, coalesce(max_by(v, length(h || q)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
GROUP BY page_id, host, path
"""

ORACLES["op7_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(text) + length(role) + 23
    + (length(text || chr(10) || role) - length(regexp_replace(text || chr(10) || role,
      '(<)(\\*(?:\|turn\|>|\|text\|>|\|end\|>|\|endoftext\|>|\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>))|(\[)(\\*(?:INST\]|/INST\]))', '\2\4', 'g'))) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_WORDS = r"list_filter(string_split_regex({0}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"

ORACLES["op4_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(na.n) + any_value(nb.n) - count(*))
), c AS (
  SELECT doc_id AS a, doc_id AS r FROM n
  UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.a AND c.r < l.b
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.r AS component_id FROM n JOIN (SELECT a, min(r) AS r FROM c GROUP BY a) m ON m.a = n.doc_id
"""

ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS p FROM w, range(1, 6) r(m)),
f AS (SELECT lang, p, count(*) AS a FROM grams GROUP BY lang, p HAVING count(*) >= 100),
cuts AS (
  SELECT f.lang, f.p, f.a, n, k, x.a AS l, y.a AS r, ((1000::HUGEINT * f.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1) f
  JOIN total USING (lang) JOIN f x ON x.lang = f.lang AND x.p = f.p[:k] JOIN f y ON y.lang = f.lang AND y.p = f.p[k + 1:]
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, p[i:i + m - 1] AS p, max(a) AS f
  FROM (SELECT *, unnest(range(1, len(p) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(p))) AS m FROM f WHERE len(p) > 2))
  GROUP BY ALL
), kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, p) WHERE coalesce(100 * f < 100 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept
) WHERE rank <= 2000
"""
