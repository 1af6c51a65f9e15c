"""DuckDB SQL of the queries that SQL can express, by plainer methods: joins of equal words, windows, all phrases."""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACES = r"E' \t\n\x0B\f\r'"

_RUNS = r"""WITH crc_steps AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
 hashed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295) AS h
  FROM documents, crc_steps),
 sized AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed),
 periodic AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
 planted AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1 AS INT)]) END AS w FROM periodic),
 words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM planted),
 equal AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
 islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
 stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
 runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
 told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM runs GROUP BY doc_id),
 best AS (SELECT x.* FROM runs x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
 gone AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
 kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM planted d LEFT JOIN told t ON d.doc_id = t.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id"""

_PHRASES = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(translate(coalesce(text, ''), {_LOWER}), E'.,;:!?\n\x0B\f\r\t', repeat(chr(10), 10) || ' '), chr(10))) AS piece FROM documents),
 split AS (SELECT lang, list_filter(string_split(piece, ' '), lambda w: w <> '') AS w FROM pieces),
 ends AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
 phrases AS (SELECT lang, w[i:i + k - 1] AS p FROM ends, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
 f AS (SELECT lang, p, count(*) AS f FROM phrases GROUP BY lang, p),
 total AS (SELECT lang, sum(f) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
 candidates AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1 AND f >= 100),
 cuts AS (SELECT c.lang, c.p, c.a, k, l.f AS l, r.f AS r, n, (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM candidates) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1:] JOIN total t ON t.lang = c.lang),
 scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
 told AS (SELECT *, array_to_string(p, ' ') AS phrase FROM scored),
 free AS (SELECT * FROM told s WHERE NOT EXISTS (SELECT 1 FROM candidates o WHERE o.lang = s.lang AND len(o.p) > len(s.p) AND 100 * o.a >= 100 * s.a AND contains(' ' || array_to_string(o.p, ' ') || ' ', ' ' || s.phrase || ' '))),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""

_LINES = rf"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
 lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM split),
 keyed AS (SELECT *, translate(trim(line, {_SPACES}), {_LOWER}) AS key FROM lines),
 shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
 told AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id < s.last, false) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id"""

SQL = {"op11_periodic_runs": _RUNS, "op12_phrase_collocations": _PHRASES, "op13_line_dedup": _LINES}
