"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from codeatlas.llm import rules

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
OP9 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
  g AS (SELECT doc_id, i, string_agg(x, ' ') OVER r AS g, count(*) OVER r AS n FROM e WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
  f AS (SELECT g, min(doc_id) AS first FROM g WHERE n = 13 GROUP BY g), hit AS (SELECT g.doc_id, g.i FROM g JOIN f USING (g) WHERE n = 13 AND f.first < g.doc_id),
  k AS (SELECT doc_id, x, i, max(h) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) > i - 13 AS out FROM (SELECT e.doc_id, x, e.i, hit.i AS h FROM e LEFT JOIN hit ON e.doc_id = hit.doc_id AND e.i = hit.i))
  SELECT d.doc_id, len(d.w) AS n_words, count(*) FILTER (out) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY k.i) FILTER (NOT coalesce(out, false) AND x IS NOT NULL), '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.w"""

_MARKS = "regexp_extract_all(x, '<!*\\|')"
OP4 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, v.turn, v.role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(role) + len({_MARKS.replace('(x,', '(role,')}) + length(text) + len({_MARKS.replace('(x,', '(text,')}) + length('<|im_start|><|im_sep|><|im_end|>'))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

_PLAIN = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6 = f"""WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_PLAIN} AS w FROM benchmark),
  iw AS (SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g, least(len(w), 13) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
  hit AS (SELECT doc_id, dg.i, dg.n, item FROM dg JOIN iw ON dg.g = iw.g AND dg.n = iw.n), cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
  it AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit WHERE item IS NOT NULL GROUP BY doc_id)
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""

_IS = lambda column, *texts: "(" + " OR ".join(f"{column} = '{t}'" for t in texts) + ")"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(rules.STOP_WORDS))
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_MARK = rules.PUNCTUATION.replace("'", "''")
_COUNT = "(length(t) - length(translate(t, '{}', '')))"
OP12 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_TRIM}) <> '') AS l, row_number() OVER () AS row FROM documents),
  g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
  h AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
  r AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY row),
  c AS (SELECT doc_id, len(w) AS n_words, length(translate(t, {_TRIM}, '')) AS word_chars, {_COUNT.format(rules.SYMBOLS)} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {_COUNT.format('!')} AS n_exclamations,
    {_COUNT.format(_UPPER)} AS n_capitals, {_COUNT.format(_UPPER + _UPPER.lower())} AS n_letters, len(list_filter(w, lambda x: lower(trim(x, '{_MARK}')) IN ({_STOP}))) AS n_stop_words, len(l) AS n_lines,
    len(list_filter(l, lambda x: {_IS(f"substr(ltrim(x, {_TRIM}), 1, 1)", *rules.BULLETS)})) AS n_bullet_lines, len(list_filter(l, lambda x: {" OR ".join(f"ends_with(rtrim(x, {_TRIM}), '{e}')" for e in rules.ELLIPSES)})) AS n_ellipsis_lines FROM d LEFT JOIN r ON d.row = r.row)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rules.verdict_sql()} AS kept FROM c"""

_NEAR = "SELECT row, part, entry, d FROM (SELECT x.row, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d, row_number() OVER (PARTITION BY x.row, x.part ORDER BY sum((x.v - b.v) * (x.v - b.v)), b.entry) AS r FROM x JOIN b{0} b ON x.part = b.part AND x.pos = b.pos GROUP BY x.row, x.part, b.entry) WHERE r = 1"
_ROUNDS = ", ".join(
    f"a{i} AS MATERIALIZED ({_NEAR.format(i)}), b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (SELECT a.part, a.entry, x.pos, ((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM a{i} a JOIN x ON a.row = x.row AND a.part = x.part GROUP BY a.part, a.entry, x.pos) m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"
    for i in range(4)
)
OP11 = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) AS row FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  x AS MATERIALIZED (SELECT row, (i - 1) // (n // 4) AS part, (i - 1) % (n // 4) AS pos, floor(1024 * v::DOUBLE)::BIGINT AS v FROM (SELECT row, len(e) AS n, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM k)),
  b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, pos, v FROM x WHERE row <= 256), {_ROUNDS}, z AS MATERIALIZED ({_NEAR.format(4)}),
  c AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY row),
  s AS (SELECT label, sum(error)::BIGINT AS label_error FROM c JOIN k ON c.row = k.row GROUP BY label)
  SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b4) AS codebooks_sha256 FROM c JOIN k ON c.row = k.row JOIN s ON k.label IS NOT DISTINCT FROM s.label"""

ORACLE_SQL = {"op11_vector_codes": OP11, "op12_quality_rules": OP12, "op4_chat_formatting": OP4, "op6_decontamination": OP6, "op9_recompression_dedup": OP9}
