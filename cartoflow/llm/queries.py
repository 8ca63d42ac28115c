"""The queries that ``__spark_entry__.py`` registers for this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartoflow.llm import decontaminate, infill, licences, lm, mixing, neighbours, quality, simhash, spelling, suffixes, toolcalls, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(_table(spark, sf_dir, "documents"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.turns(_table(spark, sf_dir, "conversations"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(_table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.linked(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64("fp").alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_tool_calls": op6_tool_calls,
    "op7_licences": op7_licences,
    "op8_lm_scores": op8_lm_scores,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_quality_neighbours": op11_quality_neighbours,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_spelling_variants": op13_spelling_variants,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEMPLATES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licences.TEMPLATES)

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {1 + 10 * i}, 10))::UBIGINT >> {35 - 5 * j}) & 31)::INT + 1, 1)" for i in range(4) for j in range(8))

ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, min(page_id) AS first_id FROM rows GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM rows JOIN firsts USING (hex)
""",
    "op2_decontamination": rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest([array_to_string(w[i : i + least(13, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(13, len(w)) + 2)]) AS window_text
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM docs, sizes WHERE len(w) >= size),
found AS (
  SELECT p.doc_id, p.i, p.size, x.item_id FROM (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS window_text FROM places) p
  JOIN windows x ON x.size = p.size AND x.window_text = p.window_text),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id),
matched AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN matched USING (doc_id)
""",
    "op6_tool_calls": r"""
WITH call_rows AS (
  SELECT conv_id || ':' || turn AS id, conv_id || ':' || (turn - 2) AS parent, conv_id, turn, role AS name, text, count(*) AS n_repeats
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS DISTINCT FROM 'assistant' GROUP BY ALL),
answer_rows AS (
  SELECT conv_id || ':' || (turn - 1) AS id, text AS result, count(*) AS n_repeats
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role = 'assistant' GROUP BY ALL),
calls AS (SELECT id, parent, conv_id, turn, min((name, text)) AS c, count(*) AS kinds, sum(n_repeats) AS n_repeats FROM call_rows GROUP BY ALL),
chained AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM calls),
called AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS depth FROM chained),
answers AS (SELECT id, min(result) AS result, count(*) AS answers FROM answer_rows GROUP BY 1),
single AS (
  SELECT coalesce(c.id, a.id) AS id, c.* EXCLUDE (id, c), c[1] AS name, c[2] AS text, c.id IS NOT NULL AS called, a.result,
         CASE WHEN coalesce(kinds, 1) > 1 OR coalesce(answers, 1) > 1 THEN 'conflict' WHEN c.id IS NOT NULL AND a.id IS NOT NULL THEN 'linked' WHEN c.id IS NOT NULL THEN 'unanswered' ELSE 'orphan' END AS status
  FROM called c FULL JOIN answers a ON c.id = a.id),
linked AS (
  SELECT id, name, parent, turn, text, n_repeats, depth, status, called, result FROM single WHERE status <> 'conflict'
  UNION ALL SELECT r.id, r.name, r.parent, r.turn, r.text, r.n_repeats, s.depth, s.status, true, NULL FROM call_rows r JOIN single s ON s.id = r.id AND s.status = 'conflict'
  UNION ALL SELECT r.id, NULL, NULL, NULL, NULL, r.n_repeats, NULL, s.status, false, r.result FROM answer_rows r JOIN single s ON s.id = r.id AND s.status = 'conflict')
SELECT id, name, parent, coalesce(n_repeats, 0)::BIGINT AS n_repeats, depth::BIGINT AS depth, status,
       CASE WHEN called THEN length(coalesce(text, '')) > 0 AND turn >= 0 END AS valid,
       CASE WHEN called THEN concat_ws('; ', CASE WHEN text = '' THEN '$.text: minLength' END, CASE WHEN text IS NULL THEN '$.text: type' END, CASE WHEN turn < 0 THEN '$.turn: minimum' END) END AS errors,
       '{"arguments":' || CASE WHEN called THEN '{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || turn || '}' ELSE 'null' END
         || ',"id":' || to_json(id)::VARCHAR || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS canonical_json
FROM linked
UNION ALL
SELECT NULL, role, NULL, 1, NULL, 'no_id', NULL, NULL,
       '{"conv_id":' || coalesce(conv_id::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}'
FROM conversations WHERE conv_id IS NULL OR turn IS NULL
""",
    "op7_licences": rf"""
WITH templates AS (SELECT row_number() OVER () AS t, licence, w FROM (
  SELECT licence, regexp_extract_all({_LOWER.format("text")}, '[a-z0-9]+') AS w FROM (VALUES {_TEMPLATES}) v(licence, text))),
template_grams AS (SELECT DISTINCT t, licence, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM templates),
template_sizes AS (SELECT t, licence, count(*) AS n FROM template_grams GROUP BY ALL),
lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, text FROM documents),
passages AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS part, unnest(parts) AS passage FROM lines
  UNION ALL SELECT doc_id, 0, text FROM lines WHERE len(parts) > 1),
words AS (SELECT doc_id, part, regexp_extract_all({_LOWER.format("passage")}, '[a-z0-9]+') AS w FROM passages),
grams AS (SELECT DISTINCT doc_id, part, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM words WHERE len(w) > 1),
sized AS (SELECT doc_id, part, count(*) AS n FROM grams GROUP BY ALL),
places AS (
  SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[a-z0-9]+') AS w FROM documents)),
hits AS (
  SELECT DISTINCT d.doc_id, d.p, g.gram, g.t FROM (SELECT doc_id, p, w[p] || ' ' || w[p + 1] AS gram FROM places) d JOIN template_grams g ON g.gram = d.gram),
longs AS (SELECT t, len(w) - 1 AS long FROM templates),
runs AS (
  SELECT a.doc_id, a.p, a.t, any_value(l.long) AS long, count(DISTINCT b.gram) AS shared FROM hits a JOIN longs l ON l.t = a.t
  JOIN hits b ON b.doc_id = a.doc_id AND b.t = a.t AND b.p >= a.p AND b.p < a.p + l.long GROUP BY ALL),
run_dice AS (
  SELECT r.doc_id, NULL::BIGINT AS part, s.licence, 2.0::DOUBLE * shared / (len(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(r.p, least(r.p + long, len(w)))])) + s.n) AS dice
  FROM runs r JOIN template_sizes s ON s.t = r.t JOIN places d ON d.doc_id = r.doc_id AND d.p = r.p WHERE shared >= 0.6 * s.n),
dice AS (
  SELECT * FROM run_dice UNION ALL
  SELECT g.doc_id, g.part, s.licence, 2.0::DOUBLE * count(*) / (p.n + s.n) AS dice
  FROM grams g JOIN template_grams t ON g.gram = t.gram JOIN template_sizes s ON s.t = t.t JOIN sized p ON p.doc_id = g.doc_id AND p.part = g.part
  GROUP BY g.doc_id, g.part, s.t, s.licence, p.n, s.n),
best AS (
  SELECT doc_id, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice, count(DISTINCT part) AS n_passages
  FROM dice WHERE dice >= 0.8 GROUP BY doc_id)
SELECT d.doc_id, b.licence, coalesce(b.dice, 0)::DOUBLE AS dice, coalesce(b.n_passages, 0)::BIGINT AS n_passages
FROM documents d LEFT JOIN best b USING (doc_id)
""",
    "op5_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '<null>')), 1, 15))::BIGINT AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sizes),
ranked AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS budget,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS w_left,
         (3 * coalesce(sum(source_size) OVER before, 0))::BIGINT AS s_before,
         row_number() OVER (ORDER BY source_size / weight, source ASC NULLS LAST) AS rank
  FROM weighted
  WINDOW before AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (
  SELECT rank AS free_rank, budget AS free_budget, s_before AS free_before, w_left AS free_weight FROM ranked
  WHERE NOT (budget - s_before) * weight > 3 * source_size * w_left ORDER BY rank LIMIT 1),
goals AS (
  SELECT source, source_size,
         CASE WHEN free_rank IS NULL OR rank < free_rank THEN (3 * source_size)::DOUBLE
              ELSE (free_budget - free_before) * weight / free_weight END AS target
  FROM ranked LEFT JOIN free ON true),
times AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times FROM goals),
groups AS (
  SELECT source, u, sum(sum(size)) OVER (PARTITION BY source ORDER BY u) AS upto, sum(size) AS group_size FROM docs GROUP BY source, u)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * least(t.times + CASE WHEN 2 * g.upto - g.group_size <= 2 * (t.target - t.times * t.source_size) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM docs d
JOIN times t ON d.source IS NOT DISTINCT FROM t.source
JOIN groups g ON d.source IS NOT DISTINCT FROM g.source AND d.u = g.u
""",
    "op12_fill_in_middle": r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex
  FROM documents),
hashed AS (
  SELECT *, len(t)::BIGINT AS n, [('0x' || substr(hex, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM docs),
formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parted AS (
  SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS p, coalesce(array_to_string(t[a + 1:b], ''), '') AS m, coalesce(array_to_string(t[b + 1:], ''), '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
""",
    # Near words here by what is left of both without one letter, and not by neighbourhoods.
    "op13_spelling_variants": rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
hexed AS (
  SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hex FROM runs WHERE length(run) >= 7),
hashed AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295, [('0x' || substr(hex, 2 * k + 1, 2))::BIGINT FOR k IN range(length(hex) // 2)]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM hexed, crc_table),
results AS MATERIALIZED (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
vocabulary AS MATERIALIZED (SELECT word, count(*)::BIGINT AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
left_out AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS (
  SELECT a.word, b.word AS near FROM left_out a JOIN left_out b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.rest FROM left_out a JOIN vocabulary v ON v.word = a.rest
  UNION SELECT a.rest, a.word FROM left_out a JOIN vocabulary v ON v.word = a.rest),
counted AS (
  SELECT near.word, count(*) AS n_near, arg_min(near, (-v.n, near)) AS best, max(v.n) AS best_n FROM near JOIN vocabulary v ON v.word = near.near GROUP BY near.word),
formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END::BIGINT AS form_n
  FROM vocabulary v LEFT JOIN counted c ON c.word = v.word),
chain AS (
  SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, formed.form, step + 1 FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL),
lasts AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, coalesce(l.root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN lasts l ON l.word = f.word
""",
}
