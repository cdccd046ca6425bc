"""DuckDB SQL for those operators whose results SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
  one AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
  both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
  link AS (SELECT x, y FROM both_ WHERE 100 * c >= 75 * (nx + ny - c)),
  reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON reach.r = link.x),
  comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)"""

REPEATED_PASSAGES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  placed AS (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM w WHERE len(w) >= 35),
  win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 35], ' ')) AS s FROM placed),
  twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
  gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN twice USING (s), range(35) t(j)),
  each AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM w),
  kept AS (SELECT each.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p GROUP BY each.doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


RECURRING_LINES = rf"""
WITH keyed AS (SELECT doc_id, md5(coalesce(text, '')) AS key, coalesce(text, '') AS text FROM documents),
  texts AS (SELECT DISTINCT key, text FROM keyed),
  raw AS (SELECT key, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM texts),
  tok AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS t FROM raw),
  solid AS (SELECT *, array_to_string(t, ' ') AS template, concat_ws(' ', len(t), t[1], t[2]) AS leaf FROM tok WHERE len(t) > 0),
  exact AS (SELECT template FROM solid GROUP BY template HAVING count(DISTINCT key) >= 10),
  leaves AS (SELECT leaf FROM solid WHERE len(t) >= 6 GROUP BY leaf HAVING count(DISTINCT key) >= 10),
  tall AS (SELECT DISTINCT key, template, leaf, t[3:] AS r, len(t) - 2 AS m, (len(t) - 2) // 4 + 1 AS g FROM solid WHERE len(t) >= 6 AND leaf IN (SELECT leaf FROM leaves) AND template NOT IN (SELECT template FROM exact)),
  cut AS (SELECT *, unnest(range(g)) AS s FROM tall),
  placed AS (SELECT key, template, r, m, s, concat_ws('|', leaf, s, array_to_string(r[s * m // g + 1:(s + 1) * m // g], ' ')) AS node FROM cut),
  nodes AS (SELECT node, count(DISTINCT key) AS n FROM placed GROUP BY node HAVING count(DISTINCT key) >= 10 AND count(DISTINCT template) > 1),
  best AS (SELECT DISTINCT template, first_value(node) OVER (PARTITION BY template ORDER BY n DESC, s) AS node FROM placed JOIN nodes USING (node)),
  members AS (SELECT * FROM placed JOIN best USING (template, node)),
  each AS (SELECT node, template, r, m, count(*) AS docs FROM members GROUP BY ALL),
  token AS (SELECT node, template, m, docs, unnest(r) AS x, unnest(range(m)) AS i FROM each),
  constant AS (SELECT node, i, x, true AS c FROM token GROUP BY node, i, x HAVING sum(docs) >= 10),
  masked AS (SELECT node, template, m, count(c) AS constants, string_agg(CASE WHEN c THEN x ELSE chr(1) END, ' ' ORDER BY i) AS general FROM token LEFT JOIN constant USING (node, i, x) GROUP BY node, template, m),
  fits AS (SELECT * FROM masked WHERE constants >= 0.75 * m),
  general AS (SELECT node, general FROM members JOIN fits USING (node, template) GROUP BY node, general HAVING count(DISTINCT key) >= 10),
  gone AS (SELECT template FROM exact UNION SELECT template FROM fits JOIN general USING (node, general)),
  judged AS (SELECT key, pos, line, len(t) AS n, len(t) > 0 AND array_to_string(t, ' ') IN (SELECT template FROM gone) AS found FROM tok),
  spared AS (SELECT *, 2 * sum(CASE WHEN found THEN n ELSE 0 END) OVER (PARTITION BY key) >= sum(n) OVER (PARTITION BY key) AS spared FROM judged),
  counts AS (SELECT key, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (found AND NOT spared) AS n_dropped, count(*) FILTER (found AND spared) AS n_spared, string_agg(line, chr(10) ORDER BY pos) FILTER (spared OR NOT found) AS text FROM spared GROUP BY key)
SELECT doc_id, n_lines, n_dropped, n_spared, sha256(coalesce(counts.text, '')) AS text_sha256 FROM keyed JOIN counts USING (key)"""

EXACT_COPIES = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)"""

FILTER_AUDIT = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  failed AS (SELECT w.doc_id, part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM w LEFT JOIN labels ON labels.doc_id = w.doc_id),
  f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
  o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  s AS (SELECT filter_order, s AS step, filter_order[s] AS own, filter_order[1:s - 1] AS before FROM o, unnest([1, 2, 3, 4, 5]) t(s)),
  c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM failed GROUP BY ALL),
  x AS (SELECT part, filter_order, step, own, n, good, bad, failed, contains(failed, own) AS hit, failed <> '' AND translate(failed, before, '') <> failed AS earlier FROM c, s),
  r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit AND NOT earlier), 0) AS BIGINT) AS removed,
      CAST(coalesce(sum(n) FILTER (hit AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = own), 0) AS BIGINT) AS unique_fails,
      CAST(coalesce(sum(good) FILTER (hit AND NOT earlier), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (hit AND NOT earlier), 0) AS BIGINT) AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

RESAMPLED = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
  d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'UPPER', 'LOWER'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
  b AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'UPPER', 'LOWER'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS x FROM benchmark),
  each AS (SELECT doc_id, unnest(w) AS x FROM d),
  word AS (SELECT DISTINCT x FROM (SELECT x FROM each UNION ALL SELECT x FROM b)),
  code AS (SELECT x, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, len(hex(encode(x))) // 2 + 1), lambda i: ('0x' || hex(encode(x))[2 * i - 1:2 * i])::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) % 10000 AS k FROM word, crc),
  s AS (SELECT k, count(*) AS s FROM each JOIN code USING (x) GROUP BY k), t AS (SELECT k, count(*) AS t FROM b JOIN code USING (x) GROUP BY k),
  g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (k)),
  weighed AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM each JOIN code USING (x) JOIN g USING (k) GROUP BY doc_id),
  scores AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (doc_id)),
  drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_features >= 20 QUALIFY rank <= 10 * count(*) OVER () // 100)
SELECT scores.*, rank FROM scores LEFT JOIN drawn USING (doc_id)""".replace("UPPER", _UPPER).replace("LOWER", _UPPER.lower())

ORACLES = {
    "op3_minhash_neardup": NEAR_DUPLICATES, "op8_line_templates": RECURRING_LINES, "op10_substring_dedup": REPEATED_PASSAGES,
    "op11_bloom_exact_dedup": EXACT_COPIES, "op12_filter_audit": FILTER_AUDIT, "op13_importance_resampling": RESAMPLED,
}
