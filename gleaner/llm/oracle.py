"""DuckDB SQL for the pN_ queries that SQL can express over whole tables."""

TERMS = r"""
WITH q AS (SELECT DISTINCT query_id, keywords FROM query_builders),
m AS (SELECT DISTINCT hit_id, match_text FROM matches),
k1 AS (SELECT query_id AS id, unnest(keywords) AS k FROM q),
k2 AS (SELECT id, trim(regexp_replace(lower(nfc_normalize(k)), '[\s\x{00A0}]+', ' ', 'g')) AS k FROM k1 WHERE k IS NOT NULL),
k3 AS (SELECT id, trim(regexp_replace(k, '^not:', '')) AS k FROM k2),
k4 AS (SELECT id, trim(regexp_replace(k, '^["''“”‘’](.*)["''“”‘’]$', '\1')) AS k FROM k3),
t AS (
  SELECT 'keywords' AS field, id, k AS term FROM k4 WHERE k <> ''
  UNION ALL
  SELECT 'match_text', hit_id, unnest(regexp_extract_all(lower(match_text), '\p{L}+')) FROM m),
n AS (SELECT 'keywords' AS field, count(*) AS n, 5 AS pct FROM q UNION ALL SELECT 'match_text', count(*), 28 FROM m),
s AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t GROUP BY ALL),
r AS (
  SELECT field, term, occurrences, records,
    CASE WHEN records <= 2 THEN 'rare' WHEN records * 100 >= n * pct THEN 'common' END AS mark
  FROM s JOIN n USING (field))
"""
TOP = """
WITH s AS (
  SELECT DISTINCT file_idx, match_idx, match_score FROM raw_scores
  WHERE match_score IS NOT NULL AND NOT isnan(match_score) AND match_score <> -1),
r AS (SELECT file_idx, match_idx, match_score, CAST(row_number() OVER (PARTITION BY file_idx ORDER BY match_score DESC, match_idx) AS INTEGER) AS rank FROM s)
"""
RANKS = """
WITH d AS (SELECT DISTINCT criteria_uid, file_idx, match_idx, match_score, sif_score, dpr_score, cross_encoder_score FROM raw_scores),
l AS (
  SELECT criteria_uid, file_idx, match_idx, s, CASE WHEN isnan(v) OR (s = 'match_score' AND v = -1) THEN NULL ELSE v END AS v
  FROM d UNPIVOT INCLUDE NULLS (v FOR s IN (match_score, sif_score, dpr_score, cross_encoder_score))),
a AS (
  SELECT *, rank() OVER (PARTITION BY criteria_uid, s ORDER BY v DESC NULLS LAST)
    + (count(*) OVER (PARTITION BY criteria_uid, s, v) - 1) / 2 AS r FROM l),
n AS (SELECT criteria_uid, count(*) AS n_items FROM d GROUP BY 1),
o AS (
  SELECT criteria_uid, file_idx, match_idx, n_items,
    max(r) FILTER (s = 'match_score' AND v IS NOT NULL) AS match_score_rank,
    max(r) FILTER (s = 'sif_score' AND v IS NOT NULL) AS sif_score_rank,
    max(r) FILTER (s = 'dpr_score' AND v IS NOT NULL) AS dpr_score_rank,
    max(r) FILTER (s = 'cross_encoder_score' AND v IS NOT NULL) AS cross_encoder_score_rank,
    list_sort(list(CASE WHEN v IS NULL THEN 1.0 ELSE r / n_items END)) AS q
  FROM a JOIN n USING (criteria_uid) GROUP BY ALL)
"""
LINKS = r"""
WITH RECURSIVE w AS (
  SELECT hit_id AS id, list_distinct(regexp_extract_all(lower(match_text), '\p{L}+')) AS w
  FROM (SELECT DISTINCT hit_id, match_text FROM matches)),
t AS (SELECT id, w, unnest(w) AS term FROM w WHERE len(w) >= 8),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM t a JOIN t b ON a.term = b.term AND a.id < b.id GROUP BY ALL HAVING count(*) >= 6),
v AS (
  SELECT DISTINCT query_id AS id, CAST(query_sif_embeddings AS DOUBLE[]) AS v FROM query_builders
  WHERE len(query_sif_embeddings) = 64 AND len(list_filter(query_sif_embeddings, lambda x: x IS NULL OR isnan(x))) = 0
    AND len(list_filter(query_sif_embeddings, lambda x: x <> 0)) > 0),
l AS (
  SELECT 'match_text' AS field, a, b FROM o JOIN w x ON x.id = a JOIN w y ON y.id = b WHERE c * 4 >= 3 * (len(x.w) + len(y.w) - c)
  UNION ALL
  SELECT 'query_sif_embeddings', x.id, y.id FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
e AS (SELECT field, a, b FROM l UNION ALL SELECT field, b, a FROM l),
r AS (SELECT DISTINCT field, a AS root, a AS id FROM e UNION SELECT r.field, r.root, e.b FROM r JOIN e ON e.field = r.field AND e.a = r.id),
m AS (SELECT field, id, min(root) AS first FROM r GROUP BY ALL)
"""
#: Representatives are the smallest ids of equal word sets or vectors; density is the copies of a representative and of its neighbours.
DESCRIBED = """,
w2 AS (SELECT 'match_text' AS field, id, list_sort(w)::VARCHAR AS same FROM w WHERE len(w) >= 8 UNION ALL SELECT 'query_sif_embeddings', id, v::VARCHAR FROM v),
p AS (SELECT field, id, min(id) OVER (PARTITION BY field, same) AS rep, count(*) OVER (PARTITION BY field, same) AS weight FROM w2),
n AS (
  SELECT e.field, e.a AS id, sum(y.weight) AS near FROM e JOIN p x ON x.field = e.field AND x.id = e.a AND x.rep = x.id
  JOIN p y ON y.field = e.field AND y.id = e.b AND y.rep = y.id GROUP BY ALL),
d AS (
  SELECT m.field, m.first, m.id, row_number() OVER (PARTITION BY m.field, m.first ORDER BY p.weight + coalesce(n.near, 0) DESC, m.id) AS place
  FROM m JOIN p ON p.field = m.field AND p.id = m.id AND p.rep = p.id LEFT JOIN n ON n.field = m.field AND n.id = m.id),
z AS (SELECT field, first, count(*) AS size FROM m GROUP BY ALL)
SELECT z.field, z.first AS first_id, z.size, list(d.id ORDER BY place) FILTER (place <= 3) AS typical_ids FROM z JOIN d ON d.field = z.field AND d.first = z.first GROUP BY ALL
"""
NEAREST = """
WITH u AS (
  SELECT DISTINCT 'query_sif_embeddings' AS field, query_id, query_sif_embeddings AS v FROM query_builders
  UNION ALL SELECT DISTINCT 'query_dpr_embeddings', query_id, query_dpr_embeddings FROM query_builders),
v AS (
  SELECT field, query_id, CAST(v AS DOUBLE[]) AS v FROM u
  WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (
  SELECT x.field, x.query_id AS a, y.query_id AS b, list_cosine_similarity(x.v, y.v) AS c
  FROM v x JOIN v y ON x.field = y.field AND x.query_id <> y.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY field, a ORDER BY c DESC, b) AS rank FROM c WHERE c >= 0.9)
"""
REPEATED = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i : i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
f AS (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, g) AS first FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at FROM f WHERE i > first),
s AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1),
r AS (
  SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated,
    CASE WHEN len(w) > 0 THEN coalesce(n, 0) / len(w) ELSE 0.0 END AS share
  FROM w LEFT JOIN s USING (doc_id))
"""


LINES = r"""
WITH d AS (SELECT doc_id, trim(lower(coalesce(source, '')), ' ' || chr(160) || chr(9)) AS host, text FROM documents),
l AS (
  SELECT doc_id, host, unnest(list_filter(list_transform(
    regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), lambda x: trim(regexp_replace(lower(x), '[^\p{L}]+', ' ', 'g'))), lambda x: x <> '')) AS line FROM d),
c AS (SELECT *, n * len(string_split(line, ' ')) AS words FROM (SELECT doc_id, host, line, count(*) AS n FROM l GROUP BY ALL)),
g AS (SELECT host, line FROM c GROUP BY ALL HAVING count(*) > 5),
s AS (
  SELECT doc_id, sum(n) AS n_lines, coalesce(sum(n) FILTER (g.line IS NOT NULL), 0) AS n_removed, sum(words) AS n_words, coalesce(sum(words) FILTER (g.line IS NULL), 0) AS kept_words
  FROM c LEFT JOIN g ON c.host = g.host AND c.line = g.line GROUP BY 1),
r AS (
  SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_words, 0)::BIGINT AS n_words,
    coalesce(kept_words, 0)::BIGINT AS kept_words, CASE WHEN n_words > 0 THEN kept_words / n_words ELSE 1.0 END AS kept_share
  FROM (SELECT doc_id FROM d) LEFT JOIN s USING (doc_id))
SELECT *, kept_share < 0.5 AS rejected FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": TERMS + "SELECT field, term, mark FROM r WHERE mark IS NOT NULL",
        "p1_term_statistics": TERMS + "SELECT * FROM r",
        "p2_found": TOP + "SELECT file_idx, match_idx FROM r WHERE rank <= 3",
        "p2_top_matches": TOP + "SELECT * FROM r WHERE rank <= 3",
        "p3_found": LINKS + "SELECT field, first AS first_id, id AS member_id FROM m WHERE id <> first",
        "p3_clusters": LINKS + DESCRIBED,
        "p5_found": NEAREST + "SELECT DISTINCT field, least(a, b) AS query_id_a, greatest(a, b) AS query_id_b FROM r WHERE rank <= 5",
        "p6_found": RANKS
        + """SELECT criteria_uid, file_idx, match_idx FROM o WHERE n_items >= 8 AND
        (coalesce(match_score_rank = 1, false)::INT + coalesce(sif_score_rank = 1, false)::INT
        + coalesce(dpr_score_rank = 1, false)::INT + coalesce(cross_encoder_score_rank = 1, false)::INT) >= 3""",
        "p6_ranking": RANKS
        + """, b AS (SELECT *, q[1] AS a1, 1 - q[1] AS b1, q[2] AS a2, 1 - q[2] AS b2, q[3] AS a3, 1 - q[3] AS b3, q[4] AS a4 FROM o),
        t AS (SELECT *, least(1.0, 4 * least(
          (((4 * a1) * ((b1 * b1) * b1) + (6 * (a1 * a1)) * (b1 * b1)) + (4 * ((a1 * a1) * a1)) * b1) + ((a1 * a1) * a1) * a1,
          ((6 * (a2 * a2)) * (b2 * b2) + (4 * ((a2 * a2) * a2)) * b2) + ((a2 * a2) * a2) * a2,
          (4 * ((a3 * a3) * a3)) * b3 + ((a3 * a3) * a3) * a3, ((a4 * a4) * a4) * a4)) AS rho FROM b)
        SELECT criteria_uid, file_idx, match_idx, n_items, match_score_rank, sif_score_rank, dpr_score_rank, cross_encoder_score_rank, rho,
          row_number() OVER (PARTITION BY criteria_uid ORDER BY rho, file_idx, match_idx) AS position FROM t""",
        "p9_line_frequency": LINES,
        "p9_found": REPEATED + "SELECT doc_id FROM r WHERE n_words > 0 AND n_repeated * 10 >= n_words * 3",
        "p9_repetition": REPEATED + "SELECT * FROM r",
    }
