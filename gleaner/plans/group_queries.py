"""Queries of grouping, ranking, shaping, summaries and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.vectors import cosine
from gleaner.operators import grouping as G
from gleaner.operators import ranking as R
from gleaner.operators import shaping as P
from gleaner.operators import summary as M
from gleaner.operators import topics as C
from gleaner.operators.graph import connected_components
from gleaner.operators.joins import lookup_join
from gleaner.plans.registry import HITS, SCORES, query, sql_tokens, sql_words
from gleaner.plans.search_queries import criteria, files, hits, scores
from gleaner.session import written
from gleaner.sources.tables import read_table

DEFAULTED = ", ".join(
    f"CASE WHEN {c} IS NULL OR isnan({c}){' OR ' + c + ' = -1' if c == 'match_score' else ''} THEN {v} ELSE {c} END AS {c}"
    for c, v in R.DEFAULTS.items()
    if c not in ("table_score", "group_score", "scaled_score")
)
BASE = f"""{HITS}, {SCORES},
b AS (SELECT h.*, c.group_flag, c.criteria_rank, {DEFAULTED} FROM h JOIN criteria c USING (criteria_uid)
  LEFT JOIN (SELECT file_idx, match_idx, match_score, file_score, qnli_score, squad_score, boolq_score, relevancy_score FROM s) USING (file_idx, match_idx)),
d AS (SELECT *, coalesce(trim(answer) <> '', false) AS answered,
  CASE WHEN block_type = 'table' THEN 0.0 ELSE greatest(match_score, 0.2) * boolq_score * squad_score * qnli_score END AS raw_scaled FROM b),
g0 AS (SELECT criteria_uid, file_idx, parent_oid, arg_min(hit_id, struct_pack(a := match_idx, b := hit_id)) AS group_id, arg_min(group_type, struct_pack(a := match_idx, b := hit_id)) AS first_type, count(*) AS group_size
  FROM h GROUP BY ALL),
x AS (SELECT d.*, raw_scaled AS scaled, group_id, group_size FROM d JOIN g0 USING (criteria_uid, file_idx, parent_oid)),
gr AS (SELECT criteria_uid, file_idx, group_id, bool_or(answered) AS any_answer, coalesce(max(scaled) FILTER (answered), max(scaled)) AS group_best FROM x GROUP BY ALL),
rg AS (SELECT criteria_uid, file_idx, group_id, group_best, CAST(row_number() OVER (PARTITION BY criteria_uid, file_idx ORDER BY any_answer DESC, group_best DESC, group_id) AS INT) AS group_rank FROM gr),
y AS (SELECT x.*, group_rank, CAST(row_number() OVER (PARTITION BY x.criteria_uid, x.file_idx, x.group_id ORDER BY oid = parent_oid DESC NULLS LAST,
  CASE WHEN block_type IN ('list_item', 'table', 'header_summary') THEN -match_idx ELSE answered::INT END DESC, scaled DESC, hit_id) AS INT) AS place
  FROM x JOIN rg USING (criteria_uid, file_idx, group_id))"""


def scored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their criterion's flags, their scores (defaults where missing) and the scaled score."""
    own = lookup_join(hits(spark, sf_dir), criteria(spark, sf_dir).select("criteria_uid", "group_flag", "criteria_rank"), "criteria_uid", "hit_id", "inner")
    kept = scores(spark, sf_dir).select("file_idx", "match_idx", "match_score", "file_score", "qnli_score", "squad_score", "boolq_score", "relevancy_score", "raw_match_score")
    defaulted = R.with_default_scores(own.join(kept, ["file_idx", "match_idx"], "left"))
    return defaulted.withColumn("scaled", R.scaled_score(F.coalesce(F.col("block_type") == "table", F.lit(False))))


def ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored hits in the groups of their parents, with the groups' ranks and the places in them."""
    scored = scored_hits(spark, sf_dir)
    joined = scored.join(G.parent_groups(scored).select("hit_id", "group_id", "group_size"), "hit_id")
    return R.ranked_in_groups(joined.join(R.ranked_groups(joined).drop("group_best"), [*R.SCOPE, "group_id"]))


@query(f"""WITH {BASE} SELECT hit_id, file_idx, parent_oid FROM (SELECT *, row_number() OVER (PARTITION BY file_idx, parent_oid
  ORDER BY has_answer DESC NULLS LAST, criteria_rank, squad_score DESC NULLS LAST, boolq_score DESC NULLS LAST, hit_id) AS n FROM b) WHERE n = 1""")
def merge_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merged_by_passage(scored_hits(spark, sf_dir), ["file_idx", "parent_oid"]).select("hit_id", "file_idx", "parent_oid")


@query(f"WITH {BASE} SELECT hit_id, group_id, first_type AS group_type, group_size FROM h JOIN g0 USING (criteria_uid, file_idx, parent_oid)")
def group_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.parent_groups(hits(spark, sf_dir))


SAME = f"""{HITS}, k AS (SELECT hit_id, criteria_uid, file_idx, array_to_string({sql_tokens('answer')}, ' ') AS k FROM h),
q AS (SELECT criteria_uid, file_idx, k, min(hit_id) AS group_id, count(*) AS group_size FROM k WHERE k <> '' GROUP BY ALL HAVING count(*) > 1)"""


@query(f"WITH {SAME} SELECT hit_id, group_id, group_size FROM k JOIN q USING (criteria_uid, file_idx, k)")
def group_same_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.same_answer_groups(hits(spark, sf_dir))


LOCATION = f"""{HITS}, w AS (
  SELECT hit_id, criteria_uid, file_idx, match_idx, block_type, coalesce(header_text, '') AS header, list_distinct({sql_tokens('match_text')}) AS w FROM h WHERE trim(answer) <> ''),
e AS (SELECT least(a.hit_id, b.hit_id) AS a, greatest(a.hit_id, b.hit_id) AS b FROM w a JOIN w b ON a.criteria_uid = b.criteria_uid AND a.file_idx = b.file_idx
  AND a.block_type IS NOT DISTINCT FROM b.block_type AND a.header = b.header AND a.match_idx - b.match_idx BETWEEN 0 AND 3 AND (a.match_idx > b.match_idx OR a.hit_id > b.hit_id)
  WHERE len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)) > 0.5)"""


@query(f"WITH {LOCATION} SELECT * FROM e")
def group_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.location_edges(hits(spark, sf_dir))


@query(f"""WITH {HITS}, k AS (SELECT criteria_uid, file_idx, w, min(hit_id) AS hit_id FROM (SELECT hit_id, criteria_uid, file_idx, list_sort(list_distinct({sql_tokens('answer')})) AS w FROM h) WHERE len(w) > 0 GROUP BY ALL)
SELECT a.hit_id AS a, b.hit_id AS b FROM k a JOIN k b ON a.criteria_uid = b.criteria_uid AND a.file_idx = b.file_idx AND a.hit_id < b.hit_id
WHERE len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)) > 0.6""")
def group_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.similar_edges(hits(spark, sf_dir), 0.6)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT parent_oid AS a, oid AS b FROM matches WHERE parent_oid <> oid), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT node, min(root) AS component FROM r GROUP BY 1""")
def connected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = hits(spark, sf_dir).where("parent_oid <> oid").select(F.col("parent_oid").alias("a"), F.col("oid").alias("b"))
    return connected_components(links)


@query(f"""WITH {BASE}, q AS (SELECT hit_id FROM (SELECT hit_id, count(*) OVER (PARTITION BY criteria_uid, file_idx, array_to_string({sql_tokens('answer')}, ' ')) AS n,
  array_to_string({sql_tokens('answer')}, ' ') AS k FROM h) WHERE k <> '' AND n > 1),
a AS (SELECT criteria_uid, file_idx, bool_or(hit_id IN (SELECT hit_id FROM q)) AS any_same FROM b GROUP BY ALL)
SELECT hit_id, CASE WHEN any_same AND hit_id NOT IN (SELECT hit_id FROM q) THEN 0.9 ELSE 1.0 END AS group_score FROM b JOIN a USING (criteria_uid, file_idx)""")
def group_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored_hits(spark, sf_dir).select("hit_id", *R.SCOPE, "group_score")
    same = G.same_answer_groups(hits(spark, sf_dir)).select("hit_id", F.lit(True).alias("same"))
    marked = own.join(same, "hit_id", "left").withColumn("same", F.coalesce("same", F.lit(False)))
    any_same = marked.groupBy(*R.SCOPE).agg(F.bool_or("same").alias("any_same"))
    return marked.join(any_same, R.SCOPE).select("hit_id", G.down_weighted(F.col("group_score"), F.col("same"), F.col("any_same")).alias("group_score"))


@query()
def all_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grouped(scored_hits(spark, sf_dir))


@query(f"WITH {BASE} SELECT hit_id, raw_scaled AS scaled FROM d")
def scaled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_hits(spark, sf_dir).select("hit_id", "scaled")


@query(f"WITH {BASE} SELECT criteria_uid, file_idx, group_id, group_best, group_rank FROM rg")
def rank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_hits(spark, sf_dir)
    return R.ranked_groups(scored.join(G.parent_groups(scored).select("hit_id", "group_id"), "hit_id"))


@query(f"WITH {BASE} SELECT hit_id, group_id, group_rank, place FROM y")
def rank_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_hits(spark, sf_dir).select("hit_id", "group_id", "group_rank", "place")


@query(f"""WITH {BASE}, z AS (SELECT hit_id, answered AND row_number() OVER (PARTITION BY criteria_uid, file_idx, group_id, lower(trim(answer)) ORDER BY scaled DESC, hit_id) > 1 AS repeated FROM x)
SELECT hit_id, repeated FROM z""")
def answer_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_hits(spark, sf_dir)
    joined = scored.join(G.parent_groups(scored).select("hit_id", "group_id"), "hit_id")
    return R.once_per_answer(joined).select("hit_id", "repeated")


@query(f"""WITH RECURSIVE {BASE}, o AS (SELECT *, row_number() OVER (PARTITION BY criteria_uid, file_idx ORDER BY group_rank, place) AS n FROM y),
c AS (
  SELECT criteria_uid, file_idx, n, group_rank, hit_id, least(scaled, 1.0) AS v0, CASE WHEN 1.0 < scaled THEN greatest(0.0, 0.99) ELSE scaled END AS clamped,
    CASE WHEN 1.0 < scaled THEN greatest(0.0, 0.99) ELSE scaled END AS head FROM o WHERE n = 1
  UNION ALL
  SELECT o.criteria_uid, o.file_idx, o.n, o.group_rank, o.hit_id, 0.0,
    CASE WHEN (CASE WHEN o.group_rank = c.group_rank THEN c.clamped ELSE c.head END) < o.scaled THEN greatest(0.0, (CASE WHEN o.group_rank = c.group_rank THEN c.clamped ELSE c.head END) - 0.01) ELSE o.scaled END,
    CASE WHEN o.group_rank = c.group_rank THEN c.head ELSE
      CASE WHEN c.head < o.scaled THEN greatest(0.0, c.head - 0.01) ELSE o.scaled END END
  FROM c JOIN o ON o.criteria_uid = c.criteria_uid AND o.file_idx = c.file_idx AND o.n = c.n + 1)
SELECT hit_id, clamped FROM c""")
def score_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clamped_scores(ranked_hits(spark, sf_dir)).select("hit_id", "clamped")


@query(f"""WITH {BASE} SELECT criteria_uid, file_idx, group_id, string_agg(trim(answer), '; ' ORDER BY place, hit_id) AS answers
FROM y WHERE block_type = 'list_item' AND answered AND place > 1 GROUP BY ALL""")
def list_answer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.list_answers(ranked_hits(spark, sf_dir))


@query(f"WITH {BASE} SELECT hit_id, CAST(row_number() OVER (PARTITION BY criteria_uid, file_idx ORDER BY group_rank, place, hit_id) AS INT) AS rank FROM y")
def final_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.final_ranks(ranked_hits(spark, sf_dir)).select("hit_id", "rank")


@query(f"""WITH {BASE}, z AS (SELECT criteria_uid, file_idx, bool_or(answered) AS any_answer, max(file_score) AS f, round(max(match_score * relevancy_score), 6) AS m FROM b2 GROUP BY ALL)
SELECT criteria_uid, file_idx, CAST(row_number() OVER (PARTITION BY criteria_uid ORDER BY any_answer DESC, f DESC, m DESC, file_idx) AS INT) AS position FROM z""".replace("FROM b2", "FROM d"))
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.file_order(scored_hits(spark, sf_dir))


TOPICS = ["NUM:money", "NUM:perc", "NUM:period", "bool"]


@query(f"""WITH {HITS}, f AS (SELECT file_idx, expected_answer_type AS topic, hit_id, coalesce(nullif(trim(formatted_answer), ''), trim(answer), '') AS answer
  FROM h JOIN criteria USING (criteria_uid) WHERE expected_answer_type IN ({sql_words(TOPICS)}))
SELECT file_idx, {', '.join(f'''arg_min(answer, hit_id) FILTER (topic = '{t}') AS "{t}"''' for t in TOPICS)} FROM f GROUP BY 1""")
def grid_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = criteria(spark, sf_dir).where(F.col("expected_answer_type").isin(*TOPICS)).select("criteria_uid", F.col("expected_answer_type").alias("topic"))
    rows = lookup_join(hits(spark, sf_dir), kinds, "criteria_uid", "hit_id", "inner")
    facts = rows.select("file_idx", "topic", F.col("hit_id").alias("rank"), P.fact_answer(F.col("formatted_answer"), F.col("answer")).alias("answer"))
    return P.grid(facts, TOPICS)


@query(f"""WITH {BASE}, m AS (SELECT criteria_uid, file_idx, group_id, group_rank, CASE WHEN group_size > 1 THEN 'parent' ELSE 'single' END AS kind,
  list(struct_pack(place := place, hit_id := hit_id, phrase := coalesce(match_text, ''), answer := coalesce(nullif(trim(formatted_answer), ''), trim(answer), '')) ORDER BY place) AS l FROM y GROUP BY ALL)
SELECT criteria_uid, file_idx, group_rank AS rank, l[1].hit_id AS head, len(l) AS members, l[1].answer AS answer,
  CASE WHEN kind = 'parent' THEN array_to_string(list_transform(l[2:], lambda c: CAST(c.hit_id AS VARCHAR)), ',') ELSE '' END AS children FROM m""")
def facts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("group_size") > 1, "parent").otherwise("single")
    facts = P.facts(ranked_hits(spark, sf_dir).withColumn("kind", kind))
    schema = "hit_id long, phrase string, answer string, group_type string, children array<struct<hit_id: long, answer: string>>"
    read = facts.withColumn("f", F.from_json("fact", schema))
    children = F.array_join(F.transform("f.children", lambda c: c["hit_id"].cast("string")), ",")
    return read.select(*R.SCOPE, "rank", F.col("f.hit_id").alias("head"), (F.size("f.children") + 1).cast("long").alias("members"), F.col("f.answer").alias("answer"), children.alias("children"))


CANDIDATES = f"""{BASE}, cr AS (SELECT d.*, coalesce(s.raw_match_score, 0) AS raw FROM d LEFT JOIN s ON d.file_idx = s.file_idx AND d.match_idx = s.match_idx),
ca AS (SELECT *, row_number() OVER (PARTITION BY criteria_uid, file_idx ORDER BY answered DESC, round(boolq_score * squad_score, 6) DESC, raw DESC, hit_id) AS turn FROM cr),
tx AS (SELECT criteria_uid, file_idx, hit_id, turn, concat_ws(': ', nullif(trim(header_text), ''), nullif(trim(match_text), '')) AS t FROM ca WHERE turn <= 25),
ty AS (SELECT criteria_uid, file_idx, hit_id, turn, CASE WHEN regexp_matches(t, '[.!?;:,]$') THEN t ELSE t || '.' END AS text FROM tx WHERE t <> ''),
tz AS (SELECT *, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) OVER (PARTITION BY criteria_uid, file_idx ORDER BY turn) AS used FROM ty)"""


@query(f"WITH {CANDIDATES} SELECT criteria_uid, file_idx, CAST(turn AS INT) AS turn, hit_id, text, CAST(used AS BIGINT) AS used FROM tz WHERE used < 60")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.within_budget(scored_hits(spark, sf_dir), budget=60)


@query(f"WITH {CANDIDATES} SELECT criteria_uid, file_idx, string_agg(text, ' ' ORDER BY turn) AS summary FROM tz WHERE used < 3000 AND turn <= 3 GROUP BY ALL")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.extractive_summary(M.within_budget(scored_hits(spark, sf_dir)))


PHRASES = rf"""ph AS (SELECT DISTINCT unnest(list_filter(list_transform(string_split(array_to_string(list_transform(regexp_extract_all(lower(match_text), '([\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s])'),
  lambda p: CASE WHEN regexp_matches(p, '^[^\p{{L}}\p{{N}}]') OR p IN ({sql_words(T.STOP_WORDS)}) THEN '|' ELSE p END), ' '), '|'), lambda r: trim(r)),
  lambda r: r <> '' AND NOT regexp_matches(r, '^[\p{{N}} ]+$'))) AS phrase FROM matches),
pw AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS word, len(string_split(phrase, ' ')) AS n FROM ph),
ws AS (SELECT word, count(*) AS frequency, CAST(sum(n) AS BIGINT) AS degree FROM pw GROUP BY 1)"""


@query(f"WITH {PHRASES} SELECT * FROM ws")
def rake_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_stats(C.distinct_phrases(read_table(spark, sf_dir, "matches"), "match_text"))


@query(f"WITH {PHRASES} SELECT phrase, round(sum(degree / frequency), 4) AS score FROM pw JOIN ws USING (word) GROUP BY 1")
def rake_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.phrase_scores(written(C.distinct_phrases(read_table(spark, sf_dir, "matches"), "match_text")))


@query("""WITH p AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT label, unnest(range(1, 65)) AS i, v FROM p),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM x GROUP BY ALL) GROUP BY 1),
n AS (SELECT label, vec_id, round(list_cosine_similarity(v, c), 6) AS near FROM p JOIN c USING (label))
SELECT label, arg_min(vec_id, struct_pack(a := -near, b := vec_id)) AS title FROM n GROUP BY 1""")
def cluster_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster_titles(read_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 64)


@query(rf"""WITH w AS (SELECT doc_kind, unnest(list_filter({sql_tokens('text')}, lambda t: t NOT IN ({sql_words(T.STOP_WORDS)}))) AS w FROM documents),
s AS (SELECT doc_kind, CASE WHEN length(w) > 4 THEN regexp_replace(w, '(?:ings|ing|ies|ed|es|s|en|e)$', '') ELSE w END AS word FROM w),
c AS (SELECT doc_kind, word, count(*) AS n FROM s WHERE length(word) > 2 GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_kind ORDER BY n DESC, word) AS INT) AS rank FROM c) WHERE rank <= 3""")
def cluster_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_words(read_table(spark, sf_dir, "documents"), "doc_kind", "text")


@query(rf"""WITH {HITS}, p AS (SELECT block_type, trim(regexp_replace(lower(answer), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS phrase FROM h),
c AS (SELECT block_type, phrase, count(*) AS n FROM p WHERE phrase <> '' GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY block_type ORDER BY n DESC, phrase) AS INT) AS rank FROM c) WHERE rank <= 5""")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster_labels(hits(spark, sf_dir), "block_type", "answer")


@query("""SELECT doc_kind, lower(trim(source)) AS source, lang, count(*) AS members, round(sum(n_chars), 2) AS total, CAST(grouping(doc_kind, source, lang) AS BIGINT) AS level
FROM (SELECT doc_kind, lower(trim(source)) AS source, lang, CAST(n_chars AS DOUBLE) AS n_chars FROM documents) GROUP BY ROLLUP (doc_kind, source, lang)""")
def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_kind", F.lower(F.trim("source")).alias("source"), "lang", F.col("n_chars").cast("double").alias("n_chars"))
    return C.rolled_up(rows, ["doc_kind", "source", "lang"], "n_chars")


@query()
def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the phrases in answers by bisecting k-means."""
    answers = hits(spark, sf_dir).where("answer is not null and trim(answer) <> ''").groupBy(F.lower(F.trim("answer")).alias("phrase")).agg(F.min("hit_id").alias("hit_id"))
    return C.phrase_clusters(answers, "hit_id", "phrase").groupBy("cluster").agg(F.count(F.lit(1)).alias("phrases"))


@query("""SELECT label, count(*) AS members, round(avg(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c)), 4) AS cohesion FROM embeddings JOIN (
SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(embedding AS DOUBLE[])[i]) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1) USING (label) GROUP BY 1""")
def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    near = lookup_join(rows, C.cluster_centres(rows, "label", "embedding", 64), "label", "vec_id", "inner").select("label", cosine(F.col("embedding"), F.col("centre")).alias("near"))
    return near.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("near"), 4).alias("cohesion"))
