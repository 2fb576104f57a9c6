"""Queries of field definitions, questions, explanations and unit classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import values as V
from gleaner.operators import fields as D
from gleaner.operators import models as M
from gleaner.operators import scoring as S
from gleaner.operators.context import hierarchy_headers, with_parent
from gleaner.operators.shaping import fact_fields
from gleaner.plans.registry import HITS, SCORES, query, sql_padded, sql_tokens, sql_words
from gleaner.plans.request import passage_columns
from gleaner.plans.search_queries import GRAMS, WORDS, _sql_phrase, _sql_stats, criteria, deliveries, hits, scores, with_criteria

TOPICS = ["NUM:money", "NUM:date", "ORG"]


def rules() -> dict:
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return {
        "amount_known": F.when(filled("formatted_answer"), "yes"),
        "needs_review": F.when(F.coalesce("has_answer", F.lit(False)) & ~filled("answer"), "yes"),
        "page": (F.col("page_idx") + 1).cast("string"),
    }


@query("""SELECT criteria_uid, coalesce(question, '') AS question, coalesce(expected_answer_type, '') AS expected_answer_type, coalesce(group_flag, '') AS group_flag,
coalesce(page_start, -1) AS page_start, coalesce(page_end, -1) AS page_end, coalesce(criteria_rank, -1) AS criteria_rank, coalesce(enable_similar_search, true) AS enable_similar_search,
len(coalesce(templates, [])) AS templates, len(coalesce(headers, [])) AS headers FROM criteria""")
def field_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = ["criteria_uid", "question", "expected_answer_type", "group_flag", "page_start", "page_end", "criteria_rank", "enable_similar_search"]
    whole = D.with_defaults(criteria(spark, sf_dir))
    return whole.select(*plain, F.size("templates").cast("long").alias("templates"), F.size("headers").cast("long").alias("headers"))


_ASKS = r"list_filter(regexp_split_to_array(lower(trim({})), '\s+'), lambda w: w <> '')"
_KINDS = " ".join(rf"WHEN regexp_matches(lower(question), '{rule}') THEN '{kind}'" for kind, rule in M.ANSWER_TYPES)


@query(f"""WITH q AS (SELECT criteria_uid, question, {_ASKS.format("CASE WHEN contains(question, '|') THEN split_part(question, '|', 2) ELSE question END")} AS a, {_ASKS.format('question')} AS b FROM criteria)
SELECT criteria_uid, CASE WHEN len(a) > 1 AND a[1] IN ({sql_words(T.QUESTION_WORDS + T.BOOL_QUESTION_WORDS)}) AND NOT (len(b) > 1 AND b[1] IN ({sql_words(T.BOOL_QUESTION_WORDS)})) THEN CASE {_KINDS} ELSE 'ENTY:other' END ELSE '' END AS kind FROM q""")
def answer_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return criteria(spark, sf_dir).select("criteria_uid", M.answer_type(F.col("question")).alias("kind"))


@query(f"""WITH t AS (SELECT criteria_uid, {sql_tokens('question')} AS w FROM criteria),
c AS (SELECT criteria_uid, array_to_string(list_transform(w, lambda x: CASE WHEN x IN ({sql_words([*T.STOP_WORDS, *T.QUESTION_WORDS, *T.BOOL_QUESTION_WORDS])}) THEN '|' ELSE x END), ' ') AS c FROM t),
r AS (SELECT DISTINCT criteria_uid, unnest(list_filter(list_transform(string_split(c, '|'), lambda x: trim(x)), lambda x: x <> '')) AS r FROM c)
SELECT criteria_uid, r AS keyword, CAST(row_number() OVER (PARTITION BY criteria_uid ORDER BY len(string_split(r, ' ')) DESC, r) AS INTEGER) AS place FROM r""")
def question_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = criteria(spark, sf_dir).select("criteria_uid", F.posexplode(M.question_keywords(F.col("question"))).alias("pos", "keyword"))
    return found.select("criteria_uid", "keyword", (F.col("pos") + 1).alias("place"))


_TERMS = " UNION ALL ".join(
    f"SELECT hit_id, ' {' '.join(g.words)} ' AS term, round({g.weight} * ({_sql_phrase(g.words, 'p', 'len(w)', 'st')}), 4) AS weight FROM p, st" for g in GRAMS
)


@query(f"""WITH {HITS}, t AS (SELECT hit_id, {sql_tokens('match_text')} AS w FROM h), st AS ({_sql_stats(WORDS, 'w')}), p AS (SELECT *, {sql_padded('w')} AS p FROM t),
e AS (SELECT * FROM ({_TERMS}) WHERE weight > 0)
SELECT hit_id, trim(term) AS term, weight FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.hit_id = a.hit_id AND length(b.term) > length(a.term) AND contains(b.term, a.term))""")
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_columns(hits(spark, sf_dir).select("hit_id", "match_text", "header_text"))
    stats = S.field_stats(rows, "tokens", WORDS)
    found = rows.select("hit_id", F.explode(S.explained(F.col("padded"), F.size("tokens"), GRAMS, stats)).alias("e"))
    return found.select("hit_id", "e.term", "e.weight")


_CLASSES = " ".join(f"WHEN list_has_any(w, [{sql_words(units)}]) THEN '{name}'" for name, units in V.UNIT_CLASSES.items())


@query(rf"""WITH {HITS}, w AS (SELECT hit_id, answer, regexp_extract_all(lower(answer), '(\p{{L}}+(?:-\p{{L}}+)*|[%$€£¥])', 1) AS w FROM h WHERE answer IS NOT NULL)
SELECT hit_id, CASE {_CLASSES} END AS unit_class FROM w WHERE regexp_matches(answer, '[0-9]') AND CASE {_CLASSES} END IS NOT NULL""")
def unit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deliveries(spark, sf_dir).where("answer is not null").select("hit_id", V.unit_class(F.col("answer")).alias("unit_class"))
    return found.where("unit_class is not null").distinct()


@query(f"""WITH {HITS} SELECT hit_id, h.criteria_uid, CAST(CASE expected_answer_type WHEN 'NUM:money' THEN 1 WHEN 'NUM:date' THEN 2 WHEN 'ORG' THEN 3 ELSE 4 END AS INTEGER) AS topic_position
FROM h JOIN criteria USING (criteria_uid)""")
def topic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = D.in_task_order(criteria(spark, sf_dir).select("criteria_uid", "expected_answer_type"), "expected_answer_type", TOPICS)
    return deliveries(spark, sf_dir).select("hit_id", "criteria_uid").distinct().join(kinds.select("criteria_uid", "topic_position"), "criteria_uid")


@query(f"""WITH {HITS} SELECT hit_id, 'amount_known' AS field, 'yes' AS value FROM h WHERE trim(coalesce(formatted_answer, '')) <> ''
UNION ALL SELECT hit_id, 'needs_review', 'yes' FROM h WHERE coalesce(has_answer, false) AND trim(coalesce(answer, '')) = ''
UNION ALL SELECT hit_id, 'page', CAST(page_idx + 1 AS VARCHAR) FROM h WHERE page_idx IS NOT NULL""")
def derived_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.derived_fields(deliveries(spark, sf_dir), rules(), ["hit_id"]).distinct()


@query(f"""WITH {HITS}, u AS (SELECT DISTINCT oid, match_text AS parent_text FROM h)
SELECT hit_id, array_to_string([coalesce(parent_text, ''), coalesce(header_text, '')], ' > ') AS path FROM h LEFT JOIN u ON h.parent_oid = u.oid""")
def header_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_parent(hits(spark, sf_dir), hits(spark, sf_dir))
    level = lambda c: F.struct(F.coalesce(c, F.lit("")).alias("block_text"))
    return rows.select("hit_id", F.array_join(hierarchy_headers(F.array(level("header_text"), level("parent_text"))), " > ").alias("path"))


@query(f"""WITH {HITS}, {SCORES}, x AS (SELECT h.hit_id, h.block_type, h.answer, h.formatted_answer, h.match_text, s.* EXCLUDE (file_idx, match_idx, criteria_uid, loaded_at, scored_at), c.question
  FROM h JOIN s USING (file_idx, match_idx, criteria_uid) JOIN criteria c USING (criteria_uid))
SELECT hit_id, match_text AS phrase, coalesce(formatted_answer, answer) AS formatted_answer, question AS criteria_question,
  round(coalesce(CASE WHEN isnan(match_score) THEN NULL ELSE match_score END, 0), 6) AS match_score, round(coalesce(squad_score, 0), 6) AS qa_score,
  round(coalesce(cross_encoder_score, qnli_score, 0), 6) AS retriever_score, round(coalesce(sif_score, 0), 6) AS semantic_score FROM x""")
def fact_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ["file_idx", "match_idx", "criteria_uid"]
    scored = hits(spark, sf_dir).drop("loaded_at").join(scores(spark, sf_dir).drop("loaded_at", "scored_at"), own)
    asked = with_criteria(scored, spark, sf_dir, "question")
    facts = fact_fields(asked, T.is_question(F.coalesce("question", F.lit(""))))
    rounded = [F.round(c, 6).alias(c) for c in ("match_score", "qa_score", "retriever_score", "semantic_score")]
    return facts.select("hit_id", "phrase", "formatted_answer", "criteria_question", *rounded)
