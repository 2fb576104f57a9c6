"""Queries of scans, filters, retrieval scores and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators import filters as X
from gleaner.operators import scoring as S
from gleaner.operators.context import context_window, expand_children, qa_text, with_parent
from gleaner.operators.joins import lookup_join
from gleaner.operators.models import best_per_file, near_words, overlap_score
from gleaner.operators.ranking import top_per_group
from gleaner.plans.registry import HITS, SCORES, query, sql_padded, sql_tokens, sql_words
from gleaner.plans.request import Criteria, Settings, apply, passage_columns
from gleaner.sources.tables import read_table

#: An ad-hoc request.
QUESTION = "What is the loan balance of the annual review"
KEYWORDS = ["loan balance", "purchase price", '"fiscal year" review', "not: penalty"]
HEADERS = ["annual budget", "Item balance", "not:mortgage"]
FILE_FILTER = "lease review | what is the balance"
ACL = ["team_a", "team_b"]
SYNONYMS = {"agreement": ["contract", "accord"], "rent": ["base rent", "rental"], "fee": ["charge", "commission"]}


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches, those delivered twice once."""
    return read_table(spark, sf_dir, "matches").dropDuplicates(["hit_id"])


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as delivered, for filters: what is left is made distinct behind them."""
    return read_table(spark, sf_dir, "matches")


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "criteria")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "files")


def hits_with_criteria(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return with_criteria(hits(spark, sf_dir), spark, sf_dir, *columns)


def with_criteria(rows: DataFrame, spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return lookup_join(rows, criteria(spark, sf_dir).select("criteria_uid", *columns), "criteria_uid", "hit_id", "inner")


@query(f"WITH {HITS} SELECT f.workspace_idx, h.file_idx, h.match_idx, h.oid, h.block_type FROM h JOIN files f USING (file_idx) WHERE f.workspace_idx = 'ws_00'")
def scan_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).where(X.by_value("workspace_idx", "ws_00")).select("file_idx", "workspace_idx")
    rows = deliveries(spark, sf_dir).select("file_idx", "match_idx", "oid", "block_type")
    return lookup_join(rows, own, "file_idx", "oid", "inner").select("workspace_idx", "file_idx", "match_idx", "oid", "block_type").distinct()


@query(f"""WITH {HITS}, t AS (SELECT file_idx, block_type, coalesce(len({sql_tokens('match_text')}), 0) AS n FROM h)
SELECT file_idx, count(*) AS passages, count(*) FILTER (block_type = 'header') AS headers, CAST(sum(n) AS BIGINT) AS words FROM t GROUP BY 1""")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.size(T.tokens(F.col("match_text"))), F.lit(0))
    return hits(spark, sf_dir).groupBy("file_idx").agg(
        F.count(F.lit(1)).alias("passages"), F.count_if(F.col("block_type") == "header").alias("headers"), F.sum(F.greatest(n, F.lit(0))).alias("words")
    )


@query("""SELECT workspace_idx, file_idx, file_name FROM (
SELECT *, row_number() OVER (PARTITION BY workspace_idx ORDER BY file_name, file_idx) AS n FROM files) WHERE n > 10 AND n <= 30""")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("workspace_idx").orderBy("file_name", "file_idx"))
    return files(spark, sf_dir).withColumn("n", n).where("n <= 30").where("n > 10").select("workspace_idx", "file_idx", "file_name")


@query(f"WITH {HITS} SELECT hit_id, file_idx FROM h WHERE file_idx IN (SELECT file_idx FROM files WHERE file_meta['doc_kind'] = 'minutes')")
def filter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = files(spark, sf_dir).where(F.col("file_meta")["doc_kind"] == "minutes")
    return X.by_table(deliveries(spark, sf_dir).select("hit_id", "file_idx"), minutes, "file_idx").distinct()


@query(f"""WITH {HITS}, t AS (SELECT hit_id, {sql_tokens('match_text')} AS w FROM h), p AS (SELECT hit_id, w, {sql_padded('w')} AS p FROM t)
SELECT hit_id FROM p WHERE (list_has_all(w, ['loan', 'balance']) OR list_has_all(w, ['purchase', 'price'])
  OR (list_has_all(w, ['review']) AND contains(p, ' fiscal  year ')))""")
def keyword_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_columns(deliveries(spark, sf_dir))
    return rows.where(X.matches_keywords(F.col("tokens"), F.col("padded"), KEYWORDS[:3])).select("hit_id").distinct()


@query(f"""WITH {HITS}, t AS (SELECT hit_id, {sql_tokens('match_text')} AS w FROM h)
SELECT hit_id FROM t WHERE (list_has_all(w, ['loan', 'balance']) OR list_has_all(w, ['purchase', 'price'])) AND NOT list_has_all(w, ['annual'])""")
def keyword_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_columns(deliveries(spark, sf_dir))
    return rows.where(X.matches_keywords(F.col("tokens"), F.col("padded"), [*KEYWORDS[:2], "not:annual"])).select("hit_id").distinct()


@query(f"""WITH {HITS}, t AS (SELECT hit_id, {sql_padded(sql_tokens('match_text'))} AS p FROM h)
SELECT hit_id, CAST((length(p) - length(replace(p, ' base  rent ', ''))) / 12 AS BIGINT) AS times FROM t WHERE contains(p, ' base  rent ')""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_columns(deliveries(spark, sf_dir)).where(T.has_phrase(F.col("padded"), ["base", "rent"]))
    return rows.select("hit_id", T.phrase_count(F.col("padded"), ["base", "rent"]).cast("long").alias("times")).distinct()


@query(f"""WITH {HITS}, t AS (SELECT hit_id, {sql_tokens('header_text')} AS w FROM h)
SELECT hit_id FROM t WHERE (list_has_all(w, ['annual', 'budget']) OR list_has_all(w, ['item', 'balance'])) AND NOT list_has_all(w, ['mortgage'])""")
def header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_columns(deliveries(spark, sf_dir))
    return rows.where(X.matches_headers([(F.col("header_tokens"), F.col("header_padded"))], HEADERS)).select("hit_id").distinct()


@query(f"WITH {HITS} SELECT hit_id, entity_types FROM h WHERE list_has_any(regexp_split_to_array(entity_types, '\\s+'), ['NUM:money', 'ORG'])")
def entity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir).where(X.has_entity(F.col("entity_types"), ["NUM:money", "ORG"])).select("hit_id", "entity_types").distinct()


@query(f"""WITH {HITS} SELECT h.hit_id, h.page_idx, f.n_pages FROM h JOIN criteria c USING (criteria_uid) JOIN files f USING (file_idx)
WHERE CASE WHEN page_start = -1 AND page_end = -1 THEN true WHEN page_start > 0 AND page_end > 0 THEN coalesce(page_idx BETWEEN page_start - 1 AND page_end - 1, false)
  WHEN page_start < 0 AND page_end < 0 THEN coalesce(page_idx - n_pages BETWEEN page_start AND page_end, false) ELSE true END""")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_criteria(deliveries(spark, sf_dir), spark, sf_dir, "page_start", "page_end")
    paged = lookup_join(rows, files(spark, sf_dir).select("file_idx", "n_pages"), "file_idx", "hit_id", "inner")
    return paged.where(X.in_pages(F.col("page_idx"), F.col("n_pages"), F.col("page_start"), F.col("page_end"))).select("hit_id", "page_idx", "n_pages").distinct()


@query(f"""WITH {HITS} SELECT h.hit_id, h.block_type FROM h JOIN criteria c USING (criteria_uid)
WHERE NOT (coalesce(table_flag, '') = 'disable' AND coalesce(block_type IN ('table', 'table_cell'), false))""")
def table_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_criteria(deliveries(spark, sf_dir), spark, sf_dir, "table_flag")
    return rows.where(X.no_tables(F.col("block_type"), F.col("table_flag"))).select("hit_id", "block_type").distinct()


@query("""SELECT file_idx, 'nobody' AS reader FROM files WHERE permit_list IS NULL
UNION ALL SELECT file_idx, 'teams' FROM files WHERE (permit_list IS NULL OR list_has_any(permit_list, ['team_a', 'team_b'])) AND NOT coalesce(list_has_any(deny_list, ['team_a', 'team_b']), false)""")
def acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = files(spark, sf_dir)
    readable = lambda who, groups: table.where(X.readable(F.col("permit_list"), F.col("deny_list"), groups)).select("file_idx", F.lit(who).alias("reader"))
    return readable("nobody", []).unionByName(readable("teams", ACL))


@query(f"""WITH {HITS}, p AS (SELECT file_idx, max(CAST(list_has_any({sql_tokens('header_text')}, ['lease', 'review']) AS INT)) AS head,
  max(CAST(list_has_any({sql_tokens('match_text')}, ['lease', 'review']) AS INT)) AS body FROM h GROUP BY 1),
f AS (SELECT file_idx, CAST(list_has_any({sql_tokens('file_title')}, ['lease', 'review']) AS INT) AS title FROM files)
SELECT file_idx, 1.5 * coalesce(head, 0) + 2.0 * coalesce(title, 0) + coalesce(body, 0) AS weight FROM f LEFT JOIN p USING (file_idx)
WHERE coalesce(head, 0) + coalesce(title, 0) + coalesce(body, 0) > 0""")
def file_filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*(F.lit(w) for w in T.split_words(Criteria(FILE_FILTER).file_filter)))
    holds = lambda c: F.coalesce(F.arrays_overlap(T.tokens(F.col(c)), wanted), F.lit(False)).cast("int")
    texts = hits(spark, sf_dir).groupBy("file_idx").agg(F.max(holds("header_text")).alias("head"), F.max(holds("match_text")).alias("body"))
    joined = files(spark, sf_dir).select("file_idx", holds("file_title").alias("title")).join(texts, "file_idx", "left").na.fill(0, ["head", "body"])
    weight = F.lit(1.5) * F.col("head") + F.lit(2.0) * F.col("title") + F.col("body")
    return joined.select("file_idx", weight.alias("weight")).where("weight > 0")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The request's vector; here that of vec_id 0."""
    row = read_table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0])


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), v), 4) AS score FROM embeddings, q WHERE list_dot_product(CAST(embedding AS DOUBLE[]), v) >= 0.45""")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = V.thresholded(V.dot(F.col("embedding"), V.literal(_query_vector(spark, sf_dir))), 0.45)
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(score, 4).alias("score")).where("score is not null")


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), v), 4) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(V.dot(F.col("embedding"), V.literal(_query_vector(spark, sf_dir))), 4)
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "label", score.alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(20)


@query(f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_tokens, CAST(coalesce(len(list_distinct(w)), 0) AS BIGINT) AS n_distinct FROM t""")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read_table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    n = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return words.select("doc_id", n(F.col("w")).alias("n_tokens"), n(F.array_distinct("w")).alias("n_distinct"))


@query(f"""WITH {HITS}, t AS (SELECT {sql_tokens('match_text')} AS w FROM h),
g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t WHERE len(w) > 1)
SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).select(F.explode(T.ngrams(T.tokens(F.col("match_text")), 2)).alias("gram"))
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _sql_stats(words: list[str], column: str, table: str = "t") -> str:
    holding = ", ".join(f"count(*) FILTER (list_contains({column}, '{w}')) AS n_{w}" for w in words)
    return f"SELECT count(*) AS n, avg(coalesce(len({column}), 0)) AS mean, {holding} FROM {table}"


def _sql_phrase(words: tuple[str, ...], padded: str, length: str, stats: str) -> str:
    phrase = T.padded_phrase(list(words))
    found = f"((length({padded}) - length(replace({padded}, '{phrase}', ''))) / {len(phrase)})"
    idf = " + ".join(f"ln(1 + ({stats}.n - {stats}.n_{w} + 0.5) / ({stats}.n_{w} + 0.5))" for w in words)
    return f"CASE WHEN {found} > 0 THEN ({idf}) * {found} * 2.2 / ({found} + 1.2 * (0.25 + 0.75 * {length} / {stats}.mean)) ELSE 0 END"


def _sql_ngrams(grams: list[S.Gram], padded: str, length: str, stats: str) -> str:
    return " + ".join(f"{g.weight} * ({_sql_phrase(g.words, padded, length, stats)})" for g in grams)


GRAMS = S.query_grams(QUESTION)
WORDS = sorted({w for g in GRAMS for w in g.words})
SCORED = f"""{HITS}, t AS (SELECT hit_id, file_idx, header_text, {sql_tokens('match_text')} AS w, {sql_tokens('header_text')} AS hw FROM h),
st AS ({_sql_stats(WORDS, 'w')}), p AS (SELECT *, {sql_padded('w')} AS p, {sql_padded('hw')} AS hp FROM t),
r AS (SELECT hit_id, file_idx, {_sql_ngrams(GRAMS, 'p', 'len(w)', 'st')} AS score FROM p, st),
g AS (SELECT hit_id, file_idx, round(score, 4) AS score FROM r WHERE score > 0)"""


def _ngram_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_columns(hits(spark, sf_dir).select("hit_id", "file_idx", "match_text", "header_text"))
    stats = S.field_stats(rows, "tokens", WORDS)
    score = S.ngram_score(F.col("padded"), F.size("tokens"), GRAMS, stats)
    return rows.select("hit_id", "file_idx", score.alias("raw")).where("raw > 0").select("hit_id", "file_idx", F.round("raw", 4).alias("score"))


@query(f"WITH {SCORED} SELECT * FROM g")
def ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram_scored(spark, sf_dir)


@query(f"WITH {SCORED} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file_idx ORDER BY score DESC, hit_id) AS INT) AS rank FROM g) WHERE rank <= 20")
def topk_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(_ngram_scored(spark, sf_dir), ["file_idx"], [F.col("score").desc(), F.col("hit_id")], 20)


@query(f"WITH {SCORED} SELECT * FROM g ORDER BY score DESC, hit_id LIMIT 20 OFFSET 20")
def topk_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram_scored(spark, sf_dir).orderBy(F.col("score").desc(), "hit_id").offset(20).limit(20)


@query(f"""WITH {SCORED}, b AS (SELECT file_idx, max(score) AS best FROM g GROUP BY 1)
SELECT hit_id, round(least(1.0, score / greatest(1.0, best)), 4) AS match_score FROM g JOIN b USING (file_idx)""")
def score_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _ngram_scored(spark, sf_dir)
    best = scored.groupBy("file_idx").agg(F.max("score").alias("best"))
    return lookup_join(scored, best, "file_idx", "hit_id", "inner").select("hit_id", F.round(S.normalised(F.col("score"), F.col("best")), 4).alias("match_score"))


@query(f"""WITH {SCORED}, k AS (SELECT file_idx, round(sum(score), 2) AS file_score, count(*) AS passages FROM g GROUP BY 1)
SELECT * FROM k ORDER BY file_score DESC, file_idx LIMIT 20""")
def file_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ngram_scored(spark, sf_dir).groupBy("file_idx").agg(F.round(F.sum("score"), 2).alias("file_score"), F.count(F.lit(1)).alias("passages"))
    return ranked.orderBy(F.col("file_score").desc(), "file_idx").limit(20)


def _sql_multi() -> str:
    field = lambda w: f"greatest(2.0 * ({_sql_phrase((w,), 'p', 'len(w)', 'st')}), 1.5 * ({_sql_phrase((w,), 'hp', 'len(hw)', 'sh')}))"
    return " + ".join(field(w) for w in WORDS)


@query(f"""WITH {SCORED}, sh AS ({_sql_stats(WORDS, 'hw')}), m AS (SELECT hit_id, {_sql_multi()} AS score FROM (SELECT hit_id, coalesce(w, []) AS w, coalesce(hw, []) AS hw, coalesce(p, '') AS p, coalesce(hp, '') AS hp FROM p), st, sh)
SELECT hit_id, round(score, 4) AS score FROM m WHERE score > 0""")
def multifield_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_columns(hits(spark, sf_dir).select("hit_id", "match_text", "header_text"))
    stats = {name: S.field_stats(rows, c, WORDS) for name, c in (("match", "tokens"), ("header", "header_tokens"))}
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    fields = {"match": (text("padded"), size("tokens"), stats["match"]), "header": (text("header_padded"), size("header_tokens"), stats["header"])}
    score = S.cross_fields(fields, WORDS, S.FIELD_WEIGHTS)
    return rows.select("hit_id", score.alias("raw")).where("raw > 0").select("hit_id", F.round("raw", 4).alias("score"))


HEADER_GRAMS = [S.query_grams(h) for h in ("annual budget", "standard mortgage")]
HEADER_WORDS = sorted({w for gs in HEADER_GRAMS for g in gs for w in g.words})


@query(f"""WITH {HITS}, t AS (SELECT hit_id, {sql_tokens('header_text')} AS hw FROM h WHERE header_text IS NOT NULL), st AS ({_sql_stats(HEADER_WORDS, 'hw')}),
p AS (SELECT *, {sql_padded('hw')} AS p FROM t), r AS (SELECT hit_id, greatest({', '.join(_sql_ngrams(gs, 'p', 'len(hw)', 'st') for gs in HEADER_GRAMS)}) AS score FROM p, st)
SELECT hit_id, round(score, 4) AS score FROM r WHERE score > 0""")
def header_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_columns(hits(spark, sf_dir).where("header_text is not null").select("hit_id", "match_text", "header_text"))
    stats = S.field_stats(rows, "header_tokens", HEADER_WORDS)
    score = S.header_boost([(F.col("header_padded"), F.size("header_tokens"), stats)], ["annual budget", "standard mortgage"])
    return rows.select("hit_id", score.alias("raw")).where("raw > 0").select("hit_id", F.round("raw", 4).alias("score"))


STEM = lambda t: rf"CASE WHEN length({t}) > 4 THEN regexp_replace({t}, '(?:ings|ing|ies|ed|es|s|en|e)$', '') ELSE {t} END"


def _sql_stems(text: str) -> str:
    return f"list_distinct(list_transform({sql_tokens(text)}, lambda x: {STEM('x')}))"


@query(f"""WITH {HITS}, x AS (SELECT hit_id, block_type, coalesce({_sql_stems('match_text')}, []) AS own, unnest(CASE WHEN len(templates) > 0 THEN templates ELSE [NULL] END) AS tpl
  FROM h JOIN criteria USING (criteria_uid)),
y AS (SELECT hit_id, block_type, own, {_sql_stems('tpl')} AS want FROM x),
z AS (SELECT hit_id, block_type, max(CASE WHEN len(want) > 0 THEN len(list_intersect(own, want)) / len(want) ELSE 0 END) AS share FROM y GROUP BY ALL)
SELECT hit_id, round(CASE WHEN block_type = 'table' THEN 0.1 + 0.9 * share ELSE 0.7 + 0.3 * share END, 4) AS relevancy FROM z""")
def relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits_with_criteria(spark, sf_dir, "templates")
    score = S.relevancy(F.coalesce("match_text", F.lit("")), F.coalesce("templates", F.array().cast("array<string>")), F.coalesce(F.col("block_type") == "table", F.lit(False)))
    return rows.select("hit_id", F.round(score, 4).alias("relevancy"))


@query(rf"""WITH {HITS}, p AS (SELECT h.*, q.match_text AS above FROM h LEFT JOIN h q ON h.parent_oid = q.oid)
SELECT hit_id, CASE WHEN block_type = 'table' THEN coalesce(header_text, '')
  WHEN parent_oid <> oid AND coalesce(above, '') <> '' THEN regexp_replace(above, '[.,!?]+$', '') || ': ' || coalesce(match_text, '')
  WHEN coalesce(header_text, '') <> '' THEN header_text || ': ' || coalesce(match_text, '') ELSE coalesce(match_text, '') END AS qa_text FROM p""")
def qa_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hits(spark, sf_dir).select("hit_id", "oid", "parent_oid", "block_type", "header_text", "match_text")
    text = qa_text(F.col("block_type"), F.col("header_text"), F.col("match_text"), F.col("parent_text"), F.coalesce(F.col("parent_oid") != F.col("oid"), F.lit(False)))
    return with_parent(own, own).select("hit_id", text.alias("qa_text"))


@query(f"""WITH {HITS}, x AS (SELECT hit_id, list_distinct({sql_tokens('match_text')}) AS w, {sql_tokens('question')} AS q FROM h JOIN criteria USING (criteria_uid)),
y AS (SELECT hit_id, list_sort(list_filter(list_intersect(w, q), lambda t: t NOT IN ({sql_words(T.STOP_WORDS)}))) AS found FROM x)
SELECT hit_id, array_to_string(found, ' ') AS terms FROM y WHERE len(found) > 0""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits_with_criteria(spark, sf_dir, "question")
    found = F.array_sort(T.without(F.array_intersect(T.tokens(F.col("match_text")), T.tokens(F.col("question"))), T.STOP_WORDS))
    return rows.select("hit_id", found.alias("found")).where("size(found) > 0").select("hit_id", F.array_join("found", " ").alias("terms"))


@query(f"""WITH {HITS}, w AS (SELECT hit_id, file_idx, match_idx, before_context_window AS b, after_context_window AS a FROM h JOIN criteria USING (criteria_uid)),
j AS (SELECT w.hit_id, list(h.match_text ORDER BY h.match_idx) AS t FROM w JOIN h ON h.file_idx = w.file_idx AND h.match_idx BETWEEN w.match_idx - b AND w.match_idx + a
  WHERE h.match_text IS NOT NULL AND h.match_text <> '' GROUP BY 1)
SELECT w.hit_id, coalesce(array_to_string(t, ' '), '') AS context FROM w LEFT JOIN j USING (hit_id)""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits_with_criteria(spark, sf_dir, "before_context_window", "after_context_window").drop("match_text")
    return context_window(rows, hits(spark, sf_dir), "before_context_window", "after_context_window").select("hit_id", "context")


@query(f"""WITH {HITS}, {SCORES}, p AS (SELECT * FROM h JOIN (SELECT file_idx, match_idx, match_score FROM s WHERE match_score IS NOT NULL AND NOT isnan(match_score) AND match_score <> -1) USING (file_idx, match_idx)),
c AS (SELECT c.oid, max(p.match_score) AS up, arg_max(p.oid, struct_pack(a := p.match_score, b := p.oid)) AS via FROM h c JOIN p ON c.parent_oid = p.oid WHERE c.parent_oid <> c.oid AND p.block_type <> 'para' GROUP BY 1)
SELECT coalesce(p.oid, c.oid) AS oid, coalesce(p.match_score, c.up) AS match_score, p.oid IS NOT NULL AS direct, c.via FROM p FULL JOIN c ON p.oid = c.oid""")
def child_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = hits(spark, sf_dir)
    scored = passages.join(scores(spark, sf_dir).select("file_idx", "match_idx", "match_score"), ["file_idx", "match_idx"])
    direct = scored.where("match_score is not null and not isnan(match_score) and match_score <> -1")
    return expand_children(direct, passages, "match_score")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "raw_scores").dropDuplicates(["file_idx", "match_idx", "criteria_uid"])


@query(f"""WITH {SCORES}, r AS (SELECT file_idx, match_idx, cross_encoder_score, row_number() OVER (PARTITION BY file_idx ORDER BY cross_encoder_score DESC NULLS LAST, match_idx) AS n FROM s)
SELECT file_idx, match_idx, n <= 5 AS has_answer, round(1 / (1 + exp(-cross_encoder_score / 4)), 4) AS score FROM r""")
def rerank_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).select("file_idx", "match_idx", "cross_encoder_score")
    best = best_per_file(rows, ["file_idx"], "cross_encoder_score", ["match_idx"])
    return best.select("file_idx", "match_idx", "has_answer", F.round(V.sigmoid(F.col("cross_encoder_score")), 4).alias("score"))


@query(f"""WITH {HITS}, x AS (SELECT hit_id, coalesce(list_distinct({sql_tokens('match_text')}), []) AS w,
  list_distinct(list_filter({sql_tokens('question')}, lambda t: t NOT IN ({sql_words(T.STOP_WORDS)}))) AS q FROM h JOIN criteria USING (criteria_uid))
SELECT hit_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(w, q)) / len(q) ELSE 0 END, 4) AS score FROM x""")
def model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits_with_criteria(spark, sf_dir, "question")
    return rows.select("hit_id", F.round(overlap_score(F.coalesce("question", F.lit("")), F.coalesce("match_text", F.lit(""))), 4).alias("score"))


def _sql_grams(source: str, name: str) -> str:
    return f"""SELECT DISTINCT w AS {name}, unnest(list_distinct(list_transform(range(1, length(w) + 1), lambda i: substring('^' || w || '$', i, 3)))) AS gram FROM {source} WHERE length(w) >= 3"""


@query(f"""WITH w AS (SELECT DISTINCT unnest({sql_tokens('match_text')}) AS w FROM matches), q AS (SELECT DISTINCT unnest({sql_tokens('question')}) AS w FROM criteria),
a AS ({_sql_grams('w', 'word')}), b AS ({_sql_grams('q', 'asked')}), an AS (SELECT word, count(*) AS n FROM a GROUP BY 1), bn AS (SELECT asked, count(*) AS n FROM b GROUP BY 1),
p AS (SELECT word, asked, count(*) AS c FROM a JOIN b USING (gram) WHERE word <> asked GROUP BY ALL)
SELECT word, asked, round(2 * c / (an.n + bn.n), 4) AS similarity FROM p JOIN an USING (word) JOIN bn USING (asked) WHERE round(2 * c / (an.n + bn.n), 4) >= 0.6""")
def semantic_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda df, c: df.select(F.explode(T.tokens(F.col(c))).alias("word"))
    return near_words(words(read_table(spark, sf_dir, "matches"), "match_text"), words(criteria(spark, sf_dir), "question"))


@query(f"""WITH {HITS} SELECT hit_id, 2.0 * (len(list_filter(['NUM:money', 'ORG'], lambda t: list_contains(regexp_split_to_array(entity_types, '\\s+'), t)))) AS score FROM h WHERE list_has_any(regexp_split_to_array(entity_types, '\\s+'), ['NUM:money', 'ORG'])""")
def answer_type_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir).select("hit_id", S.entity_clause(F.col("entity_types"), ["NUM:money", "ORG"]).alias("score")).where("score > 0").distinct()


@query()
def ranked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline for one ad-hoc request of two criteria."""
    asked = [
        Criteria(question="What is the loan balance?", keywords=["loan balance", "base rent"], templates=["loan balance was"], expected_answer_type="NUM:money"),
        Criteria(question="what is the notice term", templates=["notice term reached"], expected_answer_type="NUM:period"),
    ]
    ranked = apply(hits(spark, sf_dir), files(spark, sf_dir), asked, Settings())
    return ranked.select("criteria_uid", "file_idx", "rank", "hit_id", "group_id", "kind", "answer", "formatted_answer", F.round("final_score", 6).alias("final_score"))
