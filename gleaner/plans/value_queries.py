"""Queries of request preparation, values in answers, and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import values as V
from gleaner.operators import filters as X
from gleaner.operators import tables as B
from gleaner.operators.joins import lookup_join
from gleaner.operators.units import common_quantities
from gleaner.plans.registry import HITS, SCORES, query, sql_tokens, sql_words
from gleaner.plans.search_queries import SYNONYMS, criteria, hits, hits_with_criteria, scores
from gleaner.sources.tables import read_table

ASKING = sql_words(T.QUESTION_WORDS + T.BOOL_QUESTION_WORDS)
YES_NO = sql_words(T.BOOL_QUESTION_WORDS)


def _sql_spaced(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(trim({text})), '\s+'), lambda w: w <> '')"


@query(rf"""WITH q AS (SELECT criteria_uid, {_sql_spaced("CASE WHEN contains(question, '|') THEN split_part(question, '|', 2) ELSE question END")} AS a, {_sql_spaced('question')} AS b FROM criteria)
SELECT criteria_uid, coalesce(len(a) > 1 AND a[1] IN ({ASKING}), false) AS is_question, coalesce(len(b) > 1 AND b[1] IN ({YES_NO}), false) AS is_bool_question FROM q""")
def classify_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = F.col("question")
    return criteria(spark, sf_dir).select("criteria_uid", T.is_question(question).alias("is_question"), T.is_bool_question(question).alias("is_bool_question"))


@query(rf"""WITH q AS (SELECT criteria_uid, list_filter(regexp_split_to_array(regexp_replace(lower(question), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w <> '') AS w FROM criteria)
SELECT criteria_uid, array_to_string(list_filter(w, lambda t: t NOT IN ({sql_words(T.STOP_WORDS)}, {ASKING})), ' ') AS keyword_text FROM q""")
def keyword_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return criteria(spark, sf_dir).select("criteria_uid", T.keyword_text(F.col("question")).alias("keyword_text"))


@query(r"""SELECT criteria_uid, lower(trim(split_part(question, '|', -1))) AS question, CASE WHEN trim(question) LIKE '%?' THEN trim(question) ELSE trim(question) || '?' END AS asked,
regexp_replace(trim(question), '\?+$', '') AS unasked, len(list_filter(coalesce(templates, []), lambda t: trim(t) <> '')) AS n_templates,
nullif(page_start, -1) AS page_start, nullif(criteria_rank, -1) AS criteria_rank FROM criteria""")
def normalize_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.element_at(F.split("question", r"\|"), -1)
    unset = lambda c: F.nullif(F.col(c), F.lit(-1)).alias(c)
    filled = F.filter(F.coalesce("templates", F.array().cast("array<string>")), lambda t: F.trim(t) != "")
    return criteria(spark, sf_dir).select(
        "criteria_uid", F.lower(F.trim(last)).alias("question"), T.make_question(F.col("question")).alias("asked"), T.remove_question_mark(F.col("question")).alias("unasked"),
        F.size(filled).cast("long").alias("n_templates"), unset("page_start"), unset("criteria_rank"),
    )


@query(r"""WITH k AS (SELECT DISTINCT unnest(keywords) AS k FROM query_builders), t AS (SELECT k, translate(k, '“”', '""') AS p FROM k WHERE k IS NOT NULL),
s AS (SELECT k, regexp_extract_all(p, '"([^"]+)"', 1) AS q, list_filter(regexp_split_to_array(lower(trim(k)), '\s+'), lambda w: w <> '') AS w FROM t)
SELECT k AS keyword, array_to_string(list_filter(CASE WHEN len(q) > 0 THEN q ELSE w END, lambda x: len(string_split(x, ' ')) < 5), '/') AS parts FROM s""")
def extract_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "query_builders").select(F.explode("keywords").alias("keyword")).where("keyword is not null").distinct()
    return raw.select("keyword", F.array_join(T.keywords_of(F.col("keyword")), "/").alias("parts"))


VARIANTS = [("contract", "agreement"), ("commission", "fee"), ("base rent", "rent"), ("accord", "agreement"), ("charge", "fee"), ("rental", "rent")]


def _sql_replaced(text: str) -> str:
    for variant, key in sorted(VARIANTS, key=lambda x: (-len(x[0]), x[0])):
        # two passes, since a separator can stand between two variants
        for _ in range(2):
            text = rf"regexp_replace({text}, '(?i)(^|[^\p{{L}}\p{{N}}_-]){variant}($|[^\p{{L}}\p{{N}}_-])', '\1{key}\2', 'g')"
    return text


@query(f"WITH {HITS} SELECT hit_id, {_sql_replaced('match_text')} AS text FROM h WHERE match_text IS NOT NULL")
def synonym_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).where("match_text is not null").select("hit_id", T.canonical_synonyms(F.col("match_text"), SYNONYMS).alias("text"))


@query(r"""WITH q AS (SELECT criteria_uid, question, CASE WHEN regexp_matches(question, '(?i)(^|[^\p{L}\p{N}_-])agreement($|[^\p{L}\p{N}_-])') THEN 'agreement'
  WHEN regexp_matches(question, '(?i)(^|[^\p{L}\p{N}_-])contract($|[^\p{L}\p{N}_-])') THEN 'contract' WHEN regexp_matches(question, '(?i)(^|[^\p{L}\p{N}_-])accord($|[^\p{L}\p{N}_-])') THEN 'accord' END AS m FROM criteria WHERE question IS NOT NULL),
v AS (SELECT criteria_uid, question, m, unnest(['agreement', 'contract', 'accord']) AS new FROM q)
SELECT DISTINCT criteria_uid, CASE WHEN m IS NULL THEN question ELSE regexp_replace(question, '(?i)(^|[^\p{L}\p{N}_-])' || m || '($|[^\p{L}\p{N}_-])', '\1' || new || '\2', 'g') END AS variant FROM v""")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = T.synonym_variants(F.col("question"), "agreement", SYNONYMS["agreement"])
    return criteria(spark, sf_dir).where("question is not null").select("criteria_uid", F.explode(variants).alias("variant"))


def _sql_currency(text: str) -> str:
    codes = V.symbol_codes() | {c.lower(): c for c in V.CURRENCIES}
    signs = sorted((s for s in codes if not s.isalpha()), key=lambda s: (-len(s), s))
    names = sorted((s for s in codes if s.isalpha()), key=lambda s: (-len(s), s))
    quoted = "|".join(s.replace("$", r"\$").replace(".", r"\.") for s in signs)
    before = rf"regexp_extract(lower({text}), '({quoted}|\b(?:{'|'.join(c.lower() for c in V.CURRENCIES)}))\s?\d', 1)"
    behind = rf"regexp_extract(lower({text}), '\d[\d.,]*\s?(?:(?:thousand|million|billion|k|m|bn)\s)?({'|'.join(names)})\b', 1)"
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in codes.items()) + "}"
    return f"{table}[coalesce(nullif({before}, ''), {behind})]"


@query(f"WITH {HITS} SELECT hit_id, coalesce({_sql_currency('answer')}, {_sql_currency('match_text')}) AS currency FROM h WHERE coalesce({_sql_currency('answer')}, {_sql_currency('match_text')}) IS NOT NULL")
def currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.coalesce(V.currency(F.col("answer")), V.currency(F.col("match_text")))
    return hits(spark, sf_dir).select("hit_id", code.alias("currency")).where("currency is not null")


SCALE_SQL = "CASE " + " ".join(rf"WHEN regexp_matches(lower(answer), '\d\s?{e}\b') THEN '{n}'" for n, e in V.SCALE_ENDINGS) + " END"
CONTEXT_SQL = "CASE " + " ".join(f"WHEN contains(lower(coalesce(header_text, '')), 'in {n}') THEN {V.SCALE_FACTORS[n]}" for n in ("billion", "million", "thousand", "hundred")) + " ELSE 1 END"
NUMBER_SQL = r"TRY_CAST(nullif(replace(regexp_extract({}, '(-?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|-?\d+(?:\.\d+)?)', 1), ',', ''), '') AS DOUBLE)"


@query(f"""WITH {HITS}, x AS (SELECT hit_id, answer, {SCALE_SQL} AS scale, CAST({CONTEXT_SQL} AS BIGINT) AS context, {NUMBER_SQL.format('answer')} AS n FROM h WHERE answer IS NOT NULL)
SELECT hit_id, scale, context, round(n * coalesce(CASE scale {' '.join(f"WHEN '{k}' THEN {float(v)}" for k, v in V.SCALE_FACTORS.items())} END, context), 6) AS amount FROM x""")
def money_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.coalesce("header_text", F.lit(""))
    return hits(spark, sf_dir).where("answer is not null").select(
        "hit_id", V.scale_of(F.col("answer")).alias("scale"), V.context_factor(header).alias("context"), F.round(V.money_amount(F.col("answer"), header), 6).alias("amount")
    )


@query(rf"""WITH {HITS}, x AS (SELECT hit_id, list_filter(regexp_split_to_array(lower(answer), '[^a-z]+'), lambda w: w <> '') AS w FROM h WHERE answer IS NOT NULL AND NOT regexp_matches(answer, '\d')),
y AS (SELECT hit_id, list_filter(w, lambda t: t IN ({sql_words([*V.UNITS, *filter(None, V.TENS), 'hundred'])})) AS w FROM x), z AS (SELECT hit_id, w, list_position(w, 'hundred') AS p FROM y WHERE len(w) > 0),
v AS (SELECT *, MAP {{{', '.join(f"'{w}': {i}" for i, w in enumerate(V.UNITS))}, {', '.join(f"'{w}': {10 * i}" for i, w in enumerate(V.TENS) if w)}, 'hundred': 0}} AS m FROM z)
SELECT hit_id, CAST(CASE WHEN p IS NULL THEN list_sum(list_transform(w, lambda t: m[t])) ELSE greatest(1, coalesce(list_sum(list_transform(w[1 : p - 1], lambda t: m[t])), 0)) * 100 + coalesce(list_sum(list_transform(w[p + 1 :], lambda t: m[t])), 0) END AS BIGINT) AS number FROM v""")
def words_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [*V.UNITS, *filter(None, V.TENS), "hundred"]
    words = F.filter(F.split(F.lower("answer"), "[^a-z]+"), lambda w: w.isin(*known))
    spelled = hits(spark, sf_dir).where(F.col("answer").isNotNull() & ~F.regexp_like("answer", F.lit(r"\d"))).select("hit_id", words.alias("words"))
    return spelled.where("size(words) > 0").select("hit_id", V.words_to_int(F.col("words")).alias("number"))


@query(rf"""WITH {HITS}, x AS (SELECT hit_id, answer, expected_answer_type AS kind, {SCALE_SQL} AS scale, {NUMBER_SQL.format('answer')} AS n,
  TRY_CAST(replace(nullif(regexp_extract(lower(answer), '(-?\d+(?:[.,]\d+)?)\s?(?:%|per ?cent\b|pct\b|prozent\b|pour cent\b)', 1), ''), ',', '.') AS DOUBLE) AS p,
  regexp_extract(lower(answer), '(\d+)[\s-]+(?:calendar )?(hour|day|week|month|year)s?\b', 1) AS c, regexp_extract(lower(answer), '(\d+)[\s-]+(?:calendar )?(hour|day|week|month|year)s?\b', 2) AS u
  FROM h JOIN criteria USING (criteria_uid) WHERE answer IS NOT NULL),
y AS (SELECT hit_id, answer, CASE kind WHEN 'NUM:money' THEN n * coalesce(CASE scale {' '.join(f"WHEN '{k}' THEN {float(v)}" for k, v in V.SCALE_FACTORS.items())} END, 1) WHEN 'NUM:perc' THEN p WHEN 'NUM:count' THEN n END AS v,
  CASE WHEN kind = 'NUM:period' AND c <> '' THEN c || ' ' || u END AS per FROM x)
SELECT hit_id, coalesce(regexp_replace(CAST(CAST(round(v, 4) AS DECIMAL(30, 4)) AS VARCHAR), '\.?0+$', ''), per, answer) AS value FROM y""")
def value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits_with_criteria(spark, sf_dir, "expected_answer_type").where("answer is not null")
    return rows.select("hit_id", V.parsed_value(F.col("answer"), F.col("expected_answer_type")).alias("value"))


@query(f"""WITH {HITS}, {SCORES} SELECT hit_id, CASE WHEN squad_score >= 0.3 AND coalesce(contains(match_text, answer), false) THEN answer ELSE '' END AS answer
FROM h JOIN (SELECT file_idx, match_idx, squad_score FROM s) USING (file_idx, match_idx)""")
def answer_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = hits(spark, sf_dir).join(scores(spark, sf_dir).select("file_idx", "match_idx", "squad_score"), ["file_idx", "match_idx"])
    return joined.select("hit_id", X.answered(F.col("squad_score"), F.col("answer"), F.col("match_text")).alias("answer"))


CHOICES = ["months", "employees", "million", "per cent", "square metres"]


def _sql_near(word: str) -> str:
    own = f"list_distinct(string_split('{word}', ''))"
    return f"len(list_filter(w, lambda x: 1 - len(list_intersect(list_distinct(string_split(x, '')), {own})) / len(list_distinct(list_concat(list_distinct(string_split(x, '')), {own}))) < 0.25)) > 0"


@query(f"""WITH {HITS}, x AS (SELECT hit_id, {sql_tokens('answer')} AS w FROM h WHERE trim(answer) <> ''),
y AS (SELECT hit_id, list_sort(list_filter([{', '.join(f"CASE WHEN {' AND '.join(_sql_near(p) for p in c.split())} THEN '{c}' END" for c in CHOICES)}], lambda c: c IS NOT NULL)) AS found FROM x)
SELECT hit_id, CASE WHEN len(found) > 0 THEN array_to_string(found, ', ') ELSE 'Other' END AS picked FROM y""")
def answer_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).where("trim(answer) <> ''").select("hit_id", V.picked_choices(F.col("answer"), CHOICES).alias("picked"))


@query(f"""WITH {HITS}, x AS (SELECT hit_id, {NUMBER_SQL.format('answer')} AS n FROM h)
SELECT hit_id, format('{{:,}}', CAST(round(n) AS BIGINT)) AS grouped FROM x WHERE n IS NOT NULL AND round(n) = n""")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = hits(spark, sf_dir).select("hit_id", V.number_in(F.col("answer")).alias("n")).where("n is not null and round(n) = n")
    return numbers.select("hit_id", V.grouped(F.col("n").cast("long")).alias("grouped"))


CELLS = """cells AS (SELECT CAST(n_regionkey AS BIGINT) AS table_id, n_nationkey AS row_idx, CAST(year(o_orderdate) AS INT) AS col_idx, n_name AS row_label, CAST(year(o_orderdate) AS VARCHAR) AS col_label,
  CAST(CAST(round(sum(o_totalprice)) AS BIGINT) AS VARCHAR) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
ix AS (SELECT table_id, 'row' AS type, row_idx AS idx, (row_idx % 5 + 1) / 5 AS score FROM cells GROUP BY ALL UNION ALL SELECT table_id, 'col', col_idx, (col_idx % 3 + 1) / 4 FROM cells GROUP BY ALL),
ln AS (SELECT * FROM ix QUALIFY score >= max(score) OVER (PARTITION BY table_id, type)),
sl AS (SELECT c.* FROM cells c JOIN ln r ON r.type = 'row' AND r.table_id = c.table_id AND r.idx = c.row_idx JOIN ln k ON k.type = 'col' AND k.table_id = c.table_id AND k.idx = c.col_idx)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of order volume, one per region: a nation a row, a year a column."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    rows = orders.join(customers, "o_custkey").groupBy("n_nationkey", "year").agg(F.sum("o_totalprice").alias("total"))
    named = rows.join(F.broadcast(read_table(spark, sf_dir, "nation")), "n_nationkey")  # 25 rows
    return named.select(
        F.col("n_regionkey").cast("long").alias("table_id"), F.col("n_nationkey").alias("row_idx"), F.col("year").alias("col_idx"), F.col("n_name").alias("row_label"),
        F.col("year").cast("string").alias("col_label"), F.round("total").cast("long").cast("string").alias("value"),
    )


def index(cell_rows: DataFrame) -> DataFrame:
    rows = cell_rows.select("table_id", F.lit("row").alias("type"), F.col("row_idx").alias("idx")).distinct().withColumn("score", (F.col("idx") % 5 + 1) / 5)
    cols = cell_rows.select("table_id", F.lit("col").alias("type"), F.col("col_idx").alias("idx")).distinct().withColumn("score", (F.col("idx") % 3 + 1) / 4)
    return rows.unionByName(cols)


@query(f"WITH {CELLS} SELECT table_id, type, idx, score FROM ln")
def table_best_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.best_lines(index(cells(spark, sf_dir))).select("table_id", "type", "idx", "score")


@query(f"WITH {CELLS} SELECT table_id, row_label, col_label, value FROM sl")
def table_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    return B.sliced(own, B.best_lines(index(own))).select("table_id", "row_label", "col_label", "value")


@query(f"""WITH {CELLS}, n AS (SELECT table_id, count(*) AS cells FROM sl GROUP BY 1), t AS (SELECT table_id, max(score) FILTER (type = 'row') AS r, max(score) FILTER (type = 'col') AS c FROM ix GROUP BY 1)
SELECT table_id, cells, CASE WHEN cells = 1 THEN 1.0 ELSE 0.75 END AS table_score, true AS has_answer, round(least(1.0, 0.5 * (r + c) * greatest(r, c)), 6) AS rescaled FROM n JOIN t USING (table_id)""")
def table_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    lines = index(own)
    counts = B.sliced(own, B.best_lines(lines)).groupBy("table_id").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.size(F.split("value", " "))).alias("words"))
    score, found = B.outcome(F.col("cells"), F.col("cells"), F.col("words"), F.lit(0.7))
    scaled = B.rescaled(F.lit(0.5), F.col("row_score"), F.col("col_score"), F.col("other_score"))
    return counts.join(B.table_scores(lines), "table_id").select("table_id", "cells", score.alias("table_score"), found.alias("has_answer"), F.round(scaled, 6).alias("rescaled"))


@query(f"""WITH {CELLS}, g AS (SELECT table_id, row_idx, row_label, list(value ORDER BY col_idx) AS v FROM cells GROUP BY ALL)
SELECT table_id, row_idx, to_json(list_concat([row_label], v))::VARCHAR AS row FROM g""")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.grid(cells(spark, sf_dir))


@query(f"""WITH {CELLS}, f AS (SELECT * FROM cells QUALIFY row_idx = min(row_idx) OVER (PARTITION BY table_id))
SELECT table_id, row_label || chr(10) || string_agg(col_label || ': ' || value, chr(10) ORDER BY col_idx) AS key_values FROM f GROUP BY table_id, row_label""")
def table_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.key_values(cells(spark, sf_dir))


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = read_table(spark, sf_dir, "files").select("file_idx", F.col("file_meta")["lang"].alias("lang"))
    return common_quantities(
        read_table(spark, sf_dir, "matches"), "hit_id", "answer", "formatted_answer", "header_text", "match_text", "file_idx", langs, read_table(spark, sf_dir, "common_units")
    )


@query("""SELECT lower(trim(lang)) AS lang, count(*) AS files FROM (SELECT file_meta['lang'] AS lang FROM files) GROUP BY 1""")
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = read_table(spark, sf_dir, "files").select(F.lower(F.trim(F.col("file_meta")["lang"])).alias("lang"))
    return langs.groupBy("lang").agg(F.count(F.lit(1)).alias("files"))


@query(f"""WITH {HITS}, c AS (SELECT criteria_uid, expected_answer_type AS kind FROM criteria)
SELECT kind, count(*) AS hits, count(DISTINCT file_idx) AS files, count(*) FILTER (has_answer) AS answered FROM h JOIN c USING (criteria_uid) GROUP BY 1""")
def answer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = criteria(spark, sf_dir).select("criteria_uid", F.col("expected_answer_type").alias("kind"))
    rows = lookup_join(hits(spark, sf_dir), kinds, "criteria_uid", "hit_id", "inner")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("file_idx").alias("files"), F.count_if("has_answer").alias("answered"))
