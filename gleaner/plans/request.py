"""Requests: criteria, tasks and settings, and the stages they run through."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.functions.values import currency, parsed_value
from gleaner.operators import filters as X
from gleaner.operators import scoring as S
from gleaner.operators.context import context_window
from gleaner.operators.grouping import SCOPE, down_weighted, grouped, merged_by_passage
from gleaner.operators.models import best_per_file, overlap_score
from gleaner.operators.ranking import (
    clamped_scores, final_ranks, has_text, list_answers, once_per_answer, ranked_groups, ranked_in_groups, scaled_score, top_per_group, with_default_scores,
)
from gleaner.session import written

BOOL_TYPE = "bool"


@dataclass(frozen=True)
class Criteria:
    """One query. -1 is an unset page or rank."""

    question: str = ""
    keywords: list[str] = field(default_factory=list)
    templates: list[str] = field(default_factory=list)
    headers: list[str] = field(default_factory=list)
    expected_answer_type: str = "auto"
    group_flag: str = "auto"
    table_flag: str = "auto"
    page_start: int = -1
    page_end: int = -1
    criteria_rank: int = -1
    enable_similar_search: bool = True
    entity_types: list[str] = field(default_factory=list)
    additional_questions: list[str] = field(default_factory=list)
    before_context_window: int = 0
    after_context_window: int = 0
    vector: list[float] | None = None

    def normalised(self) -> Criteria:
        """Texts stripped and lower-case, blank ones dropped; what stands before the last bar filters files and is cut off."""
        question = self.question.rsplit("|", 1)[-1].strip().lower()
        words = question.split()
        asks = len(words) > 1 and words[0] in T.QUESTION_WORDS + T.BOOL_QUESTION_WORDS
        kind = self.expected_answer_type
        if len(words) > 1 and words[0] in T.BOOL_QUESTION_WORDS:
            kind = BOOL_TYPE
        elif not asks or kind in ("auto", "any", "disable"):
            kind = "" if kind in ("auto", "any", "disable") else kind
        clean = lambda values: [v.strip() for v in values or [] if v and v.strip()]
        templates = [t.lower().rstrip(".?") for t in clean(self.templates)]
        return replace(self, question=question, expected_answer_type=kind, templates=templates, headers=clean(self.headers), keywords=clean(self.keywords))

    @property
    def file_filter(self) -> str:
        return self.question.rsplit("|", 1)[0].strip() if "|" in self.question else ""

    @property
    def uid(self) -> str:
        import hashlib

        c = self.normalised()
        parts = [c.question, *c.templates, *c.headers, c.expected_answer_type, c.group_flag, c.table_flag, str(c.page_start), str(c.page_end), str(c.criteria_rank)]
        return hashlib.md5(":".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Settings:
    """Switches of a workspace."""

    doc_per_page: int = 20
    match_per_doc: int = 20
    offset: int = 0
    topn: int = -1
    acl: list[str] | None = None
    file_level_first: bool = True
    perform_only_dpr: bool = False
    sif_threshold: float = 0.45
    dpr_threshold: float = 0.45
    qnli_threshold: float = 0.5
    expand_children: bool = True
    private_dictionary: dict[str, list[str]] = field(default_factory=dict)
    scorer: Callable[[Column, Column], Column] = overlap_score
    #: Scores over columns of files, added to every file's score.
    file_boosters: list[Column] = field(default_factory=list)
    #: Text columns of files whose words of the question add to a file's score, with their weights; not for questions unless switched on.
    file_dynamic_boosters: dict[str, float] = field(default_factory=dict)
    dynamic_boosters_for_questions: bool = False


def coerced(value: object, default: object) -> object:
    """An option's text as what its default is: truth (1, true, yes, on), whole number, number, or text; the default if it isn't one."""
    if not isinstance(value, str) or default is None:
        return default if value is None else value
    if isinstance(default, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    try:
        return type(default)(value.strip()) if isinstance(default, (int, float)) else value
    except ValueError:
        return default


def settings_of(options: dict) -> Settings:
    """Settings from an option file's groups (private_dictionary, search_settings, index_settings) or from plain options; unknown ones are ignored."""
    flat = {**options, **(options.get("index_settings") or {}), **(options.get("search_settings") or {})}
    known = Settings()
    return replace(known, **{k: coerced(v, getattr(known, k)) for k, v in flat.items() if k in Settings.__dataclass_fields__ and v is not None})


def passage_columns(passages: DataFrame) -> DataFrame:
    """Passages with the token arrays and padded texts that scores and filters use."""
    with_tokens = passages.withColumns({"tokens": T.tokens(F.col("match_text")), "header_tokens": T.tokens(F.col("header_text"))})
    return with_tokens.withColumns({"padded": T.padded(F.col("tokens")), "header_padded": T.padded(F.col("header_tokens"))})


def passage_filter(criteria: Criteria) -> Column:
    """All conditions of a criterion that don't score."""
    c = criteria.normalised()
    keywords = X.implied_keywords(criteria.question, c.keywords)
    condition = X.matches_keywords(F.col("tokens"), F.col("padded"), keywords)
    if c.headers:
        condition = condition & X.matches_headers([(F.col("header_tokens"), F.col("header_padded"))], c.headers)
    if c.entity_types:
        condition = condition & X.has_entity(F.col("entity_types"), c.entity_types)
    if (c.page_start, c.page_end) != (-1, -1):
        condition = condition & X.in_pages(F.col("page_idx"), F.col("n_pages"), F.lit(c.page_start), F.lit(c.page_end))
    if keywords and not c.question:
        condition = condition & X.no_headers(F.col("block_type"))
    return condition & X.no_tables(F.col("block_type"), c.table_flag)


@dataclass(frozen=True)
class Asked:
    """What one criterion looks for."""

    criteria: Criteria
    grams: list[S.Gram]
    words: list[str]
    header_words: list[str]

    @staticmethod
    def of(criteria: Criteria, settings: Settings) -> Asked:
        c = criteria.normalised()
        questions = [c.question, *(q.strip().lower() for q in c.additional_questions or [] if q and q.strip())]
        texts = [t for q in questions for t in T.expanded_synonyms(q, settings.private_dictionary)[0]]
        grams = list({g.words: g for t in texts for g in S.query_grams(t)}.values())
        headers = {w for h in c.headers if not h.lower().startswith(X.NEGATION) for g in S.query_grams(h) for w in g.words}
        return Asked(criteria, grams, sorted({w for g in grams for w in g.words}), sorted(headers))


def passage_score(asked: Asked, settings: Settings, columns: list[str], body: S.FieldStats, head: S.FieldStats) -> Column:
    """The best main clause and half of the others, plus all boosters; 0 where no main clause matches."""
    c = asked.criteria.normalised()
    length, header_length = F.size("tokens"), F.size("header_tokens")
    main = [] if settings.perform_only_dpr else [S.ngram_score(F.col("padded"), length, asked.grams, body)]
    similar = bool(c.vector) and c.enable_similar_search and bool(c.question)
    if similar and "vector" in columns and not settings.perform_only_dpr:
        main.append(V.thresholded(V.dot(F.col("vector"), V.literal(c.vector)), settings.sif_threshold))
    score = S.best_of(main) if main and (asked.grams or c.vector) else F.lit(1.0)
    boosters = []
    if similar and "header_vector" in columns:
        boosters.append(V.thresholded(V.dot(F.col("header_vector"), V.literal(c.vector)), settings.sif_threshold))
    if similar and "dpr_vector" in columns:
        boosters.append(V.thresholded(V.dot(F.col("dpr_vector"), V.literal(c.vector)), settings.dpr_threshold))
    if not settings.perform_only_dpr:
        fields = {"match": (F.col("padded"), length, body), "header": (F.col("header_padded"), header_length, head)}
        boosters.append(S.cross_fields(fields, asked.words, S.FIELD_WEIGHTS))
        if asked.header_words:
            boosters.append(S.header_boost([fields["header"]], [h for h in c.headers if not h.lower().startswith(X.NEGATION)]))
        if "key_values" in columns:
            tokens = T.tokens(F.col("key_values"))
            phrases = [k.strip('"') for k in c.keywords if k.startswith('"')]
            texts = phrases or ([] if asks(c.question) else [c.question])
            boosters.append(S.key_value_boost(T.padded(tokens), F.size(tokens), texts, body))
            boosters.append(S.quoted_boost(T.padded(tokens), phrases, body, F.size(tokens)))
        if c.expected_answer_type and c.expected_answer_type != BOOL_TYPE and asks(c.question):
            boosters.append(S.entity_clause(F.col("entity_types"), [c.expected_answer_type]))
    return F.coalesce(F.round(S.boosted(score, boosters), 6), F.lit(0.0))


def asks(question: str) -> bool:
    words = question.split()
    return len(words) > 1 and words[0] in T.QUESTION_WORDS + T.BOOL_QUESTION_WORDS


def file_filters(rows: DataFrame, criteria: list[Criteria]) -> DataFrame | None:
    """(file_idx, wanted): the criteria whose file filter a file passes: one of its words in the title, a heading or a text; None if no criterion has one."""
    if not any(c.file_filter for c in criteria):
        return None
    tests = []
    for c in criteria:
        words = T.split_words(c.file_filter)
        wanted = F.array(*(F.lit(w) for w in words)).cast("array<string>")
        held = [F.coalesce(F.arrays_overlap(F.col(t), wanted), F.lit(False)) for t in ("tokens", "header_tokens", "title_tokens")]
        tests.append(F.when(held[0] | held[1] | held[2], F.lit(c.uid)) if words else F.lit(c.uid))
    passed = rows.select("file_idx", F.explode(F.filter(F.array(*tests), lambda u: u.isNotNull())).alias("criteria_uid")).distinct()
    return passed


def file_boost(criteria: list[Criteria], settings: Settings) -> Column | None:
    """What a file's own columns add to its score, by criterion."""
    boost = S.total([F.coalesce(b.cast("double"), F.lit(0.0)) for b in settings.file_boosters]) if settings.file_boosters else None
    if not settings.file_dynamic_boosters:
        return boost
    dynamic = F.lit(0.0)
    for c in criteria:
        question = c.normalised().question
        if S.use_dynamic_boosters(asks(question), settings.dynamic_boosters_for_questions):
            words = F.array(*(F.lit(w) for w in T.split_words(question))).cast("array<string>")
            own = S.total([w * F.size(F.array_intersect(T.tokens(F.coalesce(F.col(name), F.lit(""))), words)) for name, w in settings.file_dynamic_boosters.items()])
            dynamic = F.when(F.col("criteria_uid") == c.uid, own).otherwise(dynamic)
    return dynamic if boost is None else boost + dynamic


def search_all(passages: DataFrame, files: DataFrame, criteria: list[Criteria], settings: Settings | None = None) -> DataFrame:
    """Best passages of the best files for every criterion, with match_score and file_score.

    The passages are read once for the words' statistics and once for all
    criteria together. A criterion's files are ranked by their passages' summed
    scores and own boosters, and its page of files is taken; then the best
    passages of those files, and the children of hits that are no paragraphs.
    """
    settings = settings or Settings()
    criteria = list({c.uid: c for c in criteria}.values())
    asked = [Asked.of(c, settings) for c in criteria]
    if settings.acl is not None:
        files = files.where(X.readable(F.col("permit_list"), F.col("deny_list"), settings.acl))
    title = T.tokens(F.coalesce(F.col("file_title"), F.lit(""))) if "file_title" in files.columns else F.array().cast("array<string>")
    tokenised = passage_columns(passages)
    body, head = S.stats_of_fields(tokenised, {"tokens": sorted({w for a in asked for w in a.words}), "header_tokens": sorted({w for a in asked for w in [*a.words, *a.header_words]})})
    rows = tokenised.join(files.select("file_idx", "n_pages", title.alias("title_tokens")), "file_idx")
    hits_of = [F.struct(F.lit(a.criteria.uid).alias("criteria_uid"), F.when(passage_filter(a.criteria), passage_score(a, settings, passages.columns, body, head)).otherwise(0.0).alias("raw_match_score")) for a in asked]
    kept = [c for c in passages.columns if c != "criteria_uid"]
    found = rows.select(*kept, "n_pages", F.explode(F.filter(F.array(*hits_of), lambda h: h["raw_match_score"] > 0)).alias("hit"))
    matched = found.select(*kept, "n_pages", "hit.*")
    passed = file_filters(rows, criteria)
    if passed is not None:
        matched = matched.join(passed, ["criteria_uid", "file_idx"], "left_semi")
    if settings.file_level_first:
        ranked = matched.groupBy("criteria_uid", "file_idx").agg(F.sum("raw_match_score").alias("file_score"))
        boost = file_boost(criteria, settings)
        if boost is not None:
            ranked = ranked.join(files, "file_idx").select("criteria_uid", "file_idx", (F.col("file_score") + boost).alias("file_score"))
        ranked = ranked.withColumn("file_score", F.round("file_score", 4))
        page = top_per_group(ranked, ["criteria_uid"], [F.col("file_score").desc(), F.col("file_idx")], settings.offset + settings.doc_per_page)
        page = page.where(F.col("rank") > settings.offset).drop("rank")
        matched = matched.join(F.broadcast(page), ["criteria_uid", "file_idx"])  # one page of files for each criterion
    top = top_per_group(matched, SCOPE, [F.col("raw_match_score").desc(), F.col("hit_id")], settings.match_per_doc)
    best = top.groupBy(*SCOPE).agg(F.max("raw_match_score").alias("__best"))
    scored = top.join(best, SCOPE).withColumn("match_score", S.normalised(F.col("raw_match_score"), F.col("__best"))).drop("__best", "rank")
    return with_children(scored, passages) if settings.expand_children else scored


def search(passages: DataFrame, files: DataFrame, criteria: Criteria, settings: Settings | None = None) -> DataFrame:
    """``search_all`` for one criterion."""
    return search_all(passages, files, [criteria], settings)


def with_children(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Hits and the children of those that are no paragraphs; a child has its parent's scores unless it is a hit itself, the best parent's if several."""
    hits = written(hits)  # a page of hits for each criterion
    carried = [c for c in hits.columns if c not in passages.columns or c == "criteria_uid"]
    parents = hits.where("block_type <> 'para' and oid is not null").select(F.col("oid").alias("__parent"), F.col("file_idx").alias("__file"), *carried)
    inside = passages.drop("criteria_uid").where("parent_oid <> oid")
    children = inside.join(parents, (F.col("parent_oid") == F.col("__parent")) & (F.col("file_idx") == F.col("__file"))).drop("__parent", "__file")
    every = hits.withColumn("__own", F.lit(1)).unionByName(children.withColumn("__own", F.lit(0)))
    first = F.row_number().over(W.partitionBy("criteria_uid", "hit_id").orderBy(F.col("__own").desc(), F.col("match_score").desc()))
    return every.withColumn("__n", first).where("__n = 1").drop("__n", "__own")


def asked_table(hits: DataFrame, criteria: list[Criteria]) -> DataFrame:
    """(criteria_uid, question, ...): one row for each criterion of the request."""
    plain = [(c.uid, c.normalised()) for c in criteria]
    data = [
        (uid, c.question, c.templates, c.expected_answer_type, asks(c.question), c.group_flag, c.criteria_rank, max(c.before_context_window or 0, 0), max(c.after_context_window or 0, 0))
        for uid, c in dict(plain).items()
    ]
    schema = "criteria_uid string, question string, templates array<string>, __kind string, __asks boolean, group_flag string, criteria_rank int, __before int, __after int"
    return hits.sparkSession.createDataFrame(data, schema)


def extract(hits: DataFrame, passages: DataFrame, criteria: list[Criteria], settings: Settings | None = None, tables: DataFrame | None = None) -> DataFrame:
    """Hits with model scores, answers, formatted values and context.

    Of a question, a hit whose entailment score is below the threshold gets no
    answer; tables are exempt. ``tables`` (hit_id, table_score, table_answer)
    has what was extracted from tables; it overrides a table's answer. Where
    hits have a cross_encoder_score, only the five best of a file keep one.
    """
    settings = settings or Settings()
    columns = {"question", "templates", "group_flag", "criteria_rank", "table_score", "table_answer"} & set(hits.columns)
    asked = hits.drop(*columns).join(F.broadcast(asked_table(hits, criteria)), "criteria_uid")  # one row for each criterion
    is_table = F.coalesce(F.col("block_type") == "table", F.lit(False))
    scored = asked.withColumns({
        "qnli_score": F.greatest(settings.scorer(F.col("question"), F.col("match_text")), F.lit(0.01)),
        "relevancy_score": S.relevancy(F.col("match_text"), F.col("templates"), is_table),
    })
    answer = F.when(is_table | ~F.col("__asks") | (F.col("qnli_score") >= settings.qnli_threshold), F.col("answer"))
    if tables is not None:
        read = tables.select("hit_id", "table_score", "table_answer")
        scored = scored.join(read, "hit_id", "left")
        answer = F.when(is_table & (F.col("__kind") != BOOL_TYPE), F.coalesce("table_answer", answer)).otherwise(answer)
    else:
        scored = scored.withColumn("table_score", F.lit(1.0))
    if "cross_encoder_score" in scored.columns:
        scored = best_per_file(scored, SCOPE, "cross_encoder_score", ["hit_id"]).withColumn("answer", answer)
        answer = F.when(F.col("has_answer"), F.col("answer"))
    scored = scored.withColumn("__given", F.col("answer")).withColumn("answer", answer)
    value = parsed_value(F.coalesce("answer", F.lit("")), F.col("__kind"))
    given = F.nullif(F.col("formatted_answer"), F.lit(""))
    result = scored.withColumns({"formatted_answer": F.when(F.col("answer").isNotNull() | F.col("__given").isNull(), F.coalesce(given, value)).otherwise(""), "currency": currency(F.col("answer"))})
    if any((c.before_context_window or 0) > 0 or (c.after_context_window or 0) > 0 for c in criteria):
        result = context_window(result, passages, "__before", "__after")
    return result.drop("question", "templates", "__kind", "__asks", "__before", "__after", "__given")


def rank(hits: DataFrame, topn: int = -1) -> DataFrame:
    """Grouped and ranked hits with final scores.

    A passage that several criteria of the task found counts for one of them:
    with answer first, then by the criterion's rank. Where a file has a group of same answers, other hits count less. An answer
    that a location group already has and a hit that only announces the table
    behind it are no part of the ranking: they come last. A list's head without
    answer gets those of its items. Hits whose score is 0 are left out.
    """
    named = with_default_scores(hits).withColumns({"has_answer": has_text(F.col("answer")), "__passage": F.coalesce(F.col("oid"), F.col("hit_id").cast("string"))})
    hits = written(merged_by_passage(named, ["file_idx", "__passage"]).drop("__passage"))
    scored = hits.join(written(grouped(hits)), "hit_id")
    same = F.col("kind") == "same_answer"
    any_same = scored.where(same).select(*SCOPE).distinct().withColumn("__same", F.lit(True))
    scored = scored.join(any_same, SCOPE, "left").withColumn("group_score", down_weighted(F.col("group_score"), same, F.coalesce("__same", F.lit(False)))).drop("__same")
    scored = scored.withColumn("scaled", scaled_score(F.col("block_type") == "table")).where(X.scored(F.col("scaled")))
    scored = once_per_answer(scored)
    out = F.col("repeated") & (F.col("kind") == "location")
    placed = written(ranked_in_groups(scored.withColumn("__out", out)))
    members = placed.where("not __out").groupBy(*SCOPE, "group_id").agg(F.count(F.lit(1)).alias("__n"), F.bool_or((F.col("block_type") == "table") & (F.col("place") > 1)).alias("__table"))
    announced = F.coalesce((F.col("__n") == 2) & F.col("__table") & (F.col("block_type") != "table"), F.lit(False))
    placed = written(placed.join(members, [*SCOPE, "group_id"], "left").withColumn("__out", F.col("__out") | announced).drop("__n", "__table"))
    ranked = placed.where("not __out")
    order = ranked_groups(ranked).drop("group_best")
    ordered = written(ranked.join(order, [*SCOPE, "group_id"]))
    clamped = clamped_scores(ordered).select(*SCOPE, "hit_id", F.col("clamped").alias("final_score"))
    items = list_answers(ordered)
    head = (F.col("block_type") == "list_item") & (F.col("place") == 1) & ~has_text(F.col("answer"))
    result = ordered.join(clamped, [*SCOPE, "hit_id"]).join(items, [*SCOPE, "group_id"], "left")
    result = result.withColumn("answer", F.when(head & F.col("answers").isNotNull(), F.col("answers")).otherwise(F.col("answer"))).drop("answers")
    rest = placed.where("__out").withColumns({"group_rank": F.lit(None).cast("int"), "final_score": F.col("scaled")})
    whole = final_ranks(result.unionByName(rest).drop("__out", "repeated"))
    return whole.where(F.col("group_rank") <= topn) if topn > 0 else whole


STAGES: dict[str, Callable[..., DataFrame]] = {"search": search_all, "extract": extract, "rank": rank}


def apply(passages: DataFrame, files: DataFrame, criteria: list[Criteria], settings: Settings | None = None, tables: DataFrame | None = None) -> DataFrame:
    """Ranked hits of all criteria of a task; a criterion without any condition gives none."""
    settings = settings or Settings()
    asked = [c for c in criteria if c.question.strip() or c.keywords or c.headers or c.entity_types]
    if not asked:
        raise ValueError("no criterion has a question, keyword, header or entity type")
    found = STAGES["search"](passages, files, asked, settings)
    return STAGES["rank"](STAGES["extract"](found, passages, asked, settings, tables), settings.topn)
