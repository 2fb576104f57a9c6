"""The request pipeline, sinks, streams, tables, summaries and models on small fixtures."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleaner.operators import fields as D
from gleaner.operators import models as M
from gleaner.operators import scoring as S
from gleaner.operators import shaping as P
from gleaner.operators import summary as Y
from gleaner.operators import tables as B
from gleaner.operators.dispatch import Registry
from gleaner.operators.grouping import grouped
from gleaner.plans.request import Criteria, Settings, apply, extract, search, search_all, settings_of
from gleaner.sources.sinks import append_field, overwrite_field, page_of_files, read_any
from gleaner.streaming import events as E
from gleaner.streaming.extraction import extract_arrivals

PASSAGES = "hit_id long, file_idx string, match_idx int, criteria_uid string, oid string, parent_oid string, block_type string, page_idx int, group_type string, header_text string, match_text string, entity_types string, answer string, formatted_answer string"


@pytest.fixture
def passages(spark):
    texts = [
        ("f1", 0, "para", "The loan balance was $ 5 million", "$ 5 million"),
        ("f1", 1, "para", "The loan was repaid", None),
        ("f1", 2, "header", "Loan balance", None),
        ("f2", 0, "para", "Balance of the loan and the loan balance", "n/a"),
        ("f2", 1, "table", None, None),
        ("f3", 0, "para", "Nothing to see", None),
    ]
    return spark.createDataFrame([(i, f, m, "c", f"o{i}", f"o{i}", b, 0, "single", "Loans", t, None, a, None) for i, (f, m, b, t, a) in enumerate(texts)], PASSAGES)


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(f"f{i}", "ws", f"n{9 - i}", i, ["a"] if i == 2 else None, None) for i in (1, 2, 3)], "file_idx string, workspace_idx string, file_name string, n_pages int, permit_list array<string>, deny_list array<string>")


def test_search_ranks_files_then_passages(spark, passages, files):
    found = search(passages, files, Criteria("What is the loan balance?")).collect()
    assert {r["file_idx"] for r in found} == {"f1", "f2"} and all(0 < r["match_score"] <= 1 for r in found)
    assert {r["file_idx"] for r in search(passages, files, Criteria("loan balance"), Settings(acl=[])).collect()} == {"f1"}
    assert search(passages, files, Criteria("loan balance"), Settings(doc_per_page=1, match_per_doc=1)).count() == 1
    assert search(passages, files, Criteria("loan balance", keywords=["not:repaid"])).where("hit_id = 1").count() == 0


def test_apply_gives_ranked_facts(spark, passages, files):
    ranked = apply(passages, files, [Criteria("loan balance", expected_answer_type="NUM:money")]).collect()
    first = next(r for r in ranked if r["file_idx"] == "f1" and r["rank"] == 1)
    assert first["hit_id"] == 0 and first["currency"] == "USD" and first["formatted_answer"] == "5000000"
    with pytest.raises(ValueError):
        apply(passages, files, [Criteria()])


def test_groups_by_step(spark):
    def hit(i, parent, place, answer, text, flag="auto", block="para"):
        return (i, "c", "f", f"o{i}", parent, place, block, "single", "H", text, answer, flag)

    hits = spark.createDataFrame(
        [
            hit(1, "p", 0, "a b", "x y"), hit(2, "p", 1, None, "z"),
            hit(3, "o3", 10, "one", "same words here now"), hit(4, "o4", 11, "two", "same words here then"),
            hit(5, "o5", 20, "Equal one", "q"), hit(6, "o6", 40, "equal ONE", "r"),
            hit(7, "o7", 60, "k l m n o p", "s"), hit(8, "o8", 80, "k l m n o p q", "t"),
            hit(9, "o9", 90, None, None), hit(10, "p", 91, "a b", "x", "disable"),
        ],
        "hit_id long, criteria_uid string, file_idx string, oid string, parent_oid string, match_idx int, block_type string, group_type string, header_text string, match_text string, answer string, group_flag string",
    )
    got = {r["hit_id"]: (r["group_id"], r["kind"]) for r in grouped(hits).collect()}
    assert got == {1: (1, "parent"), 2: (1, "parent"), 3: (3, "location"), 4: (3, "location"), 5: (5, "same_answer"), 6: (5, "same_answer"), 7: (7, "similar_answer"), 8: (7, "similar_answer"), 9: (9, "single"), 10: (10, "single")}


def test_tables(spark):
    cells = spark.createDataFrame([(1, r, c, f"r{r}", f"c{c}" if c else "_UNKNOWN_1", None if (r, c) == (2, 1) else str(10 * r + c)) for r in range(3) for c in range(2)], "table_id long, row_idx int, col_idx int, row_label string, col_label string, value string")
    lines = spark.createDataFrame([(1, "row", 0, 1.0), (1, "row", 1, 0.5)], "table_id long, type string, idx int, score double")
    assert rows(B.sliced(cells, B.best_lines(lines)).select("value")) == [("0",), ("1",)]
    assert B.sliced(cells, lines.limit(0)).count() == 6
    assert {(r["row_idx"], r["col_label"]) for r in B.cleaned(cells).collect()} == {(0, ""), (0, "c1"), (1, ""), (1, "c1")}
    ladder = spark.createDataFrame([(0, 0, 1.0), (4, 0, 1.0), (4, 1, 1.0), (4, 4, 1.0), (4, 4, 6.0)], "d int, a int, w double")
    score, has = B.outcome(F.col("d"), F.col("a"), F.col("w"), F.lit(0.5))
    assert [tuple(r) for r in ladder.select(score, has).collect()] == [(0.0, False), (0.9, False), (1.0, True), (0.75, True), (0.3, True)]
    entries = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 2.5)], "table_id long, column string, score double")
    assert S.table_scores(entries).first()["score"] == 3.0


def test_summaries(spark):
    contexts = spark.createDataFrame([("c", "f", "See the Base Rent and Rent.")], "criteria_uid string, file_idx string, text string")
    known = spark.createDataFrame([("f", "base rent", "Base Rent means x"), ("f", "rent", "Rent means y"), ("f", "ren", "no")], "file_idx string, key string, text string")
    assert Y.with_references(contexts, known).first()["text"] == "See the Base Rent and Rent.\nBase Rent means x"
    assert Y.with_references(contexts, known, budget=7).first()["text"] == "See the Base Rent and Rent."
    heads = spark.createDataFrame([("c", "f", i, 1, a, None) for i, a in ((2, "y"), (1, "x"), (3, " "))], "criteria_uid string, file_idx string, group_rank int, place int, answer string, formatted_answer string")
    assert P.joined_answers(heads).first()["answer"] == "x/ny"


def test_models(spark):
    calls = spark.createDataFrame([("q a", "a b"), (None, None)], "q string, s string")
    column = M.model_column(lambda: lambda q, s: float(len(set(q.split()) & set(s.split()))))
    assert [r[0] for r in calls.select(column(F.col("q"), F.col("s"))).collect()] == [1.0, 0.0]
    assert M.scored_once(calls, "s", F.length, "n").where("s = 'a b'").first()["n"] == 3
    row = spark.range(1).select(M.picked_by_logit(["b", "a"], [F.lit(0.7), F.lit(0.9)]), M.picked_by_logit(["b"], [F.lit(0.1)]), M.boolean_answer(F.lit(0.2), F.lit(0.5), F.lit(0.3))).first()
    assert tuple(row) == ("a, b", "Other", "No")
    pairs = spark.createDataFrame([(1, "x", "1"), (1, "b", "2"), (1, None, "3")], "k int, e string, a string")
    assert M.entity_answers(pairs, ["k"], "e", "a").first()["a"] == "b => 2; x => 1"
    assert S.page_info(45, 40, 20) == {"total": 45, "offset": 40, "size": 20, "shown": 5}


def test_sinks_and_formats(spark, tmp_path, files):
    facts = spark.createDataFrame([("t1", 1), ("t2", 2)], "topic string, v int")
    overwrite_field(facts, str(tmp_path / "facts"), ["topic"])
    overwrite_field(facts.where("topic = 't1'").withColumn("v", F.lit(7)), str(tmp_path / "facts"), ["topic"])
    assert rows(spark.read.parquet(str(tmp_path / "facts")).select("topic", "v")) == [("t1", 7), ("t2", 2)]
    for _ in range(2):
        append_field(facts, str(tmp_path / "more"), "b1", ["topic"])
    append_field(facts, str(tmp_path / "more"), "b2", ["topic"])
    assert spark.read.parquet(str(tmp_path / "more")).count() == 4
    for kind in ("orc", "json", "csv", "parquet"):
        facts.write.format(kind).save(str(tmp_path / kind))
        assert rows(read_any(spark, str(tmp_path / kind), kind, "topic string, v int")) == rows(facts)
    assert [r["file_idx"] for r in page_of_files(files, "ws", 2, 1).collect()] == ["f2", "f1"]


def test_streams_equal_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, start + dt.timedelta(hours=i), i % 3, "a", 1.0) for i in range(60)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = E.stream_of(spark, str(tmp_path / "in"), events)
    seen = []
    E.run_available(E.first_seen(stream, "user_id"), lambda df, i: seen.extend(r["user_id"] for r in df.collect()), str(tmp_path / "state"), "append")
    assert sorted(seen) == [0, 1, 2]
    counts = []
    E.run_available(E.tumbling_counts(stream), lambda df, i: counts.extend(map(tuple, df.collect())), str(tmp_path / "state2"))
    assert sorted(counts) == sorted(map(tuple, E.tumbling_counts(events).collect()))


def test_extraction_of_arrivals(spark, tmp_path, passages, files):
    passages.where("file_idx = 'f1'").write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: extract_arrivals(E.stream_of(spark, str(tmp_path / "in"), passages), files, [Criteria("loan balance")], out, state)
    run()
    first = {r["hit_id"] for r in spark.read.parquet(out).collect()}
    passages.where("file_idx = 'f2'").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    both = spark.read.parquet(out).collect()
    assert first == {0, 1, 2} and {r["hit_id"] for r in both} == {0, 1, 2, 3} and len(both) == 4


def test_two_criteria_in_one_pass(spark, passages, files):
    named = files.withColumn("file_title", F.concat(F.lit("Report "), F.col("file_idx")))
    asked = [Criteria("f2 | loan balance"), Criteria("What is the loan balance?", keywords=["loan"]), Criteria("was repaid", headers=["loans"])]
    found = search_all(passages, named, asked, Settings(expand_children=False))
    by = {}
    for r in found.collect():
        by.setdefault(r["criteria_uid"], set()).add(r["hit_id"])
    assert by[asked[0].uid] == {3} and by[asked[1].uid] == {0, 1, 2, 3} and by[asked[2].uid] == {1}
    alone = {(r["hit_id"], r["match_score"]) for r in search(passages, named, asked[1], Settings(expand_children=False)).collect()}
    assert alone == {(r["hit_id"], r["match_score"]) for r in found.where(F.col("criteria_uid") == asked[1].uid).collect()}
    also = search(passages, named, Criteria("Was it repaid?", additional_questions=["balance", None, " "]), Settings(expand_children=False))
    assert {r["hit_id"] for r in also.collect()} == {0, 1, 2, 3}
    with_words = Settings(file_dynamic_boosters={"file_title": 100.0}, dynamic_boosters_for_questions=True)
    scores = {r["file_idx"]: r["file_score"] for r in search(passages, named, Criteria("What is the loan report?"), with_words).collect()}
    assert min(scores.values()) > 100
    assert {r["file_score"] > 7 for r in search(passages, named, asked[1], Settings(file_boosters=[F.when(F.col("n_pages") == 2, 7.0)])).where("file_idx = 'f2'").collect()} == {True}


def test_children_of_hits_are_found(spark, files):
    rows_ = [(0, "o0", "o0", "header", "Loan balance by year"), (1, "o1", "o0", "list_item", "first item"), (2, "o2", "o0", "list_item", "the loan balance itself"), (3, "o3", "o9", "para", "other")]
    texts = spark.createDataFrame([(i, "f1", i, "c", o, p, b, 0, "single", "H", t, None, "x" if i == 1 else None, None) for i, o, p, b, t in rows_], PASSAGES)
    got = {r["hit_id"]: r["match_score"] for r in search(texts, files, Criteria("loan balance")).collect()}
    assert set(got) == {0, 1, 2} and got[1] == got[0]
    assert {r["hit_id"] for r in search(texts, files, Criteria("loan balance"), Settings(expand_children=False)).collect()} == {0, 2}
    context = apply(texts, files, [Criteria("loan balance", before_context_window=1, after_context_window=7)]).where("hit_id = 2").first()["context"]
    assert context == "first item the loan balance itself other"


def test_gate_tables_and_order(spark, passages, files):
    asked = [Criteria("What is the loan covenant ratio of the balance sheet?")]
    hits = search_all(passages, files, asked)
    assert extract(hits, passages, asked).where("answer is not null").count() == 0  # no text holds half of the question's words
    assert extract(hits, passages, asked, Settings(qnli_threshold=0.1)).where("answer is not null").count() == 2
    table = hits.limit(1).withColumn("block_type", F.lit("table"))
    read = table.select("hit_id", F.lit(0.5).alias("table_score"), F.lit("7").alias("table_answer"))
    row = extract(table, passages, asked, tables=read).first()
    assert (row["table_score"], row["answer"]) == (0.5, "7")


def test_processors_are_looked_up():
    known = Registry()
    known.register("NumberFormatter", lambda kind="MONEY", only=False: (kind, only))
    assert known("NumberFormatter('UNITS', only=True)") == ("UNITS", True) and known("NumberFormatterProcessor") == ("MONEY", False)
    assert known("Missing()") is None and known("NumberFormatter(open('x'))") is None and known("a; b") is None and known("NumberFormatter(1, 2, 3)", "d") == "d"
    assert known.chain(["NumberFormatter", "Bad("], "default") == [("MONEY", False)] and known.chain(None, "default") == ["default"]


def test_settings_and_fields(spark):
    made = settings_of({"doc_per_page": "7", "search_settings": {"perform_only_dpr": "true", "sif_threshold": "0.6", "topn": "x"}, "private_dictionary": {"a": ["b"]}, "other": 1})
    assert (made.doc_per_page, made.perform_only_dpr, made.sif_threshold, made.topn, made.private_dictionary) == (7, True, 0.6, -1, {"a": ["b"]})
    table = spark.createDataFrame([("u1", None, None, None), ("u2", "q", ["h"], 3)], "criteria_uid string, question string, headers array<string>, page_start int")
    assert D.field_definitions(table, ["u2", "x", "u1"]) == [{"criteria_uid": "u2", "question": "q", "headers": ["h"], "page_start": 3}, {"criteria_uid": "u1", "question": "", "headers": [], "page_start": -1}]
    with pytest.raises(ValueError):
        D.field_definitions(table, ["a", "b"], most=1)


def test_stand_ins(spark):
    row = spark.range(1).select(
        M.best_span(F.lit("where is the loan"), F.lit("No. The loan is here. The loan was.")).alias("span"), M.hashed_encoding(F.lit("a b a"), 8).alias("v"),
        M.hashed_encoding(F.lit("--"), 8).alias("none"), M.question_keywords(F.lit("What is the loan balance of rent")).alias("k"),
    ).first()
    assert row["span"]["answer"] == "The loan is here." and abs(sum(x * x for x in row["v"]) - 1) < 1e-6 and row["none"] is None and row["k"] == ["loan balance", "rent"]
    assert not M.extraction_wanted(True, False, False, False) and M.extraction_wanted(False, True, True, False) and not M.extraction_wanted(False, True, True, True)


def test_filters_come_before_distinct(spark, tmp_path, passages):
    from gleaner.plans.queries import queries

    root = str(tmp_path)
    passages.write.parquet(f"{root}/matches.parquet")
    plan = queries()["keyword_and_or"](spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("Filter")
