"""Operators against worked examples and brute force."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import values as V
from gleaner.operators import filters as X
from gleaner.operators import scoring as S
from gleaner.operators.context import context_window
from gleaner.operators.graph import connected_components
from gleaner.operators.joins import as_of_join, lookup_join, range_join
from gleaner.operators.ordered import average_ranks, running_sum_by_hash
from gleaner.operators.ranking import clamped_scores
from gleaner.operators.topics import distinct_phrases
from gleaner.plans.request import Criteria


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_ngram_weights_prefer_order(spark):
    grams = S.query_grams("A1 B1 C1", stop=[])
    df = spark.createDataFrame([("a1 b1 c1",), ("b1 c1 a1",), ("c1 b1 a1",)], "t string")
    scored = df.select("t", F.round(S.unit_ngram_score(T.padded(T.tokens(F.col("t"))), grams), 2))
    # three words, two pairs and a triple
    expected = {"a1 b1 c1": 3 + 2 * 0.37 + 0.14, "b1 c1 a1": 3 + 0.37, "c1 b1 a1": 3}
    assert dict(map(tuple, scored.collect())) == {k: pytest.approx(v) for k, v in expected.items()}


@pytest.mark.parametrize(
    "text, question, yes_no",
    [("what is x", True, False), ("is it y", True, True), ("revenue growth", False, False), ("what", False, False), ("a | what is b", True, False), (None, False, False), ("", False, False)],
)
def test_questions(spark, text, question, yes_no):
    row = spark.createDataFrame([(text,)], "t string").select(T.is_question(F.col("t")), T.is_bool_question(F.col("t"))).first()
    assert tuple(row) == (question, yes_no)


def test_text_of_requests(spark):
    assert one(spark, T.make_question(F.lit("is it "))) == "is it?"
    assert one(spark, T.remove_question_mark(F.lit("is it??"))) == "is it"
    assert one(spark, T.keywords_of(F.lit('all "base rent" here'))) == ["base rent"]
    assert one(spark, T.ngrams(T.tokens(F.lit("a b")), 3)) == []
    assert X.implied_keywords('what is "base rent"', ["loan"]) == ['loan "base rent"']
    assert Criteria("lease file | Is it due?").normalised().expected_answer_type == "bool"
    assert Criteria("lease file | Is it due?").file_filter == "lease file"


def test_synonyms_replace_longer_variants_first(spark):
    text = T.canonical_synonyms(F.lit("aapl.o and AAPL, not AAPLX"), {"Apple": ["AAPL", "AAPL.O"]})
    assert one(spark, text) == "Apple and Apple, not AAPLX"
    texts, used = T.expanded_synonyms("the rent due", {"rent": ["rental"]})
    assert texts == ["the rent due", "the rental due"] and used == {"rent": ["rent", "rental"]}


def test_phrases(spark):
    df = spark.createDataFrame([("Red apples, are good in flavour.",), (None,), ("",)], "t string")
    got = lambda lo, hi: {r[0] for r in distinct_phrases(df, "t", ["are", "in"], lo, hi).collect()}
    assert got(1, 2) == {"red apples", "good", "flavour"}
    assert got(1, 1) == {"good", "flavour"}
    assert got(2, 2) == {"red apples"}


def test_long_phrases_are_kept(spark):
    df = spark.createDataFrame([("net annual base rent per month of office",)], "t string")
    assert {r[0] for r in distinct_phrases(df, "t", ["of"]).collect()} == {"net annual base rent per month", "office"}


@pytest.mark.parametrize("start, end, kept", [(1, 3, {0, 1, 2}), (-2, -1, {8, 9}), (2, -1, set(range(10))), (-1, -1, set(range(10))), (0, 0, set(range(10)))])
def test_page_ranges(spark, start, end, kept):
    pages = spark.range(10).select(F.col("id").cast("int").alias("p"))
    assert {r[0] for r in pages.where(X.in_pages(F.col("p"), F.lit(10), F.lit(start), F.lit(end))).collect()} == kept


@pytest.mark.parametrize(
    "acl, permit, deny, ok",
    [([], None, None, True), ([], None, ["a"], True), ([], ["a"], None, False), (["a"], None, None, True), (["a"], ["a"], None, True), (["a"], ["b"], None, False), (["a"], None, ["a"], False), (["a"], ["a"], ["a"], False), (["a"], [], None, False)],
)
def test_access(spark, acl, permit, deny, ok):
    df = spark.createDataFrame([(permit, deny)], "p array<string>, d array<string>")
    assert bool(df.select(X.readable(F.col("p"), F.col("d"), acl)).first()[0]) is ok


def test_dis_max_and_normalisation(spark):
    assert one(spark, S.best_of([F.lit(2.0), F.lit(1.0), F.lit(None).cast("double")])) == 2.5
    assert one(spark, S.best_of([F.lit(0.0)])) is None
    assert one(spark, S.normalised(F.lit(0.5), F.lit(0.4))) == 0.5


def test_relevancy_shares(spark):
    df = spark.createDataFrame([("alpha beta",), ("alpha",), ("gamma",)], "t string")
    values = lambda table: [round(r[0], 2) for r in df.select(S.relevancy(F.col("t"), F.array(F.lit("alpha beta")), F.lit(table))).collect()]
    assert values(False) == [1.0, 0.85, 0.7]
    assert values(True) == [1.0, 0.55, 0.1]


def test_values(spark):
    assert one(spark, V.currency(F.lit("paid US$ 5"))) == "USD"
    assert one(spark, V.currency(F.lit("5 million euros"))) == "EUR"
    assert one(spark, V.currency(F.lit("no money"))) is None
    words = lambda text: one(spark, V.words_to_int(F.split(F.lit(text), " ")))
    assert words("two hundred and five thousand six") == 205_006
    assert words("five apples") is None
    assert one(spark, V.money_amount(F.lit("$1,234.5 million"))) == 1_234_500_000
    assert one(spark, V.period(F.lit("within 3 calendar months"))) == "3 month"
    assert one(spark, V.date_in(F.lit("on 5 March 2020"))) == "2020-03-05"
    assert one(spark, V.picked_choices(F.lit("12 months"), ["months", "days"])) == "months"


def test_scores_never_rise(spark):
    hits = spark.createDataFrame([("c", "f", g, 1, s, g) for g, s in ((1, 0.6), (2, 0.8), (3, 0.3))], "criteria_uid string, file_idx string, group_rank int, place int, scaled double, hit_id int")
    assert [round(r["clamped"], 2) for r in clamped_scores(hits).orderBy("group_rank").collect()] == [0.6, 0.59, 0.3]


def test_context_window_against_brute_force(spark):
    rng = random.Random(1)
    passages = [(f, i, rng.choice([None, "", f"{f}{i}"])) for f in "ab" for i in rng.sample(range(60), 40)]
    asked = [(f, i, rng.randint(0, 3), rng.randint(0, 3)) for f, i, _ in passages] + [("z", 1, 1, 1)]
    p = spark.createDataFrame(passages, "file_idx string, match_idx int, match_text string")
    h = spark.createDataFrame(asked, "file_idx string, match_idx int, b int, a int")
    got = {(r[0], r[1]): r[4] for r in context_window(h, p, "b", "a", most=3, block=7).select("file_idx", "match_idx", "b", "a", "context").collect()}
    for f, i, b, a in asked:
        expected = " ".join(t for g, j, t in sorted(passages, key=lambda x: x[1]) if g == f and i - b <= j <= i + a and t)
        assert got[f, i] == expected


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(None, 3), (70, 70), (1, 2), (1, 2)]
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a int, b int")).collect()))
    nodes = {x for e in edges for x in e if None not in e}
    least = {}
    for x in sorted(nodes):
        least.setdefault(find(x), x)
    assert got == {x: least[find(x)] for x in nodes}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(edges).select("component").distinct().collect()[0][0] == 0


def test_unsettled_components_are_an_error(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=1).count()


def test_running_sums_and_ranks(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "x", None]), i, rng.randint(0, 5), float(rng.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(data, "g string, id int, w int, v double").withColumn("key", F.xxhash64("id"))
    got = running_sum_by_hash(df, ["g"], "key", ["id"], "w", "before", bits=3).collect()
    unsigned = lambda k: k % 2**64
    for r in got:
        earlier = sum(o["w"] for o in got if o["g"] == r["g"] and (unsigned(o["key"]) >> 61, o["key"], o["id"]) < (unsigned(r["key"]) >> 61, r["key"], r["id"]))
        assert r["before"] == earlier
    ranks = {(r[0], r[1]): r[2] for r in average_ranks(df.where("g is not null"), ["g"], "v", "rank").collect()}
    for g, _, _, v in data:
        if g:
            own = [x[3] for x in data if x[0] == g]
            assert ranks[g, v] == sum(x > v for x in own) + (own.count(v) + 1) / 2


def test_lookup_join_salted_equals_broadcast(spark, monkeypatch):
    big = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
    table = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    plain = rows(lookup_join(big, table, "k", "id").select("k", "id", "name"))
    monkeypatch.setattr("gleaner.operators.joins.BROADCAST_ROWS", 1)
    assert rows(lookup_join(big, table, "k", "id").select("k", "id", "name")) == plain


def test_as_of_and_range_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 9, "c")], "k int, t int, v string")
    assert rows(as_of_join(left, right, "k", "t", "t", ["v"])) == sorted([(1, 5, "b"), (1, 1, None), (2, 3, None)], key=str)
    points = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, x double")
    ranges = spark.createDataFrame([("a", 2.0, 13.0), ("b", 5.0, 6.0), ("c", 9.0, 3.0)], "r string, lo double, hi double")
    got = {(r["id"], r["r"]) for r in range_join(points, ranges, "x", "lo", "hi", 4.0).collect()}
    assert got == {(i, "a") for i in range(2, 13)} | {(5, "b")}


def test_gram_weights():
    assert [S.gram_weight(n) for n in (1, 2, 3)] == [1.0, 0.37, 0.14]
    assert [S.gram_weight(n, 2) for n in (1, 2, 3)] == [2.0, 0.74, 0.27]
    assert math.isclose(S.FieldStats(10, 5.0, {"a": 2}).idf("a"), math.log(1 + 8.5 / 2.5))
