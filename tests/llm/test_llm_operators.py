"""Each operator against brute force on small tables with nulls, ties, repeated rows and clashing names."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
import regex
from conftest import rows
from pyspark.sql import functions as F

from gleaner.llm.clusters import density_peaks, described, joined_clusters, text_clusters, vector_clusters
from gleaner.llm.forest import candidates, fit_trees, nearest_of_all, pairs_in_block, similar_vectors, unit, visit_order, weights_of_near
from gleaner.llm.line_frequency import line_frequency
from gleaner.llm.mixing import Leaf, full_total, mix, mix_report, plan_budgets
from gleaner.llm.packing import pack, shortest_pack_first
from gleaner.llm.rank_fusion import beta_tail, fuse_rankings, significance, significance_of_firsts
from gleaner.llm.repetition import repetition
from gleaner.llm.set_join import _pairs_of_runs, block_keys, similar_sets
from gleaner.llm.term_stats import keyword_of, marked_terms, term_frequencies
from gleaner.llm.tokens import token_counts
from gleaner.llm.top_n import LoserTree, top_n


# 1


def test_terms_against_brute_force(spark):
    rng = random.Random(1)
    words = "Ab ab CD été x1y2 z_z".split()
    texts = [(i, rng.choice([None, "", "12 - 3", " ".join(rng.choices(words, k=6))]), "t", 5) for i in range(60)] + [(None, "ab", "t", 5)]
    df = spark.createDataFrame(texts + texts[:20], "id long, v string, term string, records int")
    expected = {}
    for i, v, *_ in texts:
        if i is not None:
            for w in regex.findall(r"\p{L}+", (v or "").lower()):
                expected.setdefault(w, []).append(i)
    for flush in (1, 1000):
        got = {r[0]: (r[1], r[2]) for r in term_frequencies(df, "id", "v", "words", flush).collect()}
        assert got == {w: (len(i), len(set(i))) for w, i in expected.items()}
    assert term_frequencies(df.limit(0), "id", "v", "words").count() == 0


def test_marks(spark):
    df = spark.createDataFrame([(i, ["a", "a"] if i < 3 else ["b"] if i < 5 else None) for i in range(10)], "id long, k array<string>")
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in marked_terms(df, "id", "k", "keywords", "f", 2, 30).collect()}
    assert got == {"a": (6, 3, "common"), "b": (2, 2, "rare")}


@pytest.mark.parametrize(
    "raw, term",
    [(" Loan \t Balance ", "loan balance"), ("not: x y", "x y"), ('NOT:"x y"', "x y"), ("“x”", "x"), ("été", "été"), ("a b", "a b"), ("not:", ""), ("'x", "'x"), ("", "")],
)
def test_keywords(raw, term):
    assert keyword_of(raw) == term


# 2


def test_loser_tree_sorts():
    rng = random.Random(2)
    for n in range(0, 12):
        runs = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 6))) for _ in range(n)]
        at, out = [0] * n, []
        key = lambda r: runs[r][at[r]] if at[r] < len(runs[r]) else None
        tree = LoserTree([key(r) for r in range(n)])
        while n and tree.keys[tree.winner()] is not None:
            r = tree.winner()
            out.append(runs[r][at[r]])
            at[r] += 1
            tree.advance(key(r))
        assert out == sorted(x for r in runs for x in r)


def test_top_n_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", "é", None]), rng.randint(0, 40), rng.choice([None, math.nan, 0.0, -0.0, 1.5, -2.0, 3.0]), 1) for _ in range(500)]
    data = list({(g, i): (g, i, s, x) for g, i, s, x in data}.values())
    df = spark.createDataFrame(data + data[:100], "g string, i int, s double, rank int").repartition(7)
    expected = []
    for g in {d[0] for d in data} - {None}:
        own = sorted((-s, i) for h, i, s, _ in data if h == g and s is not None and not math.isnan(s))[:4]
        expected += [(g, i, -s + 0.0, n + 1) for n, (s, i) in enumerate(own)]
    assert rows(top_n(df, "g", "i", "s", 4, run_rows=50)) == sorted(expected, key=str)
    assert top_n(df.limit(0), "g", "i", "s", 4).count() == 0


# 3


def brute_clusters(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(ids, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in ids}


def test_text_clusters_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    texts = []
    for i in range(150):
        if texts and rng.random() < 0.6:
            words = (rng.choice(texts)[1] or "wa").split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.sample(vocabulary, rng.randint(6, 14))
        texts.append((i, rng.choice([" ".join(words)] * 9 + [None]), "c"))
    texts += [(200 + i, "Same eight words as one long text here now", "c") for i in range(30)]
    df = spark.createDataFrame(texts + texts[:30] + [(None, "x " * 9, "c")], "id long, t string, rep string")
    sets = {i: s for i, t, _ in texts if t and len(s := set(t.lower().split())) >= 8}
    expected = brute_clusters(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]))
    clusters = text_clusters(df, "id", "t")
    got = {r["id"]: r["cluster"] for r in clusters.collect()}
    assert got == {i: c for i, c in expected.items() if list(expected.values()).count(c) > 1}
    sizes = {r["first_id"]: r["size"] for r in described(clusters).collect()}
    assert sizes == {c: list(expected.values()).count(c) for c in set(got.values())}
    members, links, classes = similar_sets(df, "id", "t")
    assert classes is None
    rep = dict(map(tuple, members.collect()))
    assert {(r["a"], r["b"]) for r in links.collect()} == {
        tuple(sorted((rep[a], rep[b]))) for a, b in combinations(sets, 2) if rep[a] != rep[b] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])
    }
    assert text_clusters(df.limit(0), "id", "t").count() == 0


def test_texts_that_differ_in_one_word_make_no_pairs(spark, monkeypatch):
    """Many texts of one pattern, some of which have other neighbours, too: the clusters and densities are those of all pairs."""
    monkeypatch.setattr("gleaner.llm.set_join.CLASS_SETS", 20)
    monkeypatch.setattr("gleaner.llm.set_join.LONG_RUN", 30)
    letters = lambda i: f"x{chr(97 + i // 26)}{chr(97 + i % 26)}"
    pattern = "this is the same lease of one house".split()
    texts = [" ".join([*pattern, letters(i)]) for i in range(120)]
    texts += [" ".join([*pattern[:7], letters(i), "more"]) for i in range(0, 120, 3)] + [" ".join([*pattern, letters(5), letters(6)])] + texts[:10]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sets = {i: frozenset(t.split()) for i, t in enumerate(texts)}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])
    members, links, classes = similar_sets(df, "id", "t")
    assert classes.count() >= 120 and links.count() < 2500
    expected = brute_clusters(sets, alike)
    got = {r["id"]: r for r in text_clusters(df, "id", "t").collect()}
    assert {i: r["cluster"] for i, r in got.items()} == {i: c for i, c in expected.items() if list(expected.values()).count(c) > 1}
    assert all(r["density"] == sum(alike(i, j) for j in sets) for i, r in got.items())
    plain = {(r["id"], r["cluster"], r["density"]) for r in got.values()}
    monkeypatch.setattr("gleaner.llm.set_join.CLASS_SETS", 10**9)
    assert plain == {(r["id"], r["cluster"], r["density"]) for r in text_clusters(df, "id", "t").collect()}


def test_block_keys_meet():
    rng = random.Random(5)
    share = {w: rng.random() for w in range(30)}
    for _ in range(300):
        a = rng.sample(range(30), rng.randint(8, 14))
        b = sorted(set(a) - set(rng.sample(a, 1)) | {rng.randrange(30)})
        if len(set(a) & set(b)) < 0.75 * len(set(a) | set(b)):
            continue
        for block in (0, 5, 10**9):
            keys = []
            for s in (a, b):
                ordered = sorted(s, key=lambda w: (share[w], w))
                keys.append(set(block_keys([share[w] for w in ordered], ordered, math.ceil(0.75 * len(s)), 100, block)))
            assert keys[0] & keys[1]


def test_long_runs_lose_no_pair(monkeypatch):
    rng = np.random.default_rng(6)
    n = 60
    bits = rng.integers(0, 2**20, n).astype(np.uint64)
    bits[::2] = bits[1::2] ^ np.uint64(3)
    key, row, size = np.zeros(n, np.uint64), np.arange(n), np.full(n, 20, np.uint16)
    pairs = lambda: {tuple(p) for part in _pairs_of_runs(key, row, bits, size, 0.75) for p in part}
    short = pairs()
    monkeypatch.setattr("gleaner.llm.set_join.LONG_RUN", 10)
    assert pairs() == short and len(short) >= n / 2


def test_density_peaks(spark):
    links = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.2), (3, 4, 0.3)], "a long, b long, distance double")
    weights = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 5), (9, 1)], "id long, weight long")
    got = {r["id"]: (r["density"], r["parent"], r["peak"]) for r in density_peaks(links, weights).collect()}
    assert got == {1: (2, 2, 4), 2: (3, 3, 4), 3: (7, None, 3), 4: (6, 3, 3), 9: (1, None, 9)} or got[2][1] == 3 and got[9] == (1, None, 9)
    assert got[1][0] == 2 and got[2][0] == 3 and got[3][0] == 7 and got[4][0] == 6
    assert {got[i][2] for i in (1, 2, 3, 4)} == {3}


# 5


def vectors(n=400, d=64, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 :] = x[: n - n // 2] + 0.2 * rng.normal(size=(n - n // 2, d))
    return x * rng.uniform(0.1, 9, size=(n, 1))


def test_similar_vectors_recall_and_exactness(spark, monkeypatch):
    monkeypatch.setattr("gleaner.llm.forest.LEAF_ROWS", 32)
    x = vectors()
    bad = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [0.0] * 64), (1004, [math.nan] * 64), (1005, [None] * 64), (None, [1.0] * 64)]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(data + data[:50] + bad, "query_id long, v array<float>").withColumn("rank", F.lit(0))
    u = unit(x.astype(np.float32))
    c = u @ u.T
    np.fill_diagonal(c, -2)
    got = similar_vectors(df, "query_id", "v", k=5).collect()
    true = {(i, j) for i in range(len(c)) for j in np.argsort(-c[i], kind="stable")[:5]}
    found = {(r["id"], r["other"]) for r in got}
    assert len(found & true) / len(true) > 0.9 and len(found) == len(got) and max(r["rank"] for r in got) == 5
    assert all(abs(c[r["id"], r["other"]] - r["cosine"]) < 1e-4 for r in got)
    near = {(r["id"], r["other"]) for r in similar_vectors(df, "query_id", "v", k=5, min_cosine=0.9).collect()}
    wanted = {(i, j) for i, j in true if c[i, j] >= 0.9}
    assert len(near & wanted) >= 0.99 * len(wanted) and near <= wanted
    assert similar_vectors(df.limit(0), "query_id", "v").count() == 0


def test_neighbours_that_few_leaves_hold_are_found(spark, monkeypatch):
    monkeypatch.setattr("gleaner.llm.forest.LEAF_ROWS", 8)
    x = np.random.default_rng(7).normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "query_id long, v array<float>")
    c = unit(x) @ unit(x).T
    np.fill_diagonal(c, -2)
    true = {(i, int(j)) for i in range(len(c)) for j in np.argsort(-c[i], kind="stable")[:5]}
    found = {(r["id"], r["other"]) for r in similar_vectors(df, "query_id", "v", k=5).collect()}
    assert len(found) == 20000 and len(found & true) >= 0.95 * len(true)


def test_near_copies_of_a_third_of_the_rows_are_found(spark, monkeypatch):
    monkeypatch.setattr("gleaner.llm.forest.LEAF_ROWS", 8)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4500, 64))
    x[::3] = rng.normal(size=64) + 0.22 * x[::3]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "query_id long, v array<float>")
    c = unit(x) @ unit(x).T
    np.fill_diagonal(c, -2)
    true = {(i, int(j)) for i in range(len(c)) for j in np.argsort(-c[i], kind="stable")[:5] if c[i, j] >= 0.9}
    found = {(r["id"], r["other"]) for r in similar_vectors(df, "query_id", "v", k=5, min_cosine=0.9).collect()}
    assert len(true) > 7000 and len(found & true) >= 0.97 * len(true)


def test_many_copies_of_one_vector(spark):
    copies = spark.range(1500).select(F.col("id").alias("query_id"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("v"))
    got = similar_vectors(copies, "query_id", "v", k=3, min_cosine=0.9).collect()
    assert len(got) == 4500
    by = {}
    for r in got:
        by.setdefault(r["id"], set()).add(r["other"])
    assert by[700] == {0, 1, 2} and by[1] == {0, 2, 3}
    clusters = vector_clusters(copies, "query_id", "v").collect()
    assert len(clusters) == 1500 and {r["cluster"] for r in clusters} == {0}


def test_large_block_is_compared_whole(monkeypatch):
    monkeypatch.setattr("gleaner.llm.forest.BLOCK_ROWS", 50)
    x = unit(vectors(300).astype(np.float32))
    ids = np.arange(300)
    pairs = {(int(a), int(b)) for p in pairs_in_block(ids, x, ids, x, None, 0.9) for a, b in zip(p[0], p[1], strict=True)}
    c = x @ x.T
    assert pairs == {(i, j) for i in range(300) for j in range(300) if i != j and c[i, j] >= 0.9}


def test_branches_kept_by_level_give_the_first_leaves(monkeypatch):
    x = np.random.default_rng(5).normal(size=(1000, 16)).astype(np.float32)
    forest = fit_trees(x[:500], 3, 6, 1)
    x = x[500:]
    every = visit_order(x, forest, 3 * 64)
    narrow = lambda visits: visit_order(x, forest, visits)
    wide = narrow(20)
    monkeypatch.setattr("gleaner.llm.forest.WIDE_NODES", 1)
    deep = narrow(20)
    assert all(set(a) == set(b) for a, b in zip(wide[0], deep[0], strict=True))
    assert every[1].sum() == wide[1].sum() == deep[1].sum() == 3 * 500
    homes = lambda found: np.sort(found[0][found[1]].reshape(500, 3), axis=1)
    assert (homes(every) == homes(deep)).all() and (homes(wide) == homes(deep)).all()


def test_leaves_beyond_the_deepest_level_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr("gleaner.llm.forest.LEAF_ROWS", 8)
    monkeypatch.setattr("gleaner.llm.forest.MAX_DEPTH", 3)
    monkeypatch.setattr("gleaner.llm.forest.BLOCK_ROWS", 100)
    monkeypatch.setattr("gleaner.llm.forest.BUCKET_ROWS", 500)
    x = np.random.default_rng(7).normal(size=(2000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "query_id long, v array<float>")
    c = unit(x) @ unit(x).T
    np.fill_diagonal(c, -2)
    true = {(i, int(j)) for i in range(len(c)) for j in np.argsort(-c[i], kind="stable")[:5]}
    found = {(r["id"], r["other"]) for r in similar_vectors(df, "query_id", "v", k=5).collect()}
    assert len(found & true) >= 0.95 * len(true)


def test_dense_vectors_make_few_links(spark, monkeypatch):
    monkeypatch.setattr("gleaner.llm.forest.DENSE", 2)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 64))
    x[::3] = rng.normal(size=64) + 0.2 * x[::3]
    x[1::9] = x[0] + 0.25 * x[1::9]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<float>")
    c = unit(x) @ unit(x).T
    expected = brute_clusters(range(900), lambda a, b: c[a, b] >= 0.9)
    got = vector_clusters(df, "id", "v").collect()
    assert {r["id"]: r["cluster"] for r in got} == {i: k for i, k in expected.items() if list(expected.values()).count(k) > 1}
    found = candidates(df, "id", "v", 64, None, 0.9)[0].collect()
    links = sum(r["a"] != r["b"] for r in found)
    assert links < ((c >= 0.9).sum() - 900) / 4 and len(found) > links
    densest = max(got, key=lambda r: (r["density"], -r["id"]))["id"]
    assert (c[densest] >= 0.9).sum() > 0.8 * (c >= 0.9).sum(axis=1).max()


def test_dense_vectors_have_whole_densities(spark, monkeypatch):
    """Also where not all pairs are links, each copy of each neighbour counts once, whatever trees and blocks hold the pair."""
    monkeypatch.setattr("gleaner.llm.forest.DENSE", 2)
    monkeypatch.setattr("gleaner.llm.clusters.TILE_ROWS", 100, raising=False)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 64))
    x[::3] = rng.normal(size=64) + rng.uniform(0.1, 0.5, size=(300, 1)) * x[::3]
    x[1::9] = x[0] + 0.25 * x[1::9]
    x = x.astype(np.float32)
    copies = list(range(900)) + list(range(0, 900, 7)) + list(range(0, 450, 7))
    df = spark.createDataFrame([(i, x[v].tolist()) for i, v in enumerate(copies)], "id long, v array<float>")
    u = unit(x.astype(np.float64))
    near = u @ u.T >= 0.9
    assert any(r["a"] == r["b"] for r in candidates(df.where("id < 900"), "id", "v", 64, None, 0.9)[0].collect())
    density = near @ np.bincount(copies, minlength=900)
    parts = brute_clusters(range(900), lambda a, b: near[a, b])
    clusters = vector_clusters(df, "id", "v").collect()
    assert {(r["id"], r["rep"], r["cluster"], r["density"]) for r in clusters} == {(i, v, parts[v], density[v]) for i, v in enumerate(copies) if density[v] > 1}
    got = {r["first_id"]: r["typical_ids"] for r in described(vector_clusters(df, "id", "v")).collect()}
    assert got == {p: sorted((v for v in range(900) if parts[v] == p), key=lambda v: (-density[v], v))[:3] for p in {parts[v] for v in range(900) if density[v] > 1}}


def test_all_pairs_are_found_beyond_the_nearest(spark, monkeypatch):
    """Groups of eight nearly equal vectors, ten groups around one centre: the five nearest say nothing about the other groups."""
    monkeypatch.setattr("gleaner.llm.forest.LEAF_ROWS", 8)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(20, 64)), 80, axis=0) + 0.3 * np.repeat(rng.normal(size=(200, 64)), 8, axis=0) + 0.02 * rng.normal(size=(1600, 64))
    x = np.concatenate([x, rng.normal(size=(1600, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<float>")
    u = unit(x.astype(np.float64))
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)), strict=True)}
    found = {(r["a"], r["b"]) for r in candidates(df, "id", "v", 64, None, 0.9)[0].collect()}
    assert len(true) > 50_000 and true <= found


def test_farthest_of_all():
    x = unit(vectors(300).astype(np.float32))
    x = np.concatenate([x[:30] + 0.02 * s * x[30:60] for s in range(10)])
    x, ids = unit(x), np.arange(300)
    c = x @ x.T
    np.fill_diagonal(c, -2)
    for k in (2, 5):
        got = list(zip(*(v.tolist() for v in nearest_of_all(ids[:40], x[:40], ids, x, k, 0.9, True)), strict=True))
        expected = [(q, int(m)) for q in range(40) for m in sorted(np.flatnonzero(c[q] >= 0.9), key=lambda m: (c[q, m], m))[:k]]
        assert [(q, m) for q, m, _ in got] == expected and all(abs(c[q, m] - near) < 1e-6 for q, m, near in got)


def test_weights_of_near_at_the_floor():
    x = vectors(300)
    x = np.concatenate([x, x[:150] + 1e-4 * np.random.default_rng(2).normal(size=(150, 64))]).astype(np.float32)
    weights = np.arange(1, len(x) + 1, dtype=np.float64)

    def cosine(a, b):  # as Spark sums
        dot = lambda p, q: sum((float(s) * float(t) for s, t in zip(p, q, strict=True)), 0.0)
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    floor = cosine(x[3], x[303])  # a pair exactly at the floor
    got = weights_of_near(x[:5], x, weights, floor)
    assert got.tolist() == [sum(int(w) for w, other in zip(weights, x, strict=True) if cosine(own, other) >= floor) for own in x[:5]]
    assert weights_of_near(x[3:4], x[303:304], weights[:1], floor).tolist() == [1]
    assert weights_of_near(x[3:4], x[303:304], weights[:1], np.nextafter(floor, 2)).tolist() == [0]


def test_vector_clusters_against_brute_force(spark):
    x = vectors(120)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<float>")
    u = unit(x.astype(np.float32))
    expected = brute_clusters(range(120), lambda a, b: float(u[a] @ u[b]) >= 0.9)
    got = {r["id"]: r["cluster"] for r in vector_clusters(df, "id", "v").collect()}
    assert got == {i: c for i, c in expected.items() if list(expected.values()).count(c) > 1}


def test_peaks_that_touch_are_one_cluster(spark):
    links = spark.createDataFrame([(i, i + 1, 0.1) for i in range(1, 9)], "a long, b long, distance double")
    members = spark.createDataFrame([(i, i) for i in range(1, 12)] + [(50, 11)], "id long, rep long")
    got = {r["id"]: r["cluster"] for r in joined_clusters(links, members).collect()}
    assert got == {**{i: 1 for i in range(1, 10)}, 11: 11, 50: 11}


# 6


def test_beta_probabilities():
    r = np.linspace(0, 1, 11)
    assert np.allclose(beta_tail(r, 1, 1), r) and np.allclose(beta_tail(r, 2, 2), r**2)
    draws = np.sort(np.random.default_rng(8).uniform(size=(200_000, 4)), axis=1)
    for k in range(1, 5):
        assert abs((draws[:, k - 1] <= 0.3).mean() - beta_tail(np.array([0.3]), k, 4)[0]) < 0.01
    assert significance(np.array([[0.01, 0.01, 0.01, 1.0], [1.0, 1.0, 1.0, 1.0]])).argmin() == 0


def test_fusion_is_the_same_for_hot_groups_and_scales(spark):
    rng = random.Random(9)
    value = lambda: rng.choice([None, math.nan, 1.0, 2.0, rng.random()])
    data = [(rng.choice(["g", "g", "h", None]), f"f{rng.randint(0, 3)}", i, value(), value(), 1.0) for i in range(120)]
    df = spark.createDataFrame(data + data[:30], "g string, f string, i int, a double, b double, rho double")
    scores = {"a": F.col("a"), "b": F.col("b")}
    plain = fuse_rankings(df, "g", ["f", "i"], scores)
    key = lambda frame: rows(frame.select("g", "f", "i", "n_items", F.round("a_rank", 6), F.round("b_rank", 6), F.round("rho", 9), "position"))
    assert key(plain) == key(fuse_rankings(df, "g", ["f", "i"], scores, hot_rows=1))
    assert key(plain) == key(fuse_rankings(df, "g", ["f", "i"], {"a": F.col("a") * 1e6, "b": F.col("b")}))
    for r in plain.collect():
        own = [x for x in data if x[0] == r["g"]]
        assert r["n_items"] == len(own)
        a = next(x[3] for x in own if x[2] == r["i"])
        if a is None or math.isnan(a):
            assert r["a_rank"] is None
        else:
            values = [x[3] for x in own if x[3] is not None and not math.isnan(x[3])]
            assert r["a_rank"] == sum(v > a for v in values) + (values.count(a) + 1) / 2
    assert fuse_rankings(df.limit(0), "g", ["f", "i"], scores).count() == 0


# 7


def test_patterns_hold_every_item():
    rng = random.Random(10)
    for _ in range(50):
        capacity = rng.randint(1, 40)
        histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        patterns, packs = shortest_pack_first(histogram, capacity)
        filled, placed = [0] * packs, {n: [] for n in histogram}
        for length, rank, items, first in patterns.tolist():
            placed[length] += range(rank, rank + items)
            for p in range(first, first + items):
                filled[p] += length
        assert all(sorted(placed[n]) == list(range(histogram[n])) for n in histogram)
        assert all(0 < f <= capacity for f in filled)


def test_packing_is_whole(spark):
    rng = random.Random(11)
    sizes = [(i, rng.choice([0, None, 3, 3, 3, 3, 10, 20, rng.randint(1, 75)]), 1) for i in range(300)]
    df = spark.createDataFrame([*sizes, (None, 5, 1)], "doc_id long, n int, container int")
    got = pack(df, "doc_id", "n", 20).collect()
    filled = {}
    for i, n, _ in sizes:
        own = sorted((r["first_token"], r["n_tokens"]) for r in got if r["doc_id"] == i)
        assert sum(t for _, t in own) == (n or 0) and len(own) == max(1, math.ceil((n or 0) / 20))
        assert all(own[j][0] == 20 * j for j in range(len(own)))
    for r in got:
        if r["container"] is not None:
            filled[r["container"]] = filled.get(r["container"], 0) + r["n_tokens"]
        else:
            assert r["n_tokens"] == 0
    assert sorted(filled) == list(range(len(filled))) and max(filled.values()) <= 20
    assert sum(filled.values()) / (20 * len(filled)) > 0.9
    assert pack(df.limit(0), "doc_id", "n", 20).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>" * 3), (5, "word " * 50_000)], "doc_id long, text string")
    got = dict(map(tuple, token_counts(df, ["doc_id"], "text").collect()))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3 and got[5] >= 50_000


# 8


def test_shortages_go_to_siblings_first():
    leaves = [Leaf("a", "en", "a_1", 0.4, 10, 1), Leaf("a", "en", "a_2", 0.3, 1000, 1), Leaf("a", "de", "a_2", 0.1, 1000, 1), Leaf("b", "en", "b_1", 0.2, 1000, 1)]
    plan_budgets(leaves, 100)
    assert [round(x.budget) for x in leaves] == [10, 60, 10, 20]
    plan_budgets(leaves, 10_000)
    assert sum(x.budget for x in leaves) == 3010
    pair = [Leaf("a", "en", "a_1", 0.4, 10, 1), Leaf("b", "en", "b_1", 0.6, 1000, 1)]
    assert round(full_total(pair)) == 25


def test_mix_holds_shares_and_repeats(spark):
    rng = random.Random(12)
    docs = [(i, rng.choice(["Lease_A ", "lease_a", "lease_b", "esg_a", None]), rng.choice(["en", "EN-us", None]), rng.randint(0, 50)) for i in range(2000)]
    docs += [(5000 + i, "tiny_a", "fr", 40) for i in range(20)]
    df = spark.createDataFrame(docs + docs[:100], "doc_id long, source string, lang string, n_tokens long")
    targets = spark.createDataFrame([("m", "LEASE_A", 0.4, 2), ("m", "lease_b", 0.3, 1), ("m", "tiny_a", 0.2, 3), ("m", "none_a", 0.1, 2)], "mix_id string, source string, target_share double, max_repeats int")
    got = mix(df, targets)
    assert rows(got) == rows(mix(df.repartition(5), targets))
    report = {r["source"]: r for r in mix_report(got, targets).collect()}
    assert report["none_a"]["tokens"] == 0
    for source, share in (("lease_a", 0.4), ("lease_b", 0.3), ("tiny_a", 0.2)):
        # the share of the source without documents goes to those with room
        assert share - 0.01 < report[source]["reached_share"] < share / 0.9 + 0.05
    assert report["tiny_a"]["most_uses"] <= 3 and report["lease_b"]["most_uses"] <= 1 and report["lease_a"]["most_uses"] <= 2
    assert mix(df.limit(0), targets).count() == 0 and mix(df, targets.limit(0)).count() == 0
    fixed = mix_report(mix(df, targets, {"m": 1000}), targets)
    assert abs(fixed.agg(F.sum("tokens")).first()[0] - 1000) <= 60


# 9


def brute_repeated(text, k=8):
    words = regex.findall(r"\p{L}+", (text or "").lower())
    seen, marked = set(), set()
    for i in range(len(words) - k + 1):
        window = tuple(words[i : i + k])
        if window in seen:
            marked |= set(range(i, i + k))
        seen.add(window)
    return len(words), len(marked)


def test_repetition_against_brute_force(spark):
    rng = random.Random(13)
    texts = [None, "", "12 34", "a", "a " * 8, "a " * 9, "x " * 100_000, "Ab é " * 30]
    texts += [" ".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(60)]
    texts += [" ".join((s := rng.choices("abcdefgh", k=20)) + rng.choices("xyz", k=5) + s[:10]) for _ in range(20)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "a " * 20, 1.0)], "doc_id long, text string, share double")
    for chunk in (10, 10**6):
        got = {r["doc_id"]: (r["n_words"], r["n_repeated"]) for r in repetition(df, "doc_id", "text", 8, chunk).collect()}
        assert got == {i: brute_repeated(t) for i, t in enumerate(texts)}
    assert repetition(df.limit(0), "doc_id", "text").count() == 0


def test_line_frequency(spark):
    shared = "Page 1 of 9"
    data = [(i, "h", f"{shared}\r\nown line number{'x' * i} here") for i in range(4)]
    data += [(4, "h", "page 2 OF 7!"), (5, "other", "Page 3 of 3"), (6, None, None), (7, "h", ""), (8, "h", "1234\n--"), (None, "h", shared), (0, "h", data[0][2])]
    df = spark.createDataFrame(data, "doc_id long, host string, text string").withColumn("words", F.lit("x"))
    got = {r["doc_id"]: r for r in line_frequency(df, "doc_id", "host", "text", most_documents=3).collect()}
    assert set(got) == set(range(9))
    assert (got[0]["n_lines"], got[0]["n_removed"], got[0]["n_words"], got[0]["kept_words"], got[0]["rejected"]) == (2, 1, 6, 4, False)
    assert got[4]["rejected"] and got[4]["kept_share"] == 0 and not got[5]["rejected"]
    assert all(got[i]["kept_share"] == 1 and got[i]["n_lines"] == 0 for i in (6, 7, 8))
    assert line_frequency(df, "doc_id", "host", "text", most_documents=4).where("n_removed > 0").count() == 5
    assert line_frequency(df, "doc_id", "host", "text", most_documents=5).where("n_removed > 0").count() == 0
    assert line_frequency(df.limit(0), "doc_id", "host", "text").count() == 0


def test_what_a_language_leaves_over_goes_to_the_source(spark):
    """A source whose tokens lie nearly all in one document of one language still gives its share, from its other languages."""
    sizes = [(0, "one", "en", 5000)] + [(i, "one", "de", 10) for i in range(1, 60)] + [(100 + i, "two", "en", 10) for i in range(500)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, lang string, n_tokens long")
    targets = spark.createDataFrame([("m", "one", 0.1, 1), ("m", "two", 0.9, 1)], "mix_id string, source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mix_report(mix(df, targets, {"m": 4000}), targets).collect()}
    assert abs(report["one"]["reached_share"] - 0.1) < 0.01 and report["one"]["tokens"] == 400


def test_runs_keep_their_order_and_long_groups_are_skipped(spark, monkeypatch):
    rng = random.Random(12)
    data = [(f"g{rng.choice([0, 0, 0, rng.randint(1, 40)])}", i % 700, rng.choice([1.0, 2.0, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, item int, score double").repartition(4)
    best = {}
    for g, i, x in data:
        best.setdefault(g, {}).setdefault(i, x)
        best[g][i] = max(best[g][i], x)
    wanted = sorted((g, i, x, r) for g, own in best.items() for r, (i, x) in enumerate(sorted(own.items(), key=lambda p: (-p[1], p[0]))[:3], 1))
    assert sorted(rows(top_n(df, "g", "item", "score", 3, run_rows=50))) == wanted == sorted(rows(top_n(df, "g", "item", "score", 3)))


def test_who_leads_three_scores_is_significant(spark):
    rng = random.Random(13)
    data = [("g", "f", i, *((9.0, 9.0, 9.0, -9.0) if i == 5 else [rng.random() for _ in range(4)])) for i in range(9)]
    df = spark.createDataFrame(data, "g string, f string, i int, a double, b double, c double, d double")
    fused = fuse_rankings(df, "g", ["f", "i"], {x: F.col(x) for x in "abcd"})
    passed = {r["i"] for r in fused.where(F.col("rho") <= significance_of_firsts(F.col("n_items"), 3, 4)).collect()}
    assert 5 in passed and len(passed) < 4
