"""Retrieval against brute force, heads on a problem with a known answer."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelscope.operators import features as fe
from labelscope.operators import grams as gr
from labelscope.operators import heads as he
from labelscope.operators import retrieval as rt
from tests.test_known_values import ngrams

WORDS = "refund card lost bank transfer pending top up cash limit".split()


def texts(n, start=0):
    return [(i, " ".join(WORDS[(i * j + j * j) % len(WORDS)] for j in range(1, 4 + i % 5))) for i in range(start, start + n)]


def brute_force(queries, pool, k):
    counts = {i: Counter(ngrams(t, 3, 5)) for i, t in pool}
    df = Counter(g for c in counts.values() for g in c)
    idf = {g: math.log((1 + len(pool)) / (1 + d)) + 1 for g, d in df.items() if d >= 2}

    def vector(c):
        w = {g: n * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    vectors = {i: vector(c) for i, c in counts.items()}
    out = set()
    for q, t in queries:
        v = vector(Counter(ngrams(t, 3, 5)))
        sims = [(-round(sum(x * p.get(g, 0) for g, x in v.items()), 8), i) for i, p in vectors.items()]
        out |= {(q, i, rank) for rank, (s, i) in enumerate(sorted(sims)[:k], 1) if s < 0}
    return out


@pytest.mark.parametrize(("block_terms", "common"), [(60, 0.0), (300, 0.15), (400_000, 2.0)])
def test_top_k_is_exact_however_it_is_blocked(spark, block_terms, common):
    pool, queries = texts(60), texts(17, 100) + [(200, "zzzz"), (201, "")]
    as_df = lambda t: spark.createDataFrame(t, "id bigint, text string")
    lists = gr.gram_lists(as_df(pool), "id")
    fitted = gr.fit(lists, 3, 5)
    asked = gr.weighted(gr.gram_lists(as_df(queries), "id"), fitted, "id")
    got = rt.top_k(asked, gr.weighted(lists, fitted, "id"), "id", 4, block_terms, common)
    assert {(r["query"], r["pool"], r["rank"]) for r in got.collect()} == brute_force(queries, pool, 4)


def test_top_k_of_nothing_and_of_named_texts(spark):
    named = spark.createDataFrame([(f"t{i}", t) for i, t in texts(30)], "id string, text string")
    got = rt.retrieve(named, named, "id", 1).collect()
    assert {r["query"] for r in got} == {f"t{i}" for i in range(30)} and all(r["sim"] == pytest.approx(1.0) for r in got)
    none = named.filter("1 = 0")
    assert rt.retrieve(none, named, "id", 1).collect() == [] and rt.retrieve(named, none, "id", 1).collect() == []


def test_grams_and_weights_equal_the_long_tables(spark, monkeypatch):
    odd = [(900, None), (901, ""), (902, " \t\n"), (903, "a"), (904, "a bb  CCC"), (905, "Ünïcode 漢字 😀x"), (906, "x" * 3_000), (903, "a")]
    df = spark.createDataFrame(texts(40) + odd, "id bigint, text string")
    for low, high in ((2, 5), (3, 5), (4, 6)):
        got = {(r.id, g, c) for r in gr.gram_lists(df, "id", low=low, high=high).collect() for g, c in zip(r.grams, r.tfs)}
        want = Counter((r.id, r.tf) for r in fe.term_counts(df.dropDuplicates(["id"]), "id", "text", low, high).collect())
        assert Counter((i, c) for i, _, c in got) == want
    lists = gr.gram_lists(df, "id", low=2, high=4)
    for sublinear in (False, True):
        fitted = gr.fit(lists, 2, 4, 2, sublinear)
        sent = sorted((r.id, r.grams, [round(x, 9) for x in r.weights]) for r in gr.weighted(lists, fitted, "id").collect())
        monkeypatch.setattr(gr, "BROADCAST_TERMS", 0)
        joined = sorted((r.id, r.grams, [round(x, 9) for x in r.weights]) for r in gr.weighted(lists, fitted, "id").collect())
        monkeypatch.setattr(gr, "BROADCAST_TERMS", 4_000_000)
        assert sent == joined and len(sent) == len(texts(40) + odd)
        with pytest.raises(ValueError):
            gr.gram_lists(df, "id", low=1)


def test_weights_have_unit_length(spark):
    df = spark.createDataFrame(texts(30), "id bigint, text string")
    w = fe.tfidf_weights(fe.fit_tfidf(df, "id"), df, "id")
    for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect():
        assert r["s"] == pytest.approx(1.0)


def featured(spark, rows, low=2, high=5):
    df = spark.createDataFrame(rows, "id bigint, text string, label bigint")
    lists = gr.gram_lists(df, "id", low=low, high=high)
    fitted = gr.fit(lists, low, high, sublinear=True)
    return df, he.gram_features(lists, fitted, "id").join(df, "id"), fitted


THREE = [(i, f"{WORDS[i % 3]} please {i % 7}", i % 3 if i % 3 < 2 else 3) for i in range(90)]


def test_head_learns_and_absent_class_is_zero(spark):
    df, features, fitted = featured(spark, THREE)
    data = he.as_vectors(features, fitted.size)
    head, scores = he.select_head(data, data, 4, grid=(1.0, 10.0), max_iter=50)
    got = he.predict(head, data, 4).collect()
    assert all(r["pred"] == r["label"] for r in got)
    assert all(r["probs"][2] == 0.0 and sum(r["probs"]) == pytest.approx(1.0) for r in got)
    assert head.c == 1.0 and set(scores) == {1.0, 10.0}
    raw = {r["id"]: r for r in he.score_texts(head, fitted, df, "id", 4).collect()}
    for r in got:
        assert raw[r["id"]]["probs"] == pytest.approx(r["probs"], abs=1e-9) and raw[r["id"]]["pred"] == r["pred"]


def test_every_term_has_a_place_of_its_own(spark):
    _, features, fitted = featured(spark, THREE)
    terms, _ = fitted.arrays()
    assert len(set(terms.tolist())) == len(terms) == fitted.size
    used = {i for r in features.collect() for i in r["indices"]}
    assert used == set(range(fitted.size))
    vectors = {r["id"]: r["features"] for r in he.as_vectors(features, fitted.size).collect()}
    for r in features.collect():
        assert vectors[r["id"]].indices.tolist() == r["indices"] and vectors[r["id"]].values.tolist() == r["values"]


def test_sweep_equals_fits_over_terms(spark):
    """Heads of a sweep, fitted in coordinates of their rows, against Spark's fit over all terms."""
    noisy = [(i, t + f" {WORDS[(i * 7) % 10]}", (y + (i % 11 == 0)) % 4) for i, t, y in THREE]
    _, features, fitted = featured(spark, noisy)
    grid = features.withColumn("seed", F.col("id") % 2).withColumn("training_size", F.lit(45))
    vectors = he.as_vectors(features.withColumn("seed", F.col("id") % 2), fitted.size)
    for c in (0.1, 10.0):
        heads = he.sweep(grid, features, 4, c_grid=(c,))
        probs = {(r["seed"], r["id"]): r["probs"] for r in he.sweep_probabilities(heads, features, 4, "id", part_bytes=10_000).collect()}
        assert len(probs) == 180
        for seed in (0, 1):
            fit = he.fit_head(vectors.filter(F.col("seed") == seed), c, tol=1e-10)
            for r in he.predict(fit, vectors, 4).collect():
                assert probs[seed, r["id"]] == pytest.approx(r["probs"], abs=2e-4)
    both = he.sweep(grid, features, 4, c_grid=(10.0, 0.1)).collect()
    assert len(both) == 2
    for h in both:
        assert set(h["val_scores"]) == {0.1, 10.0} and h["n_classes_seen"] == 4
        assert h["c"] == (10.0 if h["val_scores"][10.0] > h["val_scores"][0.1] else 0.1)


def test_sweep_over_dense_vectors(spark):
    import random

    draw = random.Random(2)
    rows = [(i, i % 3, [float(i % 3 == k) + draw.gauss(0, 0.2) for k in range(5)]) for i in range(60)] + [(60, 1, None), (61, 2, [])]
    df = he.dense_features(spark.createDataFrame(rows, "id bigint, label bigint, v array<float>"), "v")
    by_id = {r["id"]: r for r in df.collect()}
    assert by_id[60]["indices"] == [] and by_id[61]["values"] == []
    assert sum(x * x for x in by_id[0]["values"]) == pytest.approx(1.0)
    cells = df.withColumns({"training_size": F.lit(62), "seed": F.lit(0)})
    probs = {r["id"]: r["probs"] for r in he.sweep_probabilities(he.sweep(cells, df, 3, c_grid=(1.0,)), df, 3, "id").collect()}
    vectors = he.as_vectors(df.drop("v"), 5)
    for r in he.predict(he.fit_head(vectors, 1.0, tol=1e-10), vectors, 3).collect():
        assert probs[r["id"]] == pytest.approx(r["probs"], abs=2e-4)


def test_sweep_of_one_class_and_of_texts_without_terms(spark):
    rows = [(1, 7, 0, 2, [], []), (2, 7, 0, 2, [0], [1.0]), (3, 7, 1, 0, [], []), (4, 7, 1, 1, [], [])]
    grid = spark.createDataFrame(rows, "id bigint, training_size int, seed int, label bigint, indices array<int>, values array<double>")
    heads = he.sweep(grid, grid, 3)
    got = {(r["seed"], r["id"]): r["probs"] for r in he.sweep_probabilities(heads, grid, 3, "id").collect()}
    assert got[0, 1] == [0.0, 0.0, 1.0] and got[1, 1] == pytest.approx([0.5, 0.5, 0.0])
    assert he.sweep(grid.filter("1 = 0"), grid, 3).count() == 0


def test_selection_prefers_the_more_regularised(spark):
    scores = spark.createDataFrame([(0.1, 0.5), (1.0, 0.899), (10.0, 0.9), (100.0, 0.9)], "c double, macro_f1 double")
    assert he.smallest_good_c(scores).first()["c"] == 10.0
    assert he.smallest_good_c(scores, 0.01).first()["c"] == 1.0


def test_text_without_known_terms_keeps_its_row(spark):
    pool = spark.createDataFrame(texts(10), "id bigint, text string")
    fitted = gr.fit(gr.gram_lists(pool, "id", low=2), 2, 5)
    unseen = spark.createDataFrame([(100, "qqqq"), (101, "refund card")], "id bigint, text string")
    found = he.as_vectors(he.gram_features(gr.gram_lists(unseen, "id", low=2), fitted, "id"), fitted.size)
    got = {r["id"]: r["features"].numNonzeros() for r in found.collect()}
    assert got[100] == 0 and got[101] > 0


def test_terms_are_counted_exactly_by_key_without_a_shuffle_of_terms(spark, monkeypatch):
    wide = "".join(chr(0x4E00 + i) for i in range(9_000))  # an alphabet whose 5-grams overflow 64 bits
    rows = [*texts(30), (3, "refund  again\tA b"), (None, "no key"), (None, "no key twice"), (70, None), (71, " "), (72, wide + " 😀 " + wide[::-1])]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(5)
    for low, high in ((2, 5), (3, 5), (4, 4)):
        want = {}
        for i, t in rows:
            want.setdefault(i, Counter()).update(ngrams(t or "", low, high))
        got = fe.term_counts(df, "id", "text", low, high)
        assert {(r.id, r.term): r.tf for r in got.collect()} == {(i, g): n for i, c in want.items() for g, n in c.items()}
    counts = fe.stored_counts(df, "id")
    fitted = fe.fit_tfidf(df, "id", counts=counts)
    as_set = lambda w, name: {(r["id"], r[name], round(r["weight"], 9)) for r in w.collect()}
    for name in ("term", "term_id"):
        plain, stored = fe.tfidf_weights(fitted, df, "id", name=name), fe.tfidf_weights(fitted, df, "id", name=name, counts=counts)
        assert stored._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
        shown = plain._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in shown and "Window" not in shown
        got = as_set(plain, name)
        monkeypatch.setattr(fe, "BROADCAST_TERMS", 0)
        assert got == as_set(stored, name) == as_set(fe.tfidf_weights(fitted, df, "id", name=name), name) == as_set(
            fe.tfidf_weights(fitted, df, "id", name=name, counts=counts), name)
        monkeypatch.setattr(fe, "BROADCAST_TERMS", 4_000_000)
