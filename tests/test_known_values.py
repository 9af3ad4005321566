"""Small inputs whose results are known by hand."""

import json

import pytest
from pyspark.sql import functions as F

from labelscope.functions import pricing as pr
from labelscope.functions.scoring import argmax, label_budget
from labelscope.functions.text import char_ngrams
from labelscope.operators import audits as au
from labelscope.operators import calls as ca
from labelscope.operators import costs as co
from labelscope.operators import ensemble as en
from labelscope.operators import metrics as m
from labelscope.operators import replies as re_
from labelscope.operators import resample as rs
from labelscope.operators import splits as sp
from labelscope.operators.quantiles import exact_percentiles
from labelscope.sources import datasets as ds
from labelscope.sources import store as st
from labelscope.streaming import ingest as ig


def rows(df):
    return [tuple(r) for r in df.collect()]


def one_call(spark, model="claude-sonnet-4-6"):
    n = 1_000_000
    return spark.createDataFrame(
        [(0, "call-0", model, n, n, 0, 0)] * 3,
        "run_index int, call_id string, model string, input_tokens bigint, output_tokens bigint, "
        "cache_read_input_tokens bigint, cache_creation_input_tokens bigint")


def test_a_call_is_billed_once_and_batch_is_half(spark):
    sync = co.measured_cost(one_call(spark), pr.price_table(spark), batch=False).first()
    batch = co.measured_cost(one_call(spark), pr.price_table(spark), batch=True).first()
    assert (sync["input_tokens"], sync["n_predictions"], sync["total_usd"]) == (1_000_000, 3, 18.0)
    assert batch["total_usd"] == 9.0
    assert sync["usd_per_1k_predictions"] == 6000.0


def test_unpriced_model_has_an_error_and_no_cost(spark):
    got = co.measured_cost(one_call(spark, "unknown"), pr.price_table(spark), batch=False).first()
    assert got["error"] and got["total_usd"] is None


def test_latency_is_a_percentile_per_call(spark):
    log = spark.createDataFrame(
        [(0, f"c{i}", ms) for i, ms in enumerate([100.0, 200.0, 300.0, 400.0, 5000.0]) for _ in range(2)],
        "run_index int, call_id string, latency_ms double")
    got = co.latency_summary(log, "run_index", "call_id").first()
    assert got["n_calls"] == 5 and got["p50_ms"] == 300.0
    empty = log.withColumn("latency_ms", F.lit(None).cast("double"))
    assert co.latency_summary(empty, "run_index", "call_id").count() == 0


def test_percentiles_of_many_rows_match_the_built_in(spark):
    df = spark.range(150_000).select(F.pow(F.pmod(F.col("id") * 7919, F.lit(99991)), F.lit(1.5)).alias("v"))
    df = df.withColumn("v", F.when(F.col("v") < 9e6, F.lit(1.0)).otherwise(F.col("v")))  # a third are ties
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.95, "e": 0.99, "f": 1.0}
    got = exact_percentiles(df, "v", probs).first()
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()]))).first()[0]
    assert [got[n] for n in probs] == pytest.approx(want, rel=1e-12)


def test_percentiles_by_narrowing_brackets(spark):
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.95, "e": 0.999, "f": 1.0}
    wide = F.when(F.col("id") == 0, -1.7e308).when(F.col("id") == 1, 1.7e308).when(F.col("id") % 3 == 0, 7.0)
    df = spark.range(30_000).select(
        (F.col("id") % 2).alias("k"), wide.otherwise(F.pow(F.pmod(F.col("id") * 7919, F.lit(99991)), F.lit(1.5)) - 4e6).alias("v"))
    for keys in ([], ["k"]):
        want = {r[0]: r[1] for r in df.groupBy(*(keys or [F.lit(0).alias("k")])).agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()]))).collect()}
        for most in (3, 500):
            got = exact_percentiles(df, "v", probs, keys, most=most).collect()
            assert len(got) == len(want)
            for r in got:
                assert [r[n] for n in probs] == pytest.approx(want[r["k"] if keys else 0], rel=1e-12)


def test_run_disagreement(spark):
    runs = spark.createDataFrame(
        [("a", 0, "x", 2), ("a", 0, "a", 3), ("a", 0, None, 1), ("b", 0, "y", 1), ("a", 1, "x", 1), ("b", 1, "z", 1), ("b", 1, "y", 2),
         ("c", 0, "x", 1), ("c", 1, None, 1)],
        "row_id string, run_index int, pred string, arrival int")
    got = m.run_variance(runs, "row_id", "run_index", "pred", "arrival").first()
    assert (got["n_complete"], got["n_dropped"], got["disagreement"]) == (2, 1, 0.5)


def test_resampling_is_the_same_in_any_number_of_leaves(spark):
    import random

    import numpy as np

    draw = random.Random(4)
    data = [(draw.randrange(9), draw.randrange(9), draw.randrange(9)) for _ in range(3_000)]
    cells = rs.outcome_cells(spark.createDataFrame(data, "y int, a int, b int"), "y", ("a", "b")).withColumn("multiset", F.lit(0))
    reps = spark.range(700).select(F.lit(0).alias("multiset"), F.col("id").alias("rep"))
    for mode in ("bootstrap", "swap"):
        got = [sorted(tuple(r) for r in rs.resample_cells(cells, ("a", "b"), 9, reps, 3, mode, leaf_cells=n).collect()) for n in (10_000, 100, 7)]
        assert len(got[0]) == 700 and got[0] == got[1] == got[2]
    n = np.array([5, 1, 30, 14, 50])
    h = np.sort(np.array([1, 2**63 + 5, 2**63 + 6, 2**62, 2**64 - 1], dtype=np.uint64))
    w = rs._spread([1, 0], h, n, 0, np.full(40_000, 100))
    assert (w.sum(axis=1) == 100).all()
    assert w.mean(axis=0) == pytest.approx(n, rel=0.05) and w.var(axis=0) == pytest.approx(n * (1 - n / 100), rel=0.05)
    assert np.cov(w[:, 2], w[:, 4])[0, 1] == pytest.approx(-30 * 50 / 100, rel=0.1)
    same = rs._spread([1, 0], np.array([7, 7, 7], dtype=np.uint64), np.array([10, 30, 60]), 0, np.full(20_000, 100))
    assert same.mean(axis=0) == pytest.approx([10, 30, 60], rel=0.05)


def test_cells_are_logged_and_found_without_their_data(spark, tmp_path):
    import pathlib

    path = str(tmp_path / "cells")
    rows = spark.range(6_000).select("id", (F.col("id") % 3).alias("training_size"), (F.col("id") % 2).cast("int").alias("seed"))
    st.write_cells(rows, path)
    st.write_cells(rows.filter("training_size = 1 and seed = 0 and id < 600"), path)
    log = {(r["training_size"], r["seed"]): r for r in st.cell_log(spark, path).collect()}
    assert {k: r["rows"] for k, r in log.items()} == {(n, s): 100 if (n, s) == (1, 0) else 1_000 for n in range(3) for s in range(2)}
    for (n, s), r in log.items():
        files = list(pathlib.Path(path).glob(f"training_size={n}/seed={s}/*.parquet"))
        assert len(files) == r["files"] and sum(f.stat().st_size for f in files) == r["bytes"]
    assert spark.read.parquet(path).count() == 5_100
    grid = st.discover_grid(spark, path)
    assert grid.inputFiles() and all("/_log/" in f for f in grid.inputFiles())
    assert {r["training_size"]: r["seeds"] for r in grid.collect()} == {n: [0, 1] for n in range(3)}
    assert st.write_cells(rows.filter("1 = 0"), path) == path and st.cell_log(spark, path).count() == 6


def test_large_cell_is_written_by_many_tasks(spark, tmp_path):
    path, was = str(tmp_path / "cells"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        one = spark.range(0, 60_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("x"), F.lit(1).alias("training_size"), F.lit(0).alias("seed"))
        st.write_cells(one, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    assert st.cell_log(spark, path).first()["files"] > 4


def test_short_batched_reply_keeps_its_gap(spark):
    calls = spark.createDataFrame([("call-0", ["r0", "r1", "r2"]), ("call-1", ["r3"])], "custom_id string, row_ids array<string>")
    reply = json.dumps({"predictions": [
        {"id": 1, "intent": "age_limit"}, {"id": 3, "intent": "atm_support"}, {"id": 3, "intent": "late"},
        {"id": 9, "intent": "stray"}, {"id": "2", "intent": "text id"}]})
    results = spark.createDataFrame([("call-0", reply, "end_turn")], "custom_id string, text string, stop_reason string")
    got = re_.parse_batched(calls, results).orderBy("row_id").collect()
    assert [r["pred_intent"] for r in got] == ["age_limit", None, "atm_support", None]
    assert [r["error"] for r in got] == [None, re_.NOT_IN_REPLY, None, re_.NO_RESULT]


def test_refusal_is_a_null_with_a_reason(spark):
    calls = spark.createDataFrame([("c", ["r"])], "custom_id string, row_ids array<string>")
    results = spark.createDataFrame([("c", '{"intent": "x"}', "refusal")], "custom_id string, text string, stop_reason string")
    got = re_.parse_single(calls, results).first()
    assert got["pred_intent"] is None and got["error"] == "refusal"


def test_bad_and_repeated_results_keep_one_row_per_request(spark):
    calls = spark.createDataFrame([("c", ["r0", "r1"])], "custom_id string, row_ids array<string>")
    first = '{"predictions": [7, null, "x", {"id": 3000000000, "intent": "far"}, {"id": 0, "intent": "z"}, {"id": 1, "intent": "a"}]}'
    results = spark.createDataFrame([("c", '{"predictions": []}', 2), ("c", first, 1)], "custom_id string, text string, arrival int")
    assert sorted(rows(re_.parse_batched(calls, results).select("row_id", "pred_intent", "error"))) == [
        ("r0", "a", None), ("r1", None, re_.NOT_IN_REPLY)]
    single = calls.withColumn("row_ids", F.slice("row_ids", 1, 1))
    twice = spark.createDataFrame([("c", None), ("c", '{"intent": "b"}'), ("c", '{"intent": "b"}')], "custom_id string, text string")
    assert rows(re_.parse_single(single, twice).select("row_id", "pred_intent", "error")) == [("r0", "b", None)]


def test_tolerant_parse_stages(spark):
    items = '[{"id": 1, "intent": "a"}]'
    texts = [items, f"```json\n{items}\n```", f"Here: {items} done", "nothing", "```\n[oops]\n```", f'{items[:-1]}', '[1, {"id": 2}]']
    got = re_.parse_tolerant(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()
    assert [r["note"] for r in got] == [None, re_.FENCE_WARNING, re_.ARRAY_WARNING, re_.NOT_FOUND, re_.FENCE_INVALID, re_.NOT_FOUND, None]
    assert [r["parsed"] is not None for r in got] == [True, True, True, False, False, False, True]
    flags = [r["is_object"] for r in re_.reply_items(spark.createDataFrame([(texts[6],)], "parsed string")).collect()]
    assert flags == [False, True]


def test_orders(spark):
    df = spark.range(600).select("id", (F.col("id") % 6).alias("label"))
    blocked = ca.order_rows(df, "id", "blocked")
    assert au.order_audit(blocked, "label", ["pos"], 6, 0.5).first()["transitions"] == 5
    shuffled = ca.order_rows(df, "id", "shuffled", 3)
    audit = au.order_audit(shuffled, "label", ["pos"], 6, 0.5).first()
    assert audit["transitions"] > 0.9 * audit["expected_random"] and audit["verdict"] == "shuffled"
    assert rows(shuffled.orderBy("pos")) == rows(ca.order_rows(df.repartition(7), "id", "shuffled", 3).orderBy("pos"))
    assert au.same_rows(df, shuffled, ("id", "label")).first()["same"]
    assert sorted(r["pos"] for r in shuffled.collect()) == list(range(1, 601))
    named = df.select(F.concat(F.lit("test:"), F.col("id").cast("string")).alias("id"), "label").repartition(5)
    places = ca.order_rows(named, "id", "blocked").orderBy("pos").collect()
    assert [(r["label"], r["id"]) for r in places] == sorted((r["label"], r["id"]) for r in places)
    assert [r["pos"] for r in places] == list(range(1, 601))
    with pytest.raises(ValueError):
        ca.order_rows(df, "id", "sorted")


def test_chunks_cover_each_row_once(spark):
    df = spark.range(310).select("id", F.lit("t").alias("text"))
    for per_call, calls in ((1, 310), (150, 3)):
        chunks = ca.chunk_calls(ca.order_rows(df, "id", "shuffled", 1), per_call, "id")
        ids = [i for r in chunks.collect() for i in r["row_ids"]]
        assert chunks.count() == calls and sorted(ids) == list(range(310))


def test_absent_class_scores_zero_and_counts(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, None)], "y int, pred int")
    cells = m.confusion(df, "y", "pred")
    assert m.macro_f1(cells, 3).first()[0] == pytest.approx(0.8 / 3, abs=1e-6)
    assert m.macro_f1(cells, None).first()[0] == pytest.approx(0.4, abs=1e-6)
    assert m.scores(cells, 3).first()["n_missing"] == 1


def predictions(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("row_id"), (i % 4).alias("y"),
        F.when(i % 9 == 0, (i + 1) % 4).otherwise(i % 4).alias("a"),
        F.when(i % 3 == 0, (i + 2) % 4).otherwise(i % 4).alias("b"))


def test_permutation_p_values(spark):
    p = predictions(spark)
    assert rs.paired_permutation(p, "y", "a", "a", 4, 200).first()["p_value"] == 1.0
    by_cell = rs.paired_permutation(p, "y", "a", "b", 4, 400).first()
    by_row = rs.permutation_by_hash(p, "y", "a", "b", "row_id", 4, 400, 42).first()
    assert by_cell["observed_diff"] == by_row["observed_diff"]
    assert by_cell["p_value"] == pytest.approx(1 / 401, abs=0.01) and 0 < by_row["p_value"] < 0.02


def test_cell_and_row_bootstraps_agree(spark):
    p = predictions(spark, 2000)
    cell = rs.paired_bootstrap(p, "y", "a", "b", 4, replicates=800, observed=False).first()
    reps = rs.poisson_bootstrap(p, "y", "a", "b", "row_id", 4, 800, 7)
    q = reps.agg(F.percentile(F.col("a") - F.col("b"), F.array(F.lit(0.025), F.lit(0.975)))).first()[0]
    assert (cell["ci_lower"], cell["ci_upper"]) == pytest.approx(tuple(q), abs=0.006)
    assert cell["ci_lower"] < cell["observed_diff"] < cell["ci_upper"]


def test_bootstrap_does_not_depend_on_partitioning(spark):
    p = predictions(spark)
    a = rs.paired_bootstrap(p, "y", "a", "b", 4, replicates=100).first()
    assert a == rs.paired_bootstrap(p.repartition(5), "y", "a", "b", 4, replicates=100).first()


def votes(spark, strength):
    i = F.col("id")
    probs = F.array(*[F.when(i % 3 == k, F.lit(strength)).otherwise(F.lit(0.1) * ((i + k) % 4)).cast("double") for k in range(3)])
    grid = F.array(*[F.struct(F.lit(n).alias("training_size"), F.lit(s).alias("seed")) for n in (10, 20) for s in (0, 1, 2)])
    return spark.range(300).select(i.alias("row_id"), (i % 3).alias("y"), (i % 3).alias("b"), F.inline(grid), probs.alias("probs"))


def test_crossover_never_and_always(spark):
    never = rs.crossover_interval(votes(spark, 0.0), "b", (10, 20), (0, 1, 2), 3, replicates=40).first()
    assert never["never_share"] == 1.0 and never["median_n"] is None
    always = rs.crossover_interval(votes(spark, 5.0), "b", (10, 20), (0, 1, 2), 3, replicates=40).first()
    assert (always["never_share"], always["median_n"], always["distribution"]) == (0.0, 10, "10:40,20:0")
    hashed = rs.seed_row_replicates_by_hash(votes(spark, 5.0), "b", (10, 20), (0, 1, 2), 3, 8, 1)
    assert rs.crossover_summary(rs.crossovers(hashed, (10, 20)), (10, 20)).first()["median_n"] == 10


def test_resampling_ignores_the_number_of_parts_it_is_read_in(spark):
    p = predictions(spark)
    keyed = p.withColumn("arm", F.col("row_id") % 2)
    got = [sorted(rows(rs.paired_permutation(x, "y", "a", "b", 4, 100, keys=["arm"]))) for x in (keyed, keyed.repartition(9))]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [0, 1] and all(r[3] == 100 for r in got[0])
    crossed = [rs.crossover_interval(v, "b", (10, 20), (0, 1, 2), 3, replicates=40).first()
               for v in (votes(spark, 0.2), votes(spark, 0.2).repartition(7))]
    assert crossed[0] == crossed[1]


def test_an_absent_cell_of_votes_is_named(spark):
    ragged = votes(spark, 1.0).filter("not (training_size = 20 and seed = 2 and row_id = 5)")
    with pytest.raises(Exception, match="no votes for budget 20, seed 2"):
        en.multiset_counts(ragged, [(0, (1, 1, 1))], 3, (10, 20), (0, 1, 2)).collect()


def test_multisets_cover_every_draw():
    sets = en.seed_multisets(range(5))
    assert len(sets) == 126 and sum(w for _, _, w in sets) == 5**5


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "p array<double>")
    assert df.select(argmax("p")).first()[0] == 1


def test_label_budget_counts_validation(spark):
    assert spark.range(1).select(label_budget(F.lit(50))).first()[0] == 550


def ngrams(text, low, high):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(low, high + 1):
            if n >= len(w):
                out.append(w)
                break
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return sorted(out)


@pytest.mark.parametrize("text", ["", "a", "I am  here\n", "Straße über ÉTÉ", "ab abc abcd abcde", "x y z\x1cw　v"])
@pytest.mark.parametrize("low,high", [(2, 5), (3, 5)])
def test_ngrams_follow_the_definition(spark, text, low, high):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert sorted(df.select(char_ngrams("text", low, high)).first()[0]) == ngrams(text, low, high)
    from labelscope.operators.features import term_counts
    counted = {r["term"]: r["tf"] for r in term_counts(df, "id", "text", low, high).collect()}
    assert sum(counted.values()) == len(ngrams(text, low, high)) and set(counted) == set(ngrams(text, low, high))


def test_split_validation(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 0), (2, "b", 5)], "id int, text string, label int").write.parquet(path)
    data = ds.Dataset("d", ("x", "y"), {"test": ds.SplitSource(path, "id"), "bad": ds.SplitSource(path, "nope")})
    for split, error in (("test", ValueError), ("bad", ValueError), ("none", KeyError)):
        with pytest.raises(error):
            data.load_split(spark, split)
    with pytest.raises(KeyError):
        ds.Registry([data]).get("other")


def test_vocabulary_and_glosses(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("first\n\nsecond\n")
    (tmp_path / "g.json").write_text(json.dumps({"_note": "x", "glosses": {"first": "one", "second": "two"}}))
    voc = ds.read_vocabulary(spark, str(tmp_path / "labels.txt"))
    assert rows(voc.orderBy("label")) == [(0, "first"), (1, "second")]
    full = ds.require_glosses(voc, ds.read_glosses(spark, str(tmp_path / "g.json")))
    assert rows(full.orderBy("label")) == [(0, "first", "one"), (1, "second", "two")]
    assert rows(ca.label_block(full, glosses=True)) == [("- first: one\n- second: two",)]
    (tmp_path / "h.json").write_text(json.dumps({"first": "one"}))
    with pytest.raises(ValueError):
        ds.require_glosses(voc, ds.read_glosses(spark, str(tmp_path / "h.json")))


def test_out_of_scope_needs_exactly_one_class(spark):
    data = spark.createDataFrame([(1, 0), (2, 1)], "id int, label bigint")
    voc = ds.vocabulary_table(spark, ["oos", "a"])
    kept, held, left = ds.hold_out_class(data, voc, ["oos"])
    assert [r["label"] for r in kept.collect()] == [0] and held.count() == 1 and rows(left) == [(0, "a")]
    with pytest.raises(ValueError):
        ds.hold_out_class(data, voc, ["missing"])


def test_gold_keys_must_be_unique(spark):
    gold = spark.createDataFrame([("a", 1), ("a", 2)], "row_id string, y int")
    with pytest.raises(ValueError):
        re_.join_gold(gold.select("row_id"), gold)


def test_subsets_nest_and_are_balanced(spark):
    pool = spark.range(500).select("id", F.when(F.col("id") < 170, 0).when(F.col("id") < 480, 1).otherwise(2).alias("label"))
    grid = sp.subset_grid(pool, "label", "id", (10, 50, 900), (0, 1), n_classes=3)
    got = {}
    for r in grid.collect():
        got.setdefault((r["training_size"], r["seed"]), set()).add(r["id"])
    assert {k: len(v) for k, v in got.items()} == {(10, 0): 10, (10, 1): 10, (50, 0): 50, (50, 1): 50}
    assert got[10, 0] < got[50, 0] and got[50, 0] != got[50, 1]
    labels = {r["label"]: r["count"] for r in grid.filter("training_size = 50 and seed = 0").groupBy("label").count().collect()}
    assert max(labels.values()) - min(labels.values()) <= 1


def test_hot_class_ranks(spark):
    """Two thirds of the rows in one class: ranks are still 1..n in hash order."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5 + 1).alias("label"))
    from labelscope.functions.ordering import order_hash, rank_in_group
    got = rank_in_group(df, ["label"], "id", 1, digits=2)
    hot = got.filter("label = 0").withColumn("h", order_hash(1, "id")).orderBy("h").collect()
    assert [r["rank"] for r in hot] == list(range(1, 2001))
    assert rows(rank_in_group(df, ["label"], "id", 1, limit=4, n_groups=6).orderBy("label", "rank")) == \
        rows(got.filter("rank <= 4").orderBy("label", "rank"))


def test_reply_limits():
    assert ca.max_tokens(1) == 112 and ca.max_tokens(10_000) == 16000


def test_train_subset_follows_the_table(spark):
    ordered = spark.range(1, 21).select("id", F.lit(3).alias("seed"), F.col("id").alias("pos"))
    assert ds.load_train_subset(ordered, 7, 3).count() == 7
    for n, seed in ((0, 3), (21, 3), (5, 4)):
        with pytest.raises(ValueError):
            ds.load_train_subset(ordered, n, seed)


def test_request_body_closes_the_label_set(spark):
    names = F.array(F.lit("a"), F.lit("b"))
    for per_call in (1, 3):
        body = json.loads(spark.range(1).select(ca.request_body(F.lit("s"), F.lit("u"), names, "m", per_call)).first()[0])
        schema = body["output_config"]["format"]["schema"]
        one = schema if per_call == 1 else schema["properties"]["predictions"]["items"]
        assert one["properties"]["intent"]["enum"] == ["a", "b"] and schema["additionalProperties"] is False


def test_standard_prices():
    assert pr.standard_price(False) == pytest.approx(0.00525) and pr.standard_price(True) == pytest.approx(0.00147)
    assert int(pr.FIXED_MONTHLY // pr.standard_price(False)) == 68571


def test_probe_verdicts(spark):
    truth = spark.createDataFrame([(i, "a") for i in range(1, 11)], "id bigint, intent string")
    voc = ds.vocabulary_table(spark, ["a", "b"])
    say = lambda names: spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "id bigint, intent string")
    verdict = lambda names: au.probe_verdict(truth, say(names), voc, 8).first()["verdict"]
    assert verdict(["a"] * 9 + ["b"]) == "pass"
    assert verdict(["a"] * 9 + ["zzz"]) == "fail_hallucinated"
    assert verdict(["a"] * 9) == "warn_format"
    assert verdict(["b"] * 10) == "warn_accuracy"


def test_drift_of_a_class_missing_on_one_side(spark):
    a = spark.createDataFrame([("x",)] * 3, "label string")
    b = spark.createDataFrame([("x",), ("y",)], "label string")
    assert au.class_drift(a, b, "label").first()["kl"] == pytest.approx(0.693147, abs=1e-5)


def test_stream_drops_repeats_across_runs(spark, tmp_path):
    calls = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "custom_id string")
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = ig.reply_stream(spark, str(folder), "custom_id string, text string")
        return ig.ingest(stream, calls, str(tmp_path / "sink"), str(tmp_path / "progress"))

    (folder / "1.json").write_text('{"custom_id":"c1","text":"a"}\n{"custom_id":"c2","text":"b"}\n{"custom_id":"zz","text":"stray"}\n')
    assert run().count() == 2
    (folder / "2.json").write_text('{"custom_id":"c2","text":"again"}\n{"custom_id":"c3","text":"c"}\n')
    got = run()
    assert sorted(r["text"] for r in got.collect()) == ["a", "b", "c"]
    assert ig.pending(calls, got).count() == 0


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([(50, 0, 1, "old"), (50, 1, 1, "kept")], "training_size int, seed int, at int, v string")
    new = spark.createDataFrame([(50, 0, 2, "new")], old.schema)
    got = st.upsert(old, new, ("training_size", "seed"), ("at",))
    assert sorted(r["v"] for r in got.collect()) == ["kept", "new"]


def test_run_is_written_whole(spark, tmp_path):
    manifest = st.run_manifest(spark, run_id="r", n_rows=3, models=["b", "a"], discount=0.5, dry=False)
    path = st.write_run(str(tmp_path / "run"), spark.range(3), manifest, spark.range(1))
    assert spark.read.parquet(f"{path}/predictions").count() == 3
    assert spark.read.json(f"{path}/manifest").first()["n_rows"] == 3


def test_votes_that_are_missing_or_repeated_raise(spark):
    votes = [(0, 1, 50, 0, [1.0, 0.0]), (0, 1, 50, 1, [0.0, 3.0])]
    columns = "row_id int, y int, training_size int, seed int, probs array<double>"

    def gathered(rows_, seeds):
        return en.gathered_votes(spark.createDataFrame(rows_, columns), [50], seeds, ["row_id"], "probs", ["y"]).collect()

    assert [list(r["_v"]) for r in gathered(votes[::-1], [0, 1])] == [[1.0, 0.0, 0.0, 3.0]]
    with pytest.raises(Exception, match="no votes for budget 50, seed 2"):
        gathered(votes, [0, 1, 2])
    with pytest.raises(Exception, match="twice"):
        gathered([*votes, votes[0]], [0, 1])


def test_whole_matrix_and_verdict_run_at_full_counts(spark):
    from labelscope.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    whole = {(r.arm, r.training_size): r for r in QUERIES["i7_whole_matrix"](spark, sf).collect()}
    assert set(whole) == {(arm, n) for arm in range(5) for n in (50, 100, 250, 500)}
    assert {r.n_replicates for r in whole.values()} == {10_000}
    for r in QUERIES["i7_test_matrix"](spark, sf).collect():  # the hash form: two arms, 32 draws
        full = whole[r.arm, r.training_size]
        assert full.observed_diff == r.observed_diff and abs(full.p_value - r.p_value) < 0.3
    (found,) = QUERIES["i6_bootstrap_verdict"](spark, sf).collect()
    favours = "a_better" if found.ci_lower > 0 else "b_better" if found.ci_upper < 0 else "not_significant"
    assert found.n_replicates == 5000 and found.verdict == favours
