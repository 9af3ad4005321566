"""What larger tables need: folders of files, no task for a class, no stored features of every row."""

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelscope.operators import ensemble as en
from labelscope.operators import grams as gr
from labelscope.operators import heads as he
from labelscope.operators import resample as rs
from labelscope.operators import retrieval as rt
from labelscope.plans import exchanging as ex
from labelscope.plans import inputs
from labelscope.plans import resampling as plans
from labelscope.sources import datasets as ds
from labelscope.streaming import ingest as ig


def test_replies_stream_from_a_file_or_a_folder_of_files(spark, tmp_path):
    rows = spark.createDataFrame(
        [(c, t, "system" if t == 0 else "user", f"{c} {t}") for c in range(6) for t in range(4)],
        "conv_id bigint, turn bigint, role string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "conversations.parquet")
    for folder in ("many", "one"):
        got = ex.streamed_replies(spark, str(tmp_path / folder)).collect()
        assert {r["custom_id"] for r in got} == {f"turn-{c}-{t}" for c in range(6) for t in range(1, 4)} and len(got) == 18


def test_nothing_streamed_is_an_empty_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    calls = spark.createDataFrame([("a",)], "custom_id string")
    stream = ig.reply_stream(spark, str(tmp_path / "in"), "custom_id string, text string")
    got = ig.ingest(stream, calls, str(tmp_path / "sink"), str(tmp_path / "progress"))
    assert got.columns == ["custom_id", "text"] and got.collect() == []


def test_rows_of_a_split_are_not_brought_together_by_class(spark):
    table = spark.range(1_000).select("id", F.lit("t").alias("text"), F.lit("en").alias("lang"))
    voc = ds.vocabulary_table(spark, ("de", "en"))
    rows = ds.labelled_rows(table, voc, "s", ds.SplitSource("", "id", label="lang", named=True))
    assert rows.count() == 1_000 and "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def _texts(spark, n, start=0):
    words = "refund card lost bank transfer pending top up cash limit".split()
    rows = [(i, " ".join(words[(i * j + j * j) % len(words)] for j in range(1, 4 + i % 5)), i % 3) for i in range(start, start + n)]
    return spark.createDataFrame([*rows, (start + n, "", 0), (start + n + 1, None, 1)], "id bigint, text string, label bigint")


def test_features_in_one_pass_are_those_by_way_of_lists(spark):
    train, rows = _texts(spark, 40), _texts(spark, 25, 100)
    fitted = gr.fit(gr.gram_lists(train, "id", low=2, high=4), 2, 4, 2, True)
    want = {r.id: (list(r.indices), list(r["values"])) for r in he.gram_features(gr.gram_lists(rows, "id", low=2, high=4), fitted, "id").collect()}
    once = he.text_features(rows, fitted)
    assert once.columns == ["id", "label", "indices", "values"] and "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (list(r.indices), list(r["values"])) for r in once.collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1])
    for r in he.text_features(rows, fitted, vectors=True).collect():
        assert r.features.size == fitted.size and list(r.features.indices) == want[r.id][0]


def test_heads_sent_to_the_rows_score_as_heads_met_by_block(spark):
    train, rows = _texts(spark, 40), _texts(spark, 25, 100)
    lists = gr.gram_lists(train, "id", low=2, high=4)
    fitted = gr.fit(lists, 2, 4, 2, True)
    cells = train.drop("text").join(he.gram_features(lists, fitted, "id"), "id").withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    grid = cells.withColumn("training_size", F.lit(10)).filter("id % 2 = seed or id < 8")
    heads = he.sweep(grid, cells.filter("seed = 0 and id < 9"), 3).cache()
    scored = lambda **how: {(r.seed, r.id): (r.y, list(r.probs)) for r in he.sweep_probabilities(heads, rows, 3, "id", fitted=fitted, **how).collect()}
    sent, met = scored(), scored(head_bytes=0)
    assert sent.keys() == met.keys() and len(sent) == 54
    for k in met:
        assert sent[k][0] == met[k][0] and sent[k][1] == pytest.approx(met[k][1], abs=1e-9)
    plain = he.sweep_probabilities(heads, he.text_features(rows, fitted), 3, "id")
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    assert {(r.seed, r.id): list(r.probs) for r in plain.collect()} == {k: p for k, (_, p) in sent.items()}


def test_arms_meet_their_ensemble_without_the_driver(spark):
    rows = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") % 5).alias("y"))
    seeds = rows.withColumn("training_size", F.lit(50)).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    votes = seeds.withColumn("probs", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: ((F.col("row_id") * (k + 1) + F.col("seed")) % 7).cast("double")))
    both = plans._arms(votes)
    assert both.count() == 100
    both.collect()
    assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key_type", ["bigint", "string"])
def test_few_queries_find_what_blocks_find(spark, key_type):
    pool, queries = (_texts(spark, *n).drop("label").withColumn("id", F.col("id").cast(key_type)) for n in ((60,), (17, 100)))
    queries = queries.unionByName(spark.createDataFrame([("300", "zzzz")], "id string, text string").withColumn("id", F.col("id").cast(key_type)))
    rows = lambda **how: {(r["query"], r["pool"], r["rank"], r["sim"]) for r in rt.retrieve(queries, pool, "id", 4, **how).collect()}
    few = rows()
    assert few == rows(few_terms=0) and len(few) == 68


def test_few_queries_store_no_grams(spark, monkeypatch):
    stored, kept = [], rt._kept
    monkeypatch.setattr(rt, "_kept", lambda df, name: stored.append((name, df.columns)) or kept(df, name))
    rt.retrieve(_texts(spark, 5, 100), _texts(spark, 30), "id", 2).collect()
    assert stored == [("pool-texts", ["id", "text"])]


def test_many_queries_take_little_more_disk_than_their_texts(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j * j + 7 * j) % 997}" for j in range(1, 200))) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    pool, queries, stored, kept = df.filter("id < 50"), df.filter("id >= 50"), [], rt._kept

    def recorded(made, name):
        written = kept(made, name)
        stored.append(sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in written.inputFiles()))
        return written

    monkeypatch.setattr(rt, "_kept", recorded)
    near = rt.retrieve(queries, pool, "id", 2, few_terms=0, block_terms=20_000)
    assert near.count() == 2 * queries.count()
    assert sum(stored) < 4 * sum(len(t) for _, t in rows)
    shown = near._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange") == 1 and "CartesianProduct" in shown  # rows of results only


def test_votes_are_put_together_before_they_are_shuffled_and_taken_once(spark, monkeypatch):
    rows = [(i, i % 3, (i * 7) % 4 - 1, n, s, [float((i * (k + 2) * (s + 1) + n) % 5) for k in range(3)])
            for i in range(40) for n in (10, 20) for s in (0, 1, 2)]
    votes = spark.createDataFrame(rows, "row_id bigint, y bigint, b bigint, training_size bigint, seed bigint, probs array<double>").coalesce(1)
    placed = votes.withColumn("_at", F.lit(0))
    assert en._neighbours(placed, ["row_id"], ["y"], "probs").count() == 40
    sets = [(m, times) for m, times, _ in en.seed_multisets((0, 1, 2))]
    found = lambda df, by=("y", "b"): Counter({tuple(r)[:-1]: r.n for r in en.multiset_counts(df, sets, 3, (10, 20), (0, 1, 2), by=by).collect()})
    want = Counter()
    for m, times in sets:
        for i in range(40):
            own = [[sum(times[s] * r[5][k] for r in rows if r[0] == i and r[3] == n for s in [r[4]]) for k in range(3)] for n in (10, 20)]
            want[(m, i % 3, (i * 7) % 4 - 1, *(x.index(max(x)) for x in own))] += 1
    assert found(votes) == want == found(votes.repartition(4, "seed"))
    monkeypatch.setattr(en, "HELD_CELLS", 1)
    assert found(votes) == want
    far = found(votes.withColumn("y", F.col("y") + 1_000))  # classes that no digit holds
    assert far == Counter({(m, y + 1_000, *rest): n for (m, y, *rest), n in want.items()})
    taken, counts = [], rs.multiset_counts
    monkeypatch.setattr(rs, "multiset_counts", lambda *a, **k: taken.append(1) or counts(*a, **k))
    gaps = rs.hierarchical_gaps(votes, "b", (10, 20), (0, 1, 2), 3, replicates=30).collect()
    assert len(gaps) == 2 and len(taken) == 1
    seen = rs.observed_curve(votes, "b", (10, 20), (0, 1, 2), 3).first()
    assert {r.training_size: r.observed_diff for r in gaps} == {n: round(seen[f"n{n}"] - seen["base"], 6) for n in (10, 20)}


def _written_blocks(spark, rows, limit):
    lists = gr.gram_lists(spark.createDataFrame(rows, "id bigint, text string").coalesce(1), "id", "text", 3, 5)
    weighed = gr.weighted(lists, gr.fit(lists, 3, 5, 1), "id").select("id", "grams", "weights")
    found = rt._packed(weighed, "bigint", limit, rt._of_lists, False).orderBy("block").toArrow().to_batches()
    return [rt._Stored(b, i, "", None, False) for b in found for i in range(b.num_rows)]


def _in_two_languages(n, start=0):
    syllables = ["ba do ki lu me".split(), "xyr qov wuz jix vyw".split()]
    word = lambda own, a: own[a % 5] + own[a // 5 % 5] + own[a // 25 % 5]
    return [(start + i, " ".join(word(syllables[i % 2], (start + i + 1) * j * j + 3 * j) for j in range(1, 40 + i % 7))) for i in range(n)]


def test_unlike_texts_are_in_other_blocks_and_not_multiplied(spark, monkeypatch):
    pool, queries = _written_blocks(spark, _in_two_languages(60), 3_000), _written_blocks(spark, _in_two_languages(40, 100), 3_000)
    assert len(pool) > 2 and all(len({i % 2 for i in b.ids}) == 1 for b in [*pool, *queries])
    terms = np.unique(np.concatenate([b.terms for b in queries]))
    asked, cells, product = [rt._Asked(b, terms, 2, 0.03) for b in queries], [], rt._similarities
    monkeypatch.setattr(rt, "_similarities", lambda *a: cells.append(0) or (lambda r: cells.append(r[0].size) or r)(product(*a)))
    axes = rt._axes(asked, len(terms))
    for own in asked:
        own.along(axes)
    for block in pool:
        placed = rt._Placed(block, terms)
        placed.along(axes)
        for own in asked:
            own.look(placed)
    weights = lambda blocks: {i: {g: w for g, w, d in zip(np.repeat(b.terms, b.times), b.weight, b.doc) if d == n}
                              for b in blocks for n, i in enumerate(b.ids)}
    of_pool, of_queries = weights(pool), weights(queries)
    for own in asked:
        for q, best in zip(own.ids, own.found):
            sims = [(-round(sum(w * of_pool[p].get(g, 0) for g, w in of_queries[q].items()), 8), p) for p in of_pool]
            assert best == sorted(s for s in sims if s[0])[:2]
    assert sum(cells) < 0.75 * 60 * 40


def test_a_block_goes_to_a_task_once_not_with_every_pair(spark, monkeypatch):
    def counted(k, common, key_type, sent, sublinear):
        def run(batches):
            held = list(batches)
            if held:  # a task may have no query block
                rows = pa.Table.from_batches(held)
                sent = [len(rows) - rows.column(c).null_count for c in ("p_terms", "q_terms")]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*sent, len(rows)), (pa.int64(), pa.int64(), pa.float64()))],
                                                 names=["query", "pool", "sim"])

        return run

    stored, kept = [], rt._kept
    monkeypatch.setattr(rt, "_kept", lambda df, name: stored.append(kept(df, name)) or stored[-1])
    monkeypatch.setattr(rt, "_searched", counted)
    pool, queries = (spark.createDataFrame(_in_two_languages(60, a), "id bigint, text string") for a in (0, 100))
    found = rt.retrieve(queries, pool, "id", 1_000, few_terms=0, block_terms=1_000).collect()  # a row a task
    p, q = (df.count() for df in stored)
    tasks = len(found)
    assert tasks * p < p * q and p > 5
    assert sum(r["sim"] for r in found) == p * q and sum(r["query"] for r in found) == tasks * p and sum(r["pool"] for r in found) == q


def test_texts_are_not_shuffled_to_their_labels(spark, tmp_path, monkeypatch):
    rows = [(i if i < 40 else None, f"t{i}", "en", "s") for i in range(42)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i,) for i in (*range(0, 40, 3), 3)], "doc_id bigint").write.parquet(str(tmp_path / "labels.parquet"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (inputs.BROADCAST_IDS, 3):  # ids are sent, or joined where they are too many
            monkeypatch.setattr(inputs, "BROADCAST_IDS", most)
            sides = inputs.split_documents(spark, str(tmp_path))
            assert [len(df.collect()) for df in sides] == [14, 28]
            plans = [df._jdf.queryExecution().executedPlan().toString() for df in sides]
            assert all(("BroadcastHashJoin" in p and "hashpartitioning" not in p) == (most > 3) for p in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
