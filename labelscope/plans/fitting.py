"""Heads that learn the language of `documents` from whole texts.

The labelled side is the test set. Its texts are removed from the rest, a validation set is
carved by text, and what remains is the pool the budgets are drawn from. One head alone learns
from `LABELLED` rows of the pool; the vectoriser sees those rows, or the rows of all budgets.

Fitted heads have no SQL, except on one-hot features: there a weakly penalised head repeats the
shares of its training rows, so what it predicts is what they have most of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.functions.scoring import argmax
from labelscope.operators import ensemble as en
from labelscope.operators import grams as gr
from labelscope.operators import heads as he
from labelscope.operators import metrics as m
from labelscope.operators import splits as sp
from labelscope.plans.inputs import K, P_SQL, SIDES_SQL, f1_sql, predictions, split_documents, table
from labelscope.plans.registry import query
from labelscope.plans.scoring import CURVE_CTES, _single_runs
from labelscope.session import scratch_dir
from labelscope.sources.store import stack_cells

N_LANGS = 4
VAL_ROWS, DENSE_TEST = 60, 200
LABELLED = 1_000  # rows that a head of its own is fitted on
BUDGETS, SEEDS = (24, 80, 250, 500), (0, 1, 2, 3, 4)
LOW, HIGH = 2, 5


def _table(df, name):
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sides(spark, d):
    """(pool, val, test) as written tables."""
    test, rest = split_documents(spark, d)
    test, rest = (t.select("doc_id", "label", "text") for t in (test, rest))
    val, pool = sp.carve_by_text(sp.drop_leaked(rest, test), VAL_ROWS, "label", "doc_id", 42)
    parts = {"pool": pool, "val": val, "test": test}
    rows = _table(stack_cells([t.withColumn("split", F.lit(s)) for s, t in parts.items()]), "rows")
    return [rows.filter(F.col("split") == s).drop("split") for s in parts]


def _lists(rows):
    return gr.gram_lists(gr.spread(rows.select("doc_id", "text"), "doc_id"), "doc_id", "text", LOW, HIGH)


def _featured(rows, fitted):
    return rows.drop("text").join(he.gram_features(_lists(rows), fitted, "doc_id"), "doc_id")


def _met(rows):
    """Rows and the texts of their ids: rows that share an id meet all its texts, one without drops out."""
    return rows.drop("text").join(rows.select("doc_id", "text"), "doc_id")


def _prepared(spark, d):
    """(train, val, test) with vectors, texts of all three, and the vocabulary; the vectoriser sees
    the training rows only. Training and validation rows are bounded, and their vectors are
    written for the fit to read many times; the test rows are cut as they are scored."""
    pool, val, test = _sides(spark, d)
    train = _table(sp.round_robin(pool, "label", "doc_id", 0, limit=LABELLED, n_groups=N_LANGS), "train")
    fitted = gr.fit(_table(_lists(train), "grams"), LOW, HIGH, sublinear=True)
    rows = stack_cells([t.withColumn("split", F.lit(s)) for s, t in (("train", train), ("val", val))])
    vectors = he.as_vectors(_featured(rows, fitted), fitted.size)
    held = [vectors.filter(F.col("split") == s).drop("split") for s in ("train", "val")]
    return [*held, he.text_features(_met(test), fitted, vectors=True)], pool.unionByName(val).unionByName(test), fitted


@query("m1_logistic_head")
def logistic_head(spark, d):
    (train, _, test), _, _ = _prepared(spark, d)
    head = he.fit_head(train, 10.0)
    return he.predict(head, test, N_LANGS).select("doc_id", "label", "pred")


@query("m2_select_c")
def select_c(spark, d):
    (train, val, test), _, _ = _prepared(spark, d)
    head, _ = he.select_head(train, val, N_LANGS)
    scored = m.scores(m.confusion(he.predict(head, test, N_LANGS), "label", "pred"), N_LANGS)
    return scored.withColumn("c", F.lit(head.c))


@query("m2_selection_rule", f"""WITH {CURVE_CTES}, s AS (SELECT training_size, pow(10.0, seed - 1) AS c, macro_f1 FROM per_seed),
near AS (SELECT *, max(macro_f1) OVER (PARTITION BY training_size) AS best FROM s)
SELECT training_size, min(c)::DOUBLE AS c, arg_min(macro_f1, c) AS val_macro_f1 FROM near WHERE macro_f1 >= best - 0.002 GROUP BY 1""")
def selection_rule(spark, d):
    # Five seeds of a budget stand for five regularisation settings.
    runs = _single_runs(spark, d).withColumn("c", F.pow(F.lit(10.0), F.col("seed") - 1))
    return he.smallest_good_c(runs, 0.002, ["training_size"])


def _swept(grid, val, test, n_classes, key, fitted=None):
    """The heads of a grid of cells and what they say about the test rows, both written."""
    heads = _table(he.sweep(grid, val, n_classes), "heads")
    return heads, _table(he.sweep_probabilities(heads, test, n_classes, key, fitted=fitted), "probabilities")


def _reported(heads, probs, n_classes, key):
    """Per cell: the chosen setting, classes seen, test macro-F1, and the score of its budget's ensemble."""
    keys = ["training_size", "seed"]
    single = m.macro_f1(m.confusion(probs.select(*keys, "y", argmax("probs").alias("pred")), "y", "pred", keys), n_classes, keys)
    voted = en.soft_vote(probs, n_classes, keys=(key, "training_size"))
    ensemble = m.macro_f1(m.confusion(voted, "y", "pred", ["training_size"]), n_classes, ["training_size"], out="ensemble")
    tried = F.array_sort(F.map_entries("val_scores"))
    listed = F.array_join(F.transform(tried, lambda e: F.format_string("%.1f:%.5f", e["key"], e["value"])), ",")
    found = heads.select(*keys, "c", "n_classes_seen", listed.alias("val_scores")).join(single, keys).join(ensemble, "training_size")
    return found.withColumns({c: F.round(c, 6) for c in ("macro_f1", "ensemble")})


@query("m3_budget_sweep")
def budget_sweep(spark, d):
    """Every budget the pool fills, five seeds and four penalties."""
    pool, val, test = _sides(spark, d)
    grid = _table(sp.subset_grid(pool, "label", "doc_id", BUDGETS, SEEDS, n_classes=N_LANGS), "grid")
    seen = sp.distinct_pool(grid, "doc_id").select("doc_id", "text")
    fitted = gr.fit(_table(_lists(seen), "grams"), LOW, HIGH, sublinear=True)
    parts = {"pool": pool.join(grid.select("doc_id").distinct(), "doc_id", "left_semi"), "val": val}
    rows = stack_cells([t.withColumn("split", F.lit(s)) for s, t in parts.items()])
    features = _table(_featured(rows, fitted), "features")
    part = lambda s: features.filter(F.col("split") == s).drop("split")
    cells = grid.select("doc_id", "training_size", "seed").join(part("pool"), "doc_id")
    # The rows of the budgets and the validation rows are bounded; test rows are cut as they are scored.
    heads, probs = _swept(cells, part("val"), _met(test), N_LANGS, "doc_id", fitted)
    return _reported(heads, probs, N_LANGS, "doc_id")


@query("m3_dense_sweep")
def dense_sweep(spark, d):
    """The same sweep over frozen vectors: every budget the pool fills, five seeds, four penalties."""
    rows = he.dense_features(table(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding"), "embedding")
    carved = sp.carve_splits(rows.select("vec_id", "label"), {"test": DENSE_TEST, "val": VAL_ROWS}, "label", "vec_id", 42)
    features = _table(rows.drop("embedding").join(carved.select("vec_id", "split"), "vec_id"), "vectors")
    part = lambda s: features.filter(F.col("split") == s).drop("split")
    n_classes = features.agg(F.max("label")).first()[0] + 1
    grid = sp.subset_grid(part("pool"), "label", "vec_id", BUDGETS, SEEDS, n_classes=n_classes)
    heads, probs = _swept(grid, part("val"), part("test"), n_classes, "vec_id")
    return _reported(heads, probs, n_classes, "vec_id")


@query("m4_full_simplex", f"""WITH {SIDES_SQL} SELECT label, count(*) AS n_rows, 0.0::DOUBLE AS absent_class,
  1.0::DOUBLE AS min_total, 1.0::DOUBLE AS max_total FROM labelled GROUP BY 1""")
def full_simplex(spark, d):
    """Trained without one class: its probability is 0 in every row and each row sums to 1."""
    (train, _, test), _, _ = _prepared(spark, d)
    head = he.fit_head(train.filter("label <> 2"), 1.0)
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return head.probabilities(test, N_LANGS).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.get("probs", F.lit(2))).alias("absent_class"),
        F.round(F.min(total), 6).alias("min_total"), F.round(F.max(total), 6).alias("max_total"))


@query("m6_batch_inference")
def batch_inference(spark, d):
    """A fitted head over every document's raw text; the bench turns its time into rows per second."""
    (train, _, _), rows, fitted = _prepared(spark, d)
    head = he.fit_head(train, 10.0)
    return he.score_texts(head, fitted, rows, "doc_id", N_LANGS).groupBy("pred").agg(F.count(F.lit(1)).alias("n_rows"))


# --- one-hot features --------------------------------------------------------------------

WEAK, NEAR_TIE = 1e5, 2e-3
GROUPS = 4
HOT_BUDGETS = (50, 100, 250, 500)
HOT_SQL = f"{P_SQL}, hot AS (SELECT p.row_id, p.y, e.user_id % {GROUPS} AS g FROM p JOIN events e ON p.row_id = e.event_id)"


def _hot(spark, d):
    """row_id, y, the group g and its one-hot feature, of every event."""
    groups = table(spark, d, "events").select(F.col("event_id").alias("row_id"), (F.col("user_id") % GROUPS).alias("g"))
    rows = predictions(spark, d).select("row_id", "y").join(groups, "row_id")
    return rows.withColumns({"indices": F.array(F.col("g").cast("int")), "values": F.array(F.lit(1.0))})


def _most(probs):
    """The first class within a near tie of the best: equal shares are equal but for the penalty."""
    return F.array_position(F.transform(probs, lambda x: x >= F.array_max(probs) - NEAR_TIE), True) - 1


MOST_SQL = f"min(y) FILTER (WHERE n >= best - {NEAR_TIE} * total)"


def _saturated(spark, d):
    rows = he.as_vectors(_hot(spark, d), GROUPS)
    return he.fit_head(rows, WEAK, "y", tol=1e-9).probabilities(rows, K).withColumn("pred", _most("probs"))


HEAD_SQL = f"""WITH {HOT_SQL}, c AS (SELECT g, y, count(*) AS n FROM hot GROUP BY ALL),
top AS (SELECT g, max(n) AS best, sum(n) AS total FROM c GROUP BY g),
said AS (SELECT g, {MOST_SQL} AS pred, max(total)::BIGINT AS n_rows FROM c JOIN top USING (g) GROUP BY g)"""


@query("m1_saturated_head", f"{HEAD_SQL} SELECT g, pred, n_rows FROM said")
def saturated_head(spark, d):
    return _saturated(spark, d).groupBy("g", "pred").agg(F.count(F.lit(1)).alias("n_rows"))


@query("m6_saturated_inference", f"{HEAD_SQL} SELECT pred, sum(n_rows)::BIGINT AS n_rows FROM said GROUP BY pred")
def saturated_inference(spark, d):
    return _saturated(spark, d).groupBy("pred").agg(F.count(F.lit(1)).alias("n_rows"))


@query("m3_saturated_sweep", f"""WITH {HOT_SQL}, s AS (SELECT hot.*, seed FROM hot, (SELECT unnest(range(5)) AS seed)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed, y ORDER BY md5(seed || ':' || row_id), row_id) AS r FROM s),
turns AS (SELECT seed, y, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || y), y) AS o FROM (SELECT DISTINCT seed, y FROM s)),
placed AS (SELECT ranked.*, row_number() OVER (PARTITION BY seed ORDER BY r, o) AS pos FROM ranked JOIN turns USING (seed, y)),
c AS (SELECT training_size, seed, g, y, count(*) AS n FROM placed JOIN (VALUES {', '.join(f'({n})' for n in HOT_BUDGETS)}) b(training_size)
  ON pos <= training_size GROUP BY ALL),
top AS (SELECT training_size, seed, g, max(n) AS best, sum(n) AS total FROM c GROUP BY ALL),
said AS (SELECT training_size, seed, g, {MOST_SQL} AS pred FROM c JOIN top USING (training_size, seed, g) GROUP BY ALL),
long AS (SELECT training_size, seed, y, pred FROM hot JOIN said USING (g)),
seen AS (SELECT training_size, seed, count(DISTINCT y) AS n_classes_seen FROM c GROUP BY ALL),
{f1_sql('sat', 'long', group='training_size, seed')}
SELECT training_size, seed, {WEAK}::DOUBLE AS c, n_classes_seen::INTEGER AS n_classes_seen, round(avg(f1), 6) AS macro_f1
FROM f1_sat JOIN seen USING (training_size, seed) GROUP BY ALL""")
def saturated_sweep(spark, d):
    """Twenty cells, each fitted, validated and scored as in the sweep over texts."""
    rows = _table(_hot(spark, d), "one-hot")
    grid = sp.subset_grid(rows, "y", "row_id", HOT_BUDGETS, SEEDS, n_classes=K)
    val = rows.orderBy(F.md5(F.col("row_id").cast("string")), "row_id").limit(VAL_ROWS)
    keys = ["training_size", "seed"]
    heads = _table(he.sweep(grid, val, K, label="y", c_grid=(WEAK,)), "heads")
    probs = he.sweep_probabilities(heads, rows, K, "row_id", label="y")
    cells = m.confusion(probs.select(*keys, "y", _most("probs").alias("pred")), "y", "pred", keys)
    found = heads.select(*keys, "c", "n_classes_seen").join(m.macro_f1(cells, K, keys), keys)
    return found.withColumn("macro_f1", F.round("macro_f1", 6))
