"""Carves, subset grids and leakage checks over `documents`, `labels` and `benchmark`."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.operators import audits as au
from labelscope.operators import splits as sp
from labelscope.plans.inputs import (
    DOCS_SQL, EVENT_TYPES, P_SQL, SIDES_SQL, VOTES_SQL, documents, predictions, split_documents,
    table, votes,
)
from labelscope.plans.registry import query
from labelscope.session import scratch_dir
from labelscope.sources import datasets as ds
from labelscope.sources import store as st

N_LANGS = 4
SIZES = (50, 100, 250, 500, 1_000_000_000)  # the last one never fits and must be skipped
SEEDS = (0, 1, 2)


def _docs(spark, d):
    return documents(spark, d).select("doc_id", "lang", "label")


# --- sources and sinks -------------------------------------------------------------------


@query("s1_load_split", """SELECT 'all:' || doc_id AS row_id, text, dense_rank() OVER (ORDER BY lang) - 1 AS label,
  lang AS intent FROM documents""")
def load_split(spark, d):
    data = ds.Dataset("documents", ("de", "en", "es", "fr"), {
        "all": ds.SplitSource(f"{d}/documents.parquet", "doc_id", label="lang", named=True)})
    return data.load_split(spark, "all")


@query("s2_fixed_splits", """WITH v AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM
  (SELECT DISTINCT label FROM embeddings))
SELECT split, count(*) AS n_rows, count(DISTINCT label) AS n_classes FROM (
  SELECT 'test' AS split, CAST(label AS VARCHAR) AS label FROM embeddings
  UNION ALL SELECT 'val', event_type FROM events UNION ALL SELECT 'dev', lang FROM documents) GROUP BY split""")
def fixed_splits(spark, d):
    names = tuple(str(i) for i in range(10))
    parts = (
        ("test", names, ds.SplitSource(f"{d}/embeddings.parquet", "vec_id", text="vec_id")),
        ("val", EVENT_TYPES, ds.SplitSource(f"{d}/events.parquet", "event_id", text="props", label="event_type", named=True)),
        ("dev", ("de", "en", "es", "fr"), ds.SplitSource(f"{d}/documents.parquet", "doc_id", label="lang", named=True)),
    )
    loaded = []
    for split, vocabulary, source in parts:
        data = ds.Dataset(split, vocabulary, {split: source})
        load = {"test": data.load_test_set, "val": data.load_val_set, "dev": data.load_dev_slice}[split]
        loaded.append(load(spark).groupBy(F.lit(split).alias("split")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct("label").alias("n_classes")))
    return st.stack_cells(loaded)


# Place of a document in its seed's round-robin order, from first principles.
def order_sql(seed: str, by_seed: str = "", label_order: str = "shuffled", src: str = "docs") -> str:
    turn = f"md5({seed} || ':' || label), label" if label_order == "shuffled" else "label"
    part = f"PARTITION BY {by_seed} " if by_seed else ""
    comma = f"{by_seed}, " if by_seed else ""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {comma}label ORDER BY md5({seed} || ':' || doc_id), doc_id) AS r
  FROM {src}),
turns AS (SELECT {comma}label, row_number() OVER ({part}ORDER BY {turn}) AS o FROM (SELECT DISTINCT {comma}label FROM {src})),
placed AS (SELECT ranked.*, row_number() OVER ({part}ORDER BY r, o) AS pos FROM ranked JOIN turns USING ({comma}label))"""


@query("s3_budget_subset", f"WITH {DOCS_SQL}, {order_sql(repr('1'))} SELECT doc_id, label, pos FROM placed WHERE pos <= 100")
def budget_subset(spark, d):
    seeded = _docs(spark, d).drop("lang").withColumn("seed", F.lit(1))
    ordered = sp.round_robin(seeded, "label", "doc_id", "seed", limit=100, n_groups=N_LANGS)
    return ds.load_train_subset(ordered, 100, 1).select("doc_id", "label", "pos")


@query("s4_discover_grid", f"""WITH {P_SQL}, {VOTES_SQL} SELECT training_size, '0,1,2,3,4' AS seeds FROM votes GROUP BY 1""")
def discover_grid(spark, d):
    path = scratch_dir(spark, "grid")
    st.write_cells(votes(spark, d), path)
    grid = st.discover_grid(spark, path)
    return grid.select(F.col("training_size").cast("bigint").alias("training_size"),
                       F.concat_ws(",", F.col("seeds").cast("array<string>")).alias("seeds"))


@query("s5_vocabulary", "SELECT row_number() OVER (ORDER BY source) - 1 AS label, source AS intent FROM (SELECT DISTINCT source FROM documents WHERE source <> '')")
def vocabulary(spark, d):
    return ds.vocabulary_of(table(spark, d, "documents"), "source")


@query("s6_glosses", """SELECT row_number() OVER (ORDER BY source) - 1 AS label, source AS intent,
  'texts such as document ' || min(doc_id) AS gloss FROM documents GROUP BY source""")
def glosses(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.groupBy(F.col("source").alias("intent")).agg(
        F.concat(F.lit("texts such as document "), F.min("doc_id").cast("string")).alias("gloss"))
    return ds.require_glosses(ds.vocabulary_of(docs, "source"), lines)


@query("s7_stack_cells", f"""WITH {P_SQL}, {VOTES_SQL} SELECT training_size, seed, count(DISTINCT row_id) AS n_rows,
  sum(vote)::DOUBLE AS total FROM votes GROUP BY ALL""")
def stack_cells(spark, d):
    v = votes(spark, d)
    cells = [v.filter(F.col("training_size") == n) for n in (50, 100, 250, 500)]
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return st.stack_cells(cells).groupBy("training_size", "seed").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(total).alias("total"))


@query("s8_write_predictions", f"""WITH {P_SQL}, {VOTES_SQL} SELECT training_size, seed, count(DISTINCT row_id) AS n_rows,
  count(DISTINCT row_id) FILTER (WHERE y = 0) AS n_first FROM votes GROUP BY ALL""")
def write_predictions(spark, d):
    """Write all cells, then one again: dynamic overwrite replaces that cell only."""
    path = scratch_dir(spark, "predictions")
    cells = votes(spark, d).select("row_id", "y", "training_size", "seed")
    st.write_cells(cells, path)
    st.write_cells(cells.filter("training_size = 50 AND seed = 0"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("training_size").cast("bigint").alias("training_size"),
                        F.col("seed").cast("bigint").alias("seed")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y") == 0).alias("n_first"))


@query("s8_cell_log", f"""WITH {P_SQL}, {VOTES_SQL} SELECT training_size, seed, count(DISTINCT row_id) AS rows, 2 AS writes, true AS counted
FROM votes WHERE training_size = 50 GROUP BY ALL UNION ALL
SELECT training_size, seed, count(DISTINCT row_id), 1, true FROM votes WHERE training_size <> 50 GROUP BY ALL""")
def cell_log(spark, d):
    """The log after all cells and then those of one budget were written."""
    path = scratch_dir(spark, "cells")
    cells = votes(spark, d).select("row_id", "y", "training_size", "seed")
    st.write_cells(cells, path)
    st.write_cells(cells.filter("training_size = 50"), path)
    writes = spark.read.parquet(f"{path}/{st.LOG}").groupBy(*st.CELL).agg(F.count(F.lit(1)).cast("int").alias("writes"))
    return st.cell_log(spark, path).join(writes, list(st.CELL)).select(
        *st.CELL, "rows", "writes", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("counted"))


@query("s9_remaining_cells", """SELECT source, lang FROM documents GROUP BY ALL
EXCEPT SELECT source, lang FROM documents JOIN labels USING (doc_id)""")
def remaining_cells(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    done = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return st.remaining(docs.select("source", "lang").distinct(), done, ("source", "lang"))


@query("s10_keep_last", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def keep_last(spark, d):
    log = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    first, later = log.filter("event_type < 'e'"), log.filter("event_type >= 'e'")
    return st.upsert(first, later, ("user_id", "event_type"), ("ts", "event_id")).drop("ts")


@query("s11_response_status", f"""WITH {P_SQL}, got AS (SELECT call_no, sum(output_tokens) AS response_tokens FROM p
  WHERE latency_ms IS NOT NULL GROUP BY 1)
SELECT call_no, CASE WHEN response_tokens IS NULL THEN 'missing' ELSE 'ready' END AS status,
  coalesce(response_tokens, 0)::BIGINT AS response_tokens FROM (SELECT DISTINCT call_no FROM p) e LEFT JOIN got USING (call_no)""")
def response_status(spark, d):
    p = predictions(spark, d)
    got = p.filter("latency_ms is not null").groupBy("call_no").agg(F.sum("output_tokens").alias("response_tokens"))
    return st.response_status(p, got, "call_no", "response_tokens")


# --- splits ------------------------------------------------------------------------------

CARVE_SQL = """{out}_share AS (SELECT label, ({m} * count(*)) // (SELECT count(*) FROM {src}) AS whole,
    ({m} * count(*)) % (SELECT count(*) FROM {src}) AS rest FROM {src} GROUP BY label),
{out}_quota AS (SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
    <= {m} - (SELECT sum(whole) FROM {out}_share) THEN 1 ELSE 0 END AS quota FROM {out}_share),
{out} AS (SELECT s.* EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || doc_id), doc_id) AS r
    FROM {src}) s JOIN {out}_quota USING (label) WHERE r <= quota)"""


def carve_sql(out: str, src: str, m: int, seed: int) -> str:
    return CARVE_SQL.format(out=out, src=src, m=m, seed=seed)


@query("d1_stratified_carve", f"WITH {DOCS_SQL}, {carve_sql('val', 'docs', 150, 42)} SELECT doc_id, label FROM val")
def stratified_carve(spark, d):
    return sp.stratified_carve(_docs(spark, d).drop("lang"), 150, "label", "doc_id", 42)


@query("d2_two_carves", f"""WITH {DOCS_SQL}, {carve_sql('val', 'docs', 80, 42)},
  left1 AS (SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM val)), {carve_sql('dev', 'left1', 50, 42)}
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM val) THEN 'val'
  WHEN doc_id IN (SELECT doc_id FROM dev) THEN 'dev' ELSE 'pool' END AS split FROM docs""")
def two_carves(spark, d):
    # Both sides draw the second carve with the seed of the first: one order serves both.
    rows = _docs(spark, d).drop("lang")
    return sp.carve_splits(rows, {"val": 80, "dev": 50}, "label", "doc_id", 42).select("doc_id", "split")


@query("d3_round_robin", f"WITH {DOCS_SQL}, {order_sql(repr('7'))} SELECT doc_id, label, pos FROM placed")
def round_robin(spark, d):
    return sp.round_robin(_docs(spark, d).drop("lang"), "label", "doc_id", 7)


@query("d4_balanced_take", f"""WITH {DOCS_SQL}, {order_sql(repr('7'), label_order='label')}
SELECT doc_id, label, pos, md5('7:order:' || doc_id) AS order_key FROM placed WHERE pos <= 130""")
def balanced_take(spark, d):
    return sp.balanced_take(_docs(spark, d).drop("lang"), 130, "label", "doc_id", 7, n_classes=N_LANGS)


GRID_SQL = f"""{DOCS_SQL}, seeded AS (SELECT docs.*, seed FROM docs, (SELECT unnest(range(3)) AS seed)),
{order_sql('seed', 'seed', src='seeded')},
grid AS (SELECT doc_id, text, label, seed, pos, n AS training_size FROM placed
  JOIN (VALUES (50), (100), (250), (500), (1000000000)) b(n) ON pos <= n WHERE n <= (SELECT count(*) FROM docs))"""


def _grid(spark, d, text: bool = False):
    pool = documents(spark, d).select("doc_id", "label", *(["text"] if text else []))
    return sp.subset_grid(pool, "label", "doc_id", SIZES, SEEDS, n_classes=N_LANGS)


@query("d5_subset_grid", f"WITH {GRID_SQL} SELECT doc_id, label, seed::INTEGER AS seed, pos, training_size FROM grid")
def subset_grid(spark, d):
    return _grid(spark, d)


@query("d6_class_coverage", f"""WITH {GRID_SQL}, c AS (SELECT training_size, seed, count(DISTINCT label) AS n FROM grid GROUP BY ALL)
SELECT training_size, max(n) FILTER (WHERE seed = 0) AS seed_0, max(n) FILTER (WHERE seed = 1) AS seed_1,
  max(n) FILTER (WHERE seed = 2) AS seed_2, 4 - min(n) AS most_missing FROM c GROUP BY training_size""")
def class_coverage(spark, d):
    return sp.class_coverage(_grid(spark, d), "label", N_LANGS, SEEDS)


@query("d7_drop_leaked", f"WITH {SIDES_SQL} SELECT doc_id FROM unlabelled WHERE text NOT IN (SELECT text FROM labelled)")
def drop_leaked(spark, d):
    test, train = split_documents(spark, d)
    return sp.drop_leaked(train.select("doc_id", "text"), test).select("doc_id")


@query("d8_carve_by_text", f"""WITH {DOCS_SQL}, {carve_sql('val', 'docs', 90, 5)}
SELECT doc_id, 'carved' AS side FROM val UNION ALL
SELECT doc_id, 'rest' FROM docs WHERE text NOT IN (SELECT text FROM val)""")
def carve_by_text(spark, d):
    carved, rest = sp.carve_by_text(documents(spark, d).select("doc_id", "label", "text"), 90, "label", "doc_id", 5)
    return carved.select("doc_id", F.lit("carved").alias("side")).unionByName(rest.select("doc_id", F.lit("rest").alias("side")))


@query("d9_split_overlaps", f"""WITH {SIDES_SQL}, s AS (SELECT DISTINCT split, text FROM (
  SELECT 'labelled' AS split, text FROM labelled UNION ALL SELECT 'unlabelled', text FROM unlabelled
  UNION ALL SELECT 'benchmark', text FROM benchmark)),
pairs(split_a, split_b) AS (VALUES ('labelled', 'unlabelled'), ('labelled', 'benchmark'), ('unlabelled', 'benchmark'))
SELECT split_a, split_b, n AS shared, CASE WHEN n > 0 THEN 'leak' ELSE 'ok' END AS verdict FROM (
  SELECT *, (SELECT count(*) FROM s x JOIN s z USING (text) WHERE x.split = split_a AND z.split = split_b) AS n FROM pairs)""")
def split_overlaps(spark, d):
    test, train = split_documents(spark, d)
    rows = st.stack_cells([
        test.select("text", F.lit("labelled").alias("split")),
        train.select("text", F.lit("unlabelled").alias("split")),
        table(spark, d, "benchmark").select("text", F.lit("benchmark").alias("split")),
    ])
    return sp.split_overlaps(rows, ("labelled", "unlabelled", "benchmark"))


@query("d10_seed_independence", f"""WITH {GRID_SQL}, t AS (SELECT training_size, text, count(DISTINCT seed) AS m FROM grid GROUP BY ALL),
a AS (SELECT training_size, count(*) FILTER (WHERE m = 3) AS shared_by_all, sum(m * (m - 1) // 2) / 3 AS mean FROM t GROUP BY 1)
SELECT training_size, shared_by_all, round(mean, 6) AS mean_pairwise,
  round(training_size * training_size / (SELECT count(DISTINCT text) FROM docs), 6) AS expected_random,
  mean / training_size > 0.9 AS near_identical FROM a""")
def seed_independence(spark, d):
    return sp.seed_independence(_grid(spark, d, text=True), table(spark, d, "documents"), len(SEEDS))


@query("d11_distinct_pool", f"WITH {GRID_SQL} SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM grid GROUP BY text")
def distinct_pool(spark, d):
    pool = sp.distinct_pool(_grid(spark, d, text=True).select("doc_id", "text"), "doc_id")
    return pool.select("doc_id", F.md5("text").alias("digest"))


# --- audits ------------------------------------------------------------------------------


@query("a1_null_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM documents"
    for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))))
def null_counts(spark, d):
    return au.null_counts(table(spark, d, "documents"))


@query("a2_class_balance", """WITH c AS (SELECT lang, count(*) AS c FROM documents GROUP BY 1)
SELECT count(*) AS n_classes, min(c) AS min_rows, (SELECT lang FROM c ORDER BY c, lang LIMIT 1) AS min_class,
  round(quantile_cont(c, 0.5), 6) AS median_rows, round(avg(c), 6) AS mean_rows, max(c) AS max_rows,
  (SELECT lang FROM c ORDER BY c DESC, lang DESC LIMIT 1) AS max_class, count(*) FILTER (WHERE c < 50) AS rare_classes FROM c""")
def class_balance(spark, d):
    return au.class_balance(table(spark, d, "documents"), "lang", 50)


@query("a2_rare_classes", "SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(*) < 60")
def rare_classes(spark, d):
    return au.rare_classes(table(spark, d, "events"), "user_id", 60)


LENGTHS_SQL = """SELECT min(n) AS min_len, round(quantile_cont(n, 0.5), 6) AS median_len, round(quantile_cont(n, 0.95), 6) AS p95_len,
  round(quantile_cont(n, 0.99), 6) AS p99_len, max(n) AS max_len, {over} FROM (SELECT {n} AS n FROM documents)"""


@query("a3_length_chars", LENGTHS_SQL.format(n="length(text)", over=", ".join(
    f"round(avg(CASE WHEN n > {c} THEN 1.0 ELSE 0.0 END), 6) AS over_{c}" for c in (200, 1000, 5000))))
def length_chars(spark, d):
    return au.length_stats(table(spark, d, "documents"), F.char_length("text").cast("bigint"), (200, 1000, 5000))


@query("a3_length_words", LENGTHS_SQL.format(n=r"len(regexp_extract_all(text, '\S+'))", over=", ".join(
    f"round(avg(CASE WHEN n > {c} THEN 1.0 ELSE 0.0 END), 6) AS over_{c}" for c in (32, 64, 128))))
def length_words(spark, d):
    return au.length_stats(table(spark, d, "documents"), F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).cast("bigint"), (32, 64, 128))


@query("a4_class_drift", f"""WITH {SIDES_SQL}, c AS (SELECT source, (SELECT count(*) FROM labelled l WHERE l.source = v.source) AS na,
    (SELECT count(*) FROM unlabelled u WHERE u.source = v.source) AS nb FROM (SELECT DISTINCT source FROM docs) v),
s AS (SELECT na / sum(na) OVER () + 1e-12 AS p, nb / sum(nb) OVER () + 1e-12 AS q FROM c),
r AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM s)
SELECT count(*) AS n_classes, round(sum(p * ln(p / q)), 6) AS kl FROM r""")
def class_drift(spark, d):
    test, train = split_documents(spark, d)
    return au.class_drift(test, train, "source")


@query("a5_order_audit", """WITH o AS (SELECT event_type, lag(event_type) OVER (ORDER BY ts, event_id) AS prev FROM events),
t AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_type <> prev) AS transitions FROM o)
SELECT n_rows, transitions, round(n_rows * (1 - 1 / 5), 6) AS expected_random,
  CASE WHEN transitions < 0.5 * n_rows * (1 - 1 / 5) THEN 'sorted_by_class' ELSE 'shuffled' END AS verdict FROM t""")
def order_audit(spark, d):
    return au.order_audit(table(spark, d, "events"), "event_type", ("ts", "event_id"), 5, 0.5)


@query("a5_order_audit_blocked", """WITH t AS (SELECT count(*) AS n_rows, count(DISTINCT event_type) - 1 AS transitions FROM events)
SELECT n_rows, transitions, round(n_rows * (1 - 1 / 5), 6) AS expected_random,
  CASE WHEN transitions < 0.5 * n_rows * (1 - 1 / 5) THEN 'sorted_by_class' ELSE 'shuffled' END AS verdict FROM t""")
def order_audit_blocked(spark, d):
    return au.order_audit(table(spark, d, "events"), "event_type", ("event_type", "event_id"), 5, 0.5)


BATCH_SQL = f"""{P_SQL}, b AS (SELECT call_no, count(*) AS n_rows, count(DISTINCT y) AS n_classes,
  round(avg(CASE WHEN b = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1)"""


@query("a6_batch_profile", f"WITH {BATCH_SQL} SELECT * FROM b")
def batch_profile(spark, d):
    return au.batch_profile(predictions(spark, d), "call_no", "y", "b")


@query("a6_batch_summary", f"""WITH {BATCH_SQL} SELECT count(*) AS n_batches, round(avg(n_classes), 6) AS mean_classes,
  min(accuracy) AS min_accuracy, max(accuracy) AS max_accuracy FROM b""")
def batch_summary(spark, d):
    return au.batch_summary(au.batch_profile(predictions(spark, d), "call_no", "y", "b"))


@query("a7_same_rows", """SELECT count(*) AS n_before, count(*) AS n_after, 0 AS n_lost, 0 AS n_gained, 0 AS n_repeated, true AS same FROM events""")
def same_rows(spark, d):
    from labelscope.operators.calls import order_rows
    rows = table(spark, d, "events").select("event_id", "event_type")
    return au.same_rows(rows, order_rows(rows, "event_id", "shuffled", seed=11), ("event_id", "event_type"))


@query("a8_probe_verdict", f"""WITH {P_SQL}, t AS (SELECT count(*) AS n FROM p),
s AS (SELECT count(*) AS n_items, count(*) FILTER (WHERE b = y AND b <> 4) AS n_correct,
  count(*) FILTER (WHERE b = 4) AS n_hallucinated, count(*) FILTER (WHERE b IS NULL) AS malformed FROM p)
SELECT n AS n_expected, n_items, n_correct, n_hallucinated, 0 AS n_unmatched, malformed AS n_issues,
  CASE WHEN n_correct >= 8 AND n_hallucinated = 0 AND malformed = 0 THEN 'pass' WHEN n_hallucinated > 0 THEN 'fail_hallucinated'
       WHEN malformed > 0 THEN 'warn_format' ELSE 'warn_accuracy' END AS verdict FROM s, t""")
def probe_verdict(spark, d):
    names = F.array(*[F.lit(n) for n in EVENT_TYPES])
    p = predictions(spark, d)
    truth = p.select(F.col("row_id").alias("id"), F.get(names, F.col("y").cast("int")).alias("intent"))
    items = p.select(F.col("row_id").alias("id"), F.get(names, F.col("b").cast("int")).alias("intent"))
    known = ds.vocabulary_table(spark, EVENT_TYPES[:4])
    return au.probe_verdict(truth, items, known, 8)
