"""Derived inputs the queries share, each as a DataFrame and as a SQL common table expression.

Predictions, votes and runs are integer arithmetic on the rows of `events`, one row per event,
so both engines agree bit for bit and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 5
BUDGETS = (50, 100, 250, 500)
BONUS = (1, 2, 5, 10)
SEEDS = (0, 1, 2, 3, 4)
#: Labelled ids that are sent to the texts (8 MB), so that no text is shuffled to them; more are joined.
BROADCAST_IDS = 1_000_000
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_class() -> Column:
    """Position of the event type in the sorted vocabulary."""
    c = F.lit(K - 1)
    for i, name in reversed(list(enumerate(EVENT_TYPES[:-1]))):
        c = F.when(F.col("event_type") == name, i).otherwise(c)
    return c.cast("bigint")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y, two systems a and b (b sometimes missing), and the call each row was sent in."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", event_class().alias("y"))
    i, call = F.col("event_id"), F.expr("event_id div 150")
    return e.select(
        i.alias("row_id"),
        "y",
        F.when(i % 7 == 0, (F.col("y") + 1 + i % 4) % K).otherwise(F.col("y")).alias("a"),
        F.when(i % 101 == 0, None)
        .when(i % 6 == 0, (F.col("y") + 2 + F.col("user_id") % 3) % K)
        .otherwise(F.col("y"))
        .alias("b"),
        call.alias("call_no"),
        (1000 + call % 37).alias("input_tokens"),
        (50 + call % 11).alias("output_tokens"),
        F.when(call % 13 == 0, None).otherwise(100 + (call * 37) % 900).alias("latency_ms"),
    )


P_SQL = """p AS (
  SELECT event_id AS row_id, y,
         CASE WHEN event_id % 7 = 0 THEN (y + 1 + event_id % 4) % 5 ELSE y END AS a,
         CASE WHEN event_id % 101 = 0 THEN NULL
              WHEN event_id % 6 = 0 THEN (y + 2 + user_id % 3) % 5 ELSE y END AS b,
         event_id // 150 AS call_no,
         1000 + (event_id // 150) % 37 AS input_tokens,
         50 + (event_id // 150) % 11 AS output_tokens,
         CASE WHEN (event_id // 150) % 13 = 0 THEN NULL
              ELSE 100 + ((event_id // 150) * 37) % 900 END AS latency_ms
  FROM (SELECT event_id, user_id,
               CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                    WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS y FROM events) e
)"""

# F1 of every class of [0, 5) per run: needs a CTE `long(run..., y, pred)`.
F1_SQL = """f1_{name} AS (
  SELECT {g_}c.label, coalesce(t.tp, 0) AS tp, coalesce(q.predicted, 0) AS predicted,
         coalesce(t.n_true, 0) AS n_true,
         CASE WHEN coalesce(q.predicted, 0) + coalesce(t.n_true, 0) > 0
              THEN 2.0 * coalesce(t.tp, 0) / (coalesce(q.predicted, 0) + coalesce(t.n_true, 0))
              ELSE 0.0 END AS f1
  FROM (SELECT {g_}label FROM (SELECT DISTINCT {g}1 AS one FROM {src}) g
        CROSS JOIN (SELECT unnest(range({k})) AS label) v) c
  LEFT JOIN (SELECT {g}{y} AS label, sum(CASE WHEN {y} = {pred} THEN 1 ELSE 0 END) AS tp,
                    count(*) AS n_true FROM {src} GROUP BY ALL) t USING ({g}label)
  LEFT JOIN (SELECT {g}{pred} AS label, count(*) AS predicted FROM {src}
             WHERE {pred} IS NOT NULL GROUP BY ALL) q USING ({g}label)
)"""


def f1_sql(name: str, src: str, y: str = "y", pred: str = "pred", group: str = "", k: int = K) -> str:
    """A CTE `f1_<name>` with the F1 of every class, per group."""
    cols = [c.strip() for c in group.split(",") if c.strip()]
    return F1_SQL.format(
        name=name, src=src, y=y, pred=pred, k=k,
        g="".join(f"{c}, " for c in cols), g_="".join(f"{c}, " for c in cols),
    )


def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y, run_index, pred, resolved_model: three runs over every row, some answers missing."""
    p = predictions(spark, sf_dir).select("row_id", "y")
    r = F.col("run_index")
    wrong = (F.col("row_id") * (r + 1)) % 11 == 0
    pred = F.when((F.col("row_id") + r) % 97 == 0, None).when(wrong, (F.col("y") + 1) % K).otherwise(F.col("y"))
    model = F.when((F.col("row_id") + r) % 97 == 0, None).otherwise(
        F.concat(F.lit("served-"), ((F.col("row_id") + r) % 2).cast("string"))
    )
    return p.withColumn("run_index", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "row_id", "y", "run_index", pred.alias("pred"), model.alias("resolved_model")
    )


RUNS_SQL = """runs AS (
  SELECT row_id, y, run_index,
         CASE WHEN (row_id + run_index) % 97 = 0 THEN NULL
              WHEN (row_id * (run_index + 1)) % 11 = 0 THEN (y + 1) % 5 ELSE y END AS pred,
         CASE WHEN (row_id + run_index) % 97 = 0 THEN NULL
              ELSE 'served-' || CAST((row_id + run_index) % 2 AS VARCHAR) END AS resolved_model
  FROM p, (SELECT unnest([0, 1, 2]) AS run_index)
)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y, b, training_size, seed, probs: a class vote per row, budget and seed."""
    p = predictions(spark, sf_dir).select("row_id", "y", "b")
    budgets = F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("training_size"), F.lit(b).cast("bigint").alias("bonus"))
        for n, b in zip(BUDGETS, BONUS)
    ])
    seeds = F.array(*[F.lit(s).cast("bigint") for s in SEEDS])
    vote = [
        ((F.col("row_id") * (k + 3) * (F.col("seed") + 2) + F.col("seed") * 7 + F.col("training_size")) % 23
         + F.when(F.col("y") == k, F.col("bonus")).otherwise(0)).cast("double")
        for k in range(K)
    ]
    return (
        p.select("*", F.inline(budgets))
        .select("*", F.explode(seeds).alias("seed"))
        .select("row_id", "y", "b", "training_size", "seed", F.array(*vote).alias("probs"))
    )


VOTES_SQL = """votes AS (
  SELECT row_id, y, b, n AS training_size, seed, k,
         (row_id * (k + 3) * (seed + 2) + seed * 7 + n) % 23
         + CASE WHEN k = y THEN bonus ELSE 0 END AS vote
  FROM p, (VALUES (50, 1), (100, 2), (250, 5), (500, 10)) budgets(n, bonus),
       (SELECT unnest(range(5)) AS seed), (SELECT unnest(range(5)) AS k)
)"""
SINGLE_SQL = """single AS (
  SELECT row_id, y, training_size, seed, arg_max(k, vote * 10 - k) AS pred
  FROM votes GROUP BY row_id, y, training_size, seed
)"""
ENSEMBLE_SQL = """ensemble AS (
  SELECT row_id, y, b, training_size, arg_max(k, v * 10 - k) AS pred
  FROM (SELECT row_id, y, b, training_size, k, sum(vote) AS v FROM votes GROUP BY ALL)
  GROUP BY row_id, y, b, training_size
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source, and the id of the language in the sorted vocabulary."""
    lang = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1) \
        .when(F.col("lang") == "es", 2).otherwise(3).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", lang.alias("label"))


DOCS_SQL = """docs AS (
  SELECT doc_id, text, lang, source,
         CAST(CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS BIGINT) AS label
  FROM documents
)"""


def split_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents with an entry in `labels`, documents without): the labelled and unlabelled side."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")
    if labels.count() <= BROADCAST_IDS:
        labels = F.broadcast(labels)
    return docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")


SIDES_SQL = DOCS_SQL + """, labelled AS (
  SELECT * FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)
), unlabelled AS (
  SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)
)"""
