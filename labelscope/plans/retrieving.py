"""Features and retrieval over whole `documents`, `benchmark` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.functions.text import char_ngrams
from labelscope.operators import features as fe
from labelscope.operators import grams as gr
from labelscope.operators import metrics as m
from labelscope.operators import retrieval as rt
from labelscope.operators.calls import fixed_demonstrations, user_text
from labelscope.plans.inputs import DOCS_SQL, SIDES_SQL, documents, f1_sql, split_documents, table
from labelscope.plans.registry import query
from labelscope.plans.scoring import SCORES_SQL
from labelscope.sources import datasets as ds


def terms_sql(name: str, src: str, key: str, low: int, high: int) -> str:
    """CTE `<name>(key, term, tf)` of whole texts."""
    sizes = ", ".join(f"({n})" for n in range(low, high + 1))
    return rf"""{name}_words AS (SELECT {key}, ' ' || w || ' ' AS p, count(*) AS c FROM
    (SELECT {key}, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM {src}) WHERE w <> '' GROUP BY ALL),
{name}_grams AS (SELECT {key}, c, p, n, unnest(range(1, greatest(length(p) - n, 0) + 2)) AS i FROM {name}_words, (VALUES {sizes}) s(n)
  WHERE n < length(p) OR n = greatest({low}, length(p))),
{name} AS (SELECT {key}, substr(p, i, n) AS term, sum(c) AS tf FROM {name}_grams GROUP BY ALL)"""


def idf_sql(name: str, terms: str, src: str) -> str:
    return f"""{name} AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM {src})) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM {terms} GROUP BY term) WHERE df >= 2)"""


def weights_sql(name: str, terms: str, idf: str, key: str, sublinear: bool) -> str:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"""{name}_raw AS (SELECT {key}, term, {tf} * idf AS w FROM {terms} JOIN {idf} USING (term)),
{name}_len AS (SELECT {key}, sqrt(sum(w * w)) AS len FROM {name}_raw GROUP BY {key}),
{name} AS (SELECT {key}, term, w / len AS weight FROM {name}_raw JOIN {name}_len USING ({key}))"""


@query("t1_char_ngrams", f"""WITH {terms_sql('t', 'documents', 'doc_id', 3, 5)} SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS total FROM t GROUP BY term""")
def ngrams(spark, d):
    tf = fe.term_counts(table(spark, d, "documents"), "doc_id", "text", 3, 5)
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("total"))


@query("t1_ngrams_per_text", f"""WITH {terms_sql('t', 'benchmark', 'item_id', 2, 5)} SELECT item_id, sum(tf)::BIGINT AS n_grams,
  count(*) AS n_distinct FROM t GROUP BY 1""")
def ngrams_per_text(spark, d):
    grams = char_ngrams("text", 2, 5)
    return table(spark, d, "benchmark").select(
        "item_id", F.size(grams).cast("bigint").alias("n_grams"),
        F.size(F.array_distinct(grams)).cast("bigint").alias("n_distinct"))


@query("t2_idf", f"""WITH {SIDES_SQL}, {terms_sql('t', 'labelled', 'doc_id', 2, 5)}, {idf_sql('idf', 't', 'labelled')}
SELECT term, df, round(idf, 6) AS idf FROM idf""")
def idf(spark, d):
    pool, _ = split_documents(spark, d)
    return fe.fit_tfidf(pool, "doc_id").idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query("t2_tfidf", f"""WITH {SIDES_SQL}, {terms_sql('t', 'labelled', 'doc_id', 2, 5)}, {idf_sql('idf', 't', 'labelled')},
{weights_sql('w', 't', 'idf', 'doc_id', True)} SELECT doc_id, count(*) AS n_terms, round(sum(weight), 5) AS total, round(max(weight), 6) AS top FROM w GROUP BY 1""")
def tfidf(spark, d):
    pool, _ = split_documents(spark, d)
    counts = fe.stored_counts(pool, "doc_id")  # every text is cut once
    return _by_doc(fe.tfidf_weights(fe.fit_tfidf(pool, "doc_id", counts=counts), pool, "doc_id", counts=counts))


def _by_doc(weights):
    return weights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 6).alias("top"))


@query("t3_transform_unseen", f"""WITH {SIDES_SQL}, {terms_sql('t', 'labelled', 'doc_id', 2, 5)}, {idf_sql('idf', 't', 'labelled')},
{terms_sql('u', 'unlabelled', 'doc_id', 2, 5)}, {weights_sql('w', 'u', 'idf', 'doc_id', True)}
SELECT doc_id, count(*) AS n_terms, round(sum(weight), 5) AS total, round(max(weight), 6) AS top FROM w GROUP BY 1""")
def transform_unseen(spark, d):
    pool, rest = split_documents(spark, d)
    return _by_doc(fe.tfidf_weights(fe.fit_tfidf(pool, "doc_id"), rest, "doc_id"))


@query("t4_encode_once", f"""WITH {terms_sql('t', 'documents', 'doc_id', 3, 5)}, c AS (SELECT doc_id, sum(tf)::BIGINT AS n_grams FROM t GROUP BY 1)
SELECT doc_id, coalesce(n_grams, 0) AS n_grams, (SELECT count(DISTINCT coalesce(text, '')) FROM documents) AS n_encoded
FROM documents LEFT JOIN c USING (doc_id)""")
def encode_once(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encode = lambda unique: gr.gram_lists(unique, "text_id", "text", 3, 5).select(
        "text_id", F.aggregate("tfs", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_grams"))
    features, references = fe.encode_once(docs, "doc_id", "text", encode)
    encoded = references.agg(F.countDistinct("text_id").alias("n_encoded")).withColumn("_one", F.lit(1))
    joined = references.join(features, "text_id").withColumn("_one", F.lit(1))
    return joined.join(F.broadcast(encoded), "_one").select("doc_id", "n_grams", "n_encoded")


NEAR_SQL = f"""{terms_sql('t', '{pool}', 'doc_id', 3, 5)}, {idf_sql('idf', 't', '{pool}')}, {weights_sql('pw', 't', 'idf', 'doc_id', False)},
{terms_sql('u', '{queries}', '{key}', 3, 5)}, {weights_sql('qw', 'u', 'idf', '{key}', False)},
pairs AS (SELECT q.{{key}} AS query, p.doc_id AS pool, round(sum(q.weight * p.weight), 8) AS sim FROM qw q JOIN pw p USING (term) GROUP BY 1, 2),
near AS (SELECT query, pool, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, pool) AS rank FROM pairs)"""


def near_sql(pool: str, queries: str, key: str) -> str:
    sql = NEAR_SQL
    for name, value in (("pool", pool), ("queries", queries), ("key", key)):
        sql = sql.replace("{%s}" % name, value)
    return sql


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


@query("t5_cosine_top_k", f"""WITH {DOCS_SQL}, {near_sql('docs', 'benchmark', 'item_id')}
SELECT query, pool, round(sim, 6) AS sim, rank::INTEGER AS rank FROM near WHERE rank <= 3""")
def cosine_top_k(spark, d):
    near = rt.retrieve(_items(spark, d), documents(spark, d).select("doc_id", "text"), "doc_id", 3)
    return near.withColumn("sim", F.round("sim", 6))


@query("t5_retrieved_requests", f"""WITH {DOCS_SQL}, {near_sql('docs', 'benchmark', 'item_id')},
shown AS (SELECT query, string_agg('query: "' || text || '"' || chr(10) || 'intent: ' || lang, chr(10) ORDER BY rank DESC) AS demos
  FROM near JOIN docs ON doc_id = pool WHERE rank <= 2 GROUP BY query)
SELECT item_id AS query, md5(coalesce('Similar labelled examples:' || chr(10) || demos || chr(10) || chr(10), '')
  || 'Classify this query:' || chr(10) || '"' || text || '"') AS digest
FROM benchmark LEFT JOIN shown ON item_id = query""")
def retrieved_requests(spark, d):
    pool, items = documents(spark, d).select("doc_id", "text", F.col("lang").alias("intent")), _items(spark, d)
    demos = rt.demonstrations(rt.retrieve(items, pool.select("doc_id", "text"), "doc_id", 2), pool, "doc_id")
    # A query without neighbours is asked without demonstrations.
    rows = items.withColumnRenamed("doc_id", "query").join(demos, "query", "left")
    return rows.select("query", F.md5(user_text(F.array("text"), F.col("demos"))).alias("digest"))


@query("t6_fixed_demonstrations", f"""WITH {DOCS_SQL}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('9:' || doc_id), doc_id) AS r FROM docs)
SELECT doc_id, label FROM r WHERE r <= 3""")
def fixed_demos(spark, d):
    voc = ds.vocabulary_of(table(spark, d, "documents"), "lang")
    return fixed_demonstrations(documents(spark, d).select("doc_id", "label"), voc, 3, "label", "doc_id", 9)


@query("t7_normalise", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT vec_id, dim::INTEGER AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value FROM x""")
def normalise(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(fe.l2_normalise("embedding")).alias("dim", "value"))
    return v.withColumn("value", F.round("value", 6))


@query("t7_masked_mean", """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings WHERE vec_id % 5 <> 0),
a AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY ALL)
SELECT label, dim::INTEGER AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM a""")
def masked_mean(spark, d):
    # Vectors of one label stand for the tokens of one text; every fifth is padding.
    tokens = table(spark, d, "embeddings").select("label", "embedding", (F.col("vec_id") % 5 != 0).alias("kept"))
    return fe.masked_mean(tokens, "label", "embedding", "kept").withColumn("value", F.round("value", 6))


VOTE_SQL = f"""{SIDES_SQL}, {near_sql('labelled', 'unlabelled', 'doc_id')},
votes AS (SELECT query, l.label, count(*) AS n, max(sim) AS best FROM near JOIN labelled l ON l.doc_id = pool WHERE rank <= 3 GROUP BY 1, 2),
picked AS (SELECT query, label AS pred, row_number() OVER (PARTITION BY query ORDER BY n DESC, best DESC, label) AS r FROM votes),
voted AS (SELECT u.doc_id, u.label AS y, pred FROM unlabelled u LEFT JOIN (SELECT * FROM picked WHERE r = 1) ON u.doc_id = query)"""


@query("t8_neighbour_vote", f"WITH {VOTE_SQL} SELECT doc_id, y, pred FROM voted")
def neighbour_vote(spark, d):
    return _voted(spark, d)


def _voted(spark, d):
    pool, queries = split_documents(spark, d)
    near = rt.retrieve(queries.select("doc_id", "text"), pool.select("doc_id", "text"), "doc_id", 3)
    voted = rt.vote(near, pool.select("doc_id", "label"), "doc_id", "label").withColumnRenamed("query", "doc_id")
    # A query that shares no n-gram with the pool keeps its row, without a prediction.
    return queries.select("doc_id", F.col("label").alias("y")).join(voted, "doc_id", "left")


@query("t8_vote_scores", f"WITH {VOTE_SQL}, {f1_sql('v', 'voted', k=4)} " + SCORES_SQL.format(g="", f1="f1_v", by=""))
def vote_scores(spark, d):
    return m.scores(m.confusion(_voted(spark, d), "y", "pred"), 4)
