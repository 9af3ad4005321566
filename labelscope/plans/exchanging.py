"""Requests and replies over `events`, `documents` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.operators import calls as ca
from labelscope.operators import replies as re_
from labelscope.operators import retrieval as rt
from labelscope.plans.inputs import (
    DOCS_SQL, EVENT_TYPES, P_SQL, RUNS_SQL, documents, predictions, repeated_runs, table,
)
from labelscope.plans.registry import query
from labelscope.plans.retrieving import near_sql
from labelscope.session import scratch_dir
from labelscope.sources import datasets as ds
from labelscope.streaming import ingest as ig

PER_CALL = 150
SEED = 20260729


def order_cte(src: str, key: str) -> str:
    return f"""ordered AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || {key}), {key}) AS pos FROM {src})"""


@query("o1_shuffled_order", f"WITH {order_cte('events', 'event_id')} SELECT event_id, event_type, pos FROM ordered")
def shuffled_order(spark, d):
    return ca.order_rows(table(spark, d, "events").select("event_id", "event_type"), "event_id", "shuffled", SEED)


@query("o1_blocked_order", "SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) AS pos FROM events")
def blocked_order(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    return ca.order_rows(rows, "event_id", "blocked", label="event_type")


def _doc_calls(spark, d, per_call: int = 20):
    rows = documents(spark, d).select("doc_id", "text")
    return ca.chunk_calls(ca.order_rows(rows, "doc_id", "shuffled", SEED), per_call, "doc_id")


CALLS_SQL = f"""{DOCS_SQL}, {order_cte('docs', 'doc_id')},
calls AS (SELECT (pos - 1) // 20 AS call_no, 'call-' || lpad(CAST((pos - 1) // 20 AS VARCHAR), 5, '0') AS custom_id,
  count(*)::INTEGER AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos) AS row_ids,
  string_agg(((pos - 1) % 20 + 1) || '. "' || text || '"', chr(10) ORDER BY pos) AS numbered,
  string_agg(pos || '. ' || text, chr(10) ORDER BY pos) AS listed, min(pos) AS start, max(pos) AS stop,
  min(text) AS any_text FROM ordered GROUP BY 1, 2)"""


@query("o2_chunk_calls", f"WITH {CALLS_SQL} SELECT call_no, custom_id, n, row_ids FROM calls")
def chunk_calls(spark, d):
    return _doc_calls(spark, d).select("call_no", "custom_id", "n", F.array_join("row_ids", ",").alias("row_ids"))


@query("o3_first_calls", f"WITH {CALLS_SQL} SELECT custom_id, n FROM calls WHERE call_no < ceil(90 / 20)")
def first_calls(spark, d):
    return ca.first_calls(_doc_calls(spark, d), 90, 20).select("custom_id", "n")


def _class_list(spark, d):
    return ds.vocabulary_of(table(spark, d, "documents"), "source")


BLOCK_SQL = "block AS (SELECT string_agg('- ' || source, chr(10) ORDER BY source) AS b FROM (SELECT DISTINCT source FROM documents))"
TASK_SQL = "'" + ca.TASK.format(domain="document").replace("\n", "' || chr(10) || '") + "'"
USER_SQL = """CASE WHEN n = 1 THEN 'Classify this query:' || chr(10) || '"' || any_text || '"'
  ELSE 'Classify each of these ' || n || ' queries. Return one object per query, with `id` from 1 to ' || n || ':' || chr(10) || numbered END"""


def _with_prompts(spark, d):
    block = ca.label_block(_class_list(spark, d))
    shared = block.select(
        ca.system_text("document", F.col("label_block")).alias("system"), "label_block", F.lit(1).alias("_one"))
    calls = _doc_calls(spark, d).withColumn("_one", F.lit(1))
    return calls.join(F.broadcast(shared), "_one").drop("_one").withColumn("user", ca.user_text(F.col("texts")))


@query("o4_render_requests", f"""WITH {CALLS_SQL}, {BLOCK_SQL}, r AS (SELECT custom_id,
  {TASK_SQL} || chr(10) || chr(10) || 'Intents:' || chr(10) || b AS system, {USER_SQL} AS content FROM calls, block)
SELECT custom_id, md5(system) AS system_digest, md5(content) AS user_digest, length(content) // 4 AS est_tokens FROM r""")
def render_requests(spark, d):
    return _with_prompts(spark, d).select(
        "custom_id", F.md5("system").alias("system_digest"), F.md5("user").alias("user_digest"),
        ca.estimated_tokens(F.col("user")).alias("est_tokens"))


TEMPLATE = "Pick one of:\n{label_list_block}\n\nQueries:\n{query_block}\n\nIds run from {start_id} to {end_id}."


@query("o4_fill_template", f"""WITH {CALLS_SQL}, {BLOCK_SQL}, r AS (SELECT custom_id, 'Pick one of:' || chr(10) || b || chr(10) || chr(10)
  || 'Queries:' || chr(10) || listed || chr(10) || chr(10) || 'Ids run from ' || start || ' to ' || stop || '.' AS t FROM calls, block)
SELECT custom_id, md5(t) AS digest, length(t) // 4 AS est_tokens FROM r""")
def fill_template(spark, d):
    start = F.col("call_no") * 20 + 1
    text = ca.fill_template(TEMPLATE, F.col("label_block"), F.col("texts"), start)
    return _with_prompts(spark, d).select("custom_id", F.md5(text).alias("digest"), ca.estimated_tokens(text).alias("est_tokens"))


@query("o4_demonstrations", f"""WITH {DOCS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || doc_id), doc_id) AS r FROM docs)
SELECT md5(string_agg('query: "' || text || '"' || chr(10) || 'intent: ' || lang, chr(10) ORDER BY lang, text)) AS digest,
  count(*) AS n FROM r WHERE r <= 2""")
def demonstrations(spark, d):
    docs = documents(spark, d).select("doc_id", "label", "text", F.col("lang").alias("intent"))
    voc = ds.vocabulary_of(table(spark, d, "documents"), "lang")
    demos = ca.fixed_demonstrations(docs, voc, 2, "label", "doc_id", 3).select("intent", "text")
    text = F.array_sort(F.collect_list(F.struct("intent", "text")))
    return demos.agg(F.md5(ca.demo_text(text)).alias("digest"), F.count(F.lit(1)).alias("n"))


@query("o5_request_bodies", f"""WITH {CALLS_SQL}, r AS (SELECT custom_id, {USER_SQL} AS content FROM calls)
SELECT custom_id, 'model-x' AS model, 1024 AS max_tokens, 'disabled' AS thinking, 'json_schema' AS format,
  20 AS n_enum, md5(content) AS user_digest FROM r""")
def request_bodies(spark, d):
    names = ds.vocabulary_of(table(spark, d, "documents"), "source").agg(
        F.array_sort(F.collect_list("intent")).alias("names"), F.lit(1).alias("_one"))
    calls = _with_prompts(spark, d).withColumn("_one", F.lit(1)).join(F.broadcast(names), "_one")
    body = ca.request_body(F.col("system"), F.col("user"), F.col("names"), "model-x", 20)
    get = lambda path: F.get_json_object("body", path)
    enum = "$.output_config.format.schema.properties.predictions.items.properties.intent.enum"
    return calls.select("custom_id", body.alias("body")).select(
        "custom_id", get("$.model").alias("model"), get("$.max_tokens").cast("int").alias("max_tokens"),
        get("$.thinking.type").alias("thinking"), get("$.output_config.format.type").alias("format"),
        F.json_array_length(get(enum)).alias("n_enum"),
        F.md5(get("$.messages[0].content")).alias("user_digest"))


# --- the four kinds of prompt, over the items of `benchmark` and the languages as classes ---

PROMPTS = {
    "zero_shot": ca.Prompt("zero_shot"),
    "glosses": ca.Prompt("glosses", extra="Answer with the name alone."),
    "fixed_kshot": ca.Prompt("fixed_kshot", 2, effort="low"),
    "retrieved_kshot": ca.Prompt("retrieved_kshot", 2),
}


def _assembled(spark, d, rung):
    docs = documents(spark, d).select("doc_id", "label", "text", F.col("lang").alias("intent"))
    names = ds.vocabulary_of(table(spark, d, "documents"), "lang")
    n = docs.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
    glosses = n.select("intent", F.concat(F.lit("text in "), "intent", F.lit(", as in "), F.col("n").cast("string"), F.lit(" others")).alias("gloss"))
    voc = names if rung == "zero_shot" else ds.require_glosses(names, glosses)
    items = table(spark, d, "benchmark").select("item_id", "text")
    calls = items.select(F.concat(F.lit("call-"), F.col("item_id").cast("string")).alias("custom_id"), F.array("text").alias("texts"))
    fixed = retrieved = None
    if rung == "fixed_kshot":
        fixed = ca.fixed_demonstrations(docs, voc.select("label", "intent"), 2, "label", "doc_id", 3).select("intent", "text")
    if rung == "retrieved_kshot":
        near = rt.retrieve(items.withColumnRenamed("item_id", "doc_id"), docs.select("doc_id", "text"), "doc_id", 2)
        retrieved = rt.demonstrations(near, docs, "doc_id").select(
            F.concat(F.lit("call-"), F.col("query").cast("string")).alias("custom_id"), "demos")
    return ca.assemble(calls, PROMPTS[rung], voc, fixed, retrieved)


def _assembled_sql(rung):
    """The same calls in SQL: system text, user text, and what is hashed of the prompt."""
    p = PROMPTS[rung]
    text = lambda t: "'" + t.replace("\n", "' || chr(10) || '") + "'"
    line = "'- ' || lang" + ("" if rung == "zero_shot" else " || ': text in ' || lang || ', as in ' || n || ' others'")
    demo = """'query: "' || text || '"' || chr(10) || 'intent: ' || lang"""
    ctes = [DOCS_SQL, "langs AS (SELECT lang, count(*) AS n FROM docs WHERE lang <> '' GROUP BY lang)"]
    system = text(ca.TASK.format(domain=p.domain) + "\n\nIntents:\n") + f" || (SELECT string_agg({line}, chr(10) ORDER BY lang) FROM langs)"
    user = """'Classify this query:' || chr(10) || '"' || text || '"'"""
    source = "benchmark"
    if rung == "fixed_kshot":
        ctes.append("r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || doc_id), doc_id) AS r FROM docs)")
        system += " || " + text("\n\nLabelled examples:\n") + f" || (SELECT string_agg({demo}, chr(10) ORDER BY lang, text) FROM r WHERE r <= 2)"
    if rung == "retrieved_kshot":
        ctes += [near_sql("docs", "benchmark", "item_id"),
                 f"shown AS (SELECT query, string_agg({demo}, chr(10) ORDER BY rank DESC) AS demos FROM near JOIN docs ON doc_id = pool WHERE rank <= 2 GROUP BY query)"]
        user = f"coalesce({text('Similar labelled examples:' + chr(10))} || demos || chr(10) || chr(10), '') || {user}"
        source = "benchmark LEFT JOIN shown ON item_id = query"
    if p.extra:
        system += " || " + text("\n\n" + p.extra)
    names = """'[' || (SELECT string_agg('"' || lang || '"', ',' ORDER BY lang) FROM langs) || ']'"""
    schema = f"""'{{"type":"object","properties":{{"intent":{{"type":"string","enum":' || {names} || '}}}},"required":["intent"],"additionalProperties":false}}'"""
    config = (f'{{"config":{{"domain":"{p.domain}","effort":"{p.effort or ""}","extra":"' + f"' || sha256('{p.extra}') || '"
              + f'","k":{p.k},"model":"{p.model}","per_call":{p.per_call},"rung":"{p.rung}","thinking":"{p.thinking}"}},"labels":"')
    return ctes, system, user, source, f"""'{config}' || sha256({names}) || '","schema":"' || sha256({schema}) || '","system":"' || sha256(system) || '"}}'"""


def _rung_sql(rung):
    ctes, system, user, source, content = _assembled_sql(rung)
    return f"""WITH {", ".join(ctes)}, one AS (SELECT {system} AS system), who AS (SELECT system, substr(sha256({content}), 1, 16) AS fingerprint FROM one)
SELECT 'call-' || item_id AS custom_id, md5(system) AS system_digest, md5({user}) AS user_digest, fingerprint FROM {source}, who"""


def _rung(rung):
    def plan(spark, d):
        return _assembled(spark, d, rung).select(
            "custom_id", F.md5("system").alias("system_digest"), F.md5("user").alias("user_digest"), "fingerprint")

    return plan


for _name_of_rung in ca.RUNGS:
    query(f"o4_rung_{_name_of_rung}", _rung_sql(_name_of_rung))(_rung(_name_of_rung))


@query("o6_fingerprint", " UNION ALL ".join(
    "(WITH {}, one AS (SELECT {} AS system) SELECT '{}' AS rung, substr(sha256({}), 1, 16) AS fingerprint FROM one)".format(
        ", ".join(ctes), system, rung, content)
    for rung in ca.RUNGS if rung != "retrieved_kshot" for ctes, system, _, _, content in [_assembled_sql(rung)]))
def prompt_fingerprint(spark, d):
    found = None
    for rung in ca.RUNGS:
        if rung != "retrieved_kshot":
            one = _assembled(spark, d, rung).select(F.lit(rung).alias("rung"), "fingerprint").distinct()
            found = one if found is None else found.unionByName(one)
    return found


# --- replies -----------------------------------------------------------------------------

NAME_SQL = "CASE {c} WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' WHEN 4 THEN 'view' END"


def _name(column: str):
    return F.get(F.array(*[F.lit(n) for n in EVENT_TYPES]), F.col(column).cast("int"))


def _row_calls(spark, d):
    """One call per row, and a reply to it: refused, empty, cut off, without the key, or fine; some
    calls are answered once more."""
    p = predictions(spark, d).select("row_id", "b")
    cid = F.concat(F.lit("call-"), F.col("row_id").cast("string"))
    calls = p.select(cid.alias("custom_id"), F.array("row_id").alias("row_ids"))
    i = F.col("row_id")
    good = F.to_json(F.struct(_name("b").alias("intent")))
    text = F.when(i % 31 == 0, None).when(i % 37 == 0, '{"intent": "cli').when(i % 41 == 0, "{}").otherwise(good)
    results = p.filter(i % 43 != 0).select(
        cid.alias("custom_id"), text.alias("text"),
        F.when(i % 47 == 0, "errored").otherwise("succeeded").alias("status"),
        F.when(i % 29 == 0, "refusal").otherwise("end_turn").alias("stop_reason"),
        F.concat(F.lit("served-"), (i % 3).cast("string")).alias("resolved_model"), F.lit(0).alias("arrival"))
    again = results.filter("endswith(custom_id, '7')").withColumns({"text": F.lit('{"intent": "late"}'), "arrival": F.lit(1)})
    return calls, results.unionByName(again)


@query("r1_single_replies", f"""WITH {P_SQL}, r AS (SELECT row_id, b, CASE WHEN row_id % 43 = 0 THEN 'no batch result returned'
    WHEN row_id % 47 = 0 THEN 'batch result errored' WHEN row_id % 29 = 0 THEN 'refusal' WHEN row_id % 31 = 0 THEN 'no text block'
    WHEN row_id % 37 = 0 THEN 'invalid JSON' END AS error FROM p)
SELECT row_id, CASE WHEN error IS NULL AND row_id % 41 <> 0 THEN {NAME_SQL.format(c='b')} END AS pred_intent, error FROM r""")
def single_replies(spark, d):
    return re_.parse_single(*_row_calls(spark, d)).select("row_id", "pred_intent", "error")


def _batch_calls(spark, d):
    """Calls of 150 rows; replies skip every 13th row, repeat every 17th, add ids out of range and an
    item that is no object. Every fifth call is answered once more."""
    p = predictions(spark, d).select("row_id", "b")
    ordered = ca.order_rows(p, "row_id", "shuffled", SEED).withColumn("name", F.coalesce(_name("b"), F.lit("none")))
    calls = ca.chunk_calls(ordered, PER_CALL, "row_id", text="name")
    at = F.expr(f"(pos - 1) % {PER_CALL} + 1").cast("bigint")
    entry = F.struct(at.alias("id"), F.col("name").alias("intent"))
    again = F.struct(at.alias("id"), F.lit("repeat").alias("intent"))
    stray = F.struct((at + 1000).alias("id"), F.lit("stray").alias("intent"))
    entries = F.when(F.col("row_id") % 13 == 0, F.array(stray)).when(F.col("row_id") % 17 == 0, F.array(entry, again)) \
        .otherwise(F.array(entry))
    call = F.expr(f"(pos - 1) div {PER_CALL}")
    results = ordered.groupBy(call.alias("call_no")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", entries.alias("e")))), lambda r: r["e"])).alias("e")
    ).filter("call_no % 11 <> 5").select(
        "call_no", ca.custom_id("call_no").alias("custom_id"),
        F.concat(F.lit('{"predictions":["no object",{"id":3000000000,"intent":"far"},{"id":0,"intent":"zero"},'),
                 F.substring(F.to_json("e"), 2, 2**31 - 1), F.lit("}")).alias("text"),
        F.when(F.col("call_no") % 7 == 3, "refusal").otherwise("end_turn").alias("stop_reason"), F.lit(0).alias("arrival"))
    again = results.filter("call_no % 5 = 0").withColumns({"text": F.lit('{"predictions":[]}'), "arrival": F.lit(1)})
    return calls, results.unionByName(again).drop("call_no")


@query("r2_batched_replies", f"""WITH {P_SQL}, {order_cte('p', 'row_id')}, r AS (SELECT row_id, pos, b,
  CASE WHEN ((pos - 1) // 150) % 11 = 5 THEN 'no batch result returned' WHEN ((pos - 1) // 150) % 7 = 3 THEN 'refusal'
       WHEN row_id % 13 = 0 THEN 'missing from batched reply' END AS error FROM ordered)
SELECT row_id, CASE WHEN error IS NULL THEN coalesce({NAME_SQL.format(c='b')}, 'none') END AS pred_intent, error,
  ((pos - 1) % 150)::INTEGER AS position_in_call FROM r""")
def batched_replies(spark, d):
    return re_.parse_batched(*_batch_calls(spark, d)).select("row_id", "pred_intent", "error", "position_in_call")


def _wrapped(spark, d):
    """Every conversation turn as a reply: plain, fenced, inside prose, cut off, or prose only."""
    c = table(spark, d, "conversations")
    item = F.struct(F.col("turn").alias("id"), F.col("role").alias("intent"))
    js = F.to_json(F.array(item, item))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("\n "), js, F.lit(" \n")))
        .when(kind == 1, F.concat(F.col("text"), F.lit("\n```json\n"), js, F.lit("\n```\n"), F.col("text")))
        .when(kind == 2, F.concat(F.col("text"), F.lit(" "), js, F.lit(" "), F.col("text")))
        .when(kind == 3, F.concat(F.lit("```\n["), F.col("text"), F.lit("]\n```")))
        .otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", text.alias("reply"))


@query("r3_tolerant_parse", """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 < 3 THEN
    '[{"id":' || turn || ',"intent":"' || role || '"},{"id":' || turn || ',"intent":"' || role || '"}]' END AS parsed,
  CASE (conv_id + turn) % 5 WHEN 1 THEN 'stripped markdown code fence' WHEN 2 THEN 'extracted JSON array from surrounding text'
    WHEN 3 THEN 'JSON inside markdown fence still invalid' WHEN 4 THEN 'no valid JSON array found in response' END AS note FROM conversations""")
def tolerant_parse(spark, d):
    return re_.parse_tolerant(_wrapped(spark, d), "reply").drop("reply")


@query("r4_reply_counts", """SELECT conv_id, count(*) * 2 AS n_expected, sum(CASE WHEN (conv_id + turn) % 5 < 3 THEN 2 ELSE 0 END)::BIGINT AS n_items,
  0 AS n_not_object, count(*) * 2 = sum(CASE WHEN (conv_id + turn) % 5 < 3 THEN 2 ELSE 0 END) AS complete FROM conversations GROUP BY 1""")
def reply_counts(spark, d):
    wrapped = _wrapped(spark, d)
    parsed = re_.parse_tolerant(wrapped, "reply").filter("parsed is not null").select("conv_id", "parsed")
    expected = wrapped.groupBy("conv_id").agg((F.count(F.lit(1)) * 2).alias("n_expected"))
    return re_.reply_counts(expected, re_.reply_items(parsed), "conv_id")


@query("r5_results_by_id", f"""WITH {P_SQL}, r AS (SELECT CASE WHEN row_id % 43 = 0 THEN 'no batch result returned'
    WHEN row_id % 47 = 0 THEN 'batch result errored' WHEN row_id % 29 = 0 THEN 'refusal' WHEN row_id % 31 = 0 THEN 'no text block'
    WHEN row_id % 37 = 0 THEN 'invalid JSON' ELSE 'ok' END AS reason FROM p)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def results_by_id(spark, d):
    calls, results = _row_calls(spark, d)
    got = re_.attach_results(calls, re_.explain_results(results))
    return got.groupBy(F.coalesce("error", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("r6_join_gold", f"""WITH {P_SQL} SELECT p.row_id, p.y, e.event_type AS true_intent, p.b FROM p JOIN events e ON e.event_id = p.row_id""")
def join_gold(spark, d):
    gold = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("true_intent"))
    return re_.join_gold(predictions(spark, d).select("row_id", "y", "b"), gold).select("row_id", "y", "true_intent", "b")


@query("r7_streamed_replies", """SELECT 'turn-' || conv_id || '-' || turn AS custom_id, role, md5(text) AS digest FROM conversations
WHERE role <> 'system'""")
def streamed_replies(spark, d):
    """`conversations` read as a file stream; turns of the system are not expected and drop out."""
    c = table(spark, d, "conversations")
    cid = F.concat_ws("-", F.lit("turn"), F.col("conv_id"), F.col("turn")).alias("custom_id")
    # A pattern takes the table as one file or as a folder of them.
    stream = ig.reply_stream(spark, f"{d}/conversations.parque[t]", c.schema, "parquet").select(cid, "role", "text")
    calls = c.filter("role <> 'system'").select(cid)
    root = scratch_dir(spark, "replies")
    out = ig.ingest(stream, calls, f"{root}/sink", f"{root}/progress")
    return out.select("custom_id", "role", F.md5("text").alias("digest"))


@query("r8_served_models", f"""WITH {P_SQL}, {RUNS_SQL} SELECT run_index, string_agg(DISTINCT resolved_model, ',' ORDER BY resolved_model) AS models
FROM runs GROUP BY 1""")
def served_models(spark, d):
    return re_.served_models(repeated_runs(spark, d), "run_index")
