"""Replies of an external model turned into exactly one row per requested row.

A prediction that is missing is null with a reason. No row is dropped and none is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons and warnings the reply tables carry.
REFUSAL = "refusal"
NO_TEXT = "no text block"
INVALID = "invalid JSON"
NOT_IN_REPLY = "missing from batched reply"
NO_RESULT = "no batch result returned"
FAILED = "batch result "
FENCE_WARNING = "stripped markdown code fence"
ARRAY_WARNING = "extracted JSON array from surrounding text"
FENCE_INVALID = "JSON inside markdown fence still invalid"
ARRAY_INVALID = "could not parse extracted array"
NOT_FOUND = "no valid JSON array found in response"
# Where JSON may hide in a reply.
FENCE = r"(?s)```(?:json)?\s*\n?(\[.*?\])\s*\n?```"
ARRAY = r"(?s)(\[\s*\{.*?\}\s*\])"

RESULT_COLUMNS = (
    "status", "stop_reason", "resolved_model", "text", "input_tokens", "output_tokens",
    "cache_creation_input_tokens", "cache_read_input_tokens", "latency_ms",
)
CARRIED = tuple(c for c in RESULT_COLUMNS if c not in ("status", "text"))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; never null. The strict grammar counts: `NaN` and
    repeated keys of an object are not JSON."""
    return F.try_parse_json(text).isNotNull()


def requested_rows(calls: DataFrame) -> DataFrame:
    """`custom_id, position_in_call, row_id` for every row of every call."""
    return calls.select("custom_id", F.posexplode("row_ids").alias("position_in_call", "row_id"))


def explain_results(results: DataFrame) -> DataFrame:
    """`custom_id, text, error` and the carried columns; `error` is null for a usable reply.

    `results` may lack any of RESULT_COLUMNS. A column `arrival` goes through.
    """
    absent = [F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS if c not in results.columns]
    full = results.select("*", *absent)
    status = F.coalesce(F.col("status"), F.lit("succeeded"))
    reason = (
        F.when(status != "succeeded", F.concat(F.lit(FAILED), status))
        .when(F.col("stop_reason") == "refusal", REFUSAL)
        .when(F.col("text").isNull(), NO_TEXT)
        .when(~is_json(F.col("text")), INVALID)
    )
    return full.select("custom_id", "text", reason.alias("error"), *CARRIED, *_arrival(results))


def _arrival(results: DataFrame) -> list[str]:
    return [c for c in ("arrival",) if c in results.columns]


def one_per_call(explained: DataFrame) -> DataFrame:
    """One result per `custom_id`: the one with the smallest `arrival` if there is such a column,
    else a usable one before others, and of those the smallest by its contents."""
    rest = [c for c in explained.columns if c not in ("custom_id", "arrival")]
    order = F.struct(*_arrival(explained), F.col("error").isNotNull(), *rest)
    first = F.min_by(F.struct(*rest), order)
    return explained.groupBy("custom_id").agg(first.alias("_first")).select("custom_id", "_first.*")


def attach_results(calls: DataFrame, explained: DataFrame) -> DataFrame:
    """Every expected call with one result, found by id whatever order results arrive in.
    A call without one keeps nulls and a reason."""
    found = one_per_call(explained).withColumn("_found", F.lit(True))
    reason = F.when(F.col("_found").isNull(), NO_RESULT).otherwise(F.col("error"))
    return calls.join(found, "custom_id", "left").withColumn("error", reason).drop("_found")


def parse_single(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One prediction per call of one row. Replies are parsed before the join, so their text
    is not shuffled."""
    intent = F.when(F.col("error").isNull(), F.from_json("text", "intent string")["intent"])
    parsed = explain_results(results).withColumn("pred_intent", intent).drop("text")
    return attach_results(calls, parsed).select(
        "custom_id",
        F.lit(0).alias("position_in_call"),
        F.get("row_ids", F.lit(0)).alias("row_id"),
        "pred_intent", "error", *CARRIED,
    )


def parse_batched(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One prediction per requested row of calls that ask about many.

    Of several entries with one id the first counts; ids outside the call and entries that are
    not objects are ignored, the others of such a reply count. Entries and rows meet on
    (call, id), so neither a long reply nor a long call sits in one row.
    """
    explained = one_per_call(explain_results(results))
    items = F.from_json("text", "predictions array<string>")["predictions"]
    entries = (
        explained.filter("error is null")
        .select("custom_id", F.posexplode(items).alias("p", "raw"))
        .select("custom_id", "p", F.from_json("raw", "id bigint, intent string").alias("item"))
        .filter(F.col("item.id").between(1, 2**31 - 1))
        .groupBy("custom_id", (F.col("item.id") - 1).cast("int").alias("position_in_call"))
        .agg(F.min_by(F.struct("item.intent"), "p").alias("entry"))
    )
    rows = attach_results(calls, explained.drop("text")).select(
        "custom_id", "error", *CARRIED, F.posexplode("row_ids").alias("position_in_call", "row_id")
    )
    missing = F.when(F.col("entry").isNull(), NOT_IN_REPLY)
    return rows.join(entries, ["custom_id", "position_in_call"], "left").select(
        "custom_id", "position_in_call", "row_id",
        F.col("entry.intent").alias("pred_intent"),
        F.coalesce("error", missing).alias("error"),
        *CARRIED,
    )


def parse_tolerant(df: DataFrame, text: str) -> DataFrame:
    """Adds `parsed` (JSON text or null) and `note` (warning or error, null if plain).

    Tries the text itself, then a fenced block, then the first array of objects inside it.
    """
    t = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    fenced = F.regexp_extract(t, FENCE, 1)
    array = F.regexp_extract(t, ARRAY, 1)
    parsed = (
        F.when(is_json(t), t)
        .when(fenced != "", F.when(is_json(fenced), fenced))
        .when(array != "", F.when(is_json(array), array))
    )
    note = (
        F.when(is_json(t), F.lit(None).cast("string"))
        .when(fenced != "", F.when(is_json(fenced), FENCE_WARNING).otherwise(FENCE_INVALID))
        .when(array != "", F.when(is_json(array), ARRAY_WARNING).otherwise(ARRAY_INVALID))
        .otherwise(NOT_FOUND)
    )
    return df.withColumn("parsed", parsed).withColumn("note", note)


def reply_items(parsed: DataFrame, column: str = "parsed") -> DataFrame:
    """One row per array item: the other columns, `pos`, `id`, `intent`, `is_object`."""
    rest = [c for c in parsed.columns if c != column]
    item = F.from_json("raw", "id bigint, intent string")
    raw = F.posexplode(F.from_json(column, "array<string>")).alias("pos", "raw")
    return parsed.select(*rest, raw).select(
        *rest, "pos", item["id"].alias("id"), F.trim(item["intent"]).alias("intent"),
        F.coalesce(F.startswith("raw", F.lit("{")), F.lit(False)).alias("is_object"),
    )


def reply_counts(expected: DataFrame, items: DataFrame, batch: str) -> DataFrame:
    """Items against expected rows per batch, and items that are not objects.

    `expected`: `batch, n_expected`. A batch with no reply at all shows zero items.
    """
    got = items.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(~F.col("is_object")).alias("n_not_object")
    )
    both = expected.join(got, batch, "left").fillna(0, ["n_items", "n_not_object"])
    return both.withColumn(
        "complete", (F.col("n_items") == F.col("n_expected")) & (F.col("n_not_object") == 0)
    )


def join_gold(predictions: DataFrame, gold: DataFrame, row: str = "row_id") -> DataFrame:
    """Predictions with text and true label; raises if a gold key repeats, which would fan out."""
    repeated = gold.groupBy(row).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"gold rows repeat for {[r[row] for r in repeated]}")
    return predictions.join(gold, row, "left")


def served_models(df: DataFrame, run: str, model: str = "resolved_model") -> DataFrame:
    """The model ids that answered in each run, sorted; nulls do not count."""
    return df.groupBy(run).agg(F.array_join(F.sort_array(F.collect_set(model)), ",").alias("models"))
