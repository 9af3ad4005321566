"""Toxic passages by maximum-scoring segments over token log-odds.

Training counts hashed tokens of labelled toxic and clean texts. A token's score is its log-odds
between the two classes under Dirichlet priors, less a fixed drift that makes the expected score
of clean text negative. In every text a linear scan finds all maximal segments of positive
total. Extreme-value theory says how high the best segment of a clean text of m tokens climbs by
chance: `K m exp(-lambda S)` such segments are expected. A segment is significant if that is
below `E_LIMIT`; the evidence of a text is the sum of `-log` of it over its significant segments,
and a logistic curve of its logarithm, fitted on the training rows, gives the score.

The model is a table of `BUCKETS` floats and four numbers, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import in_arrow, kept, numbered
from labelscope.llm.words import ALNUM, LOWER, Words, blocks

BUCKETS = 1 << 18
#: Prior strength in tokens, split over the classes by their share of all tokens.
PRIOR = 4.0
#: Taken from every token's log-odds; a token seen once in a toxic text stays below it.
DRIFT = 1.5
#: At most so many labelled rows of each class are learnt from, chosen by hash of the id.
TRAIN_ROWS = 20_000
E_LIMIT = 0.05
_U = np.uint64


@dataclass
class Model:
    table: np.ndarray
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    shift: float = -3.0


def held_out(key: str | Column = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text divisible by five."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % 5 == 0


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments `(begin, end, total)` of a score sequence, in linear time.

    Only positive scores are visited; what lies between two of them enters as one sum.
    """
    before = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    out: list[list] = []  # begin, end, sum before, sum at the end, last earlier with a smaller sum
    for i in np.flatnonzero(scores > 0).tolist():
        low, high = before[i], before[i + 1]
        seg = [i, i + 1, low, high, -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= seg[3]:
                seg[4] = j
                out.append(seg)
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3], -1]
            del out[j:]
    return [(b, e, high - low) for b, e, low, high, _ in out]


def _tokens(block) -> tuple[Words, np.ndarray]:
    words = Words(block, ALNUM, LOWER)
    return words, (words.hash & _U(BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
        for block in blocks(batch.column(0)):
            words, bucket = _tokens(block)
            toxic = np.repeat(label[block.first : block.first + block.n], words.counts)
            for k in (0, 1):
                totals[k] += np.bincount(bucket[toxic == k], minlength=BUCKETS)
    seen = np.flatnonzero(totals.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(totals[0, seen]), pa.array(totals[1, seen])], names=["bucket", "clean", "toxic"]
    )


def _evidence(model: Model, gives: str):
    """What every text gives: `evidence` with its best segment and token count, `score`, or
    `passages` with the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            for block in blocks(batch.column(batch.num_columns - 1)):
                words, bucket = _tokens(block)
                scores = model.table[bucket]
                evidence, best, spans = np.zeros(block.n), np.zeros(block.n), [None] * block.n
                # Texts with a positive token; all others have no segment.
                hit = np.unique(np.searchsorted(words.bounds, np.flatnonzero(scores > 0), side="right") - 1)
                for d in hit.tolist():
                    a, b = words.bounds[d], words.bounds[d + 1]
                    found = maximal_segments(scores[a:b])
                    best[d] = max(s[2] for s in found)
                    chance = model.log_k + math.log(b - a)
                    sure = [s for s in found if model.lam * s[2] - chance > -math.log(E_LIMIT)]
                    evidence[d] = sum(model.lam * s[2] - chance for s in sure)
                    if gives == "passages":
                        at = block.offsets[d]
                        spans[d] = [
                            (int(words.start[a + s[0]] - at), int(words.end[a + s[1] - 1] - at)) for s in sure
                        ]
                own = [c.slice(block.first, block.n) for c in rest]
                if gives == "evidence":
                    own += [pa.array(evidence), pa.array(best), pa.array(words.counts)]
                else:
                    z = np.clip(model.slope * np.log1p(evidence) + model.shift, -60, 60)
                    own.append(pa.array(1 / (1 + np.exp(-z))))
                if gives == "passages":
                    flat = [x for s in spans for x in (s or ())]
                    ends = np.concatenate(([0], np.cumsum([len(s or ()) for s in spans]))).astype(np.int32)
                    pairs = pa.StructArray.from_arrays(
                        [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64())],
                        names=["begin", "end"])
                    own.append(pa.ListArray.from_arrays(pa.array(ends), pairs))
                names = [f"c{i}" for i in range(len(rest))]
                names += {"evidence": ["evidence", "best", "tokens"], "score": ["score"], "passages": ["score", "passages"]}[gives]
                yield pa.RecordBatch.from_arrays(own, names=names)

    return run


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """`text, label` of at most `rows` labelled rows of each class that are not held out.

    Both the labelled and the chosen rows are picked by hash of the id, so the sample is the
    same at any size and partitioning. Repeated labels count as their largest; null labels or
    ids are left out.
    """
    known = (
        labels.select(F.col(key).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    chosen = None
    for k in (0, 1):
        part = known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # At most 2 * rows ids and labels: about half a megabyte.
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "label")


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = TRAIN_ROWS,
) -> Model:
    """Learn token scores, calibration and the logistic curve from labelled rows.

    Without toxic or without clean rows nothing can be learnt: every token scores below zero
    and every text gets a score near 0.
    """
    sample = kept(training_rows(docs, labels, key, text, label, rows), "toxicity-sample")
    counted = in_arrow(sample, _count, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # BUCKETS rows at most
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    clean[counted["bucket"]], toxic[counted["bucket"]] = counted["clean"], counted["toxic"]
    n_clean, n_toxic = clean.sum(), toxic.sum()
    model = Model(np.full(BUCKETS, -DRIFT, dtype=np.float32))
    if not n_clean or not n_toxic:
        return model
    share = n_toxic / (n_toxic + n_clean)
    odds = np.log((toxic + PRIOR * share) / n_toxic) - np.log((clean + PRIOR * (1 - share)) / n_clean)
    model.table = (odds - DRIFT).astype(np.float32)
    model.lam = _decay(model.table, clean / n_clean)
    # One number a row: at most 2 * rows of them.
    seen = in_arrow(sample.select("label", "text"), _evidence(model, "evidence"),
                    "c0 int, evidence double, best double, tokens bigint").withColumnRenamed("c0", "label").toPandas()
    quiet = seen[(seen.label == 0) & (seen.tokens > 0)]
    if len(quiet):
        # The mean of an extreme-value variable is its mode plus Euler's constant over lambda.
        level = (model.lam * quiet.best - np.log(quiet.tokens)).mean() - 0.5772156649
        model.log_k = float(max(level, -4.0))
    seen = in_arrow(sample.select("label", "text"), _evidence(model, "evidence"),
                    "c0 int, evidence double, best double, tokens bigint").withColumnRenamed("c0", "label").toPandas()
    model.slope, model.shift = _logistic(np.log1p(seen.evidence.to_numpy()), seen.label.to_numpy())
    return model


def _decay(table: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda * score) over clean text is 1."""
    used = share > 0
    s, p = table[used].astype(np.float64), share[used]
    if not (s > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * s, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps halved until the loss falls. A small
    ridge lets separable rows converge. Rows of one class only give the default curve."""
    if not len(x) or y.min() == y.max():
        return 1.0, -3.0
    design = np.stack([x, np.ones(len(x))], axis=1)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5e-2 * w @ w)

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -60, 60)))
        grad = design.T @ (p - y) + 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step, now = np.linalg.solve(hess, grad), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, score, passages` of every row: the significant segments as UTF-8 byte ranges.

    Null and wordless texts have no segment and the score of no evidence. Rows come back one
    for one, also repeated ones and those without an id; other columns are not read.
    """
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_arrow(narrow, _evidence(model, "passages"),
                    "c0 bigint, score double, passages array<struct<begin: bigint, end: bigint>>").withColumnRenamed("c0", "doc_id")


def filter_rows(docs: DataFrame, model: Model, keep: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """The rows of `docs` whose score passes `keep`. All columns go through as they are, whatever
    they are called."""
    wide = numbered(docs, text)
    made = in_arrow(wide, _evidence(model, "score"), _fields(docs) + "score double").filter(keep(F.col("score")))
    return made.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def _fields(docs: DataFrame) -> str:
    return "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(docs.schema))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """`doc_id, held_out, score, predicted, passages` of every row of `docs`."""
    scored = score_texts(docs, fit(docs, labels, key, text, label), key, text)
    return scored.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages",
    )
