"""Text quality without gold labels: overlapping heuristic labellers, weighed by how they agree.

Each labeller looks at one side of a text and votes good, bad or nothing. Expectation-
maximisation over the counts of vote patterns, taken over all documents, estimates how often
each labeller votes what for good and for bad texts. Posterior labels of a bounded sample train
a linear scorer over hashed words, word shapes and binned statistics; the scorer, not the
votes, judges every text, so texts on which labellers abstain are judged too.

There are at most 3 ** 10 patterns, and the scorer is a vector of a few thousand weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import in_arrow, numbered
from labelscope.llm.words import IDENTITY, LOWER, NOT_SPACE, Block, Words, blocks, windows

#: Documents the scorer is trained on, chosen by hash of the id.
TRAIN_ROWS = 3_000
WORD_SLOTS, SHAPE_SLOTS, BINS = 1 << 12, 512, 8
LABELLERS = ("symbols", "capitals", "exclamations", "line_copies", "word_copies", "word_length", "endings", "variety",
             "letters", "odd_words")
SLOTS = WORD_SLOTS + SHAPE_SLOTS + BINS * len(LABELLERS) + 1
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Of each statistic: bad from or below, good to or above, and whether high values are bad.
LIMITS = {
    "symbols": (0.02, 0.005, True),
    "capitals": (0.40, 0.20, True),
    "exclamations": (0.02, 0.005, True),
    "line_copies": (0.30, 0.05, True),
    "word_copies": (0.40, 0.15, True),
    "word_length": (14.0, 10.0, True),
    "endings": (0.20, 0.60, False),
    "variety": (0.20, 0.40, False),
    "letters": (0.85, 0.92, False),
    "odd_words": (0.15, 0.05, True),
}
#: Statistics that say nothing about a text of fewer words.
LEAST_WORDS = {"word_copies": 20, "variety": 50, "capitals": 5, "word_length": 5, "line_copies": 5, "endings": 5,
               "letters": 5, "odd_words": 5}
_U = np.uint64

_LOW, _UP, _DIGIT, _SYMBOL, _BANG, _STOP, _FAR = (1 << k for k in range(7))
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = _LOW, _UP, _DIGIT, _FAR
_KIND[[ord(c) for c in "#*$%&|<>{}~^_=@\\"]] = _SYMBOL
_KIND[[ord(c) for c in "!?"]] = _BANG
_KIND[[ord(c) for c in ".,;:"]] = _STOP


def _per_text(values: np.ndarray, block: Block) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[block.offsets[1:]] - total[block.offsets[:-1]]


def statistics(block: Block) -> tuple[np.ndarray, np.ndarray, Words]:
    """One row of statistics per text (nan where a text is too short to say), the shape code of
    every word, and the words."""
    words = Words(block, NOT_SPACE, IDENTITY)
    kind, n = _KIND[block.data], words.counts
    size = np.maximum(np.diff(block.offsets), 1)
    letters = np.maximum(_per_text(kind & (_LOW | _UP) > 0, block), 1)
    out = np.full((block.n, len(LABELLERS)), np.nan)
    out[:, 0] = _per_text(kind == _SYMBOL, block) / size
    out[:, 1] = _per_text(kind == _UP, block) / letters
    out[:, 2] = _per_text(kind == _BANG, block) / size
    shape = np.zeros(len(words.start), dtype=np.int64)
    if len(words.start):
        length = words.end - words.start
        shape = np.bitwise_or.reduceat(kind, words.start).astype(np.int64) + 128 * np.digitize(length, (3, 7, 13))
        many = np.maximum(n, 1)
        spaces = np.diff(block.offsets) - np.bincount(words.owner(), weights=length, minlength=block.n)
        out[:, 8] = _per_text(kind & (_LOW | _UP | _DIGIT | _FAR) > 0, block) / np.maximum(size - spaces, 1)
        out[:, 9] = np.bincount(words.owner(), weights=shape & _SYMBOL > 0, minlength=block.n) / many
        out[:, 5] = np.bincount(words.owner(), weights=length, minlength=block.n) / many
        runs, fits = windows(words, 3)
        for d in np.flatnonzero(n >= 3).tolist():
            a, b = words.bounds[d], words.bounds[d + 1]
            out[d, 4] = 1 - len(np.unique(runs[a : b - 2])) / (b - 2 - a)
            out[d, 7] = len(np.unique(words.hash[a:b])) / min(b - a, 400)
    for d in np.flatnonzero(n > 0).tolist():
        lines = [x for x in block.text(d).split(b"\n") if x.strip()]
        out[d, 3] = 1 - len(set(lines)) / len(lines)
        out[d, 6] = sum(x.rstrip()[-1:] in b".!?:;\"')" for x in lines) / len(lines)
    for name, least in LEAST_WORDS.items():
        out[n < least, LABELLERS.index(name)] = np.nan
    out[n == 0] = np.nan
    return out, shape, words


def votes(stats: np.ndarray) -> np.ndarray:
    cast = np.full(stats.shape, ABSTAIN, dtype=np.int64)
    for k, name in enumerate(LABELLERS):
        bad, good, high = LIMITS[name]
        x = stats[:, k]
        with np.errstate(invalid="ignore"):
            cast[(x >= bad) if high else (x <= bad), k] = BAD
            cast[(x <= good) if high else (x >= good), k] = GOOD
    return cast


def features(block: Block, stats: np.ndarray, shape: np.ndarray, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and weights of each text: shares of hashed words and shapes, one bin a statistic."""
    folded = Words(block, NOT_SPACE, LOWER).hash
    slot = (folded & _U(WORD_SLOTS - 1)).astype(np.int64)
    out = []
    for d in range(block.n):
        a, b = words.bounds[d], words.bounds[d + 1]
        own, base = [np.array([SLOTS - 1])], WORD_SLOTS + SHAPE_SLOTS
        weight = [np.ones(1)]
        if b > a:
            for ids, begin, scale in ((slot[a:b], 0, 1.0), (shape[a:b], WORD_SLOTS, 3.0)):
                i, c = np.unique(ids, return_counts=True)
                own.append(i + begin)
                weight.append(scale * c / (b - a))
        for k, name in enumerate(LABELLERS):
            if not np.isnan(stats[d, k]):
                bad, good, high = LIMITS[name]
                step = int(np.clip((stats[d, k] - min(bad, good)) / abs(bad - good) * (BINS - 2) + 1, 0, BINS - 1))
                own.append(np.array([base + k * BINS + step]))
                weight.append(np.ones(1))
        out.append((np.concatenate(own), np.concatenate(weight)))
    return out


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        for block in blocks(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(votes(statistics(block)[0]) @ powers)], names=["pattern"])


def _training_rows(posterior: dict[int, float]):
    powers = 3 ** np.arange(len(LABELLERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                stats, shape, words = statistics(block)
                sparse = features(block, stats, shape, words)
                label = [posterior.get(int(p), 0.5) for p in votes(stats) @ powers]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label, pa.float64()), pa.array([i.astype(np.int32).tobytes() for i, _ in sparse]),
                     pa.array([w.astype(np.float32).tobytes() for _, w in sparse])],
                    names=["label", "slots", "weights"])

    return run


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, each labeller's rate of bad votes among those it
    casts on bad and on good texts, and the share of good texts.

    Not voting says nothing either way. A labeller starts out as rarely wrong about what it
    calls bad and often blind to what is bad for another reason; rounds end when posteriors rest.
    """
    cast = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    bad, fair = (cast == BAD).astype(float), (cast == GOOD).astype(float)
    rates = np.tile([0.4, 0.004], (len(LABELLERS), 1))
    share, old = 0.8, None
    for _ in range(rounds):
        like = bad @ np.log(rates) + fair @ np.log(1 - rates) + np.log([1 - share, share])
        good = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -60, 60)))
        if old is not None and np.abs(good - old).max() < 1e-7:
            break
        old = good
        share = float(np.clip((good * counts).sum() / counts.sum(), 0.01, 0.99))
        for c, weight in ((0, (1 - good) * counts), (1, good * counts)):
            # A few pseudo-votes at the starting rates keep rates off 0 and 1.
            n_bad, n_fair = weight @ bad + 5 * (0.4, 0.004)[c], weight @ fair + 5 * (0.6, 0.996)[c]
            rates[:, c] = n_bad / (n_bad + n_fair)
    return good, rates, share


def _descend(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Ridge logistic regression on soft labels by accelerated gradient steps; classes count alike."""
    mass = np.array([max((1 - y).sum(), 1e-9), max(y.sum(), 1e-9)])
    weight = (1 - y) / mass[0] + y / mass[1]
    weight /= weight.sum()
    rate = 4.0 / max(float((weight @ (x * x).sum(axis=1))), 1e-9)
    w = at = np.zeros(x.shape[1], dtype=np.float32)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        new = at - rate * (x.T @ (weight * (p - y)).astype(np.float32) + ridge * at)
        at, w = new + t / (t + 3) * (new - w), new
    return w


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the scorer. All documents enter the vote counts, `rows` of them the scorer."""
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = in_arrow(narrow.select("text"), _vote_rows, "pattern bigint").groupBy("pattern").count().toPandas()
    seen = seen[seen["pattern"] > 0]  # texts nobody votes on say nothing
    if not len(seen):
        return np.zeros(SLOTS, dtype=np.float32)
    good, _, _ = estimate(seen["pattern"].to_numpy(), seen["count"].to_numpy().astype(float))
    posterior = dict(zip(seen["pattern"].tolist(), good.tolist()))
    chosen = narrow.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = narrow.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text")
    made = in_arrow(sample, _training_rows(posterior), "label double, slots binary, weights binary").toPandas()
    x = np.zeros((len(made), SLOTS), dtype=np.float32)
    for i, (s, v) in enumerate(zip(made["slots"], made["weights"])):
        x[i, np.frombuffer(s, dtype=np.int32)] = np.frombuffer(v, dtype=np.float32)
    if not len(x):
        return np.zeros(SLOTS, dtype=np.float32)
    return _descend(x, made["label"].to_numpy())


def _score(weights: np.ndarray):
    """The columns of each row but the last, which is its text, and what its text scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            for block in blocks(batch.column(batch.num_columns - 1)):
                stats, shape, words = statistics(block)
                z = np.array([float(weights[i] @ v) for i, v in features(block, stats, shape, words)])
                cast = votes(stats)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(block.first, block.n) for c in rest]
                    + [pa.array((cast == GOOD).sum(axis=1)), pa.array((cast == BAD).sum(axis=1)),
                       pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))],
                    names=[f"c{i}" for i in range(len(rest))] + ["n_good", "n_bad", "score"])

    return run


def filter_rows(docs: DataFrame, weights: np.ndarray, keep: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """The rows of `docs` whose score passes `keep`. All columns go through as they are, whatever
    they are called."""
    fields = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(docs.schema))
    wide = numbered(docs, text)
    made = in_arrow(wide, _score(weights), fields + "n_good bigint, n_bad bigint, score double").filter(keep(F.col("score")))
    return made.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def score_texts(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    narrow = docs.select(F.col(key).cast("bigint").alias("c0"), F.col(text).cast("string").alias("text"))
    return in_arrow(narrow, _score(weights), "c0 bigint, n_good bigint, n_bad bigint, score double").withColumnRenamed("c0", "doc_id")


def weak_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_good, n_bad, score, kept` of every row of `docs`.

    `n_good` and `n_bad` are labellers voting so, `score` (0 to 1) is high for good texts, and
    `kept` is `score >= 0.5`. Null, empty and wordless texts get no vote; the scorer knows them
    by its intercept alone. Rows come back one for one, also repeated ones and those without an
    id; other columns are not read. Without documents, or if nobody votes, all scores are 0.5.
    """
    scored = score_texts(docs, fit(docs, key, text), key, text)
    return scored.withColumn("kept", F.col("score") >= 0.5)
