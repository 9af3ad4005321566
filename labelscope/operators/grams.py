"""Character n-grams of whole texts as one row per text, and TF-IDF weights over them.

An n-gram is a 64-bit hash of its characters here, so a text travels as two arrays and no string
is ever shuffled. Spark deals out the texts; one Arrow pass cuts a batch into n-grams without a
shuffle. Fitting counts document frequencies, which combine map-side, and writes the vocabulary;
fit and transform share the same cut texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.text import words
from labelscope.session import scratch_dir, ship_package

BLOCK_BYTES = 1 << 20  # of text that are cut at once
PART_BYTES = 1 << 24  # of text in a partition; its n-grams take some twenty times as much
#: Terms of a vocabulary that tasks are sent whole, 16 bytes each (64 MB); more are joined.
BROADCAST_TERMS = 4_000_000
_U = np.uint64
_SPACE = 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _cut(texts: list[str], low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams and counts of each text; words are apart by one space."""
    padded = [f" {t} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(p) for p in padded])
    space = codes == _SPACE
    inner = np.concatenate(([0], np.cumsum(space)))
    h, found, starts = np.zeros(len(codes), dtype=_U), [], []
    for n in range(1, high + 1):
        if n > len(codes):
            break
        # The hash of the n characters from each place on.
        h = _mix(h[: len(codes) - n + 1] ^ (codes[n - 1 :].astype(_U) + _U(0x9E3779B97F4A7C15)))
        at = np.arange(len(h))
        if n > 1:
            whole = inner[at + n - 1] == inner[at + 1]  # no space but at the ends
            if n == 2:
                whole &= ~(space[at] & space[at + 1])
            if n < low:  # only words that are shorter than the smallest n-gram, as a whole
                whole &= space[at] & space[at + n - 1]
            found.append(h[whole])
            starts.append(at[whole])
    grams, place = np.concatenate(found), np.concatenate(starts)
    owner = np.searchsorted(ends, place, side="right")
    order = np.argsort(owner, kind="stable")
    grams, bounds = grams[order].view(np.int64), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    for i in range(len(texts)):
        yield np.unique(grams[bounds[i] : bounds[i + 1]], return_counts=True)


def _in_blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t) + 2
    if first < len(texts):
        yield first, len(texts)


def cut_batch(texts: list[str], low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`_cut` in blocks of bounded size."""
    for first, last in _in_blocks(texts):
        yield from _cut(texts[first:last], low, high)


def cut_blocks(texts: list[str], low: int, high: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """`first, last, grams, tfs, owner` of blocks of bounded text: the n-grams of texts `first` to
    `last` in one array, and which of these texts each is of."""
    for first, last in _in_blocks(texts):
        made = list(_cut(texts[first:last], low, high))
        owner = np.repeat(np.arange(last - first), [len(g) for g, _ in made])
        yield first, last, np.concatenate([g for g, _ in made]), np.concatenate([c for _, c in made]), owner


def _list_array(arrays: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def spaced(text: str = "text"):
    """The lower-cased words of a text, one space apart; null is no word."""
    return F.coalesce(F.array_join(words(text), " "), F.lit(""))


def spread(df: DataFrame, key: str, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows dealt out by key to partitions of bounded text, however few files they come from."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, -(-size // BLOCK_BYTES)), -(-size // part_bytes)), key)


def gram_lists(df: DataFrame, key: str, text: str = "text", low: int = 3, high: int = 5) -> DataFrame:
    """`key, grams, tfs`: every row of `df` with its distinct n-grams, sorted, and their counts.

    Words are padded with a space on either side; a word that is shorter than the smallest n-gram
    with its spaces is one n-gram. A text without words has none and keeps its row.
    """
    if low < 2:
        raise ValueError("n-grams have two characters at least")
    ship_package(df.sparkSession)
    key_type = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in _in_blocks(texts):
                made = list(_cut(texts[first:last], low, high))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), _list_array([g for g, _ in made], np.int64),
                     _list_array([c for _, c in made], np.int32)], names=[key, "grams", "tfs"])

    return df.select(key, spaced(text).alias("text")).mapInArrow(run, f"`{key}` {key_type}, grams array<bigint>, tfs array<int>")


@dataclass(frozen=True)
class Vocabulary:
    """`table` holds `gram, df, idf`, written once; `size` is its number of rows."""

    table: DataFrame
    size: int
    low: int
    high: int
    sublinear: bool

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted n-grams and their idf, for a vocabulary of at most `BROADCAST_TERMS`."""
        if self.size > BROADCAST_TERMS:
            raise ValueError(f"{self.size} terms are too many to send to every task")
        found = self.table.select("gram", "idf").toArrow()
        grams, idf = found["gram"].to_numpy(), found["idf"].to_numpy()
        order = np.argsort(grams)
        return grams[order], idf[order]


def fit(lists: DataFrame, low: int, high: int, min_df: int = 2, sublinear: bool = False, n: int | None = None) -> Vocabulary:
    """Document frequencies of cut texts; idf = ln((1 + N) / (1 + df)) + 1. `n` is the number of
    texts where it is known, which spares cutting unwritten lists twice."""
    n = lists.count() if n is None else n
    df = lists.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    return fit_counts(df, n, low, high, min_df, sublinear)


def fit_counts(counts: DataFrame, n: int, low: int, high: int, min_df: int = 2, sublinear: bool = False) -> Vocabulary:
    """The vocabulary of `gram, df`, the document frequencies among n texts."""
    path = scratch_dir(counts.sparkSession, "grams")
    idf = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
    counts.filter(F.col("df") >= min_df).withColumn("idf", idf).write.parquet(path)
    table = counts.sparkSession.read.parquet(path)
    return Vocabulary(table, table.count(), low, high, sublinear)


def located(grams: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the known n-grams in the sorted vocabulary, and the mask of those."""
    at = np.searchsorted(terms, grams)
    at[at == len(terms)] = 0
    known = terms[at] == grams if len(terms) else np.zeros(len(grams), bool)
    return at[known], known


def scaled(tfs: np.ndarray, idf: np.ndarray, owner: np.ndarray, n: int, sublinear: bool) -> np.ndarray:
    """L2-normalised weights of the n-grams of n texts."""
    tf = tfs.astype(np.float64)
    w = (1 + np.log(tf) if sublinear else tf) * idf
    norm = np.sqrt(np.bincount(owner, weights=w * w, minlength=n))
    return w / norm[owner]


def weigh(grams: np.ndarray, tfs: np.ndarray, owner: np.ndarray, n: int, terms: np.ndarray, idf: np.ndarray, sublinear: bool):
    """Places in the sorted vocabulary and L2-normalised weights of the known n-grams of n texts,
    and the mask of those."""
    at, known = located(grams, terms)
    return at, scaled(tfs[known], idf[at], owner[known], n, sublinear), known


def weighted(lists: DataFrame, fitted: Vocabulary, key: str) -> DataFrame:
    """`key, grams, weights`: every text with its known n-grams, sorted, and their weights.

    A vocabulary of bounded size is sent to the tasks, so that texts stay where they are; a
    larger one is joined with the n-grams as rows, which are put together again by text.
    """
    spark = lists.sparkSession
    ship_package(spark)
    key_type = lists.select(key).schema[0].dataType.simpleString()
    if fitted.size > BROADCAST_TERMS:
        return _joined(lists, fitted, key)
    sent, sublinear = spark.sparkContext.broadcast(fitted.arrays()), fitted.sublinear

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = sent.value
        for batch in batches:
            own = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(own).to_numpy(zero_copy_only=False))
            grams, tfs = own.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            _, w, known = weigh(grams, tfs, owner, batch.num_rows, terms, idf, sublinear)
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner[known], minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[known])),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(w))], names=[key, "grams", "weights"])

    return lists.select(key, "grams", "tfs").mapInArrow(run, f"`{key}` {key_type}, grams array<bigint>, weights array<double>")


def _joined(lists: DataFrame, fitted: Vocabulary, key: str) -> DataFrame:
    scale = 1 + F.log("tf") if fitted.sublinear else F.col("tf")
    each = lists.select(F.monotonically_increasing_id().alias("_row"), key, "grams", "tfs")
    path = scratch_dir(lists.sparkSession, "gram-lists")
    each.write.parquet(path)
    each = lists.sparkSession.read.parquet(path)
    long = each.select("_row", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("tfs").alias("tf"))))
    found = long.join(fitted.table.select("gram", "idf"), "gram").select("_row", "gram", (scale * F.col("idf")).alias("w"))
    put = found.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("gram", "w"))).alias("s"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return each.select("_row", key).join(put, "_row", "left").select(
        key, F.coalesce("s.gram", none("bigint")).alias("grams"),
        F.coalesce(F.transform("s.w", lambda x: x / F.col("norm")), none("double")).alias("weights"))
