"""TF-IDF over character n-grams as a long table, and dense vector pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.operators.grams import BLOCK_BYTES, spaced, spread
from labelscope.session import scratch_dir, ship_package


PART_BYTES = 1 << 23  # of text whose n-grams one task counts
BLOCK_ROWS = 1 << 20  # counts of texts that are weighed at once, and rows of a batch, about
#: Terms of a vocabulary that tasks are sent whole, some 40 bytes each (160 MB); more are joined.
BROADCAST_TERMS = 4_000_000


@dataclass(frozen=True)
class Tfidf:
    """A fitted vocabulary: `idf` holds `term, df, idf, term_id`; the rest are the settings.

    `term_id` is unique but not dense. It is fixed by being written with the table.
    """

    idf: DataFrame
    low: int
    high: int
    sublinear: bool


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _grams(words: list[str], low: int, high: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct n-grams of distinct words; places of a word's n-grams among them, word after word,
    and how many each word has."""
    padded = "".join(f" {w} " for w in words)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(w) for w in words]) + 2
    start = np.cumsum(size) - size
    word, place, length = [], [], []
    for n in range(low, high + 1):
        # A word that is shorter than the smallest n-gram is one as a whole.
        many = np.where(size >= n, size - n + 1, 1 if n == low else 0)
        word.append(np.repeat(np.arange(len(words)), many))
        place.append(_runs(start, many))
        length.append(np.minimum(n, size)[word[-1]])
    word, place, length = (np.concatenate(x) for x in (word, place, length))
    alphabet, digit = np.unique(codes, return_inverse=True)
    base, code, reach = len(alphabet) + 1, np.zeros(len(place), np.int64), 1
    for j in range(int(length.max())):
        if reach * base >= 1 << 62:  # number the beginnings anew, so that codes stay exact
            seen, code = np.unique(code, return_inverse=True)
            reach = len(seen)
        code = code * base + np.where(length > j, digit[np.minimum(place + j, len(codes) - 1)] + 1, 0)
        reach *= base
    _, first, rank = np.unique(code, return_index=True, return_inverse=True)
    at = np.concatenate(([0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(int))))
    begin, end = at[place[first]], at[place[first] + length[first]]
    data = np.frombuffer(padded.encode("utf-8", "surrogatepass"), np.uint8)[_runs(begin, end - begin)]
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
    return terms, rank[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def _counted(texts: list[str], low: int, high: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """`terms, owner, place, tf`: the distinct n-grams of some texts, whose words are one space apart, and
    for each text, in order, the places of its own in `terms` and their counts. Each distinct word
    of the texts is cut up once."""
    split = pc.split_pattern(pa.array(texts, pa.string()), " ")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = split.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.filter(pa.array(real)).dictionary_encode()
    if not len(coded):
        none = np.zeros(0, np.int64)
        return pa.array([], pa.string()), none, none, none
    distinct = len(coded.dictionary)
    pair, times = np.unique(owner[real] * distinct + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    terms, by_word, many = _grams(coded.dictionary.to_pylist(), low, high)
    word, n = pair % distinct, len(terms)
    own = many[word]
    place = by_word[_runs((np.cumsum(many) - many)[word], own)]
    cell, tf = np.repeat(pair // distinct, own) * n + place, np.repeat(times, own)
    bits = int(times.max()).bit_length()
    if (len(texts) * n) << bits < 1 << 63:  # counts ride in the low bits of what is sorted
        both = np.sort(cell << bits | tf)
        cell, tf = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(cell, kind="stable")
        cell, tf = cell[order], tf[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    return terms, cell[first] // n, cell[first] % n, np.add.reduceat(tf, first)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts in blocks of bounded text. Rows come sorted by key; those of one key are one text."""
    keys, texts, size, kind, held = [], [], 0, None, []
    same = lambda a, b: a == b or a is b or (a != a and b != b)
    for batch in batches:
        kind = batch.schema.field(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if keys and same(keys[-1], key):
                held.append(text)
            else:
                if keys:
                    texts.append(" ".join(held))
                if size >= BLOCK_BYTES:
                    yield pa.array(keys, kind), texts
                    keys, texts, size = [], [], 0
                keys.append(key)
                held = [text]
            size += len(text) + 2
    if keys:
        yield pa.array(keys, kind), [*texts, " ".join(held)]


def _cut(df: DataFrame, key: str, text: str, make: Callable, fields: str) -> DataFrame:
    """What `make` gives of the keys and texts of a block. The text is shuffled by key before it is
    cut up, at a small fraction of the size of its n-grams, to partitions of a bounded amount."""
    ship_package(df.sparkSession)
    key_type = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _blocks(batches):
            yield from make(keys, texts)

    by_key = spread(df.select(key, text), key, text, PART_BYTES).sortWithinPartitions(key)
    return by_key.select(key, spaced(text).alias("_t")).mapInArrow(run, f"`{key}` {key_type}, {fields}")


def _batches(columns: dict[str, Callable[[slice], pa.Array]], n: int) -> Iterator[pa.RecordBatch]:
    """Rows 0 to n in batches of bounded size."""
    for first in range(0, n, BLOCK_ROWS >> 3):
        some = slice(first, min(first + (BLOCK_ROWS >> 3), n))
        yield pa.RecordBatch.from_arrays([make(some) for make in columns.values()], names=list(columns))


def term_counts(df: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    """`key, term, tf` over whole texts, cut in one Arrow pass after a shuffle of the texts."""

    def make(keys: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        terms, owner, place, tf = _counted(texts, low, high)
        yield from _batches({
            key: lambda s: keys.take(pa.array(owner[s])), "term": lambda s: terms.take(pa.array(place[s])),
            "tf": lambda s: pa.array(tf[s], pa.int64())}, len(tf))

    return _cut(df, key, text, make, "term string, tf bigint")


def stored_counts(df: DataFrame, key: str, text: str = "text", low: int = 2, high: int = 5) -> DataFrame:
    """`key, terms, tfs`: `term_counts` as a written table of one row per key, for a fit and a
    transform of the same texts."""

    def make(keys: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        terms, owner, place, tf = _counted(texts, low, high)
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32))
        lists = (terms.take(pa.array(place)), pa.array(tf, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, *(pa.ListArray.from_arrays(ends, x) for x in lists)], names=[key, "terms", "tfs"])

    path = scratch_dir(df.sparkSession, "term-counts")
    _cut(df, key, text, make, "terms array<string>, tfs array<bigint>").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fit_tfidf(
    pool: DataFrame, key: str, text: str = "text", low: int = 2, high: int = 5, min_df: int = 2,
    sublinear: bool = True, path: str | None = None, counts: DataFrame | None = None,
) -> Tfidf:
    """Document frequencies of the pool only; idf = ln((1 + N) / (1 + df)) + 1.

    The vocabulary is written as a table (to `path`, or below the shared checkpoint folder).
    It is then computed once however often it is used. `counts` are the pool's `stored_counts`, if
    there are any.
    """
    n = pool.count()
    each = term_counts(pool, key, text, low, high) if counts is None else counts.select(F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.filter(F.col("df") >= min_df).withColumn(
        "idf", F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    path = path or scratch_dir(pool.sparkSession, "vocabulary")
    idf.withColumn("term_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return Tfidf(pool.sparkSession.read.parquet(path), low, high, sublinear)


def _hashed(terms: pa.Array, salt: int) -> np.ndarray:
    return pd.util.hash_array(np.array(terms.to_pylist(), dtype=object), hash_key=f"{salt:016d}", categorize=False)


def _sent(idf: DataFrame) -> tuple:
    """A bounded vocabulary by the hashes of its terms, which are all different: salt, hashes, terms,
    idf, term ids."""
    table = idf.select("term", "idf", "term_id").toArrow()
    terms, salt = table["term"].cast(pa.string()).combine_chunks(), 0
    while len(np.unique(hashes := _hashed(terms, salt))) < len(terms):
        salt += 1
    order = np.argsort(hashes)
    return salt, hashes[order], terms.take(pa.array(order)), table["idf"].to_numpy()[order], table["term_id"].to_numpy()[order]


def tfidf_weights(
    fitted: Tfidf, df: DataFrame, key: str, text: str = "text", name: str = "term", counts: DataFrame | None = None,
) -> DataFrame:
    """`key, <name>, weight`, L2-normalised per text, where `name` is `term` or `term_id`. Terms outside the vocabulary drop out, and
    so does a text with no known term.

    A vocabulary of bounded size is sent to the tasks, so that texts are cut and weighed where they
    are and no n-gram is shuffled; a larger one is joined with the n-grams as rows. `counts` are the
    `stored_counts` of `df`, if there are any.
    """
    spark, sublinear = df.sparkSession, fitted.sublinear
    if fitted.idf.count() > BROADCAST_TERMS:
        return _joined(fitted, df, key, text, name, counts)
    kinds = {f.name: f.dataType.simpleString() for f in fitted.idf.schema}
    sent = spark.sparkContext.broadcast(_sent(fitted.idf))

    def weigh(keys: pa.Array, terms: pa.Array, owner: np.ndarray, place: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
        salt, hashes, vocabulary, idf, ids = sent.value
        if not len(terms) or not len(hashes):
            return
        at = np.searchsorted(hashes, _hashed(terms, salt))
        at[at == len(hashes)] = 0
        known = pc.equal(vocabulary.take(pa.array(at)), terms).to_numpy(zero_copy_only=False)[place]
        owner, place = owner[known], at[place[known]]
        tf = tf[known].astype(float)
        w = (1 + np.log(tf) if sublinear else tf) * idf[place]
        w /= np.sqrt(np.bincount(owner, w * w, len(keys)))[owner]
        shown = (lambda s: vocabulary.take(pa.array(place[s]))) if name == "term" else lambda s: pa.array(ids[place[s]])
        yield from _batches({key: lambda s: keys.take(pa.array(owner[s])), name: shown, "weight": lambda s: pa.array(w[s])}, len(w))

    fields = f"`{name}` {kinds[name]}, weight double"
    if counts is None:
        low, high = fitted.low, fitted.high

        def make(keys: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
            yield from weigh(keys, *_counted(texts, low, high))

        return _cut(df, key, text, make, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            of_block = (np.cumsum(sizes) - sizes) // BLOCK_ROWS
            for block in np.unique(of_block):
                first, last = np.searchsorted(of_block, [block, block + 1])
                some = batch.slice(first, last - first)
                coded = some.column(1).flatten().dictionary_encode()
                owner = np.repeat(np.arange(last - first), sizes[first:last])
                yield from weigh(some.column(0), coded.dictionary, owner, coded.indices.to_numpy(), some.column(2).flatten().to_numpy())

    ship_package(spark)
    key_type = counts.select(key).schema[0].dataType.simpleString()
    return counts.select(key, "terms", "tfs").mapInArrow(run, f"`{key}` {key_type}, {fields}")


def _joined(fitted: Tfidf, df: DataFrame, key: str, text: str, name: str, counts: DataFrame | None) -> DataFrame:
    """A term most texts contain meets one vocabulary row, which the adaptive skew join splits."""
    tf = term_counts(df, key, text, fitted.low, fitted.high) if counts is None else counts.select(
        key, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    scale = 1 + F.log("tf") if fitted.sublinear else F.col("tf")
    known = tf.join(fitted.idf.select("term", "term_id", "idf"), "term")
    raw = known.select(key, name, (scale * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, name, (F.col("w") / norm).alias("weight"))


def encode_once(
    rows: DataFrame, key: str, text: str, encode: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(features by `text_id`, references `key, text_id`): each distinct text is encoded once.

    A text is identified by its digest, so pointing rows at their text needs no join, and
    copies collapse before the shuffle. Join the two on `text_id` where rows are needed.
    """
    ids = rows.withColumn("text_id", F.sha2(text, 256))
    unique = ids.groupBy("text_id").agg(F.first(text).alias(text))
    return encode(unique), ids.select(key, "text_id")


def l2_normalise(vector: str | Column) -> Column:
    """A vector divided by its length, in doubles; a zero vector stays as it is."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x))


def masked_mean(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """`key, dim, value`: the mean of the token vectors whose mask is set, L2-normalised.

    Sums are per dimension and combine map-side, so a text with very many tokens is no hot key.
    """
    kept = tokens.filter(F.col(mask)).select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    mean = kept.groupBy(key, "dim").agg(F.avg("x").alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))  # one row per dimension
    return mean.select(key, "dim", F.when(length > 0, F.col("m") / length).otherwise(F.col("m")).alias("value"))
