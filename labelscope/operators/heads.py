"""Linear heads over frozen features, swept over budget x seed x regularisation.

Features are sparse: `indices` (sorted places in a dense term dictionary) and `values`. One head
over many rows is fitted by Spark's own logistic regression. A sweep has many small cells, one
budget of rows each, so Spark deals out the cells: each is a group, and a task fits all its
penalties from strong to weak, each from the last, and keeps the one that validates best.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from labelscope.functions.scoring import argmax
from labelscope.operators import grams as gr
from labelscope.operators.features import l2_normalise
from labelscope.operators.metrics import confusion, macro_f1
from labelscope.session import scratch_dir, ship_package

# The regularisation grid, the stopping rule and the serving batch.
C_GRID = (0.1, 1.0, 10.0, 100.0)
MAX_ITER = 2000
TOLERANCE = 1e-4
SERVING_BATCH = 64
PART_BYTES = 1 << 25  # of features scored in a task
VAL_BYTES = 1 << 26  # of validation features that every cell is sent
HEAD_BYTES = 1 << 28  # of heads that every task is sent
SMALLEST = 1e-9


def gram_features(lists: DataFrame, fitted: gr.Vocabulary, key: str) -> DataFrame:
    """`key, indices, values`: TF-IDF weights by the place of their n-gram among all of the
    fitted ones in order, so every term has a place of its own. A text without a known term
    keeps its row and has none."""
    ship_package(lists.sparkSession)
    key_type = lists.select(key).schema[0].dataType.simpleString()
    sent, sublinear = lists.sparkSession.sparkContext.broadcast(fitted.arrays()), fitted.sublinear

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = sent.value
        for batch in batches:
            own = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(own).to_numpy(zero_copy_only=False))
            at, w, known = gr.weigh(own.flatten().to_numpy(), batch.column(2).flatten().to_numpy(), owner, batch.num_rows, terms, idf, sublinear)
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[known], minlength=batch.num_rows)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(w))], names=[key, "indices", "values"])

    return lists.select(key, "grams", "tfs").mapInArrow(run, f"`{key}` {key_type}, indices array<int>, values array<double>")


def text_features(rows: DataFrame, fitted: gr.Vocabulary, text: str = "text", vectors: bool = False) -> DataFrame:
    """`rows` without their text, with its `indices` and `values`, or with these as `features`.

    Texts are cut and weighed where they are, a block of bounded text at a time. Nothing is
    shuffled, and n-grams are never stored or handed on between tasks.
    """
    spark = rows.sparkSession
    ship_package(spark)
    sent, (low, high, sublinear, size) = spark.sparkContext.broadcast(fitted.arrays()), (fitted.low, fitted.high, fitted.sublinear, fitted.size)
    others = [f for f in rows.schema if f.name != text]
    features = [StructField("features", VectorUDT())] if vectors else [
        StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))]
    names = [f.name for f in [*others, *features]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = sent.value
        for batch in batches:
            for first, last, grams, tfs, owner in gr.cut_blocks(batch.column(0).to_pylist(), low, high):
                n = last - first
                at, w, known = gr.weigh(grams, tfs, owner, n, terms, idf, sublinear)
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[known], minlength=n)))).astype(np.int32))
                made = [pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(w))]
                if vectors:
                    kind, wide = pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32))
                    made = [pa.StructArray.from_arrays([kind, wide, *made], names=["type", "size", "indices", "values"])]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, n) for c in batch.columns[1:]), *made], names=names)

    return rows.select(gr.spaced(text).alias("text"), *[f.name for f in others]).mapInArrow(run, StructType([*others, *features]))


def dense_features(rows: DataFrame, vector: str) -> DataFrame:
    """`rows` with `indices` and `values` of a dense vector, L2-normalised; a missing or empty one
    has none. Frozen encoders so feed the same heads and sweeps as n-grams do."""
    size = F.coalesce(F.size(vector), F.lit(0))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.withColumns({
        "indices": F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(none("int")),
        "values": F.when(size > 0, l2_normalise(vector)).otherwise(none("double"))})


def as_vectors(rows: DataFrame, size: int) -> DataFrame:
    """`rows` with `features` in place of `indices` and `values`. A vector is stored as a struct
    of these, so the table is written with that struct and read back as vectors; no row passes
    through Python."""
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession, "vectors")
    others = [f for f in rows.schema if f.name not in ("indices", "values")]
    names = [f.name for f in others]
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), "indices", "values")
    rows.select(*names, stored.alias("features")).write.parquet(path)
    return spark.read.schema(StructType([*others, StructField("features", VectorUDT())])).parquet(path)


@dataclass(frozen=True)
class Head:
    """A fitted model and the labels it was trained on, in model class order."""

    model: LogisticRegressionModel
    labels: tuple[int, ...]
    c: float

    def probabilities(self, rows: DataFrame, n_classes: int) -> DataFrame:
        """Adds `probs` over all of [0, K); a class absent from training gets exactly 0."""
        seen = vector_to_array("_p")
        place = {label: i for i, label in enumerate(self.labels)}
        full = F.array(*[
            F.get(seen, F.lit(place[k])) if k in place else F.lit(0.0) for k in range(n_classes)])
        return self.model.transform(rows).withColumnRenamed("probability", "_p").withColumn(
            "probs", full).drop("_p", "rawPrediction", "prediction")


def fit_head(train: DataFrame, c: float, label: str = "label", max_iter: int = MAX_ITER, tol: float = TOLERANCE) -> Head:
    """Multinomial logistic regression with inverse regularisation `c` over rows with `features`.

    The penalty of the reference is on the sum of losses and Spark's on the mean, hence
    regParam = 1 / (c n). Features are not rescaled. Stops at `max_iter` or the tolerance. Labels
    are numbered densely for the fit. Tasks are those of the table of `as_vectors`, which Spark
    sizes by its bytes.
    """
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()  # K rows
    labels, n = [r[label] for r in counts], sum(r["n"] for r in counts)
    dense = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1
    rows = train.select("features", dense.cast("double").alias("_y"))
    fitter = LogisticRegression(
        featuresCol="features", labelCol="_y", family="multinomial", regParam=1.0 / (c * n),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    return Head(fitter.fit(rows), tuple(labels), c)


def predict(head: Head, rows: DataFrame, n_classes: int) -> DataFrame:
    """Adds `probs` and `pred`, the first largest class."""
    return head.probabilities(rows, n_classes).withColumn("pred", argmax("probs"))


def score_texts(
    head: Head, fitted: gr.Vocabulary, rows: DataFrame, key: str, n_classes: int, text: str = "text",
) -> DataFrame:
    """`key, probs, pred` of raw texts in one pass without a shuffle: a batch is cut into n-grams,
    weighed and scored where it is. The head is a matrix over the fitted vocabulary, which its
    training rows bound."""
    spark = rows.sparkSession
    ship_package(spark)
    key_type = rows.select(key).schema[0].dataType.simpleString()
    low, high, sublinear = fitted.low, fitted.high, fitted.sublinear
    matrix = np.ascontiguousarray(head.model.coefficientMatrix.toArray().T)
    sent = spark.sparkContext.broadcast((*fitted.arrays(), matrix, head.model.interceptVector.toArray()))
    labels = np.array(head.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, w, b = sent.value
        for batch in batches:
            z = np.tile(b, (batch.num_rows, 1))
            for i, (grams, tfs) in enumerate(gr.cut_batch(batch.column(1).to_pylist(), low, high)):
                at, v, _ = gr.weigh(grams, tfs, np.zeros(len(grams), np.int64), 1, terms, idf, sublinear)
                z[i] += v @ w[at]
            full = _simplex(z, labels, n_classes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(full), pa.list_(pa.float64())), pa.array(full.argmax(axis=1), pa.int64())],
                names=[key, "probs", "pred"])

    return rows.select(key, gr.spaced(text).alias("text")).mapInArrow(run, f"`{key}` {key_type}, probs array<double>, pred bigint")


def _simplex(z: np.ndarray, labels: np.ndarray, n_classes: int) -> np.ndarray:
    """Probabilities over all classes; those not trained on get 0."""
    e = np.exp(z - z.max(axis=1, keepdims=True))
    full = np.zeros((len(z), n_classes))
    full[:, labels] = e / e.sum(axis=1, keepdims=True)
    return full


def smallest_good_c(scores: DataFrame, tolerance: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, c, val_macro_f1`: the most regularised setting within `tolerance` of the best."""
    best = F.max("macro_f1").over(Window.partitionBy(*keys))  # a handful of settings per cell
    near = scores.withColumn("_best", best).filter(F.col("macro_f1") >= F.col("_best") - tolerance)
    return near.groupBy(*keys).agg(
        F.min("c").alias("c"), F.min_by("macro_f1", "c").alias("val_macro_f1"))


def select_head(
    train: DataFrame, val: DataFrame, n_classes: int, grid: Sequence[float] = C_GRID, tolerance: float = 0.0,
    max_iter: int = MAX_ITER, label: str = "label",
) -> tuple[Head, dict[float, float]]:
    """The head whose validation macro-F1 wins, and the score of every setting."""

    def attempt(c: float) -> tuple[Head, float]:
        head = fit_head(train, c, label, max_iter)
        cells = confusion(predict(head, val, n_classes), label, "pred")
        return head, macro_f1(cells, n_classes).first()["macro_f1"]

    # An iteration is a short job, so the settings are tried side by side.
    with ThreadPoolExecutor(max_workers=len(grid)) as pool:
        tried = dict(zip(grid, pool.map(attempt, grid)))
    heads, scores = {c: h for c, (h, _) in tried.items()}, {c: s for c, (_, s) in tried.items()}
    ceiling = max(scores.values())
    return heads[min(c for c, v in scores.items() if v >= ceiling - tolerance)], scores


# --- sweeps ------------------------------------------------------------------------------


def _sparse_product(rows: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), dense.shape[1]))
    for i, (at, v) in enumerate(rows):
        out[i] = v @ dense[at]
    return out


def descend(z: np.ndarray, y: np.ndarray, c: float, w: np.ndarray, b: np.ndarray, max_iter: int, tol: float = 1e-7):
    """Multinomial logistic regression on dense rows by limited-memory BFGS: weights and
    intercepts that minimise c * (sum of losses) + half the squared weights, from `w, b` on."""
    n, (r, k) = len(z), w.shape
    hit = np.zeros((n, k))
    hit[np.arange(n), y] = 1.0
    scale = 1.0 / max(c * n, 1e-12)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[: r * k].reshape(r, k), x[r * k :]
        a = z @ w + b
        top = a.max(axis=1, keepdims=True)
        e = np.exp(a - top)
        total = e.sum(axis=1, keepdims=True)
        loss = (np.log(total) + top - (a * hit).sum(axis=1, keepdims=True)).sum() * c + 0.5 * (w * w).sum()
        gap = (e / total - hit) * c
        return loss * scale, np.concatenate(((z.T @ gap + w).ravel(), gap.sum(axis=0))) * scale

    x = np.concatenate((w.ravel(), b))
    f, g = value(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        if np.abs(g).max() < tol * max(1.0, abs(f)):
            break
        q, kept = -g, []
        for s, d, rho in reversed(steps):
            a = rho * (s @ q)
            kept.append(a)
            q = q - a * d
        if steps:
            s, d, _ = steps[-1]
            q = q * ((s @ d) / (d @ d))
        for (s, d, rho), a in zip(steps, reversed(kept)):
            q = q + s * (a - rho * (d @ q))
        slope = g @ q
        if slope >= 0:
            q, slope, steps = -g, -(g @ g), []
        t = 1.0 if steps else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        low, high = 0.0, np.inf
        for _ in range(40):  # weak Wolfe conditions by bisection
            new = x + t * q
            f_new, g_new = value(new)
            if f_new > f + 1e-4 * t * slope:
                high = t
            elif g_new @ q < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if np.isfinite(high) else 2 * low
        s, d = new - x, g_new - g
        if f_new >= f and np.abs(s).max() < 1e-14:
            break
        if s @ d > 1e-300:
            steps = [*steps[-19:], (s, d, 1.0 / (s @ d))]
        x, f, g = new, f_new, g_new
    return x[: r * k].reshape(r, k), x[r * k :] - x[r * k :].mean()


def fit_cell(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, grid: Sequence[float], max_iter: int = MAX_ITER,
) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """`c, labels, terms, weights, intercepts` of every penalty, from strong to weak.

    With a squared penalty the weights are a sum of the rows, so the fit is done in coordinates
    of the rows: as many as rows instead of terms, and equal to the fit over terms.
    """
    labels, dense_y = np.unique(y, return_inverse=True)
    terms = np.unique(np.concatenate([at for at, _ in rows])) if rows else np.zeros(0, np.int64)
    local = [(np.searchsorted(terms, at), v) for at, v in rows]
    n, products = len(rows), np.zeros((len(rows), len(rows)))
    for first in range(0, len(terms), 4_096):  # a stripe of terms at a time
        stripe = np.zeros((n, min(4_096, len(terms) - first)))
        for i, (at, v) in enumerate(local):
            a, b = np.searchsorted(at, (first, first + 4_096))
            stripe[i, at[a:b] - first] = v[a:b]
        products += stripe @ stripe.T
    size, turn = np.linalg.eigh(products)
    used = size > SMALLEST * max(size.max(initial=0.0), SMALLEST)
    size, turn = np.sqrt(size[used]), turn[:, used]
    z = turn * size
    w, b = np.zeros((z.shape[1], len(labels))), np.zeros(len(labels))
    for c in sorted(grid):
        w, b = descend(z, dense_y, c, w, b, max_iter)
        mix, weights = (turn / size) @ w, np.zeros((len(terms), len(labels)))
        for i, (at, v) in enumerate(local):
            weights[at] += v[:, None] * mix[i]
        yield c, labels, terms, weights, b


def _macro_f1(y: np.ndarray, pred: np.ndarray, n_classes: int) -> float:
    cells = np.bincount(y * n_classes + pred, minlength=n_classes * n_classes).reshape(n_classes, n_classes)
    return float(np.mean(2 * np.diag(cells) / np.maximum(cells.sum(0) + cells.sum(1), 1)))


HEADS = "c double, n_classes_seen int, val_scores map<double, double>, labels array<int>, terms binary, weights binary, intercepts array<double>"


def sweep(
    grid: DataFrame, val: DataFrame, n_classes: int, keys: Sequence[str] = ("training_size", "seed"), label: str = "label",
    c_grid: Sequence[float] = C_GRID, tolerance: float = 0.0, max_iter: int = MAX_ITER,
) -> DataFrame:
    """One head for every cell of `grid`, all cells in one job: `keys` and the columns of `HEADS`.

    `grid` has the keys, the label, `indices` and `values`; a cell holds a budget of rows, which
    the budget bounds. `val` (label, `indices`, `values`) is the fixed validation set; it must be
    within `VAL_BYTES`. The penalty kept is the strongest within `tolerance` of the best macro-F1.
    """
    spark = grid.sparkSession
    ship_package(spark)
    size = val.agg(F.sum(12 * F.size("indices") + 40)).first()[0] or 0
    if size > VAL_BYTES:
        raise ValueError(f"a validation set of {size} bytes is too large to send to every cell")
    held = val.select(F.col(label).cast("bigint").alias("y"), "indices", "values").toArrow()
    sent = spark.sparkContext.broadcast((held["y"].to_numpy(), _pairs(held)))
    kinds = ", ".join(f"`{k}` {t}" for k, t in grid.select(*keys).dtypes)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        y_val, val_rows = sent.value
        scores, best = {}, None
        for c, labels, terms, weights, b in fit_cell(_pairs(table), table["y"].to_numpy(), c_grid, max_iter):
            z = _sparse_product(_known(val_rows, terms), weights) + b
            scores[c] = _macro_f1(y_val, labels[z.argmax(axis=1)], n_classes) if len(y_val) else 0.0
            if best is None or scores[c] > scores[best[0]] + tolerance:
                best = c, labels, terms, weights, b
        c, labels, terms, weights, b = best
        return pa.table({
            **{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key)}, "c": [c], "n_classes_seen": pa.array([len(labels)], pa.int32()),
            "val_scores": pa.array([list(scores.items())], pa.map_(pa.float64(), pa.float64())),
            "labels": pa.array([labels.tolist()], pa.list_(pa.int32())), "terms": pa.array([terms.astype("<i4").tobytes()], pa.binary()),
            "weights": pa.array([weights.astype("<f8").tobytes()], pa.binary()), "intercepts": pa.array([b.tolist()], pa.list_(pa.float64()))})

    cells = grid.select(*keys, F.col(label).cast("bigint").alias("y"), "indices", "values")
    return cells.groupBy(*keys).applyInArrow(run, f"{kinds}, {HEADS}")


def _pairs(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each row."""
    out = []
    for batch in table.to_batches():
        at, v = (batch.column(batch.schema.get_field_index(c)) for c in ("indices", "values"))
        out += [(at[i].values.to_numpy(), v[i].values.to_numpy()) for i in range(batch.num_rows)]
    return out


def _known(rows: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows by place among `terms`, without others."""
    out = []
    for at, v in rows:
        place = np.searchsorted(terms, at)
        place[place == len(terms)] = 0
        own = terms[place] == at if len(terms) else np.zeros(len(at), bool)
        out.append((place[own], v[own]))
    return out


def sweep_probabilities(
    heads: DataFrame, rows: DataFrame, n_classes: int, key: str, keys: Sequence[str] = ("training_size", "seed"),
    together: str = "training_size", label: str = "label", part_bytes: int = PART_BYTES,
    fitted: gr.Vocabulary | None = None, text: str = "text", head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """`keys, key, y, probs`: every row scored by every head, over the full label simplex.

    Rows have `indices` and `values`, or with `fitted` their text, which is cut as it is scored.
    The rows that a head learnt from bound it; heads within `head_bytes` in all are sent to the
    tasks and rows are scored where they are. Beyond that, rows are cut into blocks of bounded
    bytes and the heads of one `together` (one budget) meet a block in one task, so a row is
    shuffled once a budget.
    """
    spark = heads.sparkSession
    ship_package(spark)
    key_type, kinds = dict(rows.dtypes)[key], dict(heads.dtypes)
    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{key}` {key_type}", "y bigint", "probs array<double>"])
    size = heads.agg(F.sum(F.octet_length("terms") + F.octet_length("weights"))).first()[0] or 0
    if size > head_bytes:
        held = rows if fitted is None else text_features(rows, fitted, text)
        return _by_block(heads, held, n_classes, key, keys, together, label, part_bytes, fields)
    by = heads.select(*keys, "labels", "terms", "weights", "intercepts").toArrow()
    sent = spark.sparkContext.broadcast(by)
    cut = None if fitted is None else spark.sparkContext.broadcast(fitted.arrays())
    low, high, sublinear = (fitted.low, fitted.high, fitted.sublinear) if fitted else (0, 0, False)

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Rows of a batch and where each row's places and values end."""
        if cut is None:
            at, v = batch.column(2), batch.column(3)
            n = np.nan_to_num(pc.list_value_length(at).to_numpy(zero_copy_only=False)).astype(np.int64)
            yield 0, batch.num_rows, at.flatten().to_numpy(), v.flatten().to_numpy(), np.cumsum(n)
            return
        for first, last, grams, tfs, owner in gr.cut_blocks(batch.column(2).to_pylist(), low, high):
            at, w, known = gr.weigh(grams, tfs, owner, last - first, *cut.value, sublinear)
            yield first, last - first, at, w, np.cumsum(np.bincount(owner[known], minlength=last - first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [_Scorer(head) for head in sent.value.to_pylist()]
        for batch in batches:
            for first, n, at, v, ends in blocks(batch):
                for scorer in made:
                    full = _simplex(scorer.scores(at, v, ends), scorer.labels, n_classes)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_classes + 1, n_classes, dtype=np.int32)), pa.array(full.ravel()))
                    own = [pa.array([scorer.head[k]] * n, by.schema.field(k).type) for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [*own, *(c.slice(first, n) for c in batch.columns[:2]), lists], names=[*keys, key, "y", "probs"])

    features = ["indices", "values"] if cut is None else [gr.spaced(text).alias("text")]
    return rows.select(key, F.col(label).cast("bigint").alias("y"), *features).mapInArrow(run, fields)


class _Scorer:
    """A head with the place of each term it knows."""

    def __init__(self, head: dict):
        self.head, self.labels, self.b = head, np.array(head["labels"], dtype=np.int64), np.array(head["intercepts"])
        terms = np.frombuffer(head["terms"], "<i4")
        self.weights = np.frombuffer(head["weights"], "<f8").reshape(len(terms), len(self.labels))
        self.place = np.full(int(terms.max(initial=-1)) + 2, -1, dtype=np.int32)  # the last stands for all beyond
        self.place[terms] = np.arange(len(terms))

    def scores(self, at: np.ndarray, v: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of rows whose places and values lie one after the other."""
        place = self.place[np.minimum(at, len(self.place) - 1)]
        own = np.flatnonzero(place >= 0)
        ends = np.searchsorted(own, ends)
        begins = np.concatenate(([0], ends[:-1]))
        z, some = np.tile(self.b, (len(ends), 1)), np.flatnonzero(ends > begins)
        if len(some):
            z[some] += np.add.reduceat(self.weights[place[own]] * v[own, None], begins[some], axis=0)
        return z


def _by_block(heads, rows, n_classes, key, keys, together, label, part_bytes, fields) -> DataFrame:
    total = rows.agg(F.sum(12 * F.size("indices") + 40)).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    groups = heads.select(together).distinct()  # one row a budget
    number = [F.lit(r[0]) for r in groups.orderBy(together).collect()]
    if not number:
        return heads.sparkSession.createDataFrame([], fields)
    at = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = rows.select(key, F.col(label).cast("bigint").alias("y"), "indices", "values", at.alias("_block"),
                       F.explode(F.array(*number)).alias("_of"))
    right = heads.select(*keys, F.col(together).alias("_of"), "labels", "terms", "weights", "intercepts",
                         F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_block"))

    def run(these: pa.Table, by: pa.Table) -> pa.Table:
        pairs, out = _pairs(these), []
        for head in by.to_pylist():
            labels, terms = np.array(head["labels"], dtype=np.int64), np.frombuffer(head["terms"], "<i4")
            weights = np.frombuffer(head["weights"], "<f8").reshape(len(terms), len(labels))
            full = _simplex(_sparse_product(_known(pairs, terms), weights) + np.array(head["intercepts"]), labels, n_classes)
            out.append(pa.table(
                [*(pa.array([head[k]] * len(pairs), by.schema.field(k).type) for k in keys), these[key], these["y"],
                 pa.array(list(full), pa.list_(pa.float64()))], names=[*keys, key, "y", "probs"]))
        if not out:
            return pa.schema([*(by.schema.field(k) for k in keys), these.schema.field(key), pa.field("y", pa.int64()),
                              pa.field("probs", pa.list_(pa.float64()))]).empty_table()
        return pa.concat_tables(out)

    return left.groupBy("_of", "_block").cogroup(right.groupBy("_of", "_block")).applyInArrow(run, fields)
