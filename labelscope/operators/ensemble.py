"""Soft votes over seeds, and over resampled multisets of seeds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement
from math import factorial, prod

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.scoring import argmax
from labelscope.operators.metrics import confusion, scores
from labelscope.session import ship_package

KEYS = ("row_id", "training_size")
HELD_CELLS = 1 << 20  # distinct outcomes that a task counts before it hands them on


def soft_vote(
    probs: DataFrame, n_classes: int, keys: Sequence[str] = KEYS, value: str = "probs", carry: Sequence[str] = ("y",)
) -> DataFrame:
    """`keys, carry, n_seeds, pred`: class of the largest mean probability, first on ties.

    `probs` holds one array of K values per row and seed. A row's arrays (one per seed, a
    handful) are folded in seed order, so a sum of doubles never depends on arrival order.
    """
    votes = F.sort_array(F.collect_list(F.struct("seed", value)))
    total = F.aggregate(
        F.transform("_v", lambda s: s[value]),
        F.array_repeat(F.lit(0.0), n_classes),
        lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b),
    )
    return (
        probs.groupBy(*keys)
        .agg(votes.alias("_v"), *[F.first(c).alias(c) for c in carry])
        .select(*keys, *carry, F.size("_v").alias("n_seeds"), argmax(total).alias("pred"))
    )


def ensemble_scores(voted: DataFrame, n_classes: int, keys: Sequence[str] = ("training_size",)) -> DataFrame:
    """Accuracy and F1 of the ensemble per budget; budgets with one seed have no ensemble."""
    cells = confusion(voted.filter("n_seeds >= 2"), "y", "pred", [*keys, "n_seeds"])
    return scores(cells, n_classes, [*keys, "n_seeds"])


def seed_multisets(seeds: Sequence[int]) -> list[tuple[int, tuple[int, ...], int]]:
    """(id, times each seed is drawn, orderings) of every multiset of len(seeds) draws.

    There are C(2S-1, S) of them (126 for five seeds), so voting once per multiset replaces
    voting once per replicate. Orderings over S**S is the multiset's probability.
    """
    size = len(seeds)
    out = []
    for i, drawn in enumerate(combinations_with_replacement(range(size), size)):
        times = Counter(drawn)
        ways = factorial(size) // prod(factorial(t) for t in times.values())
        out.append((i, tuple(times.get(s, 0) for s in range(size)), ways))
    return out


def _neighbours(placed: DataFrame, keys: list[str], carry: list[str], value: str) -> DataFrame:
    """`keys, carry, _s`: `_at` and `value` of rows with the same keys that come one after another."""
    rows = placed.select(*keys, *carry, F.col("_at").cast("int").alias("_at"), value)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = [*[f"`{c}` {kind[c]}" for c in [*keys, *carry]], f"_s array<struct<_at: int, `{value}`: {kind[value]}>>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = np.zeros(batch.num_rows, dtype=bool)
            new[:1] = True
            for c in batch.columns[: len(keys)]:
                a, b = c.slice(0, max(len(c) - 1, 0)), c.slice(1)
                alike = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
                new[1:] |= ~alike.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            ends = pa.array(np.append(first, batch.num_rows).astype(np.int32))
            cells = pa.StructArray.from_arrays(batch.columns[-2:], names=["_at", value])
            kept = [c.take(pa.array(first)) for c in batch.columns[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, cells)], names=[*keys, *carry, "_s"])

    return rows.mapInArrow(run, ", ".join(fields))


def gathered_votes(
    probs: DataFrame, budgets: Sequence[int], seeds: Sequence[int], keys: Sequence[str], value: str, carry: Sequence[str]
) -> DataFrame:
    """`keys, carry, _v`: the arrays of a row joined in budget and seed order, one after another.

    Arrays of a row that come one after another are put together before the shuffle; in it a row's
    arrays (budgets x seeds of them) meet and are sorted by their place in that order. A row without
    one of them raises an error that names it, and so does a repeated one.
    """
    cells = [(b, s) for b in budgets for s in seeds]
    places = F.create_map(*[x for i, (b, s) in enumerate(cells) for x in (F.lit(f"{b}:{s}"), F.lit(i))])
    name = F.concat_ws(":", F.col("training_size").cast("string"), F.col("seed").cast("string"))
    placed = probs.withColumn("_at", F.try_element_at(places, name)).filter("_at is not null")
    by_cell = _neighbours(placed, [*keys], [*carry], value).groupBy(*keys).agg(
        F.sort_array(F.flatten(F.collect_list("_s"))).alias("_s"), *[F.first(c).alias(c) for c in carry])
    have, all_ = F.col("_s._at"), F.sequence(F.lit(0), F.lit(len(cells) - 1))
    names = F.array(*[F.lit(f"budget {b}, seed {s}") for b, s in cells])
    lost = F.get(names, F.get(F.array_except(all_, have), F.lit(0)))
    problem = F.concat(F.lit("a row has no votes for "), lost)
    problem = F.coalesce(problem, F.lit("a row has votes of one budget and seed twice"))
    flat = F.flatten(F.col(f"_s.{value}"))
    checked = F.when(have == all_, flat).otherwise(F.raise_error(problem).cast(probs.schema[value].dataType))
    return by_cell.select(*keys, *carry, checked.alias("_v"))


def multiset_votes(
    probs: DataFrame,
    multisets: Sequence[tuple],
    n_classes: int,
    budgets: Sequence[int],
    seeds: Sequence[int],
    keys: Sequence[str] = ("row_id",),
    value: str = "probs",
    carry: Sequence[str] = ("y",),
) -> DataFrame:
    """`keys, carry, multiset, preds`: soft votes of every given seed multiset.

    `multisets` are `(number, times of each seed, ...)`; `preds` has one class per budget, in the
    order of `budgets`. A row's votes are one small matrix product, done for an Arrow batch of
    rows at a time.
    """
    ids = [m[0] for m in multisets]
    weights = np.array([m[1] for m in multisets], dtype=float)
    shape = (len(budgets), len(seeds), n_classes)

    @F.pandas_udf("array<int>")
    def vote_all(flat: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(flat), 256):  # bounds the product below
            v = np.stack(flat.iloc[start : start + 256].to_numpy()).reshape(-1, *shape)
            best = np.einsum("ms,rbsk->rmbk", weights, v).argmax(axis=3)
            out.extend(best.reshape(len(v), -1).astype(np.int32))
        return pd.Series(out, index=flat.index)

    gathered = gathered_votes(probs, budgets, seeds, keys, value, carry)
    voted = gathered.select(*keys, *carry, vote_all("_v").alias("_p"))
    numbers = F.array(*[F.lit(i) for i in ids])
    each = voted.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(ids) - 1))).alias("_m"))
    return each.select(
        *keys, *carry, F.get(numbers, F.col("_m")).alias("multiset"),
        F.slice("_p", F.col("_m") * len(budgets) + 1, len(budgets)).alias("preds"))


def multiset_counts(
    probs: DataFrame,
    multisets: Sequence[tuple],
    n_classes: int,
    budgets: Sequence[int],
    seeds: Sequence[int],
    key: str = "row_id",
    value: str = "probs",
    by: Sequence[str] = ("y",),
) -> DataFrame:
    """`multiset, by, n<budget>..., n`: how many rows get which votes under each seed multiset.

    Votes are counted where they are taken, over the batches of a task, so what leaves it is
    distinct outcomes and not rows x multisets. `by` columns are integers without nulls.
    """
    by, columns = list(by), [f"n{b}" for b in budgets]
    ids = np.array([m[0] for m in multisets], dtype=np.int32)
    weights = np.array([m[1] for m in multisets], dtype=float)
    n_seeds, cell = len(seeds), ["multiset", *by, *columns]
    # Outcomes are numbers whose digits are the multiset's place, `by` and the votes.
    base = [len(ids), *[n_classes + 1] * len(by), *[n_classes] * len(columns)]
    coded = prod(base) < 1 << 62

    def taken(v: np.ndarray) -> np.ndarray:
        """Classes voted for, multisets x rows x budgets; sums are in seed order."""
        by_class = np.ascontiguousarray(v.transpose(3, 2, 0, 1).reshape(n_classes, n_seeds, -1))
        sums = (sum((weights[:, s, None] * one[s] for s in range(1, n_seeds)), weights[:, 0, None] * one[0]) for one in by_class)
        if np.isnan(v).any():
            return np.stack([*sums]).argmax(axis=0).reshape(len(ids), len(v), -1)
        most = next(sums)
        best = np.zeros(most.shape, dtype=np.int64)
        for k, other in enumerate(sums, 1):
            best[other > most] = k
            np.maximum(most, other, out=most)
        return best.reshape(len(ids), len(v), -1)

    def codes(best: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
        code = np.arange(len(ids))[:, None]
        for c in own:
            code = code * (n_classes + 1) + c + 1
        for i in range(len(columns)):
            code = code * n_classes + best[:, :, i]
        return code.ravel()

    def counted(code: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if n is None:
            code = np.sort(code)
            first = np.flatnonzero(np.diff(code, prepend=-1))
            return code[first], np.diff(np.append(first, len(code)))
        seen, at = np.unique(code, return_inverse=True)
        return seen, np.bincount(at, n, len(seen)).astype(np.int64)

    def rows(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        digits = []
        for b in reversed(base):
            digits.append(code % b)
            code = code // b
        digits.reverse()
        values = [ids[digits[0]], *[d - 1 for d in digits[1 : len(by) + 1]], *digits[len(by) + 1 :], n]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=[*cell, "n"])

    def plain_rows(best: np.ndarray, own: list[np.ndarray]) -> pa.RecordBatch:
        """For outcomes that are no such numbers."""
        frame = pd.DataFrame({"multiset": np.repeat(ids, best.shape[1])} | {c: np.tile(x, len(ids)) for c, x in zip(by, own)}
                             | {c: best[:, :, i].ravel() for i, c in enumerate(columns)})
        return pa.RecordBatch.from_pandas(frame.groupby(cell, as_index=False).size().rename(columns={"size": "n"}), preserve_index=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            own = [c.to_numpy() for c in batch.columns[:-1]]
            votes = batch.columns[-1].flatten().to_numpy(zero_copy_only=False).astype(float)
            v = votes.reshape(batch.num_rows, len(columns), n_seeds, n_classes)
            small = coded and all(((c >= -1) & (c < n_classes)).all() for c in own)
            made = []
            for start in range(0, len(v), 256):  # bounds the products
                part = slice(start, start + 256)
                best, some = taken(v[part]), [c[part] for c in own]
                if small:
                    made.append(codes(best, some))
                else:
                    yield plain_rows(best, some)
            if made:
                held.append(counted(np.concatenate(made), None))
                size += len(held[-1][0])
            if size > 2 * HELD_CELLS:
                held = [counted(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > HELD_CELLS:
                    yield rows(*held.pop())
                    size = 0
        if held:
            yield rows(*counted(*(np.concatenate(x) for x in zip(*held))))

    schema = ", ".join(["multiset int", *[f"`{c}` bigint" for c in [*by, *columns]], "n bigint"])
    ship_package(probs.sparkSession)
    gathered = gathered_votes(probs, budgets, seeds, [key], value, by)
    plain = gathered.select(*[F.col(c).cast("bigint").alias(c) for c in by], "_v")
    return plain.mapInArrow(count, schema).groupBy(*cell).agg(F.sum("n").alias("n"))
