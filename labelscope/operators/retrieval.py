"""Exact cosine top-k over TF-IDF vectors by blocks, and a vote over the neighbours.

Texts are packed into blocks of like texts with a bounded number of n-grams. A block is one row: its
distinct n-grams, and for each the texts that have it and their counts, squeezed to little more than a byte
each, so that all blocks take about as much disk as the texts. A Cartesian product brings a
few query blocks and all pool blocks to a task and shuffles none: disk grows with the texts, though
the products grow with their square.

A task holds its query blocks and takes one pool block at a time. Texts whose coordinates along some
axes, with the lengths of what is left of them, cannot reach a k-th similarity are left out of the
pair of blocks. The n-grams that both blocks have
often are multiplied as dense matrices of floats, the others by way of postings. What comes within
the rounding of floats of a query's k-th similarity is computed again in doubles, so results are
exact. A task returns k rows per query. Nothing per pair or per shared term is ever shuffled and no
text or term is left out.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelscope.operators import grams as gr
from labelscope.session import scratch_dir, ship_package

BLOCK_TERMS = 1_500_000  # n-grams of a block, or of one text if it has more
WINDOW = 16  # blocks whose texts are grouped at once
BLOCK_TEXTS = 2_048  # of a block
FILE_BLOCKS = 2
HELD_BYTES = 6 << 20  # of the query blocks that a task holds, which take some fifteen times as much in memory
LEADERS, LIKE, SKETCH = 8, 0.3, 512  # texts that others are grouped by, the cosine that makes two alike, and its dimensions
WIDE = 1_024  # columns multiplied at once: fewer terms in a sum of floats, less rounding
AXES, AXIS_TERMS = 192, 2_048  # directions that bound similarities, and n-grams that they are of
POSTINGS = 100_000  # that are added up at once, within a core's cache
AT_ONCE = 64  # pool texts that a query is compared with in doubles
BOTH_COMMON = 0.03  # geometric mean of a term's shares in two blocks above which it is multiplied as a dense column
DENSE_CELLS = 8_000_000  # doubles in the matrix of common terms of few queries (64 MB)
COMMON = 0.15  # share of the queries above which a term goes into that matrix
DIGITS = 8  # similarities are ranked at this precision, so copies tie exactly
ROUNDED = 1e-3  # above the rounding of bounds in floats
SLACK = 1e-7  # above the rounding of sums and of ranked similarities
FEW_TERMS = 3_200_000  # n-grams of all queries up to which they are sent to the pool (51 MB)


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", FILE_BLOCKS if name == "blocks" else 0).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _squeezed(numbers: np.ndarray) -> bytes:
    """32-bit integers, most of them small, by the planes of their bytes."""
    planes = np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unsqueezed(data: pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def _of_lists(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i, name in enumerate(batch.column(0).to_pylist()):
        yield name, batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()


def _of_texts(low: int, high: int) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    def cut(batch: pa.RecordBatch) -> Iterator[tuple]:
        for name, (grams, tfs) in zip(batch.column(0).to_pylist(), gr.cut_batch(batch.column(1).to_pylist(), low, high)):
            yield name, grams, tfs

    return cut


def _sketch(grams: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit vector that stands for a text: its n-grams by some bits of their hashes."""
    sketch = np.bincount(grams & (SKETCH - 1), (1 - 2 * ((grams >> 40) & 1)) * np.sqrt(np.abs(values)), SKETCH)
    return (sketch / max(np.linalg.norm(sketch), 1e-12)).astype(np.float32)


def _alike(sketch: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A group of each text: the one of some long, unlike texts that it is most like."""
    long = np.flatnonzero(sizes >= np.median(sizes))
    near = sketch @ sketch[long[sizes[long].argmax()]][:, None]
    while near.shape[1] < LEADERS and (most := near[long].max(axis=1)).min() < LIKE:
        near = np.column_stack((near, sketch @ sketch[long[most.argmin()]]))
    group = near.argmax(axis=1)
    few = np.bincount(group, sizes, near.shape[1]) < sizes.sum() / 32  # such groups are put together
    return np.where(few[group], -1, group)


def _packed(rows: DataFrame, key_type: str, limit: int, texts: Callable[[pa.RecordBatch], Iterator[tuple]], counts: bool) -> DataFrame:
    """Blocks of the texts that have n-grams, as a written table. `texts` makes `id, sorted n-grams,
    values` of a batch, values being counts or weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, window, size, id_type = TaskContext.get().partitionId(), 0, [], 0, None

        def block(held: list[tuple]) -> pa.RecordBatch:
            nonlocal seq
            owner, values = np.repeat(np.arange(len(held)), [len(h[1]) for h in held]), np.concatenate([h[2] for h in held])
            terms, place, times = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True, return_counts=True)
            order = np.argsort(place * len(held) + owner)
            step = np.diff(owner[order], prepend=0)
            data = (terms.astype("<i8").tobytes(), _squeezed(times), _squeezed((step << 1) ^ (step >> 63)),
                    _squeezed(values[order]) if counts else values[order].astype("<f8").tobytes())
            seq += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([[h[0] for h in held]], pa.list_(id_type)),
                 *[pa.array([x], pa.binary()) for x in data]], names=["block", "n", "ids", "terms", "times", "texts", "values"])

        def blocks() -> Iterator[pa.RecordBatch]:
            """Of the texts of the window: groups of like texts, and in a group by length."""
            n = np.array([len(t[1]) for t in window])
            # Little text is not worth parting: a pair of blocks has a cost of its own.
            group = _alike(np.array([t[3] for t in window]), n) if n.sum() > limit else np.zeros(len(n), int)
            order = np.lexsort((n, group))
            for g in np.unique(group):
                own = order[group[order] == g]
                ends = np.cumsum(n[own])
                many = max(-(-ends[-1] // limit), -(-len(own) // BLOCK_TEXTS))  # of one size rather than full ones and a rest
                piece = np.maximum((ends - n[own]) // max(ends[-1] / many, 1), np.arange(len(own)) // BLOCK_TEXTS)
                for p in np.unique(piece):
                    yield block([window[i] for i in own[piece == p]])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, grams, values in texts(batch):
                if not len(grams):
                    continue
                if window and size + len(grams) > WINDOW * limit:
                    yield from blocks()
                    window, size = [], 0
                window.append((name, grams, values.astype(np.int32) if counts else values, _sketch(grams, values)))
                size += len(grams)
        if window:
            yield from blocks()
        window = []
        _give_back()

    ship_package(rows.sparkSession)
    return _kept(rows.mapInArrow(run, f"block bigint, n bigint, ids array<{key_type}>, terms binary, times binary, texts binary, values binary"), "blocks")


class _Block:
    """Texts with their n-grams: `places` in `terms`, and weights."""

    def __init__(self, ids: list, ends: np.ndarray, terms: np.ndarray, places: np.ndarray, weights: np.ndarray):
        self.ids, self.terms, self.places, self.weights = ids, terms, places, weights
        self.owner = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))


class _Stored:
    """A stored block by term: how many texts have each of its terms, which, and the weights there.
    Where it has counts, a vocabulary weighs them; the terms that are not in it weigh nothing."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str, vocabulary: tuple | None, sublinear: bool):
        at = lambda c: batch.column(side + c)[row]
        self.ids, self.terms = at("ids").as_py(), np.frombuffer(at("terms").as_buffer(), "<i8")
        n = batch.column(side + "n")[row].as_py()
        self.times, step = _unsqueezed(at("times").as_buffer(), len(self.terms)).astype(np.int64), _unsqueezed(at("texts").as_buffer(), n)
        self.doc = np.cumsum((step >> 1) ^ -(step & 1), dtype=np.int32).astype(np.uint16)
        if vocabulary is None:
            self.weight = np.frombuffer(at("values").as_buffer(), "<f8")
            return
        found, known = gr.located(self.terms, vocabulary[0])
        idf = np.zeros(len(self.terms))
        idf[known] = vocabulary[1][found]
        if not known.all():
            kept = np.repeat(known, self.times)
            self.doc, tfs = self.doc[kept], _unsqueezed(at("values").as_buffer(), n)[kept]
            self.terms, self.times, idf = self.terms[known], self.times[known], idf[known]
        else:
            tfs = _unsqueezed(at("values").as_buffer(), n)
        self.weight = gr.scaled(tfs, np.repeat(idf, self.times), self.doc, len(self.ids), sublinear)


class _Pool:
    """A block with distinct sorted terms as postings, with its common terms as a dense matrix."""

    def __init__(self, block: _Block, common: float):
        self.ids, self.terms = block.ids, block.terms
        self.order_of = np.argsort(np.argsort(np.asarray(self.ids), kind="stable"))
        by_term = np.argsort(block.places, kind="stable")
        term, doc, weight = block.places[by_term], block.owner[by_term], block.weights[by_term]
        count = np.bincount(term, minlength=len(self.terms))
        hot = np.argsort(-count, kind="stable")[: DENSE_CELLS // len(self.ids)]
        hot = hot[count[hot] > max(common * len(self.ids), 1)]
        self.column = np.full(len(self.terms), -1)
        self.column[hot] = np.arange(len(hot))
        self.dense = np.zeros((len(hot), len(self.ids)))
        is_hot = self.column[term] >= 0
        self.dense[self.column[term[is_hot]], doc[is_hot]] = weight[is_hot]
        self.doc, self.weight = doc[~is_hot], weight[~is_hot]
        self.count = np.bincount(term[~is_hot], minlength=len(self.terms))
        self.start = np.concatenate(([0], np.cumsum(self.count)[:-1])) if len(self.terms) else self.count

    def shared(self, asked: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of the queries that the block has: owner, place in its terms, weight."""
        place, known = np.searchsorted(self.terms, asked.terms), np.zeros(len(asked.terms), bool)
        place[place == len(self.terms)] = 0
        if len(self.terms):
            known = self.terms[place] == asked.terms
        have = known[asked.places]
        return asked.owner[have], place[asked.places][have], asked.weights[have]

    def similarities(self, asked: _Block, chosen: np.ndarray) -> np.ndarray:
        """Of the chosen queries to every text."""
        owner, t, w = self.shared(asked)
        wanted = np.isin(owner, chosen)
        row, t, w = np.searchsorted(chosen, owner[wanted]), t[wanted], w[wanted]
        hot = self.column[t] >= 0
        left = np.zeros((len(chosen), len(self.dense)))
        left[row[hot], self.column[t[hot]]] = w[hot]
        out = left @ self.dense if len(self.dense) else np.zeros((len(chosen), len(self.ids)))
        row, t, w = row[~hot], t[~hot], w[~hot]
        ends = np.searchsorted(row, np.arange(len(chosen) + 1))
        for i in range(len(chosen)):
            tt, ww = t[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]]
            n = self.count[tt]
            places = np.repeat(self.start[tt] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(tt) else np.zeros(0, int)
            out[i] += np.bincount(self.doc[places], np.repeat(ww, n) * self.weight[places], len(self.ids))
        return np.round(out, DIGITS)


class _Best:
    """The nearest pool texts of the queries of a block so far, and the similarity they must reach."""

    def __init__(self, ids: list, k: int):
        self.ids, self.k, self.least = ids, k, np.zeros(len(ids))
        self.found: list[list[tuple]] = [[] for _ in ids]

    def look(self, pool: _Pool | _Turned, asked: _Block, bounds: np.ndarray) -> None:
        chosen = np.flatnonzero((bounds > 0) & (bounds >= self.least - SLACK))
        if not len(chosen):
            return
        sims = pool.similarities(asked, chosen)
        for row, q in enumerate(chosen):
            s = sims[row]
            near = np.flatnonzero((s > 0) & (s >= self.least[q]))
            if len(near) > self.k:  # everything at least as near as the k-th, ties included
                near = near[s[near] >= -np.partition(-s[near], self.k - 1)[self.k - 1]]
            near = near[np.lexsort((pool.order_of[near], -s[near]))][: self.k]
            best = sorted([*self.found[q], *((-float(s[p]), pool.ids[p]) for p in near)])[: self.k]
            self.found[q] = best
            if len(best) == self.k:
                self.least[q] = max(self.least[q], -best[-1][0])

    def rows(self, key_type: pa.DataType) -> pa.Table:
        flat = [(q, p, -s) for q, best in zip(self.ids, self.found) for s, p in best]
        columns = zip(*flat) if flat else ((), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (key_type, key_type, pa.float64()))], names=["query", "pool", "sim"])


def _runs(start: np.ndarray, times: np.ndarray) -> np.ndarray:
    """`start`, `start` + 1 and so on, as often as `times` says, one run after another."""
    before = np.cumsum(times) - times
    return np.arange(times.sum()) + np.repeat(start - before, times)


class _Postings:
    """Texts by the terms of a task's queries: `count` texts have a term, whose entries begin at
    `start` of `doc` and `floats`."""

    def __init__(self, size: int, doc: np.ndarray, floats: np.ndarray, count: np.ndarray, start: np.ndarray):
        self.size, self.doc, self.floats, self.count, self.start = size, doc, floats, count, start

    def dense(self, terms: np.ndarray) -> np.ndarray:
        """A row for each of some terms, a column for each text."""
        out, times = np.zeros((len(terms), self.size), np.float32), self.count[terms]
        at = _runs(self.start[terms], times)
        out.ravel()[np.repeat(np.arange(len(terms)) * self.size, times) + self.doc[at]] = self.floats[at]
        return out


class _Placed:
    """A block by the terms of a task's queries, and by text: its entries begin at `begin` of `term`
    and `weight`, `term` being the number of terms where the queries don't have it."""

    def __init__(self, block: _Stored, terms: np.ndarray):
        at, known = np.searchsorted(terms, block.terms), np.zeros(len(block.terms), bool)
        at[at == len(terms)] = 0
        if len(terms):
            known = terms[at] == block.terms
        at[~known] = len(terms)
        self.ids, count, start = block.ids, np.zeros(len(terms) + 1, np.int64), np.zeros(len(terms) + 1, np.int64)
        start[at], count[at] = np.cumsum(block.times) - block.times, block.times
        count[len(terms)] = 0  # these are several terms
        self.postings = _Postings(len(block.ids), block.doc, block.weight.astype(np.float32), count, start)
        by_text = np.argsort(block.doc, kind="stable")
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(block.doc, minlength=len(block.ids)))))
        self.term, self.weight = np.repeat(at.astype(np.int32), block.times)[by_text], block.weight[by_text]

    def text(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.begin[i], self.begin[i + 1])
        return self.term[own], self.weight[own]

    def along(self, axes: tuple[np.ndarray, np.ndarray]) -> None:
        """`sketch`: a text's coordinates on some axes, and the length of the rest of it."""
        length = np.bincount(self.postings.doc, self.postings.floats.astype(float) ** 2, len(self.ids))
        dense = self.postings.dense(axes[0])
        on = np.concatenate([dense[:, a : a + 512].T.astype(float) @ axes[1] for a in range(0, len(self.ids), 512)])
        rest = np.sqrt(np.maximum(length - np.square(on).sum(axis=1), 0) + ROUNDED)
        self.sketch = np.column_stack((on, rest)).astype(np.float32)


def _axes(blocks: list[_Placed], n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal directions in the n-grams of most weight: of the means of blocks and of some texts."""
    energy = np.zeros(n_terms + 1)
    for b in blocks:
        energy += np.bincount(b.term, b.weight**2, n_terms + 1)
    terms = np.sort(np.argsort(-energy[:n_terms], kind="stable")[:AXIS_TERMS])
    each = -(-AXES // len(blocks))
    found = []
    for b in blocks:
        dense = b.postings.dense(terms)
        found += [dense.mean(axis=1, keepdims=True), dense[:, :: -(-dense.shape[1] // each)].copy()]
    basis, size = np.linalg.qr(np.concatenate(found, axis=1).astype(float))
    return terms, basis[:, np.abs(np.diag(size)) > 1e-6]


def _similarities(block: _Placed, texts: np.ndarray, held: _Postings, common: float) -> tuple[np.ndarray, float]:
    """Of some texts of a block to all texts that are held as postings, in floats, and what rounding
    adds at most."""
    whole, own = len(texts) == len(block.ids), block.begin[texts + 1] - block.begin[texts]
    entry = slice(None) if whole else _runs(block.begin[texts], own)
    term, weight, row = block.term[entry], block.weight[entry], np.repeat(np.arange(len(texts)), own)
    count = block.postings.count if whole else np.bincount(term, minlength=len(held.count))
    shared = count * held.count
    hot = shared > common**2 * len(texts) * held.size
    columns = np.flatnonzero(hot)
    if not whole:
        place = np.full(len(hot), -1, np.int32)
        place[columns] = np.arange(len(columns))
        column = place[term]
    sims = np.zeros((len(texts), held.size), np.float32)
    for low in range(0, len(columns), WIDE):
        part = columns[low : low + WIDE]
        if whole:
            dense = block.postings.dense(part).T
        else:
            dense, at = np.zeros((len(texts), len(part)), np.float32), np.flatnonzero((column >= low) & (column < low + WIDE))
            dense.ravel()[row[at] * len(part) + column[at] - low] = weight[at]
        sims += dense @ held.dense(part)
    cold = np.flatnonzero((~hot & (shared > 0))[term])
    row, weight, start, times = row[cold], weight[cold].astype(np.float32), held.start[term[cold]], held.count[term[cold]]
    ends, first, done = np.cumsum(times), 0, 0
    while first < len(row):
        last = max(first + 1, int(np.searchsorted(ends, done + POSTINGS, side="right")))
        part, base = slice(first, last), row[first]
        rows, at = int(row[last - 1] - base) + 1, _runs(start[part], times[part])
        cells = np.repeat((row[part] - base) * held.size, times[part]) + held.doc[at]
        found = np.bincount(cells, np.repeat(weight[part], times[part]) * held.floats[at], rows * held.size)
        sims[base : base + rows] += found.reshape(rows, held.size)
        first, done = last, ends[last - 1]
    return sims, (min(len(columns), WIDE) + len(columns) // WIDE + 64) * 2.0**-24


class _Asked(_Placed):
    """A query block, and the nearest pool texts of its queries so far."""

    def __init__(self, block: _Stored, terms: np.ndarray, k: int, common: float):
        super().__init__(block, terms)
        self.k, self.common, self.least = k, common, np.zeros(len(self.ids))
        self.found: list[list[tuple]] = [[] for _ in self.ids]

    def reached(self, pool: _Placed) -> tuple[np.ndarray, np.ndarray]:
        """The pool texts and the queries without which no pair can reach the query's k-th similarity:
        what two texts have in common is their product along the axes and at most that of the rests."""
        near = pool.sketch @ self.sketch.T >= (self.least - ROUNDED).astype(np.float32)
        queries = np.flatnonzero(near.any(axis=0))
        # A part is taken only where that is a good deal less than the whole.
        return tuple(x if len(x) < 0.7 * n else np.arange(n) for x, n in ((np.flatnonzero(near.any(axis=1)), len(near)), (queries, len(self.ids))))

    def look(self, pool: _Placed) -> None:
        texts, names = self.reached(pool)
        if not len(names) or not len(texts):
            return
        if len(names) * len(pool.ids) < len(texts) * len(self.ids):  # the smaller part is looked up in all of the other
            texts = np.arange(len(pool.ids))
            sims, slack = _similarities(self, names, pool.postings, self.common)
            sims = sims.T
        else:
            names = np.arange(len(self.ids))
            sims, slack = _similarities(pool, texts, self.postings, self.common)
        near = sims >= np.maximum(self.least[names] - slack, 1e-30).astype(np.float32)
        many = np.flatnonzero(np.count_nonzero(near, axis=0) > 4 * self.k)
        if len(many) and len(texts) > self.k:  # no more than those about the block's k-th
            own = sims[:, many]
            kth = np.partition(own, len(texts) - self.k, axis=0)[len(texts) - self.k]
            near[:, many] &= own >= kth - np.float32(2 * slack)
        query, text = np.nonzero(near.T)
        bounds = np.flatnonzero(np.diff(query, prepend=-1, append=-1))
        held = np.zeros(len(self.postings.count))
        for a, b in zip(bounds[:-1], bounds[1:]):
            q, at = names[query[a]], text[a:b]
            own, weight = self.text(q)
            held[own] = weight
            about = sims[at, query[a]]
            order = np.argsort(-about)
            for first in range(0, len(order), AT_ONCE):
                part = order[first : first + AT_ONCE]
                if about[part[0]] < self.least[q] - slack:
                    break
                p = texts[at[part]]
                n = pool.begin[p + 1] - pool.begin[p]
                entry = _runs(pool.begin[p], n)
                exact = np.round(np.add.reduceat(held[pool.term[entry]] * pool.weight[entry], np.cumsum(n) - n), DIGITS)
                new = [(-float(exact[i]), pool.ids[p[i]]) for i in np.flatnonzero((exact > 0) & (exact >= self.least[q]))]
                best = self.found[q] = sorted([*self.found[q], *new])[: self.k]
                if len(best) == self.k:
                    self.least[q] = -best[-1][0]
            held[own] = 0

    def rows(self, key_type: pa.DataType) -> pa.Table:
        flat = [(q, p, -s) for q, best in zip(self.ids, self.found) for s, p in best]
        columns = zip(*flat) if flat else ((), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (key_type, key_type, pa.float64()))], names=["query", "pool", "sim"])


def _give_back() -> None:
    """Freed memory that the worker still keeps goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def _searched(k: int, common: float, key_type: pa.DataType, sent, sublinear: bool):
    """Pairs of blocks, those of a pool block one after another. Query blocks come with the first
    pool block, a pool block with the first query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, queries, names, first, held = sent.value if sent else None, [], set(), None, None

        def placed() -> tuple:
            terms = np.unique(np.concatenate([b.terms for b in queries]))
            made = [_Asked(queries.pop(0), terms, k, common) for _ in range(len(queries))]
            axes = _axes(made, len(terms))
            for own in made:
                own.along(axes)
            _give_back()
            return terms, made, axes

        def search(block: _Stored, terms: np.ndarray, asked: list[_Asked], axes: tuple) -> None:
            pool = _Placed(block, terms)
            pool.along(axes)
            for own in asked:
                own.look(pool)

        for batch in batches:
            _give_back()
            for row, q in enumerate(batch.column("q_block").to_pylist()):
                new_query, new_pool = (batch.column(c)[row].is_valid for c in ("q_terms", "p_terms"))
                if new_query:
                    queries.append(_Stored(batch, row, "q_", vocabulary, sublinear))
                    names.add(q)
                if q not in names:
                    raise RuntimeError("a pair of blocks came before its query block")
                if not new_pool:
                    continue
                pool = _Stored(batch, row, "p_", vocabulary, sublinear)
                if new_query:
                    first = pool
                    continue
                held = held or placed()
                for block in [first, pool] if first else [pool]:
                    search(block, *held)
                first = None
        if first:
            held = held or placed()
            search(first, *held)
        for own in held[1] if held else []:
            yield from own.rows(key_type).to_batches()

    return run


def _nearest(queries: DataFrame, pool: DataFrame, key_type: str, k: int, common: float, fitted: gr.Vocabulary | None = None) -> DataFrame:
    """`top_k` over written blocks, which are weighed as they are read where a vocabulary is given."""
    spark = pool.sparkSession
    sent = spark.sparkContext.broadcast(fitted.arrays()) if fitted else None
    reader = spark.newSession()  # whose settings decide how many query blocks go to a task
    reader.conf.set("spark.sql.files.maxPartitionBytes", str(HELD_BYTES))
    reader.conf.set("spark.sql.files.openCostInBytes", "0")
    held = reader.read.schema(queries.schema).parquet(*queries.inputFiles()) if queries.inputFiles() else queries
    sides = [df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns], (F.monotonically_increasing_id() % 2**33 == 0).alias(f"{side}_first"))
             for side, df in (("p", pool.coalesce(1)), ("q", held))]
    pairs = sides[0].hint("shuffle_replicate_nl").crossJoin(sides[1])  # pool blocks outside, and nothing is shuffled
    data = ("n", "ids", "terms", "times", "texts", "values")
    once = [F.when(F.col(f"{other}_first"), F.col(f"{side}_{c}")).alias(f"{side}_{c}") for side, other in ("pq", "qp") for c in data]
    arrow_type = to_arrow_type(pool.schema["ids"].dataType.elementType)
    near = pairs.select("q_block", *once).mapInArrow(
        _searched(k, common, arrow_type, sent, fitted is not None and fitted.sublinear), f"query {key_type}, pool {key_type}, sim double")
    ranked = Window.partitionBy("query").orderBy(F.desc("sim"), "pool")  # k rows a query
    return near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def top_k(
    query_weights: DataFrame, pool_weights: DataFrame, key: str, k: int, block_terms: int = BLOCK_TERMS, common: float = BOTH_COMMON
) -> DataFrame:
    """`query, pool, sim, rank`: the k pool texts most similar to each query that share a term
    with it. Ties go to the smaller pool key. Weights are `key, grams, weights` by text."""
    if k < 1:
        raise ValueError("k must be >= 1")
    key_type = pool_weights.schema[key].dataType.simpleString()
    queries, pool = (_packed(w.select(key, "grams", "weights"), key_type, block_terms, _of_lists, False) for w in (query_weights, pool_weights))
    return _nearest(queries, pool, key_type, k, common)


class _Turned:
    """Pool texts against queries held as postings: what `_Best` looks at."""

    def __init__(self, texts: _Block, held: _Pool):
        self.texts, self.held, self.ids = texts, held, texts.ids
        self.order_of = np.argsort(np.argsort(np.asarray(texts.ids), kind="stable"))

    def similarities(self, asked: _Block, chosen: np.ndarray) -> np.ndarray:
        return self.held.similarities(self.texts, np.arange(len(self.ids))).T[chosen]


def nearest_to_few(asked: pa.Table, pool: DataFrame, fitted: gr.Vocabulary, key: str, k: int, text: str = "text", common: float = COMMON) -> DataFrame:
    """`top_k` for a bounded number of queries (`key, grams, weights`): they are sent to the pool, and
    every pool text is cut, weighed and scored where it is, in blocks of bounded text. Each task
    returns k rows a query; no n-gram of the pool is shuffled or stored."""
    spark = pool.sparkSession
    ship_package(spark)
    key_type, ids = dict(pool.dtypes)[key], asked[key].to_pylist()
    grams, weights = (asked[c].combine_chunks() for c in ("grams", "weights"))
    ends = np.cumsum(grams.value_lengths().to_numpy(zero_copy_only=False))
    terms, places = np.unique(grams.flatten().to_numpy(), return_inverse=True)
    sent = spark.sparkContext.broadcast(((ids, ends, terms, places, weights.flatten().to_numpy()), *fitted.arrays()))
    low, high, sublinear, arrow_type = fitted.low, fitted.high, fitted.sublinear, asked.schema.field(key).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, terms, idf = sent.value
        queries = _Block(*held)
        if not queries.ids:
            return
        found, postings = _Best(queries.ids, k), _Pool(queries, common)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last, own, tfs, owner in gr.cut_blocks(batch.column(1).to_pylist(), low, high):
                _, w, known = gr.weigh(own, tfs, owner, last - first, terms, idf, sublinear)
                ends = np.cumsum(np.bincount(owner[known], minlength=last - first))
                texts = _Block(names[first:last], ends, own[known], np.arange(len(w)), w)
                found.look(_Turned(texts, postings), queries, np.ones(len(queries.ids)))
        yield from found.rows(arrow_type).to_batches()

    near = pool.select(key, gr.spaced(text).alias("text")).mapInArrow(run, f"query {key_type}, pool {key_type}, sim double")
    ranked = Window.partitionBy("query").orderBy(F.desc("sim"), "pool")  # at most k rows a task
    return near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a block each of its n-grams is."""
    for batch in batches:
        for row in range(batch.num_rows):
            terms = np.frombuffer(batch.column("terms")[row].as_buffer(), "<i8")
            times = _unsqueezed(batch.column("times")[row].as_buffer(), len(terms))
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(times.astype(np.int64))], names=["gram", "df"])


def _nearest_of_many(
    queries: DataFrame, pool: DataFrame, key: str, k: int, text: str, low: int, high: int, min_df: int, block_terms: int
) -> DataFrame:
    key_type = pool.schema[key].dataType.simpleString()
    spread = lambda df: gr.spread(df.select(key, text), key, text)
    blocks = lambda df: _packed(
        spread(df).select(key, gr.spaced(text).alias("text")), key_type, block_terms, _of_texts(low, high), True)
    held = blocks(pool)
    counts = held.select("terms", "times").mapInArrow(_frequencies, "gram bigint, df bigint").groupBy("gram").agg(F.sum("df").alias("df"))
    fitted = gr.fit_counts(counts, pool.count(), low, high, min_df)
    if fitted.size > gr.BROADCAST_TERMS:
        lists = [gr.weighted(gr.gram_lists(spread(df), key, text, low, high), fitted, key) for df in (queries, pool)]
        return top_k(*lists, key, k, block_terms)
    return _nearest(blocks(queries), held, key_type, k, BOTH_COMMON, fitted)


def retrieve(
    queries: DataFrame, pool: DataFrame, key: str, k: int, text: str = "text", low: int = 3, high: int = 5,
    min_df: int = 2, block_terms: int = BLOCK_TERMS, few_terms: int = FEW_TERMS,
) -> DataFrame:
    """Nearest pool texts of every query, with the vectoriser fitted on the pool. A query that
    shares no known n-gram with the pool has no row.

    Queries of at most `few_terms` n-grams in all go to the pool's texts, which are cut once for the
    fit and once for the search. For more, the n-grams of both are stored in blocks, which the fit
    and the search read.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    n = queries.agg(F.sum((high - low + 1) * (F.length(text) + 2))).first()[0] or 0  # n-grams at most
    if n > few_terms:
        return _nearest_of_many(queries, pool, key, k, text, low, high, min_df, block_terms)
    spread = gr.spread(pool.select(key, text), key, text)
    asked = gr.gram_lists(gr.spread(queries, key, text), key, text, low, high)
    texts = _kept(spread, "pool-texts")
    fitted = gr.fit(gr.gram_lists(texts, key, text, low, high), low, high, min_df, n=texts.count())
    weighed = gr.weighted(asked, fitted, key).filter(F.size("grams") > 0)
    if fitted.size > gr.BROADCAST_TERMS:
        lists = gr.gram_lists(texts, key, text, low, high)
        return top_k(weighed, gr.weighted(lists, fitted, key), key, k, block_terms)
    return nearest_to_few(weighed.toArrow(), texts, fitted, key, k, text)


def demonstrations(neighbours: DataFrame, pool: DataFrame, key: str, text: str = "text", intent: str = "intent") -> DataFrame:
    """`query, demos`: each query's k neighbours as (text, intent), nearest last."""
    shown = neighbours.join(pool.select(F.col(key).alias("pool"), F.col(text).alias("text"), F.col(intent).alias("intent")), "pool")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text", "intent")), asc=False)  # k elements
    return shown.groupBy("query").agg(
        F.transform(ordered, lambda r: F.struct(r["text"].alias("text"), r["intent"].alias("intent"))).alias("demos"))


def vote(neighbours: DataFrame, pool: DataFrame, key: str, label: str) -> DataFrame:
    """`query, pred`: the majority label of the neighbours; ties go to the nearer, then the lower."""
    labelled = neighbours.join(pool.select(F.col(key).alias("pool"), F.col(label).alias("label")), "pool")
    counts = labelled.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"), F.max("sim").alias("best"))
    return counts.groupBy("query").agg(
        F.max_by("label", F.struct("n", "best", -F.col("label"))).alias("pred"))
