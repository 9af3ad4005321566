"""Documents packed into token sequences by a grouping genetic algorithm on islands.

A piece of a document is packed whole. Pieces are spread over islands of bounded size by a hash.
On an island, individuals are lists of bins. Crossover injects whole well-filled bins of one
parent into the other, drops the bins that then hold a document twice, opens some of the emptiest
bins besides, and puts the documents displaced by that back by best fit, largest first. An island
stops at its lower bound, or when many generations have brought nothing.

An epoch ends with migration: the fullest bins of each island's best individual are final. Bins
that are nearly as full migrate whole, each to an island where one individual starts with them;
the most frequent length patterns go to all islands of the next epoch, which seed individuals
with them, and the documents of all other bins move on to new islands. So space left over
anywhere meets documents from elsewhere, and no task ever holds more than an island.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import in_arrow, kept
from labelscope.session import ship_package

CAPACITY = 2048
ISLAND = 4_000
POPULATION, GENERATIONS, PATIENCE = 12, 120, 20
#: Bins filled to this share migrate whole.
ELITE = 0.97
#: Final before the last epoch: bins filled to this share. The last epoch takes all.
FULL = (0.998, 0.99, 0.0)
PATTERNS = 256


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level vocabulary of `path` (a tokenizers file) as an encoder of whole texts.

    The merges are run by tiktoken, which gives the same ids several times faster; tests compare
    both on texts of every kind. Strings of the vocabulary's special tokens become their ids, as
    they do there.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    to_byte = {c: b for b, c in _byte_alphabet().items()}
    special = {t["content"]: t["id"] for t in made["added_tokens"]}
    ranks = {
        bytes(to_byte[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special
    }
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary file: itself
    where printable in Latin-1, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """`start, length` of the pieces of a document: all full but the first."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            texts, rows = batch.column(1), []
            for i in range(batch.num_rows):
                ids = np.array([*encode(texts[i].as_py() or ""), 0], dtype="<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            made = np.array(rows, dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(made[:, 0])), pa.array(made[:, 1].astype(np.int32))]
                + [pa.array(made[:, k]) for k in (2, 3, 4)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class _Space:
    """Bins by the space they have left; best fit in constant time on a bit set of spaces."""

    def __init__(self, capacity: int):
        self.capacity, self.by_space, self.bits = capacity, [[] for _ in range(capacity + 1)], 0

    def add(self, bin_: list[int], left: int) -> None:
        self.by_space[left].append(bin_)
        self.bits |= 1 << left

    def put(self, item: int, size: int) -> None:
        fitting = self.bits >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            bin_ = self.by_space[left].pop()
            if not self.by_space[left]:
                self.bits ^= 1 << left
        else:
            bin_, left = [], self.capacity
        bin_.append(item)
        self.add(bin_, left - size)

    def bins(self) -> list[list[int]]:
        return [b for bins in self.by_space for b in bins]


def _fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """`bins` with all `items` added by best fit, largest first."""
    space = _Space(capacity)
    for b in bins:
        space.add(b, capacity - sum(sizes[i] for i in b))
    for i in sorted(items, key=sizes.__getitem__, reverse=True):
        space.put(i, sizes[i])
    return space.bins()


def _seeded(sizes: list[int], capacity: int, patterns: list[tuple[int, ...]]) -> list[list[int]]:
    """An individual that repeats elite length patterns as often as its documents allow."""
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    bins = []
    for pattern in patterns:
        while all(len(by_size.get(s, ())) >= pattern.count(s) for s in pattern):
            bins.append([by_size[s].pop() for s in pattern])
    return _fit([i for ids in by_size.values() for i in ids], sizes, capacity, bins)


def _filled(bin_: list[int], sizes: list[int]) -> int:
    return sum(sizes[i] for i in bin_)


def cross(giver: list[list[int]], taker: list[list[int]], sizes: list[int], capacity: int, draw: random.Random) -> list[list[int]]:
    """A child of two packings: whole well-filled bins of one go into the other."""
    least = draw.choice((1.0, 0.999, 0.995, 0.98)) * capacity
    share = draw.choice((0.5, 0.9))
    gift = [b for b in giver if _filled(b, sizes) >= least and draw.random() < share]
    given = {i for b in gift for i in b}
    stay = sorted((b for b in taker if given.isdisjoint(b)), key=lambda b: -_filled(b, sizes))
    stay = stay[: max(0, len(stay) - draw.randrange(1, max(2, len(stay) // 5)))]
    held = given.union(*stay) if stay else given
    return _fit([i for i in range(len(sizes)) if i not in held], sizes, capacity, [list(b) for b in gift + stay])


def evolve(
    sizes: list[int], capacity: int = CAPACITY, patterns: list[tuple[int, ...]] = (), seed: int = 0,
    population: int = POPULATION, generations: int = GENERATIONS, elite: list[list[int]] = (),
) -> list[list[int]]:
    """Pack items of the given sizes (each at most `capacity`); bins as lists of item numbers."""
    if not sizes:
        return []
    draw, least = random.Random(seed), -(-sum(sizes) // capacity)
    everyone = list(range(len(sizes)))

    def fitness(bins: list[list[int]]) -> tuple:
        return len(bins), -sum((_filled(b, sizes) / capacity) ** 2 for b in bins)

    people = [_fit(everyone, sizes, capacity, [])]
    if patterns:
        people.append(_seeded(sizes, capacity, patterns))
    if elite:
        held = {i for b in elite for i in b}
        people.append(_fit([i for i in everyone if i not in held], sizes, capacity, [list(b) for b in elite]))
    best = min(people, key=fitness)
    if len(best) == least:
        return best
    while len(people) < population:
        # Large items first, but in an order of their own: other fills, nearly as good.
        noisy = sorted(everyone, key=lambda i: sizes[i] * draw.uniform(0.7, 1.3), reverse=True)
        space = _Space(capacity)
        for i in noisy:
            space.put(i, sizes[i])
        people.append(space.bins())
    ranked, idle = sorted(((fitness(p), k, p) for k, p in enumerate(people))), 0
    for born in range(generations):
        if ranked[0][0][0] == least or idle >= PATIENCE:
            break
        # The better half stays; each of the others makes way for a child of two of those.
        parents, before = ranked[: max(2, len(ranked) // 2)], ranked[0][0]
        children = []
        for k in range(len(ranked) - len(parents)):
            giver, taker = draw.sample(parents, 2)
            child = cross(giver[2], taker[2], sizes, capacity, draw)
            children.append((fitness(child), (born + 1) * population + k, child))
        ranked = sorted(parents + children)
        idle = 0 if ranked[0][0] < before else idle + 1
    return ranked[0][2]


def _island(capacity: int, full: float, patterns: list[tuple[int, ...]], epoch: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        sizes, together = group["length"].tolist(), {}
        for i, bin_ in enumerate(group["elite"]):
            if bin_ >= 0:
                together.setdefault(bin_, []).append(i)
        number, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        final, pattern, elite = np.zeros(len(sizes), dtype=bool), [None] * len(sizes), np.full(len(sizes), -1, dtype=np.int64)
        island = int(group["island"].iloc[0])
        bins = evolve(sizes, capacity, patterns, seed=(epoch << 40) + island, elite=list(together.values()))
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                number[i], offset[i] = k, at
                at += sizes[i]
            if at >= full * capacity:
                final[members] = True
                if at == capacity and len(members) > 1:
                    pattern[members[0]] = ",".join(map(str, sorted((sizes[i] for i in members), reverse=True)))
            elif at >= ELITE * capacity:
                elite[members] = (island << 20) + k
        return pd.DataFrame({"uid": group["uid"], "length": group["length"], "island": group["island"], "bin": number,
                             "offset": offset, "final": final, "pattern": pattern, "elite": elite})

    return run


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32` of every piece; each document ends with id 0."""
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_arrow(narrow, _pieces(path, capacity),
                    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """`pieces` (with a column `length`) plus `sequence_id` and `offset`."""
    ship_package(pieces.sparkSession)
    pieces = kept(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") >= capacity).select(
        "uid", F.shiftleft(F.lit(len(FULL)).cast("bigint"), 58).bitwiseOR(F.col("uid")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    left, patterns, placed = pieces.filter(F.col("length") < capacity).select(
        "uid", "length", F.lit(-1).cast("bigint").alias("elite")), [], whole
    for epoch, full in enumerate(FULL):
        n = max(1, -(-left.count() // island))
        home = F.when(F.col("elite") >= 0, F.xxhash64("elite", F.lit(-epoch))).otherwise(F.xxhash64("uid", F.lit(epoch)))
        spread = left.withColumn("island", F.pmod(home, F.lit(n)).cast("bigint"))
        done = kept(
            spread.groupBy("island").applyInPandas(
                _island(capacity, full, patterns, epoch),
                "uid bigint, length bigint, island bigint, bin bigint, offset bigint, final boolean, pattern string, elite bigint"),
            "island-bins")
        number = F.shiftleft(F.lit(epoch).cast("bigint"), 58).bitwiseOR(F.shiftleft("island", 20)).bitwiseOR(F.col("bin"))
        placed = placed.unionByName(done.filter("final").select("uid", number.alias("sequence_id"), "offset"))
        left = done.filter("not final").select("uid", "length", "elite")
        top = done.filter("pattern is not null").groupBy("pattern").count().orderBy(F.desc("count"), "pattern")
        patterns = [tuple(map(int, r[0].split(","))) for r in top.limit(PATTERNS).collect()]
    return pieces.join(placed, "uid").drop("uid")


def pack_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, island: int = ISLAND,
) -> DataFrame:
    """One row per piece: where its tokens come from and where they go.

    Null and empty texts are the closing id 0 alone. Documents longer than a sequence are cut,
    the first piece being the shorter one; pieces that fill a sequence have it to themselves.
    Repeated rows are packed as often as they occur, rows without an id too. An empty table
    gives no sequence. Other columns are not read.
    """
    return pack(token_pieces(docs, path, key, text, capacity), capacity, island)
