"""Connected components of a link table: folds inside partitions, pointer jumps between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import dropped, in_arrow, kept

#: Links that a task folds into one forest before it hands it on.
FOLD_LINKS = 500_000


def _fold(limit: int):
    """Links `u, v` as stars: every node but the smallest of its group points at that. `foreign`
    marks nodes that no link of this partition began at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        own: set[int] = set()

        def top(x: int) -> int:
            root = x
            while (above := up.get(root, root)) != root:
                root = above
            while (above := up.get(x, root)) != root:
                up[x], x = root, above
            return root

        def stars() -> pa.RecordBatch:
            nodes = [x for x in up if up[x] != x]
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64()),
                 pa.array([x not in own for x in nodes], pa.bool_())], names=["u", "v", "foreign"])

        seen, last = 0, None
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seen >= limit and u != last:
                    yield stars()
                    up, own, seen = {}, set(), 0
                seen, last = seen + 1, u
                own.add(u)
                p, q = top(u), top(v)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    up.setdefault(min(p, q), min(p, q))
        if up:
            yield stars()

    return run


def _folded(links: DataFrame, limit: int) -> DataFrame:
    return in_arrow(links.select("u", "v"), _fold(limit), "u bigint, v bigint, foreign boolean")


def parents(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, fold_links: int = FOLD_LINKS) -> DataFrame:
    """`node, component` for every node of a link that can reach a smaller one; component is the
    smallest node reachable.

    Each task folds its links into stars, so a node leaves it as one row however many links it
    has. A round deals the rows out by node, folds again, and lets every node jump to what its
    own target points at; it costs three exchanges. Links joined elsewhere come back as rows of
    their own and are dealt out in the next round. Rounds grow with the logarithm of the longest
    chain. A target with a third of all nodes is a skewed join key, which adaptive execution
    splits. Null ends and self-links are ignored.
    """
    u, v = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    stars = _folded(links.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(u.alias("u"), v.alias("v")), fold_links)
    before = None
    for _ in range(max_rounds):
        once = _folded(stars.repartition("u").sortWithinPartitions("u"), fold_links)  # a node's rows in one forest
        beyond = once.select(F.col("u").alias("v"), F.col("v").alias("beyond"))
        jumped = once.join(beyond, "v", "left").select(
            "u", F.coalesce("beyond", "v").alias("v"), (F.col("foreign") | F.col("beyond").isNotNull()).alias("moved"))
        stars = kept(jumped, "stars")
        if before is not None:
            dropped(links.sparkSession, before)
        before = stars
        if stars.filter("moved").isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, fold_links: int = FOLD_LINKS) -> DataFrame:
    """`parents` with a row for the smallest nodes too."""
    found = parents(links, a, b, max_rounds, fold_links)
    tops = found.select("component").distinct()
    return found.unionByName(tops.select(F.col("component").alias("node"), "component"))
