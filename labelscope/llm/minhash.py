"""Near-duplicate documents by b-bit MinHash.

Each document's distinct word shingles give `BANDS * ROWS` or more minima. Runs of `ROWS` whole
minima are band keys; documents that share one are candidates. Of every minimum only two low
bits are kept besides, packed into six longs, and the number of agreeing slots, corrected for
chance agreement, estimates the similarity of a candidate pair before any full set is read.
Links are confirmed on the full shingle sets.

The work follows the links, not the pairs of a group:

* documents with equal shingle sets are one class from the start, whatever their number;
* in a bucket every member is compared with its smallest id; a group of near copies so costs one
  comparison a member;
* only members of buckets that still hold several components are compared further, across
  components, in blocks of bounded size; a block pair returns the links that merge components,
  not its pairs. Shingles that no other such member has bound the overlap a document can reach,
  which rules out members that were changed too much to link with anything. This is exact: every
  pair of a bucket is compared, ruled out by that bound, or already in one component.

A pair at the threshold is missed by all bands with a probability of 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.graph import parents
from labelscope.llm.stages import in_arrow, kept
from labelscope.llm.words import LOWER, NOT_SPACE, Words, blocks, mix, multipliers, shingles

SLOTS, BANDS, ROWS, BITS = 192, 38, 5, 2
LONGS = SLOTS // 64
#: Estimates this far below the threshold are still confirmed: five standard deviations.
MARGIN = 0.18
#: So many ids (16 MB) are broadcast to the text scan; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Documents, and bytes of their shingle sets, in a block of members compared at once.
BLOCK, BLOCK_SET_BYTES = 1_024, 1 << 22
_U = np.uint64
_PLANES = [f"p{b}{i}" for b in range(BITS) for i in range(LONGS)]
FEATURES = (
    "doc_id bigint, n bigint, set_a bigint, set_b bigint, "
    + ", ".join(f"{p} bigint" for p in _PLANES)
    + ", bands array<bigint>"
)


def _signatures(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima packed to two bits a slot, and band keys, of each non-empty set."""
    minima = np.empty((SLOTS, len(begins)), dtype=_U)
    for slot, factor in enumerate(multipliers(SLOTS, 5)):
        minima[slot] = np.minimum.reduceat(values * factor, begins)
    low = mix(minima)
    planes = [
        np.packbits(((low >> _U(b)) & _U(1)).astype(np.uint8), axis=0).T.copy().view(np.int64)
        for b in range(BITS)
    ]
    factors, salts = multipliers(ROWS, 6), multipliers(BANDS, 8)
    runs = minima[: BANDS * ROWS].reshape(BANDS, ROWS, -1)
    keys = mix((runs * factors[None, :, None]).sum(axis=1, dtype=_U) + salts[:, None])
    return np.concatenate(planes, axis=1), keys.view(np.int64)


def _features(size: int, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(key))
            for block in blocks(batch.column(batch.schema.get_field_index(text))):
                values, bounds = shingles(Words(block, NOT_SPACE, LOWER), size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                planes = np.zeros((block.n, len(_PLANES)), dtype=np.int64)
                sets = np.zeros((2, block.n), dtype=np.int64)
                keys = np.zeros((BANDS, 0), dtype=np.int64)
                if len(full):
                    begins = bounds[:-1][full]
                    planes[full], keys = _signatures(values, begins)
                    for k, factor in enumerate(multipliers(2, 9)):
                        sets[k, full] = np.add.reduceat(mix(values * factor), begins).view(np.int64)
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.first, block.n), pa.array(n), pa.array(sets[0]), pa.array(sets[1])]
                    + [pa.array(planes[:, k]) for k in range(len(_PLANES))]
                    + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.T.ravel()))],
                    names=["doc_id", "n", "set_a", "set_b", *_PLANES, "bands"],
                )

    return run


def _sets(size: int, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(key))
            for block in blocks(batch.column(batch.schema.get_field_index(text))):
                values, bounds = shingles(Words(block, NOT_SPACE, LOWER), size)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.first, block.n),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))],
                    names=["doc_id", "members"],
                )

    return run


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """One row per row of `docs`: set size, set fingerprint, packed minima, band keys."""
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_arrow(narrow, _features(size, "doc_id", "text"), FEATURES)


def similarity_estimate(left: str, right: str) -> Column:
    """Share of agreeing slots of two packed signatures, corrected for agreement by chance."""
    apart = None
    for i in range(LONGS):
        differ = None
        for b in range(BITS):
            x = F.col(f"{left}.p{b}{i}").bitwiseXOR(F.col(f"{right}.p{b}{i}"))
            differ = x if differ is None else differ.bitwiseOR(x)
        apart = F.bit_count(differ) if apart is None else apart + F.bit_count(differ)
    chance = 2.0**-BITS
    return (1 - apart / F.lit(float(SLOTS)) - chance) / (1 - chance)


def _near(left: str, right: str, percent: int) -> Column:
    """Pairs worth confirming: sizes that allow the threshold and a high enough estimate."""
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (
        similarity_estimate(left, right) >= percent / 100 - MARGIN
    )


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """`doc_id, n, members` of the documents with these ids: their sorted distinct shingles."""
    ids = kept(ids.select("doc_id").distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(wanted, "doc_id", "left_semi")
    return kept(in_arrow(texts, _sets(size, "doc_id", "text"), "doc_id bigint, members array<bigint>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `a, b` whose full sets have 100 * intersection >= percent * union."""
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a")
        .select("a", "b", F.size(F.array_intersect("ma", "mb")).cast("bigint").alias("both"),
                (F.size("ma") + F.size("mb")).cast("bigint").alias("sum"))
    )
    return both.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")


def _shared(sets: DataFrame) -> DataFrame:
    """`doc_id, shared`: how many of a document's shingles another document of `sets` has too."""
    each = sets.select("doc_id", F.explode("members").alias("member"))
    common = each.groupBy("member").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("member")
    return each.join(common, "member").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))


def _across(open_: DataFrame, planes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links `a, b` that join the components of open buckets; at most one per merge and task.

    Members that the bound allows a link are put together by the buckets they share, cut into
    blocks by hash, and two blocks are compared in one task.
    """
    marks = kept(open_.groupBy("doc_id").agg(F.min("component").alias("component")), "open-members")
    sets = _sets_of(docs, marks, size)
    able = kept(
        _shared(sets).join(marks, "doc_id").join(planes, "doc_id")
        .filter(F.col("shared") * 100 >= F.col("sig.n") * percent).select("doc_id", "component", "shared", "sig.*"),
        "able-members")
    inside = open_.join(able.select("doc_id"), "doc_id", "left_semi").select("band", "doc_id")
    first = inside.groupBy("band").agg(F.min("doc_id").alias("a"))
    family = parents(inside.join(first, "band").select("a", F.col("doc_id").alias("b")))
    members = kept(
        able.join(family.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id", "left")
        .withColumn("family", F.coalesce("family", "doc_id")), "families")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") * 8 / BLOCK_SET_BYTES)).cast("int")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("c"), blocks.alias("blocks")).filter("c > 1").drop("c")
    spread = (
        members.join(sizes, "family").join(sets, "doc_id")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    )
    return spread.groupBy("family", "low", "high").applyInPandas(_merge(percent), "a bigint, b bigint")


def _merge(percent: int):
    chance, planes = 2.0**-BITS, np.array(_PLANES).reshape(BITS, LONGS)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", ignore_index=True)
        x = group[group["block"] == key[1]]
        y = x if key[1] == key[2] else group[group["block"] == key[2]]
        apart = np.zeros((len(x), len(y)), dtype=np.int64)
        for i in range(LONGS):
            differ = np.zeros((len(x), len(y)), dtype=np.int64)
            for b in range(BITS):
                differ |= x[planes[b, i]].to_numpy()[:, None] ^ y[planes[b, i]].to_numpy()[None, :]
            apart += np.bitwise_count(differ.view(_U))
        n_x, n_y = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
        reach = np.minimum(x["shared"].to_numpy()[:, None], y["shared"].to_numpy()[None, :])
        reach = np.minimum(reach, np.minimum(n_x, n_y))
        likely = (1 - apart / SLOTS - chance) / (1 - chance)
        open_ = (likely >= percent / 100 - MARGIN) & (reach * 100 >= (n_x + n_y - reach) * percent)
        of_x, of_y = x["component"].to_numpy(), y["component"].to_numpy()
        i, j = np.nonzero(open_ & (of_x[:, None] != of_y[None, :]))
        order = np.argsort(-likely[i, j], kind="stable")
        ids_x, ids_y, sets_x, sets_y = (c.to_numpy() for c in (x["doc_id"], y["doc_id"], x["members"], y["members"]))
        above: dict[int, int] = {}

        def top(c: int) -> int:
            while c in above:
                c = above[c]
            return c

        out = []
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            p, q = top(of_x[a]), top(of_y[b])
            if p == q:
                continue
            both = len(np.intersect1d(sets_x[a], sets_y[b], assume_unique=True))
            if 100 * both >= percent * (len(sets_x[a]) + len(sets_y[b]) - both):
                above[max(p, q)] = min(p, q)
                out.append((ids_x[a], ids_y[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` for every row of `docs`.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. Documents link if
    their sets of distinct `size`-word shingles overlap by `percent` or more of the union;
    `component_id` is the smallest id reachable by links. A text with fewer words is one
    shingle. Null, empty and wordless texts have no shingle and link with nothing. Rows with
    the same id are one document: it links if any of its texts does, and every row comes back.
    A row without an id stands alone: component null, kept. Other columns are not read, so they may
    have any name. An empty table gives an empty result.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = kept(signatures(docs, size=size), "signatures")
    known = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))

    # One class per shingle set; its smallest id stands for it.
    row = F.struct(*_PLANES, "bands")
    reps = kept(
        known.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("doc_id"), F.min_by(row, "doc_id").alias("row"))
        .select("doc_id", "set_a", "set_b", "n", "row.*"), "classes")
    planes = reps.select("doc_id", F.struct("n", *_PLANES).alias("sig"))
    members = reps.select("doc_id", F.explode("bands").alias("band"))
    crowd = members.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("pivot")).filter("c > 1")
    buckets = kept(members.join(crowd, "band").select("band", "doc_id", "c", "pivot"), "buckets")

    star = _likely(buckets.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), planes, percent)
    links = _confirmed(star, _sets_of(docs, _ends(star), size), percent)
    # An id with several texts belongs to several classes and so links them.
    each = F.struct("set_a", "set_b", "n")
    repeated = known.groupBy("doc_id").agg(F.min(each).alias("x"), F.max(each).alias("y")).filter("x <> y").select("doc_id")
    if not repeated.isEmpty():
        texts_of = known.join(repeated, "doc_id").select(F.col("doc_id").alias("b"), "set_a", "set_b", "n").distinct()
        links = links.unionByName(texts_of.join(reps, ["set_a", "set_b", "n"]).select(F.col("doc_id").alias("a"), "b"))
    links = kept(links, "near-links")
    tops = parents(links)

    open_ = kept(_unsettled(buckets, tops), "open-buckets")
    if not open_.isEmpty():
        more = kept(_across(open_, planes, docs, size, percent), "merging-links")
        if not more.isEmpty():
            so_far = tops.select(F.col("node").alias("a"), F.col("component").alias("b"))
            tops = parents(so_far.unionByName(more))

    by_class = reps.join(tops.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "set_a", "set_b", "n", F.coalesce("component", "doc_id").alias("component_id"))
    of_id = F.coalesce("component_id", "doc_id")
    found = rows.join(by_class, ["set_a", "set_b", "n"], "left")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), of_id.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == of_id)).alias("kept"),
    )


def _likely(pairs: DataFrame, planes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs that pass the estimate on their signatures."""
    found = (
        pairs.filter("a <> b").distinct()
        .join(planes.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b")
        .join(planes.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a")
        .filter(_near("x", "y", percent)).select("a", "b")
    )
    return kept(found, "likely")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))


def _unsettled(buckets: DataFrame, tops: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, and a pair not yet compared."""
    marked = buckets.filter("c > 2").join(tops.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    mixed = marked.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return marked.join(mixed.filter("lo <> hi").select("band"), "band", "left_semi")
