"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them.

Equal vectors are one class first, so a group of copies costs one vector however large it is.
Centroids are fitted on a bounded sample; every vector is assigned: it lives in its nearest cell
and visits each cell of a smaller number that may be home to a vector as close as asked, so no
pair is lost and each meets once. A vector at home nearer to c than to h lies beyond the plane
between the two centroids; a vector y of h is at an angle of asin(y . (h - c) / |h - c|) to that
plane, so cells whose plane is farther than the angle asked for are left out, and only those.
Residents and visitors of a cell are cut into blocks by hash, and a task compares two blocks with
one matrix product. It returns counts and one link per vector that keeps the blocks' linked groups
together, never the pairs.

Clustered vectors visit few cells. Vectors without clusters visit nearly all, and every pair of
blocks is compared then. Cells number at most `CELLS`, so beyond some millions of classes they
grow, and with them the blocks to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.graph import components
from labelscope.llm.stages import in_arrow, kept
from labelscope.session import ship_package

CELLS, CELL_ROWS = 4_096, 3_200
#: Vectors, and bytes of them, the centroids are fitted on; all vectors are assigned.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 1 << 25
BLOCK, STRIPE = 8_192, 512  # vectors of a block; rows of a product taken at a time
SLACK = 1e-7  # far above the rounding of the products that decide on visits


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit vectors; starts from evenly spread rows, empty cells keep theirs."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
    return centres


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length 1; scaled by the largest component first, so that squares neither
    overflow nor vanish."""
    for batch in batches:
        offsets = batch.column(1).offsets.to_numpy()
        flat = batch.column(1).values.to_numpy(zero_copy_only=False).copy()
        for a, b in zip(offsets, offsets[1:]):
            flat[a:b] /= np.abs(flat[a:b]).max()
            flat[a:b] /= np.sqrt((flat[a:b] * flat[a:b]).sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(batch.column(1).offsets, pa.array(flat))],
                                         names=["vec_id", "unit"])


def _cells(centres: np.ndarray, least: float):
    # Sine of the angle asked for; from 90 degrees on nothing can be left out.
    reach = np.sqrt(max(0.0, 1.0 - least * least)) if least > 0 else np.inf
    numbers = np.arange(len(centres))

    def run(frames):
        square = (centres * centres).sum(axis=1)
        for frame in frames:
            for at in range(0, len(frame), 1_024):
                part = frame.iloc[at : at + 1_024].copy()
                sims = np.stack(part["unit"].to_numpy()) @ centres.T
                home = sims.argmax(axis=1)
                beyond = sims[np.arange(len(part)), home][:, None] - sims
                apart = square[home][:, None] + square[None, :] - 2 * (centres[home] @ centres.T)
                visits = (beyond <= reach * np.sqrt(np.maximum(apart, 0.0)) + SLACK) | (reach == np.inf)
                visits &= numbers[None, :] < home[:, None]
                part["home"] = home.astype(np.int32)
                part["visits"] = [np.flatnonzero(v).astype(np.int32) for v in visits]
                yield part

    return run


def _block_links(least: float):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        low, high, guests = key[1:]
        group = group.sort_values("vec_id", ignore_index=True)
        if guests:
            a, b = group[~group["guest"]], group[group["guest"]]
        else:
            a = group[group["block"] == low]
            b = a if low == high else group[group["block"] == high]
        empty = pd.DataFrame({"vec_id": [], "n": [], "label": []}).astype("int64")
        if not len(a) or not len(b):
            return empty
        x, y = np.stack(a["unit"].to_numpy()), np.stack(b["unit"].to_numpy())
        ids_a, ids_b = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        linked = np.empty((len(a), len(b)), dtype=bool)
        stripes = [slice(i, i + STRIPE) for i in range(0, len(a), STRIPE)]
        for rows in stripes:
            linked[rows] = (x[rows] @ y.T >= least) & (ids_a[rows, None] != ids_b[None, :])
        # Vectors without a link in these blocks need no label.
        some_a, some_b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(some_a):
            return empty
        linked = linked[np.ix_(some_a, some_b)]
        a, b, ids_a, ids_b = a.iloc[some_a], b.iloc[some_b], ids_a[some_a], ids_b[some_b]
        stripes = [slice(i, i + STRIPE) for i in range(0, len(a), STRIPE)]
        label_a, label_b, top = ids_a.copy(), ids_b.copy(), np.iinfo(np.int64).max
        while True:  # smallest id over linked rows, back and forth until nothing changes
            new_a, new_b = label_a.copy(), label_b.copy()
            for rows in stripes:
                new_b = np.minimum(new_b, np.where(linked[rows], label_a[rows, None], top).min(axis=0))
            for rows in stripes:
                new_a[rows] = np.minimum(new_a[rows], np.where(linked[rows], new_b[None, :], top).min(axis=1))
            if (new_a == label_a).all() and (new_b == label_b).all():
                break
            label_a, label_b = new_a, new_b
        out = [pd.DataFrame({"vec_id": ids_a, "n": linked @ b["copies"].to_numpy(), "label": label_a})]
        if guests or low != high:
            out.append(pd.DataFrame({"vec_id": ids_b, "n": a["copies"].to_numpy() @ linked, "label": label_b}))
        made = pd.concat(out, ignore_index=True)
        return made[made["n"] > 0].astype("int64")

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """`vec_id, n_links, component_id, kept` of every row.

    Cosines are taken in double precision. `n_links` counts the other rows linked directly,
    copies included. Vectors that are null, empty, zero or hold null, NaN or infinite components
    link with nothing; vectors of different lengths do not link. Rows with the same id count as
    separate rows of one id. A row without an id stands alone: component null, kept. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & usable & F.exists("v", lambda x: x != 0)
    units = in_arrow(rows.filter(whole), _units, "vec_id bigint, unit array<double>")
    units = kept(units.withColumns({"h": F.xxhash64("unit"), "g": F.xxhash64(F.lit(1), "unit")}), "units")
    classes = kept(units.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    reps = units.join(classes.select(F.col("rep").alias("vec_id"), "h", "g", "copies"), ["vec_id", "h", "g"]).dropDuplicates(["vec_id", "h", "g"])
    links = None
    for (dim,) in units.select(F.size("unit")).distinct().collect():  # nearly always one length
        found = _linked(reps.filter(F.size("unit") == dim).select("vec_id", "copies", "unit"), dim, least)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "vec_id bigint, n bigint, label bigint")
    links = kept(links, "vector-links")
    tops = components(links.select(F.col("vec_id").alias("a"), F.col("label").alias("b")))
    counts = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
    of_class = (
        classes.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left")
        .join(tops.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h", "g", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    known = units.select("vec_id", "h", "g").join(of_class, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(whole, F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(reps: DataFrame, dim: int, least: float) -> DataFrame:
    """`vec_id, n, label` of linked class representatives, one row per block pair they link in."""
    n = reps.count()
    chosen = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(
        max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))).select("unit").toPandas()
    sample = np.stack(chosen["unit"].to_numpy())
    centres = spherical_kmeans(sample, int(min(CELLS, len(sample), max(1, n // CELL_ROWS))))
    schema = "vec_id bigint, copies bigint, unit array<double>, home int, visits array<int>"
    placed = kept(reps.mapInPandas(_cells(centres, least), schema), "cells")
    residents = placed.select(F.col("home").alias("cell"), F.lit(False).alias("guest"), "vec_id", "copies", "unit")
    visitors = placed.select(F.explode("visits").alias("cell"), F.lit(True).alias("guest"), "vec_id", "copies", "unit")
    blocks = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    # One row per cell: CELLS at most. A cell without residents has nothing to compare.
    sizes = F.broadcast(blocks(residents, "homes").join(blocks(visitors, "calls"), "cell", "left").na.fill(0, ["calls"]))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cell", "low", "high", "guests", "vec_id", "copies", "unit", "guest", "block"]
    at_home = residents.join(sizes, "cell").withColumn("block", place("homes"))
    inside = (
        at_home.withColumn("other", up_to("homes")).withColumn("guests", F.lit(False))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select(columns)
    )
    hosts = (
        at_home.filter("calls > 0").withColumn("high", up_to("calls"))
        .withColumns({"low": F.col("block"), "guests": F.lit(True)}).select(columns)
    )
    guests = (
        visitors.join(sizes, "cell").withColumn("block", place("calls")).withColumn("low", up_to("homes"))
        .withColumns({"high": F.col("block"), "guests": F.lit(True)}).select(columns)
    )
    spread = inside.unionByName(hosts).unionByName(guests)
    return spread.groupBy("cell", "low", "high", "guests").applyInPandas(
        _block_links(least), "vec_id bigint, n bigint, label bigint")
