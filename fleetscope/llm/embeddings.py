"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors whose cosine reaches ``threshold`` are at most epsilon apart. Vectors are sorted by
their grid cells of width epsilon on the leading principal axes; any orthogonal axes give the
same result, principal ones let more be skipped. The sorted sequence is cut into
blocks. Pairs of blocks that touch in every leading cell are joined by recursion on
halves of both sequence intervals: intervals more than a cell apart on an axis are
skipped, short ones are compared in double precision.

Equal vectors take part as one. A pair of blocks gives link counts and one edge per
vector to the smallest vector it hangs together with there, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Axes of the grid, axes whose cells are join keys, vectors in a block and in a leaf of the recursion.
AXES, KEY_AXES, BLOCK, LEAF = 6, 2, 512, 64
#: Vectors the axes are fitted on: those with the smallest hash. The axes change no result.
SAMPLE = 10_000


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def principal_axes(sample: np.ndarray, axes: int = AXES) -> np.ndarray:
    """``dimension x axes`` orthonormal columns of largest variance."""
    _, vectors = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(sample.shape[1], -1)) if len(sample) > 1 else (None, np.eye(sample.shape[1]))
    return vectors[:, ::-1][:, :axes]


def _fit(classes: DataFrame) -> dict[int, np.ndarray]:
    sample = classes.orderBy(F.xxhash64("embedding"), "rep").limit(SAMPLE).select("embedding").collect()
    by_size: dict[int, list] = {}
    for (v,) in sample:
        by_size.setdefault(len(v), []).append(v)
    return {d: principal_axes(_unit(np.array(vs, np.float64))) for d, vs in by_size.items()}


def _cells(vectors: np.ndarray, axes: np.ndarray, epsilon: float) -> np.ndarray:
    cells = np.zeros((len(vectors), AXES), np.int64)
    cells[:, : axes.shape[1]] = np.floor(_unit(vectors) @ axes / epsilon)
    return cells


def _leaf_pairs(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, threshold: float, linked: np.ndarray) -> None:
    """Marks linked pairs of two intervals of the sequence; recursive."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        x, y = ca[i:j], cb[k:m]
        if (x.min(0) > y.max(0) + 1).any() or (y.min(0) > x.max(0) + 1).any():
            continue
        if j - i <= LEAF and m - k <= LEAF:
            linked[i:j, k:m] = a[i:j] @ b[k:m].T >= threshold
            continue
        left = [(i, j)] if j - i <= LEAF else [(i, (i + j) // 2), ((i + j) // 2, j)]
        right = [(k, m)] if m - k <= LEAF else [(k, (k + m) // 2), ((k + m) // 2, m)]
        stack += [(*p, *q) for p in left for q in right]


def _local_components(linked: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest vector that each row and column hangs together with through ``linked``."""
    la, lb, most = ra.copy(), rb.copy(), np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], most).min(1, initial=most))
        nb = np.minimum(lb, np.where(linked, na[:, None], most).min(0, initial=most))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def link_vectors(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors are compared if their labels are equal and not null and they have one length. Null, empty
    and zero vectors, vectors with null or non-finite components, and rows with a null id link
    with nothing: 0 links, their own component (null for a null id). Repeated rows are
    vectors of their own. Extra columns are dropped.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding"), F.col(label_column).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.filter(usable)
    # A class is a label and a vector with a number of its own: an id may stand on several vectors.
    classes = valid.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    axes = _fit(classes)
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9)
    cell_names = [f"c{k}" for k in range(AXES)]
    label_kind = classes.schema["label"].dataType.simpleString()
    base = ["label", "rep", "copies", "embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(3).to_pylist()
            cells = np.zeros((len(values), AXES), np.int64)
            sizes = np.array([len(v) for v in values], np.int64)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                cells[at] = _cells(np.array([values[i] for i in at], np.float64), axes.get(int(d), np.eye(int(d))[:, :AXES]), epsilon)
            packed = pa.array([np.asarray(v, "<f8").tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes), packed, *(pa.array(cells[:, k]) for k in range(AXES))],
                ["label", "rep", "copies", "size", "vector", *cell_names],
            )

    placed = classes.select(*base).mapInArrow(
        place, f"label {label_kind}, rep bigint, copies bigint, size bigint, vector binary, " + ", ".join(f"{c} bigint" for c in cell_names)
    )
    order = ["label", "size", *cell_names, "rep"]
    block_kinds = f"block bigint, label {label_kind}, size bigint, lo array<bigint>, hi array<bigint>, reps binary, copies binary, cells binary, vectors binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, group = TaskContext.get().partitionId() << 32, [], None

        def row() -> dict:
            cells = np.array([[r[c] for c in cell_names] for r in held], np.int64)
            return {
                "block": block, "label": group[0], "size": group[1], "lo": cells.min(0).tolist(), "hi": cells.max(0).tolist(),
                "reps": np.array([r["rep"] for r in held], "<i8").tobytes(), "copies": np.array([r["copies"] for r in held], "<i8").tobytes(),
                "cells": cells.tobytes(), "vectors": b"".join(r["vector"] for r in held),
            }

        for batch in batches:
            kinds = pa.schema([("block", pa.int64()), ("label", batch.schema.field("label").type), ("size", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("reps", "copies", "cells", "vectors"))])
            for r in batch.to_pylist():
                if held and (len(held) >= BLOCK or group != (r["label"], r["size"])):
                    yield pa.RecordBatch.from_pylist([row()], schema=kinds)
                    block, held = block + 1, []
                group = (r["label"], r["size"])
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pylist([row()], schema=kinds)

    blocks = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, block_kinds), "blocks")

    slabs = blocks.select("block", "label", "size", "lo", "hi")
    for side, reach in (("own", 0), ("near", 1)):
        named = slabs
        for k in range(KEY_AXES):
            named = named.withColumn(f"k{k}", F.explode(F.sequence(F.col("lo")[k] - reach, F.col("hi")[k] + reach)))
        slabs_of = named.select("label", "size", *(f"k{k}" for k in range(KEY_AXES)), F.col("block").alias("a" if side == "own" else "b"), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi"))
        pairs = slabs_of if side == "own" else pairs.join(slabs_of, ["label", "size", *(f"k{k}" for k in range(KEY_AXES))])
    touching = F.col("a") <= F.col("b")
    for k in range(AXES):
        touching = touching & (F.col("own_lo")[k] <= F.col("near_hi")[k] + 1) & (F.col("near_lo")[k] <= F.col("own_hi")[k] + 1)
    pairs = pairs.filter(touching).select("a", "b").distinct()
    payload = ["size", "reps", "copies", "cells", "vectors"]
    left = blocks.select(F.col("block").alias("a"), *payload)
    right = blocks.select(F.col("block").alias("b"), *(F.col(c).alias(f"b_{c}") for c in payload[1:]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                reps = [np.frombuffer(r[n], "<i8") for n in ("reps", "b_reps")]
                copies = [np.frombuffer(r[n], "<i8") for n in ("copies", "b_copies")]
                cells = [np.frombuffer(r[n], np.int64).reshape(-1, AXES) for n in ("cells", "b_cells")]
                units = [_unit(np.frombuffer(r[n], "<f8").reshape(-1, r["size"])) for n in ("vectors", "b_vectors")]
                linked = np.zeros((len(reps[0]), len(reps[1])), bool)
                _leaf_pairs(*units, *cells, threshold, linked)
                if r["a"] == r["b"]:
                    np.fill_diagonal(linked, False)
                near = _local_components(linked, *reps)
                counts = [linked @ copies[1], np.zeros(0) if r["a"] == r["b"] else linked.T @ copies[0]]
                for side in (0, 1) if r["a"] != r["b"] else (0,):
                    some = counts[side] > 0
                    if some.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reps[side][some]), pa.array(counts[side][some].astype(np.int64)), pa.array(near[side][some])], ["rep", "links", "least"]
                        )

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", *payload, *(f"b_{c}" for c in payload[1:]))
    found = stored(joined.mapInArrow(join, "rep bigint, links bigint, least bigint"), "vector-links")
    labels = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "embedding", "least_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    smallest = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = known.join(smallest, "component").select("label", "embedding", "n_links", "component_id")
    # One row per vector on the right: adaptive execution can split a vector that is everywhere.
    linked_rows = valid.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("component_id") == F.col("vec_id"))
