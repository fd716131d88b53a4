"""Connected components by alternating stars: ``node, component`` with the smallest reachable node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, measured

#: Edges that a task joins into stars at a time; so many at most are joined by one task alone.
EDGES = 1 << 18
STARS = "a bigint, b bigint, lot bigint"


def _stars(a: np.ndarray, b: np.ndarray, roots: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest of its component, with that; with ``roots`` the smallest too."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        mine, other = label[left], label[right]
        low = np.minimum(mine, other)
        if (mine == other).all():
            break
        np.minimum.at(label, np.maximum(mine, other), low)
        while (label[label] != label).any():
            label = label[label]
    out = np.arange(len(nodes)) if roots else np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def _contracted(edges: DataFrame, most: int, roots: bool = False) -> DataFrame:
    """Stars of up to ``most`` edges of a task at a time, with a ``lot`` of their own; with ``roots`` their centres too."""

    def joined(held: list[pa.RecordBatch], lot: int) -> pa.RecordBatch:
        a, b = _stars(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2)), roots)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), lot))], ["a", "b", "lot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                if n + part.num_rows > most and n:
                    yield joined(held, lot)
                    lot, held, n = lot + 1, [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield joined(held, lot)

    return edges.mapInArrow(run, STARS)


def _edges(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))


def _of_one_lot(edges: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Components, stored and counted, of up to ``most`` edges, by one task and without an exchange."""
    labels = _contracted(edges.coalesce(1), most, roots=True)
    return counted(labels.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")


def counted_components(edges: DataFrame, n: int, most: int = EDGES) -> tuple[DataFrame, int]:
    """Components of ``n`` edges, and a bound of their rows: as ``components``, but a lot needs no look at the edges first."""
    return _of_one_lot(_edges(edges), most) if n <= most else (components(edges, most), 2 * n)


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """Components of undirected ``a, b``. Nodes without an edge to another node get no row.

    Tasks first join what edges they have into stars, once as they are and once dealt by the larger end, of which
    each has one row then. If all stars are of one lot of edges, they are the components; up to ``most`` stars of several
    lots are joined as one more. Else, a large-star step
    hangs the larger neighbours of a node on its smallest one, a
    small-star step the smaller ones; the number of rounds is logarithmic in
    practice. Each round is stored in the shared folder. The joins have one row per
    key on one side, so adaptive execution can split a hub's rows.
    """
    pairs = _contracted(_edges(edges), most)
    state = {"n": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    pairs = _contracted(pairs.select("a", "b").repartition("a"), most)
    current, before = measured(pairs, "edges", **state, first=F.min("lot"), last=F.max("lot"))
    current, done = current.select("a", "b"), before.pop("first") == before.pop("last")
    if not done and before["n"] <= most:
        return _of_one_lot(current, most)[0]
    while not done:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every edge now points to a smaller node; its smallest target is the next root.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        current, after = measured(hung.filter("a <> b").distinct(), "edges", **state)
        done, before = after == before, after
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
