"""Connected components of an edge table, with the edges never leaving Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from screenspark.llm.batches import map_batches
from screenspark.plans.staging import discard, stage


#: Edges of one block, which a task contracts by itself.
BLOCK_EDGES = 1_000_000
EDGES = StructType([StructField("u", LongType()), StructField("v", LongType())])


def contracted(edges: DataFrame, blocks: int) -> DataFrame:
    """The edges in blocks, each replaced by stars about the smallest nodes of what it connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts = [np.stack([b.column(c).to_numpy() for c in "uv"]) for b in batches if b.num_rows]
        if parts:
            ends = np.concatenate(parts, axis=1)
            nodes, place = np.unique(ends, return_inverse=True)
            place = place.reshape(ends.shape)
            forest = Forest(len(nodes))
            forest.link(place[0], place[1])
            child = np.flatnonzero(forest.label != np.arange(len(nodes)))
            yield {"u": nodes[child], "v": nodes[forest.label[child]]}

    return map_batches(edges.repartition(blocks), run, EDGES)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the star algorithm: link the neighbours of each node to the smallest of them.

    A large star does so for the greater neighbours, a small star for the lesser
    ones and the node itself.  Minima are combined before the shuffle, so a hub
    is never gathered in one place.
    """
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(low, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    out = out.filter("u <> v")
    return out if large else out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v): the smallest node that it reaches.

    Blocks of edges are contracted to stars first; one block is then done, and more
    are joined by large and small stars in turn until the edges no longer change.
    Every round is a table in the shared folder.  Loops may be given; an empty table
    gives an empty table.
    """
    given = stage(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v"), "edges")
    blocks = max(1, math.ceil(given.count() / BLOCK_EDGES))
    now = stage(contracted(given, blocks), "edges")
    discard(given)
    state = _state(now) if blocks > 1 else (0,)
    while state[0]:
        following = stage(_star(_star(now, True), False), "edges")
        after = _state(following)
        discard(now)
        now = following
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


class Forest:
    """Local components over positions 0..n-1; links come in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:  # shorten all paths to their roots
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
