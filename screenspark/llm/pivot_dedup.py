"""Embedding near-duplicates by a pivot-permutation index.

Each vector is described by its nearest pivots, in order.  Near vectors share
pivots: a pair is a candidate if at least two of the first pivots of both are the
same.  The inverted lists are kept by pairs of pivots, so that two members of one
list share two pivots at once; the count of shared pivots is taken from the
signatures, and a pair counts only in its first common list.

A list carries each vector as one byte a component with the length of what the
rounding lost, so a cosine is known within a bound.  Pairs that the bound decides
are counted where they meet; only those within it of the threshold are looked up and
verified on the vectors themselves, in double precision.

Equal vectors are one class before the search.  A list with many members is dealt
out as pairs of blocks of them, so no task holds a whole hot list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, ShortType, StructField, StructType

from screenspark.llm.batches import map_batches
from screenspark.llm.components import Forest, components
from screenspark.plans.staging import stage

#: Pivots are at most half of so many vectors, those with the smallest hashes.
PIVOT_SAMPLE = 8192
#: Members of one block of a list.
BLOCK = 2048
#: Tables of long lists, or of pairs to verify, of at most so many rows are broadcast.
BROADCAST_ROWS = 100_000
#: What single precision may add to the bound.
SINGLE = 1e-5


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of vectors that are neither null nor zero and have finite components only."""
    return vectors.select("vec_id", "embedding").filter(usable())


def usable() -> Column:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = matrix(column).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, pivots: int, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Unit vectors, far from each other (greedy k-centre over a bounded sample)."""
    rows = vectors.orderBy(F.xxhash64("embedding"), "vec_id").limit(sample).select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, best = [0], x @ x[0]
    while len(chosen) < min(pivots, len(x)):
        i = int(np.argmin(best))
        chosen.append(i)
        best = np.maximum(best, x @ x[i])
    return x[chosen]


def prefix_of(pivots: int, prefix: int = 5) -> int:
    """First pivots of a vector that count: one more for each eightfold of 64 pivots, so that recall holds."""
    return prefix + max(0, round(math.log2(max(1, pivots) / 64) / 3))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as signed bytes, the step of each row and the length of what is lost."""
    step = np.abs(x).max(axis=1) / 127
    q = np.rint(x / step[:, None]).astype(np.int8)
    step = step.astype(np.float32)
    return q, step, (np.linalg.norm(x - q * step.astype(np.float64)[:, None], axis=1) * (1 + 1e-6)).astype(np.float32)


def described(classes: DataFrame, d: int, pivots: np.ndarray, prefix: int) -> DataFrame:
    """``classes`` with ``sig`` (first pivots; none for vectors of another length than ``d``), ``q``, ``step`` and ``lost``."""
    names = classes.columns
    schema = StructType([*classes.schema, StructField("sig", ArrayType(ShortType())), StructField("q", BinaryType()), StructField("step", FloatType()), StructField("lost", FloatType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for size in np.unique(sizes):
                b = batch.filter(pa.array(sizes == size))
                x = unit_rows(b.column("embedding"))
                q, step, lost = rounded(x)
                sig = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16) if size == d else np.zeros((len(x), 0), np.int16)
                yield {c: b.column(c) for c in names} | {"sig": list(sig), "q": [r.tobytes() for r in q], "step": step, "lost": lost}

    return map_batches(classes, run, schema)


def pivot_cells(indexed: DataFrame, width: int, prefix: int, block: int) -> DataFrame:
    """Entries of all lists by ``list, lo, hi``: a list, or two blocks of a long one; vectors of rarer lengths are a list for each length."""
    prefix = min(prefix, width)
    if width >= 2:
        pairs = F.array(*((F.least(F.col("sig")[i], F.col("sig")[j]).cast("int") * width + F.greatest(F.col("sig")[i], F.col("sig")[j])) for i in range(prefix) for j in range(i)))
    else:
        pairs = F.array(F.lit(0))
    lists = F.when(F.size("sig") > 0, pairs).otherwise(F.array(-F.col("d")))
    entries = indexed.select(F.explode(lists).alias("list"), "rep", "n", "sig", "q", "step", "lost")
    hot = stage(entries.groupBy("list").count().filter(F.col("count") > block).select("list", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot")
    entries = entries.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, "list", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    entries = entries.withColumn("mine", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return entries.select("list", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "rep", "n", "sig", "q", "step", "lost")


def cell_links(table: pa.Table, threshold: float, width: int, shared: int) -> dict:
    """Of the pairs of each cell: a spanning forest and counts of those surely near, and those to verify (``links`` is null)."""
    rep, n, mine, lists = (table.column(c).to_numpy() for c in ("rep", "n", "mine", "list"))
    step, lost = table.column("step").to_numpy(), table.column("lost").to_numpy().astype(np.float64)
    raw, sigs = table.column("q").to_pylist(), table.column("sig").combine_chunks()
    cell = np.stack([lists, table.column("lo").to_numpy(), table.column("hi").to_numpy()])
    first = np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(axis=0)))
    links, forest, doubt = np.zeros(len(rep), np.int64), Forest(len(rep)), []
    for a, b in zip(first.tolist(), np.append(first[1:], len(rep)).tolist(), strict=True):
        if b - a < 2:
            continue
        x = np.frombuffer(b"".join(raw[a:b]), np.int8).reshape(b - a, -1) * step[a:b, None]
        cross = cell[1, a] != cell[2, a]
        left = np.flatnonzero(mine[a:b] == cell[1, a])
        right = np.flatnonzero(mine[a:b] == cell[2, a]) if cross else left
        sig = np.sort(matrix(sigs.slice(a, b - a)), axis=1) if lists[a] >= 0 and width >= 2 else None
        most = float(lost[a:b].max())
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            cos = x[rows] @ x[right].T
            i, j = np.nonzero(cos >= threshold - 2 * most - most * most - SINGLE)
            cos = cos[i, j].astype(np.float64)
            i, j = rows[i], right[j]
            bound = lost[a + i] + lost[a + j] + lost[a + i] * lost[a + j] + SINGLE
            keep = cos >= threshold - bound
            if not cross:
                keep &= i < j
            i, j, sure = i[keep], j[keep], (cos >= threshold + bound)[keep]
            for k in range(0, len(i), 200_000):
                p, q, s = i[k : k + 200_000], j[k : k + 200_000], sure[k : k + 200_000]
                if sig is not None:  # shared pivots: the pair belongs to the list of the two smallest
                    both = (sig[p][:, :, None] == sig[q][:, None, :]).any(axis=2)
                    head = np.argsort(~both, axis=1, kind="stable")[:, :2]
                    key = sig[p][np.arange(len(p))[:, None], head].astype(np.int64)
                    own = (both.sum(axis=1) >= shared) & (key[:, 0] * width + key[:, 1] == lists[a])
                    p, q, s = p[own], q[own], s[own]
                doubt.append(np.stack([rep[a + p[~s]], rep[a + q[~s]]]))
                p, q = a + p[s], a + q[s]
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                forest.link(p, q)
    some = np.flatnonzero(links)
    u, v = np.concatenate(doubt, axis=1) if doubt else np.zeros((2, 0), np.int64)
    counts = pa.concat_arrays([pa.array(links[some]), pa.nulls(len(u), pa.int64())])
    return {"u": np.append(rep[some], u), "v": np.append(rep[forest.label[some]], v), "links": counts}


def pivot_links(indexed: DataFrame, width: int, threshold: float, prefix: int, shared: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Edges that connect the classes, and the number of vectors linked to each, from what :func:`described` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 20_000:
                table = pa.Table.from_batches(held).combine_chunks()
                same = np.logical_and.reduce([table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in ("list", "lo", "hi")])
                cut = int(np.argmax(same))  # the last cell may go on
                if cut:
                    yield cell_links(table.slice(0, cut).combine_chunks(), threshold, width, shared)
                held = table.slice(cut).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield cell_links(pa.Table.from_batches(held).combine_chunks(), threshold, width, shared)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            d = b.column("d").to_numpy()
            for size in np.unique(d):
                part = b.filter(pa.array(d == size))
                near = np.einsum("ij,ij->i", unit_rows(part.column("x_u")), unit_rows(part.column("x_v"))) >= threshold
                yield {c: part.column(c).filter(pa.array(near)) for c in ("u", "v", "n_u", "n_v")}

    found = StructType([StructField("u", LongType()), StructField("v", LongType()), StructField("links", LongType())])
    cells = pivot_cells(indexed, width, prefix, block).repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi")
    out = stage(map_batches(cells, run, found), "links")
    doubt = out.filter("links IS NULL").select("u", "v")
    vectors = indexed.select("rep", "n", "d", "embedding")
    if doubt.count() <= BROADCAST_ROWS:
        ends = doubt.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
        vectors = vectors.join(F.broadcast(ends), "rep", "left_semi")
    sides = [vectors.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("embedding").alias(f"x_{c}"), *(["d"] if c == "u" else [])) for c in "uv"]
    kept = StructType([StructField(c, LongType()) for c in ("u", "v", "n_u", "n_v")])
    near = stage(map_batches(doubt.join(sides[0], "u").join(sides[1], "v").select("u", "v", "n_u", "n_v", "d", "x_u", "x_v"), verify, kept), "near")
    sure = out.filter("links IS NOT NULL")
    counts = sure.select(F.col("u").alias("rep"), "links").unionByName(near.select(F.col("u").alias("rep"), F.col("n_v").alias("links"))).unionByName(near.select(F.col("v").alias("rep"), F.col("n_u").alias("links")))
    return sure.select("u", "v").unionByName(near.select("u", "v")), counts.groupBy("rep").agg(F.sum("links").alias("links"))


def embedding_components(vectors: DataFrame, threshold: float = 0.95, pivots: int = 64, prefix: int = 5, shared: int = 2, block: int = BLOCK) -> DataFrame:
    """Near-duplicate classes of all rows of ``vectors`` (vec_id, embedding).

    Returns ``vec_id, n_links, component_id, kept``.  Vectors that are null, zero
    or hold null or non-finite components link with nothing; vectors of different
    lengths do not link either, and those of rarer lengths are compared with each
    other in blocks.  Equal vectors link with each other; repeated ids are vectors of
    their own; a null vec_id is never the smallest.  The number of pivots grows with
    the square root of the table from ``pivots`` on, which keeps the lists short, and
    the ``prefix`` with it, which keeps the recall.  An empty table gives no rows;
    other columns are not read.
    """
    base = vectors.select("vec_id", "embedding")
    good = usable_vectors(base).withColumn("d", F.size("embedding"))
    usual = good.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    plain = F.transform("embedding", lambda x: x + F.lit(0.0))  # one zero only
    keys = ["k1", "k2"]
    keyed = good.withColumn("k1", F.xxhash64(plain)).withColumn("k2", F.xxhash64(F.lit(1), plain))
    classes = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("d").alias("d"), F.first("embedding").alias("embedding"))
    classes = classes.withColumn("rep", F.monotonically_increasing_id())
    if usual:
        count = max(pivots, int(2 ** math.ceil(math.log2(max(1.0, math.sqrt(usual["count"]) / 2)))))
        chosen = choose_pivots(good.filter(F.col("d") == usual["d"]), min(count, max(pivots, PIVOT_SAMPLE // 2)))
        first = prefix_of(len(chosen), prefix)
        indexed = stage(described(classes, usual["d"], chosen, min(first, len(chosen))), "classes")
        edges, links = pivot_links(indexed, len(chosen), threshold, first, shared, block)
        roots = components(edges).select(F.col("node").alias("rep"), "root")
        classed = indexed.select(*keys, "rep", "n", "low").join(roots, "rep", "left").join(links, "rep", "left")
    else:
        classed = classes.select(*keys, "rep", "n", "low").withColumn("root", F.lit(None).cast("long")).withColumn("links", F.lit(None).cast("long"))
    classed = classed.withColumn("root", F.coalesce("root", "rep")).withColumn("n_links", F.col("n") - 1 + F.coalesce("links", F.lit(0)))
    lows = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    found = keyed.select("vec_id", *keys).join(classed.join(lows, "root").select(*keys, "n_links", "component_id"), keys).select("vec_id", "n_links", "component_id")
    rest = base.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
