"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs after several rotations, each learned on a
bounded sample by alternating codes and rotations (the quantisation error never
grows).  A code is split into 16-bit substrings, each of which has an inverted
index.  Two codes within radius r agree in some substring up to floor(r / m) bits
(m substrings), so probing the buckets up to that reach in every index finds every
code within the radius.  Only codes found by a probe are looked at: their bits are
compared, and those near enough are reranked by the inner products of the original
vectors, in double precision.  With ``recall`` 1 nothing is left to chance: every code
is reranked, and the answer is exact.

Inner products are angles first: each candidate gets a coordinate
sqrt(max_norm^2 - norm^2) and each query a zero there, so that the greatest inner
product is the least angle, whatever the norms.

Queries in blocks meet shards of the index; every task returns the best of its
cell, and the best over the shards are kept.  A query's reach grows bit by bit: the
angle of its k-th score gives the chance that a neighbour at this angle lies in a
probed bucket, and the probing ends once it is ``recall`` (nearer ones are found more
surely).  Where a reach would meet over half of all codes (neighbours near a right
angle, or few vectors), all codes of the shard are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from screenspark.llm.batches import as_array, map_batches
from screenspark.llm.pivot_dedup import matrix, usable_vectors
from screenspark.plans.staging import stage

#: Vectors that the rotations are learned from, those with the smallest hashes.
LEARN_SAMPLE = 8192
SHARD_ROWS = 65_536
QUERY_ROWS = 8192
#: Blocks of queries are smaller in small tables, so that there are so many, of so many queries at least.
BLOCKS, SMALL_BLOCK = 12, 128
SUB = 16
#: Chance at which a neighbour at the angle of the k-th score must be in a probed bucket.
RECALL = 0.95
#: Standard deviations of the bits in which two vectors of one angle differ, beyond their mean.
MARGIN = 2.5


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms of rows, without overflow of the squares."""
    top = np.abs(x).max(axis=1)
    return top * np.linalg.norm(x / np.where(top > 0, top, 1.0)[:, None], axis=1)


def greatest_norm(vectors: DataFrame) -> float:
    """The greatest norm of usable vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            if b.num_rows:
                yield {"norm": [float(lengths(matrix(b.column("embedding")).astype(np.float64)).max())]}

    return map_batches(vectors.select("embedding"), run, StructType([StructField("norm", DoubleType())])).agg(F.max("norm")).first()[0]


def as_candidates(x: np.ndarray, max_norm: float) -> np.ndarray:
    """Unit rows whose angles to queries order the inner products."""
    y = x / max_norm
    return np.concatenate([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1)))[:, None]], axis=1)


def as_queries(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x / lengths(x)[:, None], np.zeros((len(x), 1))], axis=1)


def angle_share(score: float, norm: float, max_norm: float) -> float:
    """The share of bits in which codes at the angle of a score differ."""
    return math.acos(max(-1.0, min(1.0, score / norm / max_norm))) / math.pi


def needed_radius(p: float, bits: int, margin: float = MARGIN) -> int:
    """Bits within which the codes at an angle lie, with the margin."""
    return min(bits, math.ceil(bits * p + margin * math.sqrt(bits * p * (1 - p))))


def found_share(p: float, reach: int, substrings: int) -> float:
    """The chance that codes that differ in a share ``p`` of bits agree in some substring up to ``reach`` bits."""
    one = sum(math.comb(SUB, i) * p**i * (1 - p) ** (SUB - i) for i in range(reach + 1))
    return 1 - (1 - min(1.0, one)) ** substrings


def learn_rotations(vectors: DataFrame, bits: int, max_norm: float, sample: int = LEARN_SAMPLE, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Directions (d x bits) whose signs are the code."""
    rows = vectors.orderBy(F.xxhash64("embedding"), "vec_id").limit(sample).select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float64)
    x = as_candidates(x, max_norm)
    rng = np.random.default_rng(seed)
    parts, d = [], x.shape[1]
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            code = np.where(x @ turn > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(x.T @ code)
            turn = u @ vt
        parts.append(turn)
    return np.concatenate(parts, axis=1)[:, :bits]


class SubstringIndex:
    """Inverted lists of a set of codes (n x bytes), one index for each substring."""

    def __init__(self, codes: np.ndarray):
        self.words, sub = codes.view(np.uint64), codes.view(np.uint16)
        self.n, self.m = sub.shape
        self.order = np.concatenate([np.argsort(c, kind="stable") for c in sub.T]) if self.m else np.zeros(0, np.int64)
        sizes = np.stack([np.bincount(c, minlength=1 << SUB) for c in sub.T]) if self.m else np.zeros((0, 1 << SUB), np.int64)
        self.starts = np.append(0, np.cumsum(sizes.ravel()))
        self.offset = np.arange(self.m)[:, None] << SUB

    def probe(self, code: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Positions of codes in the buckets that differ from a code's substrings by one of the masks; they may repeat."""
        bucket = ((code.view(np.uint16)[:, None] ^ masks).astype(np.int64) + self.offset).ravel()
        lo = self.starts[bucket]
        n = self.starts[bucket + 1] - lo
        lo, n = lo[n > 0], n[n > 0]
        stop = np.cumsum(n)
        return self.order[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(lo - (stop - n), n)]

    def apart(self, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Bits in which a code differs from those at ``rows``."""
        return np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


_ALL = np.arange(1 << SUB, dtype=np.uint16)
#: Masks by their number of bits.
SHELLS = [_ALL[np.bitwise_count(_ALL) == e] for e in range(SUB + 1)]


def best_codes(index: SubstringIndex, code: np.ndarray, query: np.ndarray, x: np.ndarray, own: int, k: int, norm: float, max_norm: float, recall: float = RECALL, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, float]:
    """Positions of candidates among which the k best of a query are, their scores, and the share of codes that were looked at.

    ``own`` is the position of the query itself, -1 if it is not in this index.
    """
    bits, met, rows, apart = SUB * index.m, np.zeros(index.n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    others = index.n - (own >= 0)
    if own >= 0:
        met[own] = True
    if recall >= 1:
        rows = np.flatnonzero(~met)
        return rows, x[rows] @ query, 1.0
    for reach in range(SUB + 1):
        everything = not index.m or found_share(0.5, reach, index.m) > 0.5
        met_before = met.copy()
        if everything:
            met[:] = True
        else:
            met[index.probe(code, SHELLS[reach])] = True
        new = np.flatnonzero(met & ~met_before)
        rows, apart = np.append(rows, new), np.append(apart, index.apart(code, new))
        if len(rows) == others <= k:
            return rows, x[rows] @ query, 1.0
        if len(rows) <= k:
            continue
        near = np.argpartition(apart, k - 1)[:k]
        p = angle_share(float((x[rows[near]] @ query).min()), norm, max_norm)
        some = rows[apart <= max(needed_radius(p, bits, margin), int(apart[near].max()))]
        score = x[some] @ query
        p = angle_share(float(np.partition(score, len(score) - k)[len(score) - k]), norm, max_norm)
        if everything or found_share(p, reach, index.m) >= recall:
            return some, score, len(rows) / max(1, others)
    return rows, x[rows] @ query, 1.0


def search_cell(table: pa.Table, k: int, max_norm: float, recall: float = RECALL, margin: float = MARGIN) -> dict:
    """The k best of one shard for each query of one block; ids stay whole numbers with their nulls beside them."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    rows, x = table.column("row").to_numpy(), matrix(table.column("embedding")).astype(np.float64)
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)  # of no bytes: vectors that are compared whole
    q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
    out: dict = {"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": [], "probed": []}
    if not len(q) or not len(c):
        return out
    ids = table.column("vec_id").cast(pa.int64()).combine_chunks()
    null, tie = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()  # never as floats: ids may have 64 bits
    norm = lengths(x[q])
    index, y = SubstringIndex(np.ascontiguousarray(codes[c])), np.ascontiguousarray(x[c])
    place = {int(r): i for i, r in enumerate(rows[c])}
    for i, n in zip(q.tolist(), norm.tolist(), strict=True):
        some, score, share = best_codes(index, np.ascontiguousarray(codes[i]), x[i], y, place.get(int(rows[i]), -1), k, n, max_norm, recall, margin)
        j = c[some]
        score = np.einsum("j,ij->i", x[i], x[j]) if len(j) <= k else score
        best = np.lexsort((rows[j], tie[j], null[j], -score))[:k]
        j = j[best]
        score = np.einsum("j,ij->i", x[i], x[j])
        for name, values in (("query_row", np.full(len(j), rows[i])), ("query_id", np.full(len(j), i)), ("row", rows[j]), ("vec_id", j), ("score", score), ("probed", np.full(len(j), share))):
            out[name].append(values)
    found = {n: np.concatenate(v) if v else v for n, v in out.items()}
    return found | {n: ids.take(pa.array(found[n], pa.int64())) for n in ("query_id", "vec_id")}


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, bits: int = 512, recall: float = RECALL, margin: float = MARGIN, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k nearest found for each query row, by inner product.

    ``vectors`` has vec_id and embedding; the rows where ``is_query`` holds are the
    queries, and every other row than itself is a candidate.  Returns ``query_id,
    rank, vec_id, score, probed``; ties go to the smaller vec_id (a null one last),
    ``probed`` is the share of its shard's codes that the query looked at.  Vectors
    that are null, zero or hold null or non-finite components take no part.  Vectors
    of one length are candidates of each other; the index is built for the commonest
    length, and blocks of others are compared whole.  Repeated rows are candidates of
    their own.  All candidates are returned if there are fewer than k; an empty table
    gives no rows; other columns are not read.  ``recall`` is the chance at which
    probing ends, ``margin`` the standard deviations of bits by which found codes may
    lie beyond the k-th; a recall of 1 gives the exact answer.
    """
    every = usable_vectors(vectors).withColumn("d", F.size("embedding"))
    usual = every.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    spark = vectors.sparkSession
    if not usual:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, probed double")
    d, good = usual["d"], every.filter(F.col("d") == usual["d"])
    max_norm = greatest_norm(good)
    turn = learn_rotations(good, bits, max_norm)
    numbered = every.withColumn("row", F.monotonically_increasing_id()).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    kept = StructType([StructField("row", LongType()), numbered.schema["asks"], numbered.schema["d"], StructField("vec_id", LongType()), StructField("code", BinaryType()), StructField("ask", BinaryType()), numbered.schema["embedding"]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            if b.num_rows:
                code, ask = np.full(b.num_rows, b"", object), np.full(b.num_rows, b"", object)
                at = np.flatnonzero(b.column("d").to_numpy() == d)
                if len(at):
                    x = matrix(b.column("embedding").take(pa.array(at))).astype(np.float64)
                    for out, y in ((code, as_candidates(x, max_norm)), (ask, as_queries(x))):
                        out[at] = [c.tobytes() for c in np.packbits(y @ turn > 0, axis=1)]
                yield {n: b.column(n) for n in ("row", "asks", "d", "vec_id", "embedding")} | {"code": code, "ask": ask}

    coded = stage(map_batches(numbered, encode, kept), "codes")
    queries = coded.filter("asks").count()
    shards = max(1, math.ceil(usual["count"] / shard_rows))
    blocks = max(1, math.ceil(queries / query_rows), min(math.ceil(BLOCKS / shards), queries // SMALL_BLOCK))
    shard, block = F.pmod(F.xxhash64("row"), F.lit(shards)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index = coded.drop("ask").withColumn("asks", F.lit(False)).withColumn("shard", shard).withColumn("block", all_of(blocks))
    asked = coded.filter("asks").withColumn("code", F.col("ask")).drop("ask").withColumn("block", block).withColumn("shard", all_of(shards))
    found = StructType([StructField(n, DoubleType() if n in ("score", "probed") else LongType()) for n in ("query_row", "query_id", "row", "vec_id", "score", "probed")])

    def cell(table: pa.Table) -> pa.Table:
        best = search_cell(table.combine_chunks(), k, max_norm, recall, margin)
        return pa.table({n: as_array(best[n], pa.float64() if n in ("score", "probed") else pa.int64()) for n in best})

    cells = index.unionByName(asked).groupBy("d", "shard", "block").applyInArrow(cell, found)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", "probed")
