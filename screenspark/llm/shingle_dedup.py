"""Word-shingle sets, their shared lists and the verification of pairs on whole sets.

Each text puts the first shingles of its set, in one order that holds for all
texts, into an inverted index; two sets of similarity t share one of their first
n - ceil(t n) + 1 (prefix filter), so no pair is lost.  Shingles that are frequent
in a sample come last in the order; the order decides the cost, never the result.

Two bounds keep pairs apart without their texts and without losing a true pair.
Each set has a bitmap of parities: a shingle flips one bit, so two sets differ in at
least as many shingles as their bitmaps differ in bits.  And all common shingles but
the shared first ones lie behind the first ones of one of the two.  Pairs that meet by
a shared passage only fall to the first bound in the join itself.  All that are left
are verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from screenspark.llm.batches import map_batches, slices
from screenspark.plans.staging import discard, stage

#: One text of so many shows which shingles are frequent: those in so many of its texts, the most frequent ones.
SAMPLE_ONE_IN = 16
FREQUENT = 4
MOST_FREQUENT = 300_000
CACHE_WORDS = 200_000
#: Candidate pairs up to which the ids of their texts are broadcast (two ids and hashes a pair, some MB); beyond, the tables are shuffled.
BROADCAST_PAIRS = 200_000
#: Lists of more texts than this are united by stars before their pairs are looked at.
DENSE = 32
#: Bits in which the fingerprints of nearly all texts of a similarity of 0.8 differ at most (about ten are expected).
NEAR_BITS = 17
#: Columns of the parity bitmap, 64 bits each.
PARITY = ("p0", "p1", "p2", "p3")
#: Hashes of sets that a task keeps while it verifies.
CACHE_HASHES = 3_000_000
MIX = 0x9E3779B97F4A7C15


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


WORDS = Words()


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """64-bit hashes of the word shingles of a text in order, repeats included; fewer words are one shingle, none are none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(h))
    if not width:
        return h
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * np.uint64(MIX)
        out ^= out >> np.uint64(29)
    return out


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text."""
    return np.unique(shingle_hashes(text, shingle))


def parities(s: np.ndarray) -> np.ndarray:
    """The bitmap of a set of hashes: for each value of their low bits, whether the number of hashes is odd."""
    width = 64 * len(PARITY)
    odd = np.bincount((s % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in the sample, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, shingle) for t in part.column("text").to_pylist()]
                yield {"h": np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)}

    some = docs.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(SAMPLE_ONE_IN)) == 0)
    counts = map_batches(some.select("text"), run, StructType([StructField("h", LongType())])).groupBy("h").count()
    found = counts.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def described(docs: DataFrame, threshold: float, shingle: int, bits) -> DataFrame:
    """``doc_id, text_hash, key`` (of the shingle set), ``n``, ``fp`` (``bits`` of its hashes), ``prefix`` and the parity bitmap of each row, no shuffle."""
    often, counts = _frequent(docs, shingle)
    schema = StructType([docs.select("doc_id").schema[0], StructField("text_hash", LongType()), StructField("key", LongType()), StructField("n", IntegerType()), StructField("fp", LongType()), StructField("prefix", ArrayType(LongType())), *(StructField(c, LongType()) for c in PARITY)])

    def prefix(s: np.ndarray) -> np.ndarray:
        take = len(s) - math.ceil(threshold * len(s) - 1e-9) + 1 if len(s) else 0
        if len(often):
            at = np.minimum(np.searchsorted(often, s), len(often) - 1)
            s = s[np.argsort(np.where(often[at] == s, counts[at], 0), kind="stable")]
        return s[:take].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import xxhash

        for batch in batches:
            for part in slices(batch, "text", 3_000_000):
                hashes = [shingle_hashes(t, shingle) for t in part.column("text").to_pylist()]
                fp = np.array([bits(h) for h in hashes], np.uint64)
                sets = [np.unique(h) for h in hashes]
                key = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64)
                first = [prefix(s) for s in sets]
                ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
                flat = np.concatenate(first or [np.zeros(0, np.int64)])
                bitmaps = np.stack([parities(s) for s in sets]) if sets else np.zeros((0, len(PARITY)), np.int64)
                yield dict(zip(PARITY, bitmaps.T, strict=True)) | {"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "key": key.view(np.int64), "n": [len(s) for s in sets], "fp": fp.view(np.int64), "prefix": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
        WORDS.clear()  # the worker stays for later tasks

    return map_batches(docs, run, schema)


def shared_lists(rows: DataFrame) -> DataFrame:
    """The rows ``h, key`` of lists of two different texts or more, each once.

    A task streams over its lists and holds one row beside the batch, however long
    a list is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, passed = None, False  # the last row, and whether it was passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column("h").to_numpy(), batch.column("key").to_numpy()], axis=1)
            old = last is not None
            if old:
                now = np.concatenate([last, now])
            now = now[np.append(True, (now[1:] != now[:-1]).any(axis=1))]  # exact copies once
            like = now[1:, 0] == now[:-1, 0]
            keep = np.append(False, like) | np.append(like, False)
            keep[0] &= not (old and passed)
            passed = bool(like[-1]) if len(like) else passed
            last = now[-1:]
            yield {"h": now[keep, 0], "key": now[keep, 1]}

    schema = StructType([StructField("h", LongType()), StructField("key", LongType())])
    return map_batches(rows.repartition("h").sortWithinPartitions("h", "key"), run, schema)


def with_roots(lists: DataFrame, nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``h, key, n, fp, root, size`` and the bitmaps of the lists whose texts are not yet of one class; without roots each text is its own."""
    known = nodes.select("key", "n", "fp", *PARITY)
    known = known.withColumn("root", F.col("key")) if roots is None else known.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = lists.join(known, "key")
    mixed = rows.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size")).filter("a <> b").select("h", "size")
    return rows.join(mixed, "h")


def with_major(rows: DataFrame) -> DataFrame:
    """``rows`` with ``minor``: whether a text is outside the largest class of its list."""
    largest = rows.groupBy("h", "root").count().groupBy("h").agg(F.max_by("root", F.struct("count", "root")).alias("major"))
    return rows.join(largest, "h").withColumn("minor", F.col("root") != F.col("major"))


def star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs ``u, v`` of the texts of dense lists and two centres of each list, which a later turn takes from its largest class.

    Only pairs of near fingerprints count, as stars merely unite classes early; a
    text has at most two pairs for each of its lists, whatever their size.
    """
    dense = rows.filter(F.col("size") > DENSE)
    if turn:
        dense = with_major(dense)
    order = F.struct(F.xxhash64("h", "key", F.lit(turn)), F.col("key").alias("v"), F.col("root").alias("root_v"), F.col("fp").alias("fp_v"))
    held = F.when(~F.col("minor"), order) if turn else order
    centres = dense.groupBy("h").agg(F.array(F.min(held), F.max(held)).alias("c")).select("h", F.explode("c").alias("c")).select("h", "c.v", "c.root_v", "c.fp_v")
    met = dense.join(centres, "h").filter((F.col("root") != F.col("root_v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_v"))) <= NEAR_BITS))
    return met.select(F.least("key", "v").alias("u"), F.greatest("key", "v").alias("v")).distinct()


def _first(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * threshold - 1e-9) + 1


def possible_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``u, v`` of different classes in one list that may be similar, with how many first shingles they ``shared``.

    In each list the members outside its largest class meet all others, so a list
    that is nearly of one class costs little.
    """
    rows = with_major(rows)
    a, b = (rows.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "root", "minor", *PARITY))) for s in "uv")
    once = ~F.col("minor_v") | (F.col("key_u") < F.col("key_v"))
    close = F.least("n_u", "n_v") >= F.greatest("n_u", "n_v") * threshold - 1e-9
    apart = sum((F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v"))) for c in PARITY), F.lit(0))
    alike = apart <= (F.col("n_u") + F.col("n_v")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    met = a.filter("minor_u").join(b, "h").filter((F.col("root_u") != F.col("root_v")) & once & close & alike)
    u, v = F.least("key_u", "key_v").alias("u"), F.greatest("key_u", "key_v").alias("v")
    sizes = F.struct(F.least("n_u", "n_v").alias("lo"), F.greatest("n_u", "n_v").alias("hi"))
    met = met.groupBy(u, v).agg(F.count("*").alias("shared"), F.any_value(sizes).alias("n"))
    rest = F.greatest(*(F.col(f"n.{c}") - _first(F.col(f"n.{c}"), threshold) for c in ("lo", "hi")))
    need = F.ceil((F.col("n.lo") + F.col("n.hi")) * (threshold / (1 + threshold)) - 1e-9)
    return met.filter(F.col("shared") + rest >= need).select("u", "v", "shared")


def open_pairs(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose texts are not yet in one class."""
    for c in "uv":
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    return pairs.filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v", "shared")


def closest_pairs(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each text, the one that shares most."""
    ends = pairs.select("u", "v", "shared").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "shared"))
    best = ends.groupBy("u").agg(F.max_by("v", F.struct("shared", "v")).alias("v"))
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs ``u, v`` whose whole sets are similar, as a table in the shared folder."""
    pairs = stage(pairs, "pairs")
    keys = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    few = pairs.count() <= BROADCAST_PAIRS
    wanted = nodes.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("key", F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("_hash"))
    found = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"].eqNullSafe(wanted["_id"]) & (docs["text_hash"] == wanted["_hash"]))
    texts = stage(found.select("key", "text").dropDuplicates(["key"]), "texts")
    sides = [texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sets: dict[int, np.ndarray] = {}
        held = 0

        def known(key: int, text: str) -> np.ndarray:
            nonlocal held
            if key not in sets:
                if held > CACHE_HASHES:
                    sets.clear()
                    held = 0
                sets[key] = shingle_set(text, shingle)
                held += len(sets[key])
            return sets[key]

        for batch in batches:
            u, v, text_u, text_v = (batch.column(c) for c in ("u", "v", "text_u", "text_v"))
            near = []
            for i, (a, b) in enumerate(zip(u.to_pylist(), v.to_pylist(), strict=True)):
                x, y = (sets[k] if k in sets else known(k, t[i].as_py()) for k, t in ((a, text_u), (b, text_v)))
                near.append(similarity(x, y) >= threshold - 1e-12)
            yield {"u": u, "v": v, "near": near}

    schema = StructType([StructField("u", LongType()), StructField("v", LongType()), StructField("near", BooleanType())])
    both = pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "text_u", "text_v")
    out = stage(map_batches(both, run, schema).filter("near").select("u", "v"), "near")
    discard(texts)
    discard(pairs)
    return out
