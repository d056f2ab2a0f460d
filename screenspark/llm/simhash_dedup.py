"""SimHash near-duplicates by a binary trie self-join.

Fingerprints that differ in at most ``max_bits`` bits agree on one of
``max_bits + 1`` blocks of bits.  Each distinct fingerprint is rotated so that
each block in turn comes first, and the nodes under one block value are one
trie.  In a trie, pairs of nodes are traversed together from the block down:
differing bits add up, and a pair is dropped once they exceed the budget.  A pair
of nodes with very many fingerprints is dealt out as the pairs of their nodes eight
levels further down, again within the budget, until every pair is small.

A task passes on a spanning forest of the links that it finds, not the links, so
that dense groups stay linear; components join the forests.

Two rules decide what is near.  ``simhash_components`` goes by bits alone.
``similar_components`` goes by the Jaccard similarity of word shingles: the trie
join gives the first links, which are verified, and the texts that share first
shingles of their sets and are not yet in one class are compared after it, as a
similarity of 0.8 means about ten of 64 bits, a budget that prunes no trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from screenspark.llm.batches import map_batches, slices
from screenspark.llm import shingle_dedup
from screenspark.llm.components import Forest, components
from screenspark.plans.staging import stage

#: A pair of nodes with more fingerprints than this is dealt out as pairs of nodes below.
TRIE_LEAVES = 20_000
SPLIT_BITS = 8
#: Rows that a task gathers before it traverses their tries, and pairs compared at once.
TASK_ROWS = 200_000
PAIR_BLOCK = 2_000_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text (null: empty), as an unsigned number."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    if len(words) <= shingle:
        joined, spans = b" ".join(words), [(0, None)]
    else:
        joined = b" ".join(words)
        n = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(n + 1) - 1
        spans = zip((stop - n)[: 1 - shingle].tolist(), stop[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 8)
    return majority_bits(h)


def majority_bits(h: np.ndarray) -> int:
    """The bits that are set in over half the rows of eight big-endian bytes; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint_of_hashes(h: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes."""
    return majority_bits(h.astype(">u8").view(np.uint8).reshape(-1, 8))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed long) and ``text_hash`` for each row of ``docs``, no shuffle."""
    schema = StructType([docs.select("doc_id").schema[0], StructField("fp", LongType()), StructField("text_hash", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
                yield {"doc_id": part.column("doc_id"), "fp": fp.view(np.int64), "text_hash": part.column("text_hash")}

    return map_batches(docs.select("doc_id", docs["text"].cast("string").alias("text"), F.xxhash64("text").alias("text_hash")), run, schema)


def _rotated(fp: Column, bits: int) -> Column:
    return fp if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def trie_links(tree: np.ndarray, key: np.ndarray, side: np.ndarray | None, depth: int, budget: int, forest: Forest) -> None:
    """Link the positions of fingerprints within ``budget`` bits that share a trie.

    ``tree`` holds unsigned fingerprints, sorted within each run of equal
    ``key``; a run is a trie, whose first ``depth`` bits are equal.  Where ``side``
    is given, a run with sides 0 and 1 is joined across its sides only.
    """
    n = len(tree)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    last = np.append(first[1:], n)
    cut = last.copy()
    if side is not None:
        zeros = np.add.reduceat(side == 0, first)
        cut = np.where((zeros > 0) & (zeros < last - first), first + zeros, last)
    cross = cut < last
    a0, a1 = first, cut
    b0, b1 = np.where(cross, cut, first), last
    diff = np.zeros(len(first), np.int64)

    def compare(a0, a1, b0, b1):
        """All pairs of leaves of small node pairs."""
        na, nb = a1 - a0, b1 - b0
        size = na * nb
        ends = np.cumsum(size)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIR_BLOCK):
            t = np.arange(lo, min(lo + PAIR_BLOCK, int(ends[-1])))
            p = np.searchsorted(ends, t, side="right")
            r = t - (ends[p] - size[p])
            i, j = a0[p] + r // nb[p], b0[p] + r % nb[p]
            near = (i != j) & (np.bitwise_count(tree[i] ^ tree[j]) <= budget)
            forest.link(i[near], j[near])

    for bit in range(64 - depth - 1, -1, -1):
        if not len(a0):
            return
        same = a0 == b0
        done = np.where(same, a1 - a0 <= 8, (a1 - a0) * (b1 - b0) <= 64)
        sure = ~done & (diff + bit + 1 <= budget)  # the bits that are left cannot exceed the budget
        if sure.any():
            for x0, x1, y0, y1 in zip(a0[sure], a1[sure], b0[sure], b1[sure], strict=True):
                members = np.concatenate([np.arange(x0, x1), np.arange(y0, y1)])
                forest.link(np.full(len(members) - 1, members[0]), members[1:])
        compare(a0[done], a1[done], b0[done], b1[done])
        go = ~(done | sure)
        a0, a1, b0, b1, diff, same = a0[go], a1[go], b0[go], b1[go], diff[go], same[go]
        if not len(a0):
            return
        ones = np.append(0, np.cumsum((tree >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        parts = [  # (A0,B0), (A1,B1), (A0,B1), and (A1,B0) of two different nodes
            (a0, am, b0, bm, diff, None), (am, a1, bm, b1, diff, None), (a0, am, bm, b1, diff + 1, None), (am, a1, b0, bm, diff + 1, ~same),
        ]
        new = []
        for p0, p1, q0, q1, d, only in parts:
            keep = (p1 > p0) & (q1 > q0) & (d <= budget)
            if only is not None:
                keep &= only
            new.append([x[keep] for x in (p0, p1, q0, q1, d)])
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*new, strict=True))
    compare(a0, a1, b0, b1)


def node_pairs(nodes: DataFrame, max_bits: int, leaves: int) -> DataFrame:
    """``block, depth, a, b, side, r``: fingerprints by pairs (a, b) of trie nodes within the budget.

    First every trie is one pair of a node with itself.  While a pair has more than
    ``leaves`` fingerprints, it is replaced by the pairs of nodes SPLIT_BITS further
    down whose bits still fit the budget; at full depth a pair has two.
    """
    blocks = max_bits + 1
    width = 64 // blocks
    turned = F.array(*(F.struct(F.lit(i).alias("block"), _rotated(F.col("fp"), i * width).alias("r")) for i in range(blocks)))
    rows = nodes.select(F.explode(turned).alias("x")).select("x.block", "x.r")
    value = F.shiftrightunsigned("r", 64 - width)
    open_rows = rows.select("block", F.lit(width).alias("depth"), value.alias("a"), value.alias("b"), F.lit(0).alias("side"), F.lit(0).alias("diff"), "r")
    masks = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("bits")) for m in range(1 << SPLIT_BITS) if m.bit_count() <= max_bits))
    done = None
    while True:
        by = ["block", "depth", "a", "b"]
        hot = open_rows.groupBy(*by).count().filter(F.col("count") > leaves).select(*by)
        hot = stage(hot, "hot")
        cold = open_rows.join(hot, by, "left_anti")
        done = cold if done is None else done.unionByName(cold)
        if hot.isEmpty():
            return done.select(*by, "side", "r")
        depth = hot.first()["depth"]
        step = min(SPLIT_BITS, 64 - depth)
        p = F.shiftrightunsigned("r", 64 - depth - step).bitwiseAND(F.lit((1 << step) - 1))
        fits = F.filter(masks, lambda x: (x["bits"] + F.col("diff") <= max_bits) & (x["m"] < F.lit(1 << step)))
        met = open_rows.join(hot, by, "left_semi").withColumn("p", p).withColumn("x", F.explode(fits)).withColumn("q", F.col("p").bitwiseXOR(F.col("x.m")))
        self_pair = F.col("a") == F.col("b")
        below = lambda node, bits: F.shiftleft(F.col(node), step).bitwiseOR(bits)
        left = F.when(self_pair, F.least("p", "q")).when(F.col("side") == 0, F.col("p")).otherwise(F.col("q"))
        right = F.when(self_pair, F.greatest("p", "q")).when(F.col("side") == 0, F.col("q")).otherwise(F.col("p"))
        side = F.when(self_pair, (F.col("p") > F.col("q")).cast("int")).otherwise(F.col("side"))
        open_rows = stage(met.select("block", F.lit(depth + step).alias("depth"), below("a", left).alias("a"), below("b", right).alias("b"), side.alias("side"), (F.col("diff") + F.col("x.bits")).alias("diff"), "r"), "node-pairs")


def fingerprint_links(nodes: DataFrame, max_bits: int = 3, leaves: int = TRIE_LEAVES) -> DataFrame:
    """Edges ``u, v`` that connect the distinct fingerprints ``fp`` within ``max_bits`` bits."""
    width = 64 // (max_bits + 1)
    cell = ["block", "depth", "a", "b"]
    rows = node_pairs(nodes, max_bits, leaves)
    # Unsigned order of r within a side.
    rows = rows.withColumn("o", F.col("r").bitwiseXOR(F.lit(-(2**63)))).repartition(*cell).sortWithinPartitions(*cell, "side", "o")

    def links(table: pa.Table) -> dict:
        block, *where = (table.column(c).to_numpy() for c in cell)
        r = table.column("r").to_numpy().view(np.uint64)
        key = np.cumsum(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in (block, *where)])))
        side = table.column("side").to_numpy()
        first = np.flatnonzero(np.diff(key, prepend=0))
        alone = np.minimum.reduceat(side, first) == np.maximum.reduceat(side, first)
        alone &= where[1][first] != where[2][first]  # two nodes, of which one is empty
        some = ~alone[key - 1]
        block, r, key, side = block[some], r[some], key[some], side[some]
        forest = Forest(len(r))
        if len(r):
            trie_links(r, key, side, width, max_bits, forest)
        back = (block.astype(np.uint64) * np.uint64(width)) % np.uint64(64)
        fp = np.where(back == 0, r, (r >> back) | (r << ((np.uint64(64) - back) % np.uint64(64)))).view(np.int64)
        child = np.flatnonzero(forest.label != np.arange(len(r)))
        return {"u": fp[child], "v": fp[forest.label[child]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TASK_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                same = np.logical_and.reduce([table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in cell])
                cut = int(np.argmax(same))  # the last pair of nodes may go on in the next batch
                if cut:
                    yield links(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return map_batches(rows.select(*cell, "side", "r"), run, StructType([StructField("u", LongType()), StructField("v", LongType())]))


def simhash_components(docs: DataFrame, max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """Near-duplicate class of each row of ``docs`` (doc_id, text).

    Returns ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (the
    smallest doc_id in the class), ``component_key`` (one value for each class)
    and ``text_hash``.  A null, empty or blank text has fingerprint zero and is
    linked like any other; fewer words than a shingle are one shingle.  Repeated
    rows stay; null ids count only if a class has no other.  An empty table gives
    no rows; other columns are not read.
    """
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(fingerprint_links(nodes, max_bits)).select(F.col("node").alias("fp"), "root")
    classed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    found = stage(classed.select("fp", "root").join(lows, "root"), "classes")
    return marked.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("component_key"), "text_hash")


def similar_components(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, max_bits: int = 3, turns: int = 1) -> DataFrame:
    """Near-duplicate class of each row of ``docs`` (doc_id, text): texts linked by a Jaccard similarity of ``threshold`` or more of their word shingles.

    Returns ``doc_id, component_id`` (the smallest doc_id in the class),
    ``component_key`` (one value for each class) and ``text_hash``, a hash of the
    text, or the caller's column of that name that tells rows of one id apart.  Null,
    empty and blank texts are one class.  Repeated rows stay; null ids count only if a class
    has no other.  An empty table gives no rows; other columns are not read.

    All pairs are found: the trie join, the stars over dense lists (``turns`` more
    rounds) and each text's closest pair only unite classes early; every pair of two classes
    that shares a first shingle is held against the bound of its shared ones and, if
    they are still two, verified.
    """
    own = F.col("text_hash").cast("long") if "text_hash" in docs.columns else F.xxhash64("text")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), own.alias("text_hash"))
    marked = stage(shingle_dedup.described(docs, threshold, shingle, fingerprint_of_hashes), "shingles")
    one = F.struct("doc_id", "text_hash")
    nodes = stage(marked.groupBy("key").agg(F.min("doc_id").alias("low"), F.min(one).alias("one"), *(F.first(c).alias(c) for c in ("n", "fp", *shingle_dedup.PARITY))), "nodes")
    lists = stage(shingle_dedup.shared_lists(marked.select(F.explode("prefix").alias("h"), "key")), "lists")
    by_fp = stage(nodes.groupBy("fp").agg(F.min("key").alias("rep")), "fingerprints")
    ends = [by_fp.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "uv"]
    near = fingerprint_links(by_fp, max_bits).join(ends[0], "u").join(ends[1], "v").select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v"))
    near = near.unionByName(nodes.join(by_fp, "fp").filter("key <> rep").select(F.col("key").alias("u"), F.col("rep").alias("v"))).distinct()
    check = lambda pairs: shingle_dedup.verified(pairs, nodes, docs, threshold, shingle)
    first = check(near.unionByName(shingle_dedup.star_pairs(shingle_dedup.with_roots(lists, nodes, None), 0)).distinct())
    known = stage(components(first), "roots")
    stars = lambda roots: roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    for turn in range(1, turns + 1):
        rows = shingle_dedup.with_roots(lists, nodes, known)
        known = stage(components(stars(known).unionByName(check(shingle_dedup.star_pairs(rows, turn)))), "roots")
    rows = stage(shingle_dedup.with_roots(lists, nodes, known), "open-lists")
    pairs = stage(shingle_dedup.possible_pairs(rows, threshold), "possible")
    known = stage(components(stars(known).unionByName(check(shingle_dedup.closest_pairs(pairs)))), "roots")
    pairs = stage(shingle_dedup.open_pairs(pairs, known), "open")
    edges = stars(known).unionByName(check(pairs.select("u", "v")))
    roots = components(edges).select(F.col("node").alias("key"), "root")
    classes = nodes.select("key", "low").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stage(classes.select("key", "root").join(lows, "root"), "classes")
    return marked.select("doc_id", "text_hash", "key").join(named, "key").select("doc_id", "component_id", F.col("root").alias("component_key"), "text_hash")
