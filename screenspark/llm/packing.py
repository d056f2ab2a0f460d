"""Packing of documents into fixed training windows.

Method: best-fit decreasing.  Documents longer than a window are first cut into
full windows; the pieces, longest first, each go to the open window with the
smallest remaining room that holds them, found by a segment tree over the rooms.

Pieces are dealt at random into groups of bounded size, and each group is packed
by one task; at most one or two windows of a group stay part empty.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from screenspark.llm.batches import map_batches, slices
from screenspark.llm.encoding import encoder
from screenspark.plans.staging import stage

#: Pieces packed by one task, on average.
GROUP_PIECES = 20_000


class OpenWindows:
    """Open windows by remaining room: a segment tree of counts, and a stack of windows for each room."""

    def __init__(self, room: int):
        self.size = 1 << room.bit_length()
        self.tree = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(room + 1)]

    def _count(self, room: int, change: int) -> None:
        i = self.size + room
        while i:
            self.tree[i] += change
            i >>= 1

    def put(self, window: int, room: int) -> None:
        self.stacks[room].append(window)
        self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return a window with the least room of at least ``need``, and that room."""
        tree, i = self.tree, self.size + need
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.size
        self._count(room, -1)
        return self.stacks[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; ``lengths`` are in descending order and at most ``window``."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int(np.searchsorted(-lengths, -window, side="right"))
    number[:full] = np.arange(full)
    opened, used = OpenWindows(window), full
    for i, n in enumerate(lengths[full:].tolist(), full):
        if found := opened.take(n):
            k, room = found
        else:
            k, room = used, window
            used += 1
        number[i], offset[i] = k, window - room
        if room > n:
            opened.put(k, room - n)
    return number, offset


def cut_documents(docs: DataFrame, vocabulary: str, window: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: full windows from its start, then the rest."""
    fields = [StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch, "text"):
                ids, stops = encode(part.column("text"), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                begins = np.append(0, stops[:-1])
                total = stops - begins
                pieces = -(-total // window)
                doc = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, total[doc] - start)
                at = begins[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                out = {"doc_id": part.column("doc_id").take(pa.array(doc)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total[doc]}
                if with_ids:  # pieces of a document follow each other, so the ids are in order already
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield out

    return map_batches(docs.select("doc_id", docs["text"].cast("string").alias("text")), run, schema)


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = 4096, end_id: int = 2, with_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Where each piece of each row of ``docs`` (doc_id, text) goes.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, on demand, the ``ids``.  A null or empty text is its end id alone.
    Repeated rows and null ids are documents like any other; the ids of a
    document of any length are cut at multiples of ``window``.  An empty table
    gives no rows; other columns are not read.
    """
    pieces = stage(cut_documents(docs, vocabulary, window, end_id, with_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    keys = pieces.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "_row"], ascending=[False, True], ignore_index=True)
        number, offset = best_fit_decreasing(part["length"].to_numpy(), window)
        return pd.DataFrame({"_row": part["_row"], "sequence_id": number * groups + part["_group"], "offset": offset})

    placed = keys.groupBy("_group").applyInPandas(pack, "_row long, sequence_id long, offset long")
    return pieces.join(placed, "_row").drop("_row")
