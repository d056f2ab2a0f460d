"""Token-ID files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document, then two skippable frames: the
document index (ids, null flags and token counts) and the seek table in the
published zstandard seekable layout, with a checksum for each frame.  A reader
takes the table from the end of the file and decompresses only the documents
that it is asked for.

Files cover ascending, disjoint ranges of doc_id.  Each task writes a file of
its own name; the manifest, a table in the shared folder, lists the files of the
tasks that succeeded, so a task that runs again after the loss of an executor
leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from screenspark.llm.batches import map_batches, slices
from screenspark.llm.encoding import encoder
from screenspark.plans.staging import new_path, stage

# Fixed values of the zstandard formats.
INDEX_MAGIC = 0x184D2A50
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Bytes read from a file at once.
READ_BYTES = 8 << 20


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class TokenFileWriter:
    """Writes documents, one after the other, to a binary file object."""

    def __init__(self, out, width: int = 4, level: int = 1):
        import zstandard

        self.out, self.dtype = out, {2: "<u2", 4: "<u4"}[width]
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=False).compress
        self.entries, self.docs, self.nulls, self.tokens = [], [], bytearray(), []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        raw = ids.astype(self.dtype).tobytes()
        frame = self.compress(raw)
        self.out.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.tokens.append(len(ids))

    def close(self) -> None:
        head = struct.pack("<BQ", int(self.dtype[-1]), len(self.docs))
        index = head + np.array(self.docs, "<i8").tobytes() + bytes(self.nulls) + np.array(self.tokens, "<i8").tobytes()
        self.out.write(_skippable(INDEX_MAGIC, index))
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(_skippable(SKIPPABLE_MAGIC, table))
        self.out.close()


class TokenFileReader:
    """Reads documents from a seekable binary file object."""

    def __init__(self, source, size: int):
        import zstandard

        self.source = source
        self.decompress = zstandard.ZstdDecompressor().decompress
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a token file: no seek table at its end")
        table = np.frombuffer(self._read(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.raw, self.checks = table.T if frames else np.zeros((3, 0), np.int64)
        self.stops = np.cumsum(self.sizes)
        at = int(self.stops[-1]) if frames else 0
        magic, length = struct.unpack("<II", self._read(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("not a token file: no document index")
        body = self._read(at + 8, length)
        width, n = struct.unpack_from("<BQ", body)
        self.dtype = f"<u{width}"
        self.docs = np.frombuffer(body, "<i8", n, 9)
        self.nulls = np.frombuffer(body, np.uint8, n, 9 + 8 * n).astype(bool)
        self.tokens = np.frombuffer(body, "<i8", n, 9 + 9 * n)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def read(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the wanted rows (all: None) in order; neighbouring frames are fetched together."""
        rows = np.arange(len(self.docs)) if rows is None else rows
        i = 0
        while i < len(rows):
            j, begin = i, int(self.stops[rows[i]] - self.sizes[rows[i]])
            while j + 1 < len(rows) and rows[j + 1] == rows[j] + 1 and self.stops[rows[j + 1]] - begin <= READ_BYTES:
                j += 1
            data = memoryview(self._read(begin, int(self.stops[rows[j]]) - begin))
            for row in rows[i : j + 1].tolist():
                yield row, self._frame(data[int(self.stops[row] - self.sizes[row]) - begin : int(self.stops[row]) - begin], row)
            i = j + 1

    def _frame(self, frame, row: int) -> np.ndarray:
        import xxhash

        raw = self.decompress(frame, max_output_size=int(self.raw[row]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[row]:
            raise ValueError(f"checksum of frame {row} does not hold")
        return np.frombuffer(raw, self.dtype)


MANIFEST = StructType([StructField("path", StringType()), StructField("first_id", LongType()), StructField("first_place", LongType()), StructField("n_docs", LongType()), StructField("n_ids", LongType())])


def write_token_files(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int | None = 2, folder: str | None = None, width: int = 2) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) and return the manifest: ``path, first_id, first_place, n_docs, n_ids, first_token``.

    Documents are in ascending doc_id order within and across files (null ids
    first; rows of one id in the order in which they are read, over several files
    if they are many).  A null text has the end id only.  ``folder``
    is a URI that the executors reach (default: a new one in the shared folder);
    ``width`` is the bytes of an id in the files, 2 or 4.  An empty table gives
    an empty manifest.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyarrow import fs

        writer = store = path = first = place = None
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch, "text"):
                ids, stops = encode(part.column("text"), end_id)
                if len(ids) and int(ids.max()) >= 1 << (8 * width):
                    raise ValueError(f"an id does not fit {width} bytes")
                for i, (doc_id, a, b) in enumerate(zip(part.column("doc_id").to_pylist(), np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True)):
                    if writer is None:
                        path, first, place = f"{folder}/{uuid.uuid4().hex}.tokens", doc_id, part.column("place")[i].as_py()
                        store, inner = fs.FileSystem.from_uri(path)
                        store.create_dir(inner.rpartition("/")[0], recursive=True)
                        writer = TokenFileWriter(store.open_output_stream(inner), width)
                    writer.add(doc_id, ids[a:b])
        if writer is not None:
            writer.close()
            yield {"path": [path], "first_id": [first], "first_place": [place], "n_docs": [len(writer.docs)], "n_ids": [sum(writer.tokens)]}

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())  # splits the rows of one id, too
    ordered = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    manifest = stage(map_batches(ordered, run, MANIFEST), "manifest")
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_place").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, on demand, ``ids`` of the documents in the files.

    With ``wanted``, only the frames of these ids are decompressed.
    """
    fields = [StructField(n, LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyarrow import fs

        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as source:
                    reader = TokenFileReader(source, source.size())
                    starts = first + np.cumsum(reader.tokens) - reader.tokens
                    rows = None if wanted is None else np.flatnonzero(np.isin(reader.docs, wanted) & ~reader.nulls)
                    out: dict = {n: [] for n in names}
                    size = 0
                    for row, ids in reader.read(rows):
                        values = (None if reader.nulls[row] else int(reader.docs[row]), int(starts[row]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None)
                        for n, v in zip(names, values, strict=False):
                            out[n].append(v)
                        size += len(ids)
                        if size > 2_000_000 or len(out["doc_id"]) >= 20_000:
                            yield out
                            out, size = {n: [] for n in names}, 0
                    yield out

    files = manifest.count()
    return map_batches(manifest.select("path", "first_token").repartition(max(1, files)), run, StructType(fields))
