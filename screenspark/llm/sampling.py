"""Bounded samples of labelled rows for models that are trained here."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from screenspark.llm.batches import map_batches
from screenspark.plans.staging import stage

#: A table of labels of at most so many rows is broadcast.
BROADCAST_LABELS = 10_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id's text is divisible by 5 (a null id: none)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores behind those that are among ``columns`` (whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def under_share(h: Column, wanted: Column, rows: Column) -> Column:
    """Whether a signed 64-bit hash lies in the lowest ``wanted / rows`` of all; every row where that is 1 or more."""
    return h.cast("double") / F.lit(2.0**64) + 0.5 <= wanted / rows


def labelled_sample(labelled: DataFrame, label: str, per_label: int, total: int | None = None) -> DataFrame:
    """At most ``per_label`` rows of every label (rows without one: none), those with the smallest hashes of the whole row.

    With ``total``, at most so many rows in all as long as there are fewer labels
    than that: the number for each label is lowered alike, to one at least.  A bound
    on the hash, from the count of the label and with room to spare, leaves few rows
    to the exact cut, so texts are neither sorted nor shuffled as a whole.  Repeated
    rows and null ids count like any other.
    """
    marked = labelled.filter(F.col(label).isNotNull())
    h, n, place = fresh(labelled.columns, "hash", "label_rows", "place")
    marked = marked.withColumn(h, F.xxhash64(*labelled.columns))
    counts = stage(marked.groupBy(label).agg(F.count("*").alias(n)), "label-counts")
    labels = counts.count()
    keep = per_label if total is None else max(1, min(per_label, total // max(1, labels)))
    spare = keep + math.ceil(6 * math.sqrt(keep)) + 20
    some = marked.join(F.broadcast(counts) if labels <= BROADCAST_LABELS else counts, label).filter(under_share(F.col(h), F.lit(float(spare)), F.col(n)))
    cut = some.withColumn(place, F.row_number().over(Window.partitionBy(label).orderBy(h))).filter(F.col(place) <= keep)
    return cut.select(*labelled.columns)


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """What ``fit`` makes of all rows of a bounded sample, sorted; it runs in one task, and only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield {"model": [pickle.dumps(fit(rows))]}

    made = map_batches(sample.repartition(1), run, StructType([StructField("model", BinaryType())])).collect()
    return pickle.loads(made[0]["model"]) if made else None
