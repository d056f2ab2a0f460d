"""How the sources of a language differ in their terms.

Tokenizer: one ``bytes.translate`` lowers A-Z and blanks all that separates terms (the
separators are ASCII, so the bytes of other characters pass unharmed), ``bytes.split``
gives the terms, and a Counter of each document their frequencies.  Tasks add the
counters of a language and source up before anything is shuffled.

Terms kept are dealt over cells: a cell holds some terms of one language and two
blocks of its sources, as a small dense matrix of shares, from which it takes the part
of every pair of sources and the most telling terms of every source.  Sums over cells
are exact integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from screenspark.llm.batches import as_array, map_batches, slices
from screenspark.plans.staging import discard, stage

#: Bytes of ASCII letters go to small letters, other ASCII bytes to blanks, all others stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Counters are handed on when they hold so many terms.
HELD_TERMS = 200_000
#: Terms of a cell, and sources of a block of sources, on average.
CELL_TERMS, BLOCK_SOURCES = 2000, 128
#: Scale of shares.
SCALE = 1_000_000_000


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(LETTERS).split()


def source_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term, added up within tasks only.

    Every group has rows of the empty term too, which count nothing.
    """
    schema = StructType([StructField("lang", StringType()), StructField("source", StringType()), StructField("term", BinaryType()), StructField("n", LongType()), StructField("docs", LongType())])

    def rows(held: dict) -> dict:
        out: dict = {f: [] for f in ("lang", "source", "term", "n", "docs")}
        for (lang, source), (counts, docs_with) in held.items():
            out["lang"] += [lang] * (len(counts) + 1)
            out["source"] += [source] * (len(counts) + 1)
            out["term"] += [b"", *counts]
            out["n"] += [0, *counts.values()]
            out["docs"] += [0, *(docs_with[t] for t in counts)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict = {}
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    counts, docs_with = held.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(counts)
                    found = Counter(terms_of(text))
                    counts.update(found)
                    docs_with.update(found.keys())
                    size += len(counts)
                    if size > HELD_TERMS:
                        yield rows(held)
                        held, size = {}, 0
        if held:
            yield rows(held)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return map_batches(docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text")), run, schema)


def shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 kept)), exactly, beyond 64 bits too."""
    if (int(n.max(initial=0)) + 2) * SCALE < 2**63:
        return 1 + SCALE * (n + 2) // (total + 2 * kept)
    exact = 1 + SCALE * (n.astype(object) + 2) // (total.astype(object) + 2 * kept)
    return exact.astype(np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def compare_cell(cell: pa.Table, top: int) -> dict:
    """Parts of the pairs of a cell's sources, and the first ``top`` terms of each of them.

    Rows with a null term are the sources, each with the sums of its counts; others
    are occurrences of a term.  A pair gets the sum over the cell's terms, and of how
    many terms that is.
    """
    term = cell.column("term")
    groups, counts = cell.filter(pa.compute.is_null(term)), cell.filter(pa.compute.is_valid(term))
    sources, side = groups.column("source").to_pylist(), groups.column("side").to_numpy()
    place = {s: i for i, s in enumerate(sources)}
    total, kept = groups.column("group_n").to_numpy(), int(groups.column("kept")[0].as_py())
    names = sorted(set(counts.column("term").to_pylist()))
    at = {t: i for i, t in enumerate(names)}
    out: dict = {f: [] for f in ("source", "item", "term", "value", "terms")}
    if kept:
        n = np.zeros((len(sources), len(names)), np.int64)
        row, col = [place[s] for s in counts.column("source").to_pylist()], [at[t] for t in counts.column("term").to_pylist()]
        n[row, col] = counts.column("n").to_numpy()
        p = shares(n, total[:, None], kept)
        everywhere = np.zeros(len(names), np.int64)
        everywhere[col] = counts.column("lang_n_term").to_numpy()
        q = shares(everywhere, groups.column("lang_n").to_numpy()[:1], kept)
    diagonal = cell.column("one")[0].as_py() == cell.column("two")[0].as_py()
    order = sorted(range(len(sources)), key=lambda i: sources[i])
    for a in range(len(sources)):
        if diagonal:
            others = [b for b in order if sources[b] > sources[a]]
        else:
            others = [b for b in order if side[b] == 1] if side[a] == 0 else []
        if others:
            values = apart(p[a][None, :], p[others]).sum(axis=1) if kept else np.zeros(len(others), np.int64)
            out["source"] += [sources[a]] * len(others)
            out["item"] += [sources[b] for b in others]
            out["term"] += [None] * len(others)
            out["value"] += values.tolist()
            out["terms"] += [len(names)] * len(others)
        if diagonal and kept:
            telling = np.flatnonzero((n[a] > 0) & (p[a] > q))
            value = apart(p[a][telling], q[telling])
            best = np.lexsort((telling, -value))[:top]  # names are in the order of their bytes
            out["source"] += [sources[a]] * len(best)
            out["item"] += [None] * len(best)
            out["term"] += [names[i] for i in telling[best]]
            out["value"] += value[best].tolist()
            out["terms"] += [len(names)] * len(best)
    return out


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, cell_terms: int = CELL_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language differs from the others, and its telling terms.

    ``docs`` has text, lang and source (null: empty); a row is a document, repeated ones
    count each.  A language keeps the terms of at least ``least_docs`` of its documents.
    Part ``pair`` has all other sources of the language, part ``term`` the ``top`` terms
    that are commoner in the source than in the language.  Ranks go by value, then item
    in the order of its bytes.  A language without terms has pairs of value 0, an empty
    table gives no rows; other columns are not read.
    """
    counts = stage(source_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    is_term = F.length("term") > 0
    kept = counts.filter(is_term).groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n_term")).filter(F.col("in_docs") >= least_docs).drop("in_docs")
    sparse = stage(counts.filter(is_term).select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    of_lang = sparse.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    sizes = sparse.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    of_group = sparse.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.filter(~is_term).select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").join(sizes, "lang", "left").fillna(0, ["group_n", "lang_n", "kept"])
    groups = stage(groups, "groups")
    most = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("kept").alias("kept")).agg(F.max("sources"), F.max("kept")).first()
    blocks, parts = max(1, math.ceil((most[0] or 0) / block_sources)), max(1, math.ceil((most[1] or 0) / cell_terms))
    # A block of sources meets itself and every other block, as side 0 with the later ones and as side 1 with the earlier ones.
    own = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    cells = lambda df: df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0))
    void = lambda kind: F.lit(None).cast(kind)
    named = ("lang", "part", "one", "two", "side", "source")
    occurrences = cells(sparse.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))).select(*named, "term", "n", "lang_n_term", void("long").alias("group_n"), void("long").alias("lang_n"), void("long").alias("kept"))
    listed = cells(groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))).select(*named, void("binary").alias("term"), void("long").alias("n"), void("long").alias("lang_n_term"), "group_n", "lang_n", "kept")
    found = StructType([StructField("lang", StringType()), StructField("source", StringType()), StructField("item", StringType()), StructField("term", BinaryType()), StructField("value", LongType()), StructField("terms", LongType())])
    kinds = {"source": pa.string(), "item": pa.string(), "term": pa.binary(), "value": pa.int64(), "terms": pa.int64()}

    def cell(table: pa.Table) -> pa.Table:
        lang, got = table.column("lang")[0].as_py(), compare_cell(table.combine_chunks(), top)
        return pa.table({"lang": pa.array([lang] * len(got["value"]), pa.string())} | {n: as_array(got[n], kinds[n]) for n in kinds})

    compared = stage(occurrences.unionByName(listed).groupBy("lang", "part", "one", "two").applyInArrow(cell, found), "compared")
    for old in (counts, sparse):
        discard(old)
    # Terms that no source of a cell has are alike in all: each adds what two counts of zero add.
    zero = lambda n: f"(1 + CAST(2 * {SCALE} AS DECIMAL(20,0)) div nullif({n} + 2 * kept, 0))"
    sums = compared.filter("term IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    a, b = groups.select("lang", "source", "group_n", "kept"), groups.select("lang", F.col("source").alias("item"), F.col("group_n").alias("item_n"))
    sums = sums.join(a, ["lang", "source"]).join(b, ["lang", "item"]).withColumn("p", F.expr(zero("group_n"))).withColumn("q", F.expr(zero("item_n")))
    sums = sums.withColumn("value", F.expr("value + coalesce((kept - terms) * ((p - q) * (p - q) div (p + q)), 0)"))
    both = sums.select("lang", F.inline(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col("value").alias("value")) for x, y in (("source", "item"), ("item", "source"))))))
    ranked = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item")))
    pairs = ranked(both, ["lang", "source"]).withColumn("part", F.lit("pair"))
    terms = compared.filter("term IS NOT NULL").select("lang", "source", F.col("term").cast("string").alias("item"), "value")
    terms = ranked(terms, ["lang", "source"]).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN k ON c.lang = k.lang AND c.term = k.term),
gn AS (SELECT g.lang, g.source, coalesce(sum(s.n), 0) AS n FROM g LEFT JOIN s ON g.lang = s.lang AND g.source = s.source GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(s.n, 0) AS n,
  CAST(1 + ({SCALE}::HUGEINT * (coalesce(s.n, 0) + 2)) // (gn.n + 2 * v.v) AS BIGINT) AS p, CAST(1 + ({SCALE}::HUGEINT * (k.total + 2)) // (v.n + 2 * v.v) AS BIGINT) AS q
  FROM gn JOIN k ON gn.lang = k.lang JOIN v ON gn.lang = v.lang LEFT JOIN s ON gn.lang = s.lang AND gn.source = s.source AND k.term = s.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT), row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
