"""Document fingerprints by Order MinHash, in DataFrame and SQL functions only.

A text's tokens are runs without white space, cut after 16 characters, so that long
runs (texts without spaces) are sensitive to edits too.  Its k-mers of tokens are
numbered by occurrence, and each (k-mer, occurrence) has one hash.  The high bits of
the hash name one of the bins; in every bin the smallest hashes are selected, their
k-mers are put back in the order of the text, and the tuple is hashed.  Texts that
share k-mers in another order get other tuples, so the share of equal bins follows
the edit distance and not just the common k-mers.

All work on a text is on arrays of longs: hash and position share a long, as many
low bits as the number of tokens needs, so sorting needs no structures.  Equal k-mers
lie side by side once sorted, and an occurrence number is found by steps of falling
powers of two.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed shape of a fingerprint: tokens of a k-mer, k-mers of a tuple, bits of a bin's number, characters of a token.
GRAM, TUPLE, BIN_BITS, TOKEN = 3, 2, 6, 16
#: Neighbours in id order meet in buckets of about so many bytes of text, of so many rows at least; there are at most so many.
BUCKET_BYTES, BUCKET_ROWS, MAX_BUCKETS = 16_000_000, 16, 16_384


def with_signature(df: DataFrame, text: str, out: str, gram: int = GRAM, tuple_size: int = TUPLE, bin_bits: int = BIN_BITS) -> DataFrame:
    """``df`` with the signature of a text (not null): for each bin that is not empty, its number (high half) and 32 bits of its tuple's hash.

    A text of fewer tokens than ``gram`` has one k-mer, of all of them; a text without
    tokens has an empty signature.  A bin of fewer k-mers than ``tuple_size`` has a
    shorter tuple.
    """
    bin_of = lambda v: f"shiftrightunsigned({v}, {64 - bin_bits})"
    rest = ", ".join(f"get(_tokens, i + {n})" for n in range(1, gram))
    # Where the k-mer before is the same, earlier ones are counted by steps of falling powers of two.
    earlier = "aggregate(_steps, 0, (o, s) -> IF((get(_sorted, j - o - s) & ~_low) = (v & ~_low), o + s, o))"
    occurrence = f"CASE WHEN (get(_sorted, j - 1) & ~_low) = (v & ~_low) THEN {earlier} ELSE 0 END"
    places = f"sort_array(transform(filter(slice(_least, j + 1, {tuple_size}), x -> {bin_of('x')} = {bin_of('v')}), x -> CAST(x & _low AS INT)))"
    tuple_hash = f"aggregate({places}, CAST(42 AS BIGINT), (h, p) -> xxhash64(h, get(_grams, p)))"
    d = df.withColumn("_tokens", F.regexp_extract_all(F.col(text), F.lit(rf"\S{{1,{TOKEN}}}"), 0))
    d = d.withColumn("_bits", F.length(F.bin(F.size("_tokens"))))
    d = d.withColumn("_low", F.expr("shiftleft(1L, _bits) - 1")).withColumn("_steps", F.expr("transform(sequence(1, _bits), b -> shiftleft(1, _bits - b))"))
    d = d.withColumn("_grams", F.expr(f"transform(slice(_tokens, 1, greatest(size(_tokens) - {gram - 1}, least(size(_tokens), 1))), (t, i) -> xxhash64(t{', ' if rest else ''}{rest}))"))
    d = d.withColumn("_sorted", F.expr("sort_array(transform(_grams, (g, i) -> (g & ~_low) | i))"))
    d = d.withColumn("_ranked", F.expr(f"sort_array(transform(_sorted, (v, j) -> (xxhash64(get(_grams, CAST(v & _low AS INT)), {occurrence}) & ~_low) | (v & _low)))"))
    d = d.withColumn("_least", F.expr(f"filter(_ranked, (v, j) -> j < {tuple_size} OR {bin_of(f'get(_ranked, j - {tuple_size})')} <> {bin_of('v')})"))
    first = f"j = 0 OR {bin_of('get(_least, j - 1)')} <> {bin_of('v')}"
    d = d.withColumn(out, F.expr(f"sort_array(filter(transform(_least, (v, j) -> IF({first}, shiftleft({bin_of('v')}, 32) | ({tuple_hash} & 4294967295L), -1L)), x -> x >= 0))"))
    return d.drop("_tokens", "_bits", "_low", "_steps", "_grams", "_sorted", "_ranked", "_least")


def as_text(signature: Column | str) -> Column:
    """A signature as hex digits: two of the bin and eight of the tuple, bin by bin."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal bins among those that either signature has; two empty ones are alike."""
    bins = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def bucket_splits(keys: DataFrame, buckets: int) -> list[float]:
    """Bounds of the order key that cut the rows into about equal parts (approximate quantiles)."""
    if buckets < 2:
        return []
    shares = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    found = keys.agg(F.expr(f"percentile_approx(key, array({shares}), {max(10_000, 20 * buckets)})")).first()[0]
    return sorted(set(found or []))


def bucket_of(key: str, splits: list[float]) -> Column:
    """Number of the part that a key lies in, from 0 for the greatest keys; a binary search in a constant array."""
    if not splits:
        return F.lit(0)
    steps = ", ".join(str(1 << b) for b in reversed(range(len(splits).bit_length())))
    bounds = f"CAST(split('{','.join(map(repr, splits))}', ',') AS ARRAY<DOUBLE>)"
    return F.lit(len(splits)) - F.expr(f"aggregate(array({steps}), 0, (o, s) -> IF(get({bounds}, o + s - 1) < {key}, o + s, o))")


def with_next(docs: DataFrame, carried: str, buckets: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text and ``carried``) with ``next_text`` and ``next_<carried>`` of the next row by falling doc_id; after the last comes the first.

    Rows are put into buckets along (doc_id, hash of the text), null ids last, so one
    shuffle brings neighbours together; the first row of every bucket goes to the
    bucket before as well, for the last row there.  Only those first keys, at most
    MAX_BUCKETS, come to the driver.  Ids that many rows share are spread by the hash.
    """
    share = F.col("hash").cast("double") / F.lit(2.0**64) + 0.5
    keyed = docs.withColumn("hash", F.xxhash64("text")).withColumn("key", F.coalesce(F.col("doc_id").cast("double") + share, F.lit(-2e19) + share * 1e18))
    if buckets is None:
        rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        wanted = max((size or 0) / BUCKET_BYTES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        buckets = int(max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS, wanted)))
    keyed = keyed.withColumn("bucket", bucket_of("key", bucket_splits(keyed, buckets)))
    order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("hash"))
    heads = [(r["bucket"], r["first"][1], r["first"][2]) for r in keyed.groupBy("bucket").agg(F.max(order).alias("first")).orderBy("bucket").collect()]
    first = [{"bucket": b, "head_id": i, "head_hash": h, "before": heads[n - 1][0]} for n, (b, i, h) in enumerate(heads)]
    known = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(first)), "array<struct<bucket:int,head_id:bigint,head_hash:bigint,before:int>>")))
    known = F.broadcast(known.withColumnRenamed("bucket", "head_bucket"))  # MAX_BUCKETS rows at most
    same = (F.col("bucket") == F.col("head_bucket")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash"))
    places = F.array_compact(F.array(F.struct(F.lit(False).alias("copy"), F.col("bucket").alias("bucket")), F.when(F.col("before").isNotNull(), F.struct(F.lit(True).alias("copy"), F.col("before").alias("bucket")))))
    dealt = keyed.join(known, same, "left").withColumn("place", F.explode(places))
    dealt = dealt.select("doc_id", "text", carried, "hash", "place.copy", F.col("place.bucket").alias("bucket"))
    along = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("hash"))
    near = dealt.withColumn("next_text", F.lead("text").over(along)).withColumn(f"next_{carried}", F.lead(carried).over(along))
    return near.filter(~F.col("copy")).select("doc_id", "text", carried, "next_text", f"next_{carried}")


def edited_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of an edited one, with their likeness.

    ``docs`` has doc_id and text; a null text counts as empty.  The edited text has its
    last third (floor of n_chars/3 code points) replaced by the first as many of the
    next document, by falling doc_id.  Rows of one id follow each other by the hash of
    their texts, null ids come last; repeated rows count each; a single row is its own
    next.  Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, one row a document; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(with_signature(texts, "text", "sig"), "sig", buckets)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    near = near.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    near = with_signature(near.select("doc_id", n.alias("n_chars"), "sig", "next_sig", "edited"), "edited", "edited_sig")
    return near.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )
