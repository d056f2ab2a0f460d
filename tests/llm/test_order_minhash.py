"""Order MinHash against a plain version in Python, and the neighbours in id order."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from edge_rows import ROWS
from screenspark.llm import order_minhash as om


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def chained(*values):
    """XXH64 over several values as Spark has it: the hash of one is the seed of the next."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8 if isinstance(v, Long) else 4, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return Long(signed(h))


class Long(int):
    pass


def brute_signature(text):
    tokens = re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)
    grams = [chained(*tokens[i : i + 3]) for i in range(max(len(tokens) - 2, min(len(tokens), 1)))]
    low = (1 << len(tokens).bit_length()) - 1 if tokens else 1
    seen, ranked = {}, []
    for i, g in sorted(enumerate(grams), key=lambda x: (int(x[1]) & ~low, x[0])):
        key = int(g) & ~low
        ranked.append((int(chained(g, seen.get(key, 0))) & ~low | i, i))
        seen[key] = seen.get(key, 0) + 1
    out, bins = {}, {}
    for h, i in sorted(ranked):
        bins.setdefault((h % 2**64) >> 58, []).append(i)
    for b, places in bins.items():
        h = Long(42)
        for i in sorted(places[:2]):
            h = chained(h, grams[i])
        out[b] = h % 2**32
    return "".join(f"{b:02x}{h:08x}" for b, h in sorted(out.items())), out


def brute_likeness(a, b):
    either = a.keys() | b.keys()
    return sum(a.get(k) == b.get(k) for k in either) / len(either) if either else 1.0


def brute(rows):
    """Rows are (doc_id, text), ordered by falling id (null last), then falling hash of the text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    out = []
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        (fp, a), (edited_fp, b), (_, c) = map(brute_signature, (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp, edited_fp, round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=repr)


def test_equals_plain_version(spark):
    rng = random.Random(5)
    words = ["ab", "cde", "über", "日本語テキスト", "x" * 40, "same", "same"]
    rows = [(rng.choice([None, *range(30), 2**60 + rng.randrange(9)]), " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 5, 40, 300])))) for _ in range(80)]
    rows += [(7, None), (7, ""), (8, "same " * 500), (8, "same " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    for buckets in (None, 1, 7, 40):
        assert got(om.edited_fingerprints(df, buckets)) == want


def test_edge_rows(spark, docs, no_docs):
    rows = [(r[0], r[1]) for r in ROWS]
    assert got(om.edited_fingerprints(docs)) == brute(rows)
    assert om.edited_fingerprints(no_docs).collect() == []
    (one,) = om.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")).collect()
    assert (one.near_next, one.n_chars) == (1.0, 17)


def test_order_counts_and_not_only_content(spark):
    rng = random.Random(1)
    parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(4)) for _ in range(200)]
    moved = parts[:]
    rng.shuffle(moved)
    near = parts[:190] + [f"other{i}" for i in range(10)]
    rows = [(0, " ".join(parts)), (1, " ".join(moved)), (2, " ".join(near))]
    d = om.with_signature(spark.createDataFrame(rows, "doc_id long, text string"), "text", "sig")
    sig = {r.doc_id: r.sig for r in d.collect()}
    d = d.select("doc_id", om.likeness("sig", F.array(*map(F.lit, sig[0]))).alias("near"))
    near = {r.doc_id: r.near for r in d.collect()}
    assert near[0] == 1.0 and near[2] > 0.7 and near[1] < 0.5 * near[2]
