"""Source divergence against its SQL and a plain version."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from edge_rows import ROWS
from screenspark.llm import source_divergence as sd


def test_terms():
    text = "The CAT's über-Größe, 日本 x9y\x00z ÄB\t"
    assert sd.terms_of(text.encode()) == [t.encode() for t in ["the", "cat", "s", "über", "größe", "日本", "x", "y", "z", "Äb"]]


def brute(rows, least=10, top=10):
    """Rows are (text, lang, source)."""
    lower = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", l or "", s or "") for t, l, s in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda n: {t: 1 + 10**9 * (n[t] + 2) // (sum(n[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(sorted(items)[:most])]
    return sorted(out)


def made(spark, rows, **settings):
    df = spark.createDataFrame([(t, l, s, n, n) for n, (t, l, s) in enumerate(rows)], "text string, lang string, source string, term long, n long").repartition(3)
    return sorted(tuple(r) for r in sd.source_divergence(df, **settings).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("settings", [{}, {"cell_terms": 3, "block_sources": 2}])
def test_equals_plain_version(spark, monkeypatch, settings):
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["ß", "é", "日本", "Z", "z"]
    rows = [(" ".join(rng.choices(words, weights=range(1, 26), k=rng.choice([0, 3, 30]))), rng.choice(["a", "b", None]), rng.choice(["s1", "s2", "s3", "é", None])) for _ in range(150)]
    rows += [("alone", "c", "s1"), (None, "c", "s2"), (None, None, None), ("wa", "d", "only"), ("q " * 10, "e", "s1")]
    assert made(spark, rows, **settings) == brute(rows)
    assert made(spark, rows, least_docs=3, top=2, **settings) == brute(rows, 3, 2)


def test_small_counters_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(sd, "HELD_TERMS", 5)
    rows = [(f"a b c{i} d e f", "x", f"s{i % 3}") for i in range(40)]
    assert made(spark, rows) == brute(rows)


def test_edge_rows(spark, docs, no_docs):
    want = brute([(r[1], r[2], r[3]) for r in ROWS], 2)
    assert sorted(tuple(r) for r in sd.source_divergence(docs, least_docs=2).collect()) == want
    assert sd.source_divergence(no_docs).collect() == []


def test_shares_beyond_64_bits():
    import numpy as np

    n = np.array([[10**12, 5]])
    assert sd.shares(n, np.array([[10**12 + 5]]), 2).tolist() == [[1 + 10**9 * (10**12 + 2) // (10**12 + 9), 1 + 7 * 10**9 // (10**12 + 9)]]


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no data folder")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(sd.SQL).fetchall())
    assert want and sorted(tuple(r) for r in sd.source_divergence(spark.read.parquet(f"{folder}/documents.parquet")).collect()) == want
