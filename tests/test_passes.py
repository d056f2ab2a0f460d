"""Work of shared steps: what is computed once, and what is not multiplied."""

import re

from pyspark.sql import functions as F

from screenspark.operators import consensus, residues, scoring
from screenspark.plans import registry, views

FOLDER = "/root/testdata/sf0.001"


def test_wanted_keys_are_not_multiplied(spark):
    keys = spark.createDataFrame([(1, f"{c}:{n}{i}") for c in ("A", "Z", "") for n in range(12) for i in ("", ":X")], "structure long, key string")
    res = spark.createDataFrame([(1, k) for k in ("A:1", "A:3:X", "A:3:Y", "B:5", "B:5:X", "B:7:X", "A:9", "B:9")], "structure long, key string")
    out = residues.match_residues(keys, res)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    got = {r.key: (r.matched_key, r.mode) for r in out.collect()}
    assert len(got) == 72
    assert got["A:1"] == ("A:1", "exact") and got["A:1:X"] == ("A:1", "chain_number") and got["A:2:X"] == ("A:1", "offset_-1") and got["A:4:X"] == ("A:3:X", "offset_-1")
    assert got["Z:5"] == ("B:5", "any_chain_icode") and got["Z:7"] == ("B:7:X", "any_chain") and got["Z:9"] == (None, "unmatched") and got[":3:X"] == ("A:3:X", "any_chain_icode")


def test_rows_behind_the_ok_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.createDataFrame([("c", "v", str(i), i / 10, "ok") for i in range(10)], "candidate string, variant string, item string, site_hit_fraction double, status string").mapInArrow(look, "candidate string, variant string, item string, site_hit_fraction double, status string")
    scored = scoring.rule_score(scoring.keep_ok(d))
    assert scored.agg(F.count("rule_score")).first()[0] == 10
    assert seen.value == 10


def test_near_ties_are_counted_along_the_order(spark):
    scores = [0.50 + 0.013 * (i % 41) for i in range(200)] + [None, None]
    d = spark.createDataFrame(list(enumerate(scores)), "candidate long, consensus_score double")
    out = consensus.near_ties(d, "consensus_score", 0.03)
    frames = re.findall(r"RangeFrame, ([^,]+),", out._jdf.queryExecution().optimizedPlan().toString())
    assert frames and all(f.startswith("unboundedpreceding") for f in frames)
    units = [None if s is None else round(s * 1e9) for s in scores]
    want = {i: 0 if u is None else sum(w is not None and abs(w - u) <= 30_000_000 for w in units) - 1 for i, u in enumerate(units)}
    assert {r.candidate: r.near_ties for r in out.collect()} == want


def test_cards_read_their_items_once(spark, monkeypatch):
    made = []
    items = views.items
    monkeypatch.setattr(views, "items", lambda *a, **k: made.append(1) or items(*a, **k))
    assert registry.QUERIES["fl8_candidate_cards"](spark, FOLDER).count() > 0
    assert len(made) == 1
