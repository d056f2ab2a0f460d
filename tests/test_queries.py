"""Registered queries against their SQL on the smallest data folder."""

import math
import os

import pytest

FOLDER = "/root/testdata/sf0.001"


def names():
    from screenspark.plans import registry

    return sorted(registry.SQL)


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return 0.0 if isinstance(v, float) and v == 0 else str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no data folder")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, duck, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in result.fetchall())


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    import __spark_entry__

    if os.path.isdir(FOLDER):
        assert __spark_entry__.entry(spark).count() == 10


#: Columns that decide something: on the middle data folder each branch must occur.
DECISIONS = {
    "ag1_topk_selection": ["selection_mode"], "ag5_consistency": ["consistency"], "ag28_split_roles": ["role"], "src7_chain_blocks": ["block"], "src16_resolve_site": ["mode", "source"], "wn4_score_gaps": ["close_competition"],
    "sc10_suggest": ["tier"], "sc11_diversity_group": ["diversity_group"], "sc12_diversify": ["tier", "seen"], "src13_path_repair": ["reason", "auto"], "ge14_item_features": ["status", "warning", "mouth_occlusion"], "sm4_late_events": ["n_failed"],
}


@pytest.mark.parametrize("name", sorted(DECISIONS))
def test_no_decision_is_constant(spark, name):
    import __spark_entry__

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no data folder")
    rows = __spark_entry__.queries()[name](spark, folder).select(*DECISIONS[name]).distinct().collect()
    assert all(len({r[c] for r in rows}) > 1 for c in DECISIONS[name])
