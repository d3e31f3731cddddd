"""Every registered query of the domain against its SQL, and the entry points."""

import duckdb
import pytest

from tastegrid import queries as Q

Q.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["a01_static_vector", "a06_fused_vector", "x04_base_match", "q01_top_items", "c01_preset_catalog", "c03_seed_network", "j12_align_episodes", "j14_franchise_parent", "p12_season_from_title", "r01_build_spec", "t01_stream_history", "t02_stream_impressions", "u07_smart_merge", "w05_interleave", "s15_write_catalogs", "w09_diversity_caps", "r17_sort_orders", "r16_many_texts", "r01_rows", "c10_combined_search", "c17_merged_catalog", "x06_item_match", "a21_affinity_report", "j16_catalog_overlap"]


def plain(x):
    if x is None or x != x:
        return ""
    if isinstance(x, float):
        return f"{x:.5f}"
    return str(int(x)) if isinstance(x, bool) else f"{x:.5f}" if isinstance(x, int) else str(x)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, sf, db, name):
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = db.execute(Q.SQL[name])
    assert sorted(d[0] for d in rel.description) == cols
    place = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted([plain(r[i]) for i in place] for r in rel.fetchall())
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["owner", "item_id", "score", "pos"] and set(e.oracle_sql()) <= set(e.queries())
