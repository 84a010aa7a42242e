"""Registered queries against DuckDB on the smallest data, a few per family."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["a1_index_stats", "a3_otsu", "a4_class_composition", "a5_transition_matrix", "a8_scene_quality", "a9_sar_stats", "a14_ols_trend", "c5_ground_regions",
           "f9_annotate_query", "f13_extract_claims", "g1_connected_components", "j5_search_optical", "j6_search_sar", "j12_match_claims", "m1_tile_scenes",
           "p10_substitute_indices", "s2_validate_files", "s5_normalise_bands", "s12_last_write_wins", "t2_stage_metrics_stream", "w8_morphology"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in res.fetchall())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
