"""Registered queries against DuckDB.  GRIDLOOM_FULL=1 runs every query; the default is one or more per family."""

import os

import pytest

import compare
from gridloom.queries import load

SF = os.environ.get("GRIDLOOM_SF", "/root/testdata/sf0.01")
QUERIES, ORACLE = load()
SOME = """p1_sentinel_to_null p13_finite_complete_case p14_impute_train_median f4_parse_range f9_zone_hour_shift j8_date_spine j10_nearest_event_distance
j11_backward_asof j13_pairwise_gaps j17_rank_in_reference a2_last_row_per_key a14_quantile_bins a22_multi_scope_metrics w4_mad_outlier_scrub w7_ewma_mean_sd
w15_bounded_fill w19_chain_linked_index k2_append_history_keep_last k9_weekly_fallback_mart s3_read_event_counts s10_choose_block e3_cluster_robust
e5_newey_west_mean e14_threshold_ar e22_variance_ratio e46_mann_whitney b2_book_summary b13_episodes r4_rate_catalogue r6_derived_daily m5_walk_forward_folds
m19_conformal_coverage q3_expectations t2_last_scan_of_day t5_signal_episodes t6_late_corrections""".split()
NAMES = sorted(ORACLE) if os.environ.get("GRIDLOOM_FULL") else SOME


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_registry():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 200


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, msg, _ = compare.compare(spark, con, SF, name, QUERIES[name], ORACLE[name])
    assert status in ("ok", "EMPTY"), msg


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) > 0 and set(rows[0].asDict()) == {"bin", "n", "closure_pp", "se"}
