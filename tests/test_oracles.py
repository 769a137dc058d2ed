"""Registered queries against their SQL oracles on the smallest tables.

One or two queries per family run by default; ``FULL_ORACLE=1`` runs all of
them, as ``python -m tests.oracle_check 0.01`` does on larger tables.
"""

import os

import pytest

from tallyloom.plans import REGISTRY
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
CORE = """S03_delimited_parts S07_blank_line_records S08_xml_track_points S09_nested_json S10_html_fields S11_drifting_layouts
P09_wide_counts_zero P11_split_columns P17_unnest P19_validate_records P20_lump_rare P21_order_by_median P24_sample_rows
J07_sum_triples J08_cooccurring_pairs J09_dictionary_repair J12_role_join O04_top_with_ties O05_rank_bands U03_missing_ids
U04_dense_calendar A04_six_numbers A07_held_by_all A13_confusion_summary A16_radius_counts A18_box_stats A20_density_grid
W07_half_life W12_not_sum_of_previous W13_runs_with_sum W16_intervals W17_chain_arrangements T05_top_terms T09_feature_rows
T10_class_correlation G03_components G13_contained_totals G14_rule_edges TS01_stream_frames TS02_stream_aligned TS06_change_point
TS10_trade_returns TS11_impute_gaps TS12_trend_forecast M01_coefficient_table M03_anova M09_agreement M16_near_zero_variance
M20_nearest_centroid M21_knn_classify M27_outcome_shares X03_numbers_in_text X08_degree_text X14_url_parts F02_function_per_group
F04_safe_function_per_group""".split()
NAMES = sorted(REGISTRY) if os.environ.get("FULL_ORACLE") else CORE


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problems, _ = compare(REGISTRY[name], spark, con, SF_DIR)
    assert not problems


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
