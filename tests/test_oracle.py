"""Registered queries against their SQL twins on the smallest given tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
# All of them with ORACLE_ALL=1; by default one or two per operator family.
DEFAULT = ["flagship_top_objects", "W1_temporal_events", "A3_objects_rollup", "A6_weighted_stats", "A11_binned_zeropoint", "A12_sigma_clip", "A22_reference_frame", "F8_boundary_buffer",
           "F17_isolated_stars", "E5_sky_names", "E20_wcs_round_trip", "E23_packed_epoch", "J2_cross_match", "J8_brightest_star", "J10_asof_nearest", "J17_recovery_match",
           "W3_extend_events", "W4_event_significance", "W13_gap_limited_window", "P5_box_light_curve", "P8_forced_psf", "G1_spatial_groups", "G10_link_detections",
           "C2_shape_features", "C6_folded_features", "S6_whitespace_table", "S8_header_table", "ST2_streaming_events"]
NAMES = sorted(SQL) if os.environ.get("ORACLE_ALL") else DEFAULT


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    ok, message = compare(spark, duck, name, queries()[name], SQL[name], SF)
    assert ok, message


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(SQL) <= set(queries())
