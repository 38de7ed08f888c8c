"""Registered queries against their SQL at the smallest scale.

A spread over all modules runs by default; PIXELWEAVE_ALL=1 runs every oracle.
"""

import os

import pytest

from oracle import compare, duck
from pixelweave.plans import registry

SF = "/root/testdata/sf0.001"
CORE = """msd_ensemble track_features straightness linking_stats direction_autocorrelation velocity_columns
zproject normalize_percentile image_calculator_divide background_auto_roi histogram_equalize region_properties texture_glcm
mean_filter variance_filter calcium_events power_spectrum smooth_savgol ecdf event_match
gaussian_blur sobel grayscale_opening binary_erosion connected_components distance_transform
nearest_neighbour neighbour_counts duplicate_remove molecular_merge render_ash render_gaussian
localize_phasor linear_unmix boxes_to_yolo read_spt_csv stream_fps stream_latest_n""".split()
ORACLES = registry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("PIXELWEAVE_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(registry.queries()[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
