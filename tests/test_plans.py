"""Shapes of the physical plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import SF
from signalframe.plans import fixtures
from signalframe.plans.catalog import QUERIES

# Queries whose building writes tables or fits models.
EAGER = {
    "stream_silver", "stream_quota", "silver_upsert", "bronze_scan", "publish_run", "gold_scan", "gold_scan_rejects",
    "fit_global", "score_global", "score_per_series", "score_global_actions",
    "predictions_sink", "features_sink", "metrics_sink", "coerce_columns",
    "silver_versions", "changed_keys", "gold_versions", "observed_manifest", "run_manifest_document",
    "stream_quota_requests", "stream_subscriptions", "stream_verifications",
    "pooled_calibration", "walkforward_pooled", "walkforward_pooled_bounds", "fit_offsets", "offsets_optimum",
    "stored_audit", "h7_features_bucketed", "predictions_wide_bucketed", "per_series_optimum",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(QUERIES[name](spark, SF)) for name in sorted(set(QUERIES) - EAGER)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_joins(plans, name):
    text = plans[name]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["gold_features", "h7_features", "predictions", "impute_ffill", "baseline_probs", "direction_target"])
def test_one_exchange_after_the_aggregate(plans, name):
    """One for the map-side-combined observations, one for all windows, and a single sort."""
    text = plans[name]
    assert text.count("Exchange hashpartitioning") == 2 and text.count("Sort [") == 1


def test_scan_reads_only_what_it_needs(spark):
    text = plan(fixtures.observations(spark, SF))
    assert text.split("FileScan parquet [")[1].split("]")[0].count("#") == 5
    text = plan(fixtures.silver_events(spark, SF).filter(F.col("series_id") == "click"))
    assert "EqualTo(event_type,click)" in text.split("PushedFilters")[1]


def test_sums_are_combined_before_the_shuffle(spark):
    text = plan(fixtures.observations(spark, SF))
    assert "partial_sum" in text.split("Exchange")[1]


def test_medians_are_made_once(plans):
    assert plans["h7_features"].count("sort_array(") == 1


def test_no_python_outside_the_fits(plans):
    for name, text in plans.items():
        fits = name.startswith(("walkforward_", "fit_", "score_", "permutation_")) and name != "walkforward_folds"
        assert ("InPandas" in text or "ArrowEval" in text) == fits, name


@pytest.mark.parametrize("name", ["h7_features_bucketed", "predictions_wide_bucketed"])
def test_tables_in_buckets_need_no_exchange(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Exchange" not in text and "Sort [" not in text and "Bucketed: true" in text


def test_moving_medians_add_no_exchange(plans):
    text = plans["h7_features_moving"]
    assert text.count("Exchange hashpartitioning") == 2 and text.count("Sort [") == 1 and "sort_array(" not in text
