"""Profiles and cleaning over all features."""

import __spark_entry__
from wakefold.schemas import FEATURES

FOLDER = "/root/testdata/sf0.001"


def test_no_feature_is_left_out(spark):
    queries = __spark_entry__.queries()
    for name in ("clean_nonfinite_all", "impute_median_all", "standard_scale_all"):
        assert set(FEATURES) <= set(queries[name](spark, FOLDER).columns)
    bins = queries["quantile_histogram_all"](spark, FOLDER).select("feature", "bin").collect()
    assert {r["feature"] for r in bins} == set(FEATURES) and max(r["bin"] for r in bins) == 29
