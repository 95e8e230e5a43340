"""Every registered query runs; those with an oracle give DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from tessera.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUICK = ["monthly_series", "rolling_deseason", "indicator_profile", "completeness_qc", "kndvi_transform", "file_name_parts", "points_in_polygons", "period_slices", "matrix_profile_m12", "matrix_profile_m24", "top_motifs", "overlap_pairs", "mwu_floor_grid", "mann_kendall", "xcorr_lags", "mwu_shift", "mwu_p_values", "floor_flags", "annual_trend", "rolling_pearson", "bh_fdr", "fdr_summary", "xcorr_peak", "recent_trend", "annual_count_by_month", "index_by_precedence", "half_open_dates", "raster_mask", "half_even_rounding", "matrix_profile_sides", "daily_profile", "lag_intervals", "significance_changes", "binseg_breaks", "pelt_breaks_light", "segmentation_costs", "break_summary", "orders_in_validity", "projected_points", "profile_in_sql", "running_anomalies", "index_lines", "seasonal_lines", "regions_from_names", "masked_counts", "index_as_it_is", "index_from_ndvi", "region_bounds", "null_model", "null_model_of_pairs", "window_sweep_rolling", "motif_groups"]
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([float(v[i]) if isinstance(v[i], float) else v[i] for i in order]) for v in values)


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry_works_without_the_optional_parts():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert registry.flagship(spark, FOLDER).count() > 0
