"""Registered queries beside their check SQL on the smallest data folder, where it is present."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from tools.check import TABLES, compare

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

# one or two quick queries per section; tools/check.py runs all of them
NAMES = ("s1_read_banner_csv", "s5_read_quantile_mapper", "k3_pack_scaled_int", "p9_threshold_grid", "p12_bounded_suite", "p18_growth_correction", "j8_nearest_quantile",
         "j9_interp_join", "j15_inverse_cdf_join", "a3_describe_by", "a6_quantile_table", "a16_exceedance_curve", "a24_spell_summary", "w7_spell_counts", "w12_flow_duration",
         "w13_percentile_of_score", "t3_best_fit_stories", "u5_compare_tables", "f7_reference_et", "f17_z_to_percentile", "q1_soil_moisture_deficit", "r3_pull_sims",
         "r8_markov_paths", "m6_mutual_info_discrete", "e1_classify_months", "e3_story_log10_prob", "e7_restriction_scenario", "e9_eco_scores", "x5_extra_scenarios")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    out = compare(name, entry.queries()[name](spark, str(DATA)), con, entry.oracle_sql()[name])
    assert out.startswith(("ok", "CLOSE")), out


def test_entry_and_registry(spark):
    assert len(entry.entry(spark).columns) == 8
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_key_has_a_record_at_any_size(spark, folder):
    # means draw together as rows grow, and limits set by value would leave a month without a dry or another class
    from rainshade.queries.base import Tables
    path = DATA.parent / folder
    if not path.exists():
        pytest.skip("no such test tables")
    classes = Tables(spark, str(path)).rest_classes.groupBy("month").pivot("precip_class").count().collect()
    assert len(classes) == 12 and all(r["D"] and r["W"] and r["A"] for r in classes)


@pytest.mark.parametrize("name", ["r1_moving_block_bootstrap", "r2_sim_statistic", "r3_pull_sims", "x1_simulation_function"])
def test_resampling_runs_on_the_large_folder(spark, name):
    path = DATA.parent / "sf0.1"
    if not path.exists():
        pytest.skip("no such test tables")
    entry.queries()[name](spark, str(path)).write.format("noop").mode("overwrite").save()
