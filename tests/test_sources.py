"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainshade.sources import readers as R
from rainshade.sources import writers as K


def test_banner_csv_by_comment_and_by_position(spark, tmp_path):
    schema = T.StructType([T.StructField("month", T.IntegerType()), T.StructField("v", T.DoubleType())])
    (tmp_path / "a.csv").write_text("# one\n# two\n,v\n1,2.5\n2,\n")
    got = [tuple(r) for r in R.read_banner_csv(spark, str(tmp_path / "a.csv"), schema, comment="#").collect()]
    assert got == [(1, 2.5), (2, None)]
    (tmp_path / "b.csv").write_text("free text, with a comma\n,v\n1,2.5\n2,\n\n")
    got = [tuple(r) for r in R.read_banner_csv(spark, str(tmp_path / "b.csv"), schema, skip=1).collect()]
    assert got == [(1, 2.5), (2, None)]


def test_story_dir_takes_id_from_file_name(spark, tmp_path):
    for name in ("rsl-000001-good", "rsl-000002-bad"):
        (tmp_path / f"{name}.csv").write_text("date,precip_class,temp_class,rest,year,month,rest_per\n2024-07-01,A,H,0.5,2024,7,0.7\n")
    got = {(r["story_id"], r["irr_type"], r["rest_per"]) for r in R.read_story_dir(spark, str(tmp_path)).collect()}
    assert got == {("rsl-000001-good", "good", 0.7), ("rsl-000002-bad", "bad", 0.7)}


def test_transitions_and_mapper(spark, tmp_path):
    t = tmp_path / "t"
    t.mkdir()
    (t / "Mar_transitions.csv").write_text('# free text\n,"AT,AP","C,D"\n"AT,AP",0.25,1\n"C,D",0.75,0\n')
    got = {tuple(r) for r in R.read_transitions(spark, str(t), ["AT,AP", "C,D"]).collect()}
    assert got == {(3, "A-A", "A-A", 0.25), (3, "A-A", "C-D", 0.75), (3, "C-D", "A-A", 1.0), (3, "C-D", "C-D", 0.0)}
    (t / "initial.csv").write_text('# free text\n,"AT,AP","C,D"\nJan,0.4,0.6\n')
    assert {tuple(r) for r in R.read_initial(spark, str(t / "initial.csv"), ["AT,AP", "C,D"]).collect()} == {(1, "A-A", 0.4), (1, "C-D", 0.6)}
    m = tmp_path / "m"
    m.mkdir()
    (m / "D-ND_rest.csv").write_text("quantile,9,10\n0.01,0.0,0.5\n")
    assert {tuple(r) for r in R.read_quantile_mapper(spark, str(m), [9, 10]).collect()} == {("D-ND", 0.01, 9, 1e-8), ("D-ND", 0.01, 10, 0.5)}


def test_grid_point_takes_each_axis_alone_and_first_on_ties(spark):
    rows = [("2000-01-01", la, lo, la * 10 + lo) for la in (-44.0, -43.0) for lo in (171.0, 172.0)]
    grid = spark.createDataFrame(rows, "date string, lat double, lon double, rain double").withColumn("date", F.to_date("date"))
    r = R.grid_point_series(grid, -43.5, 171.6, (1999, 2001), ["rain"]).collect()
    assert [(x["lat"], x["lon"]) for x in r] == [(-44.0, 172.0)] and r[0]["doy"] == 1


def test_cached_is_read_until_recalc(spark, tmp_path):
    path = str(tmp_path / "c")
    assert R.read_cached(spark, path, lambda: spark.range(3)).count() == 3
    assert R.read_cached(spark, path, lambda: spark.range(5)).count() == 3
    assert R.read_cached(spark, path, lambda: spark.range(5), recalc=True).count() == 5


def test_pack_rounds_half_even_and_checks_range(spark):
    df = spark.createDataFrame([("D", "H", -3.005, 0.0125, None)], "precip_class string, temp_class string, log10_prob_irrigated double, rest double, rest_per double")
    r = K.pack_scaled_int(df).first()
    assert (r["precip_class"], r["temp_class"], r["rest"], r["rest_per"]) == (0, 2, 12, 65535)
    assert r["log10_prob_irrigated"] in (300, 301)
    with pytest.raises(Exception, match="out of packed range"):
        K.pack_scaled_int(df.withColumn("rest", F.lit(99.0))).collect()


def test_report_leaves_sums_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.125, 0.5, 7.0)], "month int, prob double, sum_prob double, n_count double")
    K.write_report_csv(df, str(tmp_path / "r"), "first\nsecond")
    r = spark.read.csv(str(tmp_path / "r"), header=True).first()
    assert (r["prob"], r["sum_prob"], r["n_count"]) == ("12.5%", "0.5", "7.0")
    assert sorted(x["value"] for x in spark.read.text(str(tmp_path / "r.comment")).collect()) == ["# first", "# second"]
