"""Bench of headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rainshade.queries import registry  # noqa: E402
from rainshade.session import local_session  # noqa: E402

HEADLINE = ("e1_classify_months", "e3_story_log10_prob", "r5_nyear_suite", "r8_markov_paths", "r10_random_suite", "r1_moving_block_bootstrap",
            "a3_describe_by", "a7_percentile_curve", "a16_exceedance_curve", "j9_interp_join", "j15_inverse_cdf_join", "q1_soil_moisture_deficit",
            "q2_soil_moisture_monthly", "e7_restriction_scenario", "e9_eco_scores", "w7_spell_counts", "w12_flow_duration", "p9_threshold_grid")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    queries = registry.queries()
    # one short job starts the executor threads before the clock does
    spark.range(1000).selectExpr("sum(id)").collect()
    times, rows, failed = {}, {}, {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        try:
            rows[name] = _run(queries[name](spark, sf_dir))
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # the other queries still have times
            failed[name] = str(e).strip().splitlines()[0][:300]
    stories, months = rows.get("e3_story_log10_prob", 0), rows.get("r10_random_suite", 0)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
                      "stories_scored": stories, "seconds_per_story_scored_twice": round(times.get("e3_story_log10_prob", 0) / max(stories, 1), 6),
                      "random_story_months": months, "seconds_per_random_story": round(times.get("r10_random_suite", 0) / max(months / 12, 1), 6), "failed": failed}))
    spark.stop()
    if failed:
        sys.exit(1)


def _run(df) -> int:
    """Compute every row and column without bringing them to the driver; the count comes from the same pass."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


if __name__ == "__main__":
    main()
