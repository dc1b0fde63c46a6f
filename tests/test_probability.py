"""Story probability against golden values, and transition rules."""

import math

import pytest

from rainshade.operators import sampling as R
from rainshade.plans import stories as ST

# Step probabilities used by the three best-fit stories, (month, from, to, p).
STEPS = [
    (1, "A-A", "A-A", 0.3341902313624679), (1, "A-D", "H-D", 0.27205882352941174), (1, "A-W", "H-A", 0.13986013986013987),
    (2, "A-A", "H-D", 0.13910761154855644), (2, "H-A", "A-A", 0.3284671532846715), (2, "H-D", "C-D", 0.055248618784530384),
    (3, "A-A", "A-A", 0.30809399477806787), (3, "C-D", "A-A", 0.375), (3, "H-D", "A-W", 0.04878048780487805),
    (4, "A-A", "A-A", 0.2709497206703911), (4, "A-A", "A-W", 0.1340782122905028), (4, "A-W", "A-A", 0.2922077922077922),
    (5, "A-A", "A-A", 0.30246913580246915), (5, "A-A", "A-W", 0.10802469135802469), (5, "A-W", "H-A", 0.14450867052023122),
    (7, "A-A", "A-D", 0.08587257617728532), (7, "A-A", "C-A", 0.11634349030470914), (7, "A-A", "C-W", 0.10803324099722991),
    (8, "A-D", "A-A", 0.2375), (8, "C-A", "A-A", 0.3194444444444444), (8, "C-W", "A-A", 0.37410071942446044),
    (9, "A-A", "A-A", 0.29945054945054944), (9, "A-A", "A-D", 0.1043956043956044), (9, "A-A", "H-A", 0.14560439560439561),
    (10, "A-A", "A-A", 0.31741573033707865), (10, "A-D", "A-D", 0.2848101265822785), (10, "H-A", "A-A", 0.32075471698113206),
    (11, "A-A", "A-A", 0.3116531165311653), (11, "A-A", "A-W", 0.0921409214092141), (11, "A-D", "A-D", 0.18354430379746836),
    (12, "A-A", "A-D", 0.1065989847715736), (12, "A-D", "A-A", 0.28888888888888886), (12, "A-W", "A-W", 0.20863309352517986),
]
INITIAL = [(7, "A-A", 0.27020958083832336)]

# The stories as (temperature, rain, rest, quantile) from July on.
STORIES = {
    "baseline": [("A", "A", 0.0, 0.0), ("A", "D", 0.0, 0.0), ("A", "A", 0.1384562670417198, 0.7), ("A", "A", 1e-08, 0.5), ("A", "A", 1e-08, 0.5),
                 ("A", "W", 0.1213470907790358, 0.8), ("A", "W", 0.5201951850946966, 0.9), ("H", "A", 0.644869892925161, 0.8),
                 ("A", "A", 0.3040816738254581, 0.5), ("A", "A", 0.4920027082819732, 0.8), ("A", "W", 0.0, 0.0), ("H", "A", 0.0, 0.0)],
    "hurt": [("A", "A", 0.0, 0.0), ("C", "A", 0.0, 0.0), ("A", "A", 0.0144274139612665, 0.7), ("H", "A", 0.0120411590461841, 0.7), ("A", "A", 1e-08, 0.8),
             ("A", "A", 0.4248643302385105, 0.95), ("A", "D", 0.1436983112595606, 0.5), ("H", "D", 0.8439035549837861, 0.5),
             ("C", "D", 0.8543888761658682, 0.7), ("A", "A", 0.3844599895169835, 0.5), ("A", "A", 0.0, 0.0), ("A", "W", 0.0, 0.0)],
    "scare": [("A", "A", 0.0, 0.0), ("C", "W", 0.0, 0.0), ("A", "A", 1e-08, 0.6), ("A", "D", 0.0160735224086478, 0.8), ("A", "D", 1e-08, 0.7),
              ("A", "D", 0.0062830635250221, 0.5), ("A", "A", 0.4203636201125156, 0.9), ("A", "A", 0.8914354851899087, 0.95),
              ("H", "D", 0.7843240029359122, 0.9), ("A", "W", 0.8215149376033293, 0.95), ("A", "A", 0.0, 0.0), ("A", "A", 0.0, 0.0)],
}
EXPECTED = {"hurt": (-11.160953842806723, -6.689227619973768), "scare": (-13.499197492079375, -6.9763187467990395),
            "baseline": (-11.175497730336085, -6.652618985055745)}


def tables(spark, stories=STORIES):
    rows = [(name, 2024 + (i > 5), (i + 6) % 12 + 1, i, t, p, rest, q) for name, months in stories.items() for i, (t, p, rest, q) in enumerate(months)]
    df = spark.createDataFrame(rows, "story_id string, year int, month int, seq int, temp_class string, precip_class string, rest double, rest_per double")
    return (df, spark.createDataFrame(STEPS, "month int, from_state string, to_state string, p double"),
            spark.createDataFrame(INITIAL, "month int, state string, p double"))


def test_golden_probabilities(spark):
    df, trans, init = tables(spark)
    got = {r["story_id"]: (r["log10_prob_irrigated"], r["log10_prob_dryland"]) for r in ST.story_log10_probs(df, trans, init).collect()}
    for name, want in EXPECTED.items():
        assert got[name] == pytest.approx(want, abs=1e-12)
    single = {r["story_id"]: r["log10_prob"] for r in ST.story_log10_prob(df, trans, init, add_irr_prob=False).collect()}
    assert single["hurt"] == pytest.approx(EXPECTED["hurt"][1], abs=1e-12)


def test_zero_step_is_minus_infinity_and_missing_step_fails(spark):
    df, trans, init = tables(spark, {"hurt": STORIES["hurt"]})
    zero = trans.selectExpr("month", "from_state", "to_state", "if(month = 9, 0D, p) as p")
    assert ST.story_log10_prob(df, zero, init).first()["log10_prob"] == -math.inf
    with pytest.raises(Exception, match="no probability"):
        ST.story_log10_prob(df, trans.where("month <> 9"), init).collect()
    # steps that leave May, June or July are not needed at all
    assert ST.story_log10_prob(df, trans.where("month not in (5, 6, 7)"), init).first()["log10_prob"] == pytest.approx(EXPECTED["hurt"][0], abs=1e-12)


def test_markov_paths_follow_transitions_and_repeat(spark):
    states = ["A-A", "A-D", "H-D"]
    rows = [(m, a, b, p) for m in range(1, 13) for a in states for b, p in zip(states, (0.5, 0.3, 0.2))]
    trans = spark.createDataFrame(rows, "month int, from_state string, to_state string, p double")
    sims = spark.range(4000).withColumnRenamed("id", "sim")
    a = {r["sim"]: tuple(r["states"]) for r in R.markov_paths(sims, trans, seed=3, unique=False).collect()}
    b = {r["sim"]: tuple(r["states"]) for r in R.markov_paths(sims.repartition(13), trans, seed=3, unique=False).collect()}
    assert a == b and len(a) == 4000
    assert all(p[0] == "A-A" and len(p) == 12 for p in a.values())
    for i in range(1, 12):
        share = sum(p[i] == "A-A" for p in a.values()) / 4000
        assert abs(share - 0.5) < 0.035
    unique = R.markov_paths(sims, trans, seed=3, n=500).collect()
    assert len({tuple(r["states"]) for r in unique}) == 500
    with pytest.raises(ValueError):
        R.markov_paths(sims.limit(5), trans, seed=3, n=500)
