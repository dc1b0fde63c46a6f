"""Numbers, names and limits that results depend on, stated as plain text."""

from __future__ import annotations

# The calendar of all simulations has 365 days, February always 28.
MONTH_LENGTH = {1: 31, 2: 28, 3: 31, 4: 30, 5: 31, 6: 30, 7: 31, 8: 31, 9: 30, 10: 31, 11: 30, 12: 31}
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Months with irrigation, months where a mapped restriction is 0, months whose
# transitions do not count in a story probability, months without any restriction.
IRRIGATION_MONTHS = (9, 10, 11, 12, 1, 2, 3, 4)
UNMAPPED_MONTHS = (5, 6, 7, 8)
SKIPPED_TRANSITION_MONTHS = (5, 6, 7)
NO_RESTRICTION_MONTHS = (6, 7, 8)

# First and last irrigation day of year, water take of a full scheme (m3/s), record years.
IRRIGATION_START_DOY = 244
IRRIGATION_STOP_DOY = 121
SCHEME_TAKE = 11.041
NATURALISE_FROM_YEAR = 1999
RECORD_YEARS = 48

# Restriction regimes, name -> (flow where restriction starts, flow where it is full).
REGIMES = {
    "current": (63, 41),
    "farmer_both": (53, 31),
    "farmer_tail": (63, 31),
    "farmer_front": (53, 41),
    "eco_both": (73, 51),
    "eco_tail": (63, 51),
    "eco_front": (73, 41),
}

# Class codes.
TEMP_CODES = {-1: "C", 0: "AT", 1: "H"}
PRECIP_CODES = {-1: "W", 0: "AP", 1: "D"}
PACKED_PRECIP = {"D": 0, "A": 1, "W": 2}
PACKED_TEMP = {"C": 0, "A": 1, "H": 2}
PACKED_MISSING = 65535

# Site-modes of the growth tables.
SITE_MODES = (
    ("oxford", "dryland"), ("eyrewell", "irrigated"), ("oxford", "irrigated"),
    ("eyrewell", "store400"), ("oxford", "store400"), ("eyrewell", "store600"),
    ("oxford", "store600"), ("eyrewell", "store800"), ("oxford", "store800"),
)

# Growth correction, kg per day in winter by (mode, site) and factor in other months.
WINTER_RATE = {
    ("dryland", "oxford"): {6: 5, 7: 5, 8: 10},
    ("irrigated", "eyrewell"): {6: 5, 7: 10, 8: 15},
    ("irrigated", "oxford"): {6: 5, 7: 5, 8: 10},
}
MONTH_FACTOR = {9: 1.4, 10: 1.4, 11: 1.0, 12: 0.8, 1: 0.8, 2: 0.8, 3: 0.8, 4: 1.0, 5: 1.0}

# Annual growth ranges (kg) of the most probable stories by (mode, site).
TARGET_RANGES = {
    ("dryland", "oxford"): (4, 600000),
    ("irrigated", "eyrewell"): (15000, 17000),
    ("irrigated", "oxford"): (11500, 14000),
}

# Soil moisture deficit (mm) each month starts with; 150 mm bucket.
SOIL_CAPACITY = 150.0
MONTH_START_DEFICIT = {
    1: -50.0, 2: -52.0, 3: -41.0, 4: -36.0, 5: -22.0, 6: -11.0,
    7: -7.0, 8: -8.0, 9: -14.0, 10: -30.0, 11: -41.0, 12: -49.0,
}
MONTH_START_DEFICIT_TRENDED = {
    1: -79.0, 2: -92.0, 3: -84.0, 4: -71.0, 5: -46.0, 6: -21.0,
    7: -9.0, 8: -7.0, 9: -12.0, 10: -30.0, 11: -47.0, 12: -67.0,
}

# River ecology.
MALF = 42.2007397
MAF = 991.5673849310346
FLOW_LIMIT = 50.0
TEMPERATURE_THRESHOLDS = (19, 21, 24)
SPELL_LENGTHS = (7, 14, 21, 28)
HABITAT_RANGE = (18.0, 130.0)
HABITAT_COEFFICIENTS = {
    "longfin_eel_lt_300": (-9.045618237519400e-09, 3.658952327544510e-06, 5.653574369241410e-04,
                           3.858556802202370e-02, 3.239955996233250e-01, 9.987638834796250e+01),
    "torrent_fish": (2.896163694304270e-08, 1.167620629575640e-05, 1.801041895279500e-03,
                     -1.329402534268910e-01, 5.277167341236740e+00, -1.408366189647840e+01),
    "brown_trout_adult": (4.716969949537670e-09, -2.076496120868080e-06, 3.361640291880770e-04,
                          -2.557607121249140e-02, 1.060052581008110e+00, 3.627596900757210e+00),
    "diatoms": (7.415806641571640e-11, -3.448627575182280e-08, 6.298888857172090e-06,
                -5.672527158325650e-04, 2.595917911761800e-02, -1.041530354852930e-01),
    "long_filamentous": (-2.146620894005660e-10, 8.915219136657130e-08, -1.409667339556760e-05,
                         1.057153790947640e-03, -3.874332961128240e-02, 8.884973169426100e-01),
}

# Scored statistics in order, then one weight per statistic for each weighting.
SCORED_STATISTICS = (
    "longfin_eel_lt_300_wua", "torrent_fish_wua", "brown_trout_adult_wua", "diatoms_wua", "long_filamentous_wua",
    "days_below_malf", "days_below_flow_limit", "malf_anomaly",
    "malf_events_07d", "malf_events_14d", "malf_events_21d", "malf_events_28d",
    "flow_limit_events_07d", "flow_limit_events_14d", "flow_limit_events_21d", "flow_limit_events_28d",
    "days_above_19C", "days_above_21C", "days_above_24C",
    "days_above_maf", "maf_anomaly", "maf_malf_product",
)
WEIGHTINGS = {
    "duncan_grey": (2, 3.5, 2.5, 2.5, 4.5, 4, 3.5, 4, 2.5, 3.5, 4, 4, 2.5, 2.5, 3.5, 4, 2.5, 3, 3.5, 3, 3, 3.5),
    "rich_allibone": (1.5, 3.5, 1.5, 4, 0, 2, 2, 0, 1.5, 2, 3, 3.5, 0.75, 0.75, 0.75, 1, 2.5, 3.25, 4.25, 3, 0, 0),
    "greg_burrell": (1, 1, 1, 1, -1, 4, 3.5, 4, 3.5, 3.5, 3.5, 3.5, 3.5, 3.5, 3.5, 3.5, 4, 4, 4, 4, 4, 4),
    "adrian_meredith": (3.5, 4.5, 3.5, 4, -3, 4, 4.5, 2, 4.5, 4, 4.5, 5, 4.5, 4, 4.5, 4, 3, 4, 4, 2, 3, 1.5),
    "pooled": (2, 3.125, 2.125, 2.875, 0.125, 3.5, 3.375, 2.5, 3, 3.25, 3.75, 4,
               2.8125, 2.6875, 3.0625, 3.125, 2.75, 3.5625, 3.9375, 3, 2.5, 2.25),
    "unweighted": (1,) * 22,
}
HIGHER_IS_BETTER = ("longfin_eel_lt_300_wua", "torrent_fish_wua", "brown_trout_adult_wua",
                    "diatoms_wua", "long_filamentous_wua")

# Fixed values: (min, max) of each scored statistic over the historical record, in the order above.
# The habitat areas have min above max in the published table, which flips their sign; kept as data.
BASELINE_RANGES = (
    (426, 146), (395, 71), (25, 19), (0.38, 0.28), (0.39, 0.31),
    (0, 70), (0, 108), (-18.20, 16.15),
    (0, 4), (0, 2), (0, 1), (0, 1),
    (0, 6), (0, 4), (0, 2), (0, 1),
    (0, 23), (0, 3), (0, 1),
    (0, 3), (-977.0379620689654, 431.5956442310345), (0, 180),
)

# Harvest rules.
HARVEST_STEP_DAYS = 15
RESEED_DOY = 152
IRRIGATED_TRIGGER_TARGET = (1501, 1500)
DRYLAND_TRIGGER_TARGET = (601, 600)
DRYLAND_SUMMER_TRIGGER_TARGET = (801, 800)
DRYLAND_SUMMER = (12, 1, 2, 3)
DRYLAND_WEED = {1: 0.42, 2: 0.30, 3: 0.27, 4: 0.25, 5: 0.27, 6: 0.20,
                7: 0.20, 8: 0.20, 9: 0.13, 10: 0.22, 11: 0.53, 12: 0.60}
RESEED_RULE = {("dryland", "oxford"): (0.059, 0.090), ("irrigated", "eyrewell"): (0.696, 0.727),
               ("irrigated", "oxford"): (0.678, 0.704)}
# store modes reseed at shares of their own basal cover, by (mode, site)
STORE_BASAL = {("store400", "eyrewell"): 0.7574, ("store400", "oxford"): 0.7227, ("store600", "eyrewell"): 0.7638,
               ("store600", "oxford"): 0.7289, ("store800", "eyrewell"): 0.7662, ("store800", "oxford"): 0.7329}
STORE_RESEED_SHARES = (0.935, 0.9735)
MAX_IRRIGATION = 5.0

# Restriction quantiles (%) of the random suites and their probabilities.
BAD_QUANTILES = (50, 60, 70, 80, 90, 95, 99)
GOOD_QUANTILES = (50, 40, 30, 20, 10, 5, 1)
QUANTILE_PROBABILITIES = (0.2, 0.2, 0.2, 0.2, 0.1, 0.08, 0.02)
EVENT_QUANTILES = (50, 60, 75, 80, 90, 95, 99)

# Days with rain that make a wet month (99 = never), dry thresholds and day counts.
WET_DAYS_LIMIT = {1: 99, 2: 99, 3: 99, 4: 99, 5: 14, 6: 11, 7: 11, 8: 13, 9: 13, 10: 99, 11: 99, 12: 99}
ROLLING_DRY_LIMITS = {4: 15, 5: 10, 8: 5, 9: 10}  # 10-day rain (mm) by month, other months never
ROLLING_DRY_EASED = (0, 3, 5, 7, 10)
ROLLING_DRY_LEVELS = {"zero": 0, "one": 1}  # the same limit in every month that has one
WET_RAIN_THRESHOLDS = (5, 3, 1, 0)
WET_DEFICIT_THRESHOLDS = (0, -5, -10)
MONTH_RAIN_LIMITS = {1: 31, 2: 45, 3: 38, 4: 46, 5: 37, 6: -1, 7: -1, 8: 35, 9: 30, 10: 53, 11: 43, 12: 47}  # mm; -1 is never
MONTH_RAIN_SHIFTS = {"lower_q": 0, "up_5": 5, "down_5": -5, "down_7": -7}  # in the shoulder months
SHOULDER_MONTHS = (4, 5, 8, 9)  # tested by mean temperature, the others by the maximum
SHOULDER_HOT_LIMITS = {4: 18, 5: 15, 8: 13, 9: 15}
SHOULDER_HOT_SHIFTS = {"upper_q": 0, "2_less": -2, "5_less": -5, "7_less": -7}
SHOULDER_HOT_DAYS = {"5day": 5, "7day": 7, "10day": 10, "15day": 15}
OTHER_HOT_LIMIT, OTHER_HOT_DAYS = 25, 7
HOT_THRESHOLDS = (20, 25, 28, 30, 35)
COLD_THRESHOLDS = (0, 5, 7, 10, 12)
DRY_ANOMALIES = (-5, -10, -12, -15, -17, -20)
REST_THRESHOLDS = {"half": 0.5, "3/4": 0.75, "full": 1.0}
