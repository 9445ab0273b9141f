"""Vocabularies, weights, thresholds and prices that results must agree with."""

from __future__ import annotations

import datetime as dt

#: The day that stands for today wherever a result would depend on it.
AS_OF = dt.date(2001, 12, 1)

# Damage classes by id, and their sets.
CLASSES = (
    "longitudinal_crack", "transverse_crack", "alligator_crack", "repaired_crack", "pothole",
    "pedestrian_crossing_blur", "lane_line_blur", "manhole_cover", "patchy_road", "rutting",
)
MARKINGS = ("lane_line_blur", "pedestrian_crossing_blur")
DEFAULT_THRESHOLD = 0.35
THRESHOLDS = {"lane_line_blur": 0.50}

# Weights of depth, area, contrast and sharpness, and of the class.
SIGNAL_WEIGHTS = {
    "pothole": (0.35, 0.25, 0.30, 0.10),
    "alligator_crack": (0.25, 0.40, 0.20, 0.15),
    "longitudinal_crack": (0.30, 0.25, 0.15, 0.30),
    "transverse_crack": (0.30, 0.20, 0.15, 0.35),
    "repaired_crack": (0.20, 0.30, 0.10, 0.40),
    "patchy_road": (0.25, 0.40, 0.15, 0.20),
    "rutting": (0.40, 0.25, 0.10, 0.25),
    "manhole_cover": (0.30, 0.20, 0.25, 0.25),
    "pedestrian_crossing_blur": (0.10, 0.50, 0.30, 0.10),
    "lane_line_blur": (0.10, 0.50, 0.30, 0.10),
}
CLASS_WEIGHTS = {
    "pothole": 0.50, "alligator_crack": 0.45, "rutting": 0.40, "transverse_crack": 0.35, "longitudinal_crack": 0.30,
    "patchy_road": 0.25, "manhole_cover": 0.20, "repaired_crack": 0.15, "pedestrian_crossing_blur": 0.10, "lane_line_blur": 0.10,
}
SIGNAL_DENOMS = {"area": 1000.0, "contrast": 2.0, "sharpness": 60.0}

# Severity levels from their lower bounds, and what to do.
LEVELS = ((0.75, "S5", "Emergency closure"), (0.55, "S4", "Urgent repair"), (0.35, "S3", "Priority repair"), (0.15, "S2", "Schedule maintenance"), (0.0, "S1", "Monitor"))
PRIORITY_WEIGHTS = {1: 0.10, 2: 0.25, 3: 0.50, 4: 0.75, 5: 1.00}

# Repair prices by class and factors by severity.
REPAIR_COST = {
    "pothole": 950, "alligator_crack": 1400, "longitudinal_crack": 420, "transverse_crack": 420, "patchy_road": 1800,
    "rutting": 2200, "repaired_crack": 120, "manhole_cover": 600, "lane_line_blur": 260, "pedestrian_crossing_blur": 340,
}
OTHER_COST = 700
COST_FACTOR = {1: 0.5, 2: 0.8, 3: 1.0, 4: 1.45, 5: 2.1}

# The road quality index.
QUALITY_WEIGHTS = {1: 1.0, 2: 2.0, 3: 4.0, 4: 7.0, 5: 11.0}
FADE_DAYS = 180.0
FIXED_SHARE = 0.2
PENALTY_SCALE = 8.0
QUALITY_BANDS = (("A", 85), ("B", 70), ("C", 50), ("D", 30))
LANDING_BANDS = (("A", 85), ("B", 70), ("C", 55), ("D", 40))
METRES_PER_DEGREE = 111_320.0
EARTH_M = 6_371_000.0

ORDER_STATUSES = ("open", "scheduled", "in_progress", "repaired", "verified", "cancelled")
# Points by reason, and badges by their condition on the counters.
POINTS = {"event_confirmed": 10, "event_verified": 15, "event_fixed": 25, "event_promoted": 20}
BADGES = (
    ("first_report", "reports_total >= 1"), ("confirmed_10", "confirmed_total >= 10"), ("confirmed_50", "confirmed_total >= 50"),
    ("verified_first", "verified_total >= 1"), ("streak_7", "current_streak_days >= 7"), ("fixed_1", "fixed_total >= 1"), ("fixed_5", "fixed_total >= 5"),
)
