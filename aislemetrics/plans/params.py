"""Parameters of the registered queries, used by the plans and by their SQL alike."""

from __future__ import annotations

CLASS = "prod_hier_l20_code"
SUBCLASS = "prod_hier_l10_code"
DIVISIONS = ("01",)

SLICE_WEEKS = (199701, 199713)
SLICE_FORMATS = ("1", "2", "3")
PROMO_TYPE = "PROMO"
WEEKEND = (6, 7)
SHIFT = 4

OVERLAP_GROUPS = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5")
OVERLAP_WEEKS = (199701, 199752)
CONTROL_DAYS = ("1997-11-28", "1997-11-29")
CONTROL_CLASSES = ("ECONOMY", "LARGE", "MEDIUM")
CONTROL_NAMES = ("economy in 1", "large in 2 on day 1", "medium on day 2")
KPI_GROUPS = ("Brand#1", "Brand#2", "Brand#3")
KPI_FORMATS = ("1", "2", "3")
KPI_DAYS = (5, 6)
PERIODS = {"TY": (199701, 199752), "LY": (199601, 199652)}

STYLES = (1, 25)
REACH_STEPS = 60
TOP_K = 6

PRICE_SEGMENTS = ("LA", "MM")
PRICE_CLASS = "ECONOMY"
PRICE_WEEKS = (199810, 199935)
PRICE_STEP = 0.01
# Money units that a price of the curve counts in.
CURVE_PRICE_UNIT = 1000.0

SEASON_WEEKS = (199640, 199739)
SHORT_SEASON = {"start_week": 199720, "end_week": 199730, "data_week_end": 199852}

CYCLE_BRAND = "Brand#1"

N_COMPONENTS = 4
N_FACTORS = 5
MEMBER_FACTOR = 1
N_CLUSTERS = 5
# Brand number at which the next start cluster begins.
CLUSTER_STARTS = (1, 10, 18)

# Files of a table dealt by card.
BUCKETS = 8
# A calendar whose weeks begin on Sunday: its first day, and the week of the snapshot.
OWN_WEEKS_FROM = "1969-12-28"
OWN_SNAPSHOT_WEEK = 1637
# Saturday and Sunday in a date table that counts the days of a week from Sunday.
OWN_WEEKEND = (1, 7)
